"""Flags over the three readings of a snippet, the texts chosen from them and prompt hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.diff import compressed_share, similarity

ENGINES = ("easyocr", "tesseract", "surya")


def flags(readings: DataFrame, script: tuple[int, int] = T.SCRIPT) -> DataFrame:
    """readings (three reading structs) with disagreement, majority_agreement, low_confidence, surya_suspect, sim_*.

    A reading is of low confidence if its mean is, or, where the struct has word_confidences, if any word is.
    Rows that lack an engine get null flags: they are never flagged. Three empty readings agree."""
    texts = [F.col(f"{e}.text") for e in ENGINES]
    full = F.lit(True)
    for e in ENGINES:
        full &= F.col(e).isNotNull()
    distinct = F.col("_distinct")  # a column of its own, so that texts are normalised once
    low = F.lit(False)
    for e in ENGINES:
        low |= F.coalesce(F.col(f"{e}.avg_confidence") < T.LOW_CONFIDENCE, F.lit(False))
        if "word_confidences" in readings.schema[e].dataType.names:
            low |= F.coalesce(F.exists(F.col(f"{e}.word_confidences"), lambda c: c < T.LOW_CONFIDENCE), F.lit(False))
    only = lambda c: F.when(full, c)
    # only texts whose compressed size decides are compressed
    n = F.length(texts[2])
    ratio = compressed_share(F.when(full & (n > T.LEAST_RATIO_CHARS) & (n <= T.MOST_CHARS), texts[2]))
    out = readings.withColumn("_distinct", only(F.size(F.array_distinct(F.transform(F.array_distinct(F.array(*texts)), T.normalised))))).withColumns({
        "disagreement": only(distinct > 1), "majority_agreement": only(distinct < 3), "low_confidence": only(low),
        "surya_suspect": only(T.suspect(texts[2], ratio, script)),
    })
    pairs = [(a, b) for i, a in enumerate(ENGINES) for b in ENGINES[i + 1 :]]
    return out.drop("_distinct").withColumns({f"sim_{a}_{b}": only(similarity(F.col(f"{a}.text"), F.col(f"{b}.text"))) for a, b in pairs})


def present_text(refined: Column) -> Column:
    """The refined text if it isn't empty, else the text of the first engine that ran, even an empty one."""
    chain = F.when(F.col("easyocr").isNotNull(), F.col("easyocr.text")).when(F.col("tesseract").isNotNull(), F.col("tesseract.text")).when(F.col("surya").isNotNull(), F.col("surya.text"))
    return F.coalesce(F.nullif(refined, F.lit("")), chain, F.lit(""))


def seed_text(refined: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(T.truthy(refined, *[F.col(f"{e}.text") for e in ENGINES]), F.lit(""))


def fallback_text(majority: Column) -> Column:
    """With a majority the first reading that a later one equals in its words, as it was read; else the first that isn't empty."""
    e, t, s = (F.coalesce(F.col(f"{x}.text"), F.lit("")) for x in ENGINES)
    same = lambda a, b: (a == b) | (T.normalised(a) == T.normalised(b))
    agreed = F.when(same(e, t) | same(e, s), e).when(same(t, s), t)
    return F.coalesce(F.when(majority, agreed), T.truthy(e, t, s))


#: Lines of a hint; callers may bring their own.
LINES = {
    "agree": "Two or more of the readings are the same.",
    "words": "Words that two or more readings share: ",
    "marks": "Marks in the readings: ",
    "doubt": "The third reading may be damaged.",
}


def hint(majority: Column, suspect: Column, lines: dict[str, str] = LINES) -> Column:
    """Lines that tell what the readings agree on, each only where it applies."""
    texts = [F.col(f"{e}.text") for e in ENGINES]
    common = T.consensus(*texts)
    some = lambda c: F.nullif(c, F.lit(""))
    marks = F.concat_ws(", ", *[F.concat(T.mark_floor(m, *texts).cast("string"), F.lit(f" x {m} or more")) for m in T.DANDAS])
    # every part stands once in the expression, else it would be computed once more; an empty line at each end makes the line feeds there
    told = [F.when(majority, lines["agree"]), F.concat(F.lit(lines["words"]), some(F.array_join(common, ", "))), F.concat(F.lit(lines["marks"]), some(marks)), F.when(suspect, lines["doubt"])]
    return F.concat_ws("\n", F.lit(""), *told, F.lit(""))


def report(flagged: DataFrame) -> DataFrame:
    """Totals of rows with all three engines: how many, how many flagged, how many where two agree."""
    full = F.col("disagreement").isNotNull()
    return flagged.agg(F.count_if(full).alias("n"), F.count_if(full & (F.col("disagreement") | F.col("low_confidence") | F.col("surya_suspect"))).alias("flagged"), F.count_if(full & F.col("majority_agreement")).alias("agreeing"))
