"""N-gram Jaccard self-join by vertical partitioning (operator 10).

1. Documents become sets of distinct word 5-gram hashes; equal texts are one set. shards.py counts in how many texts each
   n-gram occurs. The global n-gram order runs from rare to frequent: a token is a count's level and the hash in one
   number, so a sorted set is in the global order. A set with over a quarter of n-grams of its own has no partner and takes
   no further part.
2. By the prefix filter, linked sets share one of their first n - ceil(3n/4) + 1 n-grams. In every list of sets with such
   an n-gram (and similar sizes) all are paired with the list's most central set, a number of pairs in proportion to the
   lists. Sets of a list that are then still in different components are all paired with each other, but for pairs
   whose prefixes (as bitmaps) can't hold enough common n-grams, so none is lost; no candidate is capped.
3. Vertical partitioning: the global order is cut into fragments at pivots (quantiles of the sets' tokens), each set is cut
   into a segment per fragment, pairs' overlaps are counted fragment by fragment, each in tasks of its own, and summed
   per pair; the sum decides exactly. A set that heads very many pairs is split over tasks by its fragments, and adaptive
   execution splits what is left of it.

Hashes: texts are equal where two 64-bit hashes are, sets are named by the first one, n-grams are told apart by 56 bits.

Defined results: null, empty or blank texts have no n-grams, link with nothing and are a component of their own; with
fewer than five words the whole sequence is the one n-gram; rows that repeat a doc_id with equal words are one set;
a null doc_id is never the smallest unless all of its component are null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import U64, WORD_REGEX, Block, blocks, components, cut, inside, mix, record, sequence_hashes, signed, small_batches, stored, text_hashes
from quire.llm.shards import CHUNK_WORDS, STEPS, Counts, chosen_rows, keyed_rows

WORDS = 5
#: The similarity, as parts of the union: 3 of 4.
PART, OF = 3, 4
FRAGMENTS = 4
#: Words of 64 bits in the bitmap of a prefix.
BITMAP = 8


def shingle_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, sorted in it, and where each text's begin."""
    words = block.word_hashes()
    grams, ok = sequence_hashes(words, n), inside(block.first, n)
    sets, sizes = [], np.zeros(len(block.first), dtype=np.int64)
    for i, (b, e) in enumerate(zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True)):
        if e - b >= n:
            own = np.unique(grams[b : e - n + 1])
        elif e > b:
            own = mix(sequence_hashes(words[b:e], e - b) ^ U64(e - b))
        else:
            continue
        sets.append(own)
        sizes[i + 1] = len(own)
    assert ok.sum() == np.maximum(block.n_words - n + 1, 0).sum()
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.cumsum(sizes)


def signatures(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, *extra, n_words, f1, f2): each row's number of words and the fingerprint of their sequence."""
    small_batches(docs.sparkSession)
    fields = [docs.schema[c] for c in ("doc_id", *extra)]
    names = [f"_s{i}" for i in range(len(fields))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, lower=True):
            f1, f2 = text_hashes(block)
            yield record([*names, "n_words", "f1", "f2"], [*(part.column(c) for c in names), block.n_words, signed(f1), signed(f2)])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, fields, strict=True)) + ", n_words long, f1 long, f2 long"
    rows = docs.select(*[F.col(f.name).alias(c) for c, f in zip(names, fields, strict=True)], "text").mapInArrow(sign, schema)
    return rows.toDF(*[f.name for f in fields], "n_words", "f1", "f2")


def sets_of(docs: DataFrame, words: int, n: int, chunk_words: int) -> DataFrame:
    """(cid, n, centre, toks) of every distinct text with words: its size, and its n-grams that others have too in the
    global order, null if they are too few for a partner. centre is high where a set's n-grams are widely shared and few are its own: the
    text that a group's copies come from."""

    def listed(texts: pa.Table, size: np.ndarray, grams: np.ndarray, level: np.ndarray) -> pa.Table:
        ends = np.cumsum(size)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
        n_again, weight = total(level > 0), total(level.astype(np.float64))
        alone = OF * n_again < PART * size
        row = np.repeat(np.arange(len(size)), size)
        hold = np.flatnonzero((level > 0) & ~alone[row])
        toks = (level[hold].astype(U64) << U64(56)) | (grams[hold] >> U64(8))
        toks = toks[np.lexsort((toks, row[hold]))]
        offsets = np.concatenate([[0], np.cumsum(np.where(alone, 0, n_again))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(toks)), mask=pa.array(alone))
        return pa.table({"cid": texts.column("f1"), "n": pa.array(size.astype(np.int64)), "centre": pa.array(weight * np.log(2) / STEPS / size), "toks": lists})

    counts = Counts(docs, words, lambda block: shingle_sets(block, n), lower=True, chunk_words=chunk_words)
    return counts.answered(listed, "cid long, n long, centre double, toks array<long>")


def prefix_length() -> F.Column:
    """How many of a set's ordered n-grams are in its prefix (n-grams of one set only come first and aren't listed)."""
    return F.size("toks") - F.ceil(PART * F.col("n") / OF).cast("int") + 1


def postings(sets: DataFrame) -> DataFrame:
    """(tok, size_class, cid, n, centre, pos) for each n-gram of each set's prefix; linked sets' size classes differ by at most 1."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(OF / PART)) + 1e-9).cast("int")
    rows = sets.select("cid", "n", "centre", size_class.alias("size_class"), (F.col("n") - F.size("toks")).alias("rare"), F.posexplode(F.slice("toks", F.lit(1), prefix_length())).alias("at", "tok"))
    return rows.select("tok", "size_class", "cid", "n", "centre", (F.col("rare") + F.col("at")).alias("pos"))


def may_link(a: str, b: str) -> F.Column:
    """Length and position filters: what both sets have left after the shared n-gram must do for the similarity."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = 1 + F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) - 1
    return (OF * F.least(na, nb) >= PART * F.greatest(na, nb)) & ((PART + OF) * left >= PART * (na + nb))


def prefix_bits() -> list[F.Column]:
    """A set's prefix as a bitmap of BITMAP words of 64 bits: a bit for each n-gram, set by its hash."""
    words = []
    for k in range(BITMAP):
        one = f"aggregate(filter(prefix, t -> pmod(t, {BITMAP}) = {k}), 0L, (s, t) -> s | shiftleft(1L, CAST(pmod(shiftright(t, {BITMAP.bit_length() - 1}), 64) AS INT)))"
        words.append(F.expr(one).alias(f"w{k}"))
    return words


def prefixes_allow() -> F.Column:
    """Whether a and b can link by their prefixes.

    What they share up to the end of the prefix that ends first is in both prefixes; behind it the set of that prefix has
    ceil(3n/4) - 1 n-grams left. Each bit that only one bitmap has is an n-gram at least that isn't shared."""
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}.w{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.w{k}")))) for k in range(BITMAP)), F.lit(0))
    both = F.least(F.col("a.size") - only("a", "b"), F.col("b.size") - only("b", "a"))
    left = F.greatest(*[F.ceil(PART * F.col(f"{x}.n") / OF) - 1 for x in "ab"])
    return (PART + OF) * (both + left) >= PART * (F.col("a.n") + F.col("b.n"))


def segments(sets: DataFrame, fragments: int) -> DataFrame:
    """(cid, part, seg): each set's n-grams in each fragment of the global order; pivots are quantiles of four n-grams of each set."""
    at = [F.element_at("toks", F.ceil(F.size("toks") * F.lit((2 * i + 1) / 8)).cast("int")) for i in range(4)]
    shares = [i / fragments for i in range(1, fragments)]
    bounds = [None, *(sets.where(F.size("toks") > 0).select(F.explode(F.array(*at)).alias("t")).agg(F.percentile_approx("t", shares, 1000)).first()[0] or []), None]

    def segment(low: int | None, high: int | None) -> F.Column:
        return F.filter("toks", lambda t: (F.lit(True) if low is None else t >= low) & (F.lit(True) if high is None else t < high))

    parts = F.array(*[segment(low, high) for low, high in zip(bounds[:-1], bounds[1:], strict=True)])
    return sets.select("cid", F.posexplode(parts).alias("part", "seg")).where(F.size("seg") > 0)


def verified(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """pairs (a, n_a, b, n_b) whose overlaps, summed over the fragments, reach the similarity, as links (a, b)."""
    heads = segs.join(pairs.select(F.col("b").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("b"), "part", F.col("seg").alias("seg_b"))
    members = pairs.join(segs.select(F.col("cid").alias("a"), "part", F.col("seg").alias("seg_a")), "a")
    partial = members.join(heads, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("seg_a", "seg_b")).cast("long").alias("o"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("o").alias("o"))
    return total.where((PART + OF) * F.col("o") >= PART * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def paired(joined: DataFrame) -> DataFrame:
    """Distinct pairs (a, n_a, b, n_b) of a join of lists with themselves."""
    return joined.select(F.col("a.cid").alias("a"), F.col("a.n").alias("n_a"), F.col("b.cid").alias("b"), F.col("b.n").alias("n_b")).distinct()


def links(sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """(node, root) over linked sets: components of the exact link graph of sets (cid, n, centre, toks)."""
    lists, segs = postings(sets), segments(sets, fragments)
    near = F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)).alias("size_class")
    same = (F.col("a.tok") == F.col("b.tok")) & (F.col("a.size_class") == F.col("b.size_class"))
    # every list's sets are paired with its most central one
    heads = lists.groupBy("tok", "size_class").agg(F.min_by(F.struct("cid", "n", "pos"), F.struct(-F.col("centre"), "cid")).alias("h")).select("tok", "size_class", "h.*")
    rows = lists.select("tok", near, "cid", "n", "pos").alias("a")
    pairs = cut(paired(rows.join(heads.alias("b"), same & (F.col("a.cid") != F.col("b.cid")) & may_link("a", "b"))))
    stars = cut(verified(pairs, segs))
    roots = components(stars)
    # the rest: every pair of sets of one list and different components whose prefixes allow a link
    named = lists.drop("centre").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = named.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    prefix = sets.select("cid", F.slice("toks", F.lit(1), prefix_length()).alias("prefix"))
    bits = prefix.select("cid", F.size("prefix").alias("size"), *prefix_bits())
    rest = stored(named.join(mixed, "tok", "left_semi")).join(bits, "cid")
    a, b = rest.withColumn("size_class", near).alias("a"), rest.alias("b")
    smaller = F.struct("a.n", "a.cid") < F.struct("b.n", "b.cid")
    joined = a.join(b, same & (F.col("a.root") != F.col("b.root")) & smaller & may_link("a", "b") & prefixes_allow())
    tried = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = cut(verified(paired(joined).join(tried, ["a", "b"], "left_anti"), segs))
    return roots if more.isEmpty() else components(stars.unionByName(more))


def classes(signs: DataFrame, docs: DataFrame, n: int, fragments: int, chunk_words: int) -> DataFrame:
    """(cid, n, root) of every distinct text with words."""
    words = signs.agg(F.sum("n_words")).first()[0] or 0
    sets = stored(sets_of(docs, words, n, chunk_words))
    roots = links(sets.where("toks IS NOT NULL"), fragments)
    return sets.select("cid", "n").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", F.coalesce("root", "cid").alias("root"))


def least_keys(signs: DataFrame, found: DataFrame, key: F.Column) -> DataFrame:
    """(cid, n, least): the least key of a row of signs in each text's component."""
    own = signs.where("n_words > 0").groupBy(F.col("f1").alias("cid")).agg(F.min(key).alias("least"))
    each = found.join(own, "cid")
    return each.drop("least").join(each.groupBy("root").agg(F.min("least").alias("least")), "root").select("cid", "n", "least")


def grouped(docs: DataFrame, n: int = WORDS, fragments: int = FRAGMENTS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    signs = stored(signatures(docs))
    least = least_keys(signs, classes(signs, docs, n, fragments, chunk_words), F.col("doc_id"))
    rows = signs.select("doc_id", F.col("f1").alias("cid"), "n_words").join(least, "cid", "left")
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("n_words") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def without_duplicates(docs: DataFrame, n: int = WORDS, fragments: int = FRAGMENTS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, a null one last; of several such rows that of the
    smaller hash over all columns, and of rows equal in all columns one. Rows without words stay."""
    signs = stored(signatures(keyed_rows(docs), "_quire_r1", "_quire_r2"))
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "_quire_r1", "_quire_r2")
    found = classes(signs, docs, n, fragments, chunk_words)
    best = least_keys(signs, found, key).select(F.col("least._quire_r1").alias("_quire_r1"), F.col("least._quire_r2").alias("_quire_r2")).distinct()
    words = signs.agg(F.sum("n_words")).first()[0] or 0
    has_word = F.coalesce(F.col("text").rlike(WORD_REGEX), F.lit(False))
    return chosen_rows(docs.where(has_word), best, max(1, -(-words // chunk_words))).union(docs.where(~has_word))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
