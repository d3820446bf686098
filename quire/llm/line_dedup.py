"""Line dedup (operator 11), in DataFrame functions only.

Documents are exploded to lines, a line's key (stripped of blanks, A-Z lower-cased) is hashed twice to 64 bits, and the
documents that hold each hash are counted. A key of enough characters in enough documents loses its lines in all of them
but the one with the largest doc_id. Only hashes and places travel; a text travels once, to meet the places that it loses.

Counting is an aggregation that combines in every task, so a line of a third of all documents reaches its group once a
task and document. What is repeated goes back to the lines in two ways: keys of at least 1/65536 of all repeated lines,
of which there can be 65536 at most, by broadcast; all others, none of which can fill a task, by a shuffled join. Documents
that repeat in id and text many times are dealt over salts, which only they have.

Defined results: a null or empty text is one empty line; lines are parted by U+000A alone, so U+000D is a blank of the
line before it; rows without doc_id are one document, smaller than all others; rows that repeat a doc_id are one document
when documents are counted, and every row is returned with its own lines; a key's lines stay in all rows of its largest
doc_id; texts of any length are read whole, in time that grows with their lines; an empty table gives an empty result; other
columns of any name and type are kept unchanged, and those named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import hot_bound, quoted, stored

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 64


def key_of(line: Column) -> Column:
    """The line stripped and with A-Z lower-cased; most lines need neither function that reads them character by character."""
    blank = lambda c: c.isin(*BLANKS)
    bare = F.when(blank(F.substring(line, 1, 1)) | blank(F.substring(line, -1, 1)), F.btrim(line, F.lit(BLANKS))).otherwise(line)
    return F.when(F.octet_length(line) == F.length(line), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(id, t1, t2, pos, h1, h2) of lines whose key is long enough; t1 and t2 are hashes of the whole text."""
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(0x51ED), "text").alias("t2"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = rows.withColumn("key", key_of(F.col("line"))).where(F.length("key") >= least_chars)
    return keys.select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x9E37), "key").alias("h2"))


def repeated_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """(h1, h2, last, n_rows) of keys in enough documents: the largest id that holds the key, and its lines in all."""
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    return lines.groupBy("h1", "h2").agg(n.alias("n"), F.max("id").alias("last"), F.count("*").alias("n_rows")).where(F.col("n") >= least_documents).drop("n")


def lost_places(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, t1, t2, gone, n_rows): places that a text of this id loses, in order, and how many rows have that text."""
    bound = hot_bound(repeated)
    hot = F.broadcast(repeated.where(F.col("n_rows") >= bound).drop("n_rows"))
    cold = repeated.where(F.col("n_rows") < bound).drop("n_rows")
    found = [lines.join(hot, ["h1", "h2"]), lines.join(hot, ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])]
    lost = [f.where(~F.col("id").eqNullSafe(F.col("last"))).select("id", "t1", "t2", "pos") for f in found]
    return lost[0].unionByName(lost[1]).groupBy("id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.count("*").alias("n")).select("id", "t1", "t2", "gone", (F.col("n") / F.size("gone")).cast("long").alias("n_rows"))


def without(lines: Column, gone: Column) -> Column:
    """lines without those at the places gone (sorted), as slices between these, in time that grows with both. The array
    of one struct gives both a name within the expression, else they would be computed again for every slice."""

    def kept(s: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(s["gone"], lambda p: p + 1))
        ends = F.concat(s["gone"], F.array(F.size(s["lines"])))
        return F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(s["lines"], b + 1, e - b)))

    return F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), kept), 1)


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; see the module's text."""
    lines = stored(keyed_lines(docs, least_chars))  # read three times, and far smaller than the texts
    places = stored(lost_places(lines, stored(repeated_keys(lines, least_documents))))
    new = ("n_lines", "n_dropped", "kept_text")
    names = [c for c in docs.columns if c not in new]
    own = docs.select(*[F.col(quoted(c)).alias(f"_d{i}") for i, c in enumerate(names)], F.col("text").alias("text"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(0x51ED), "text").alias("t2"))
    # documents that many rows repeat are dealt over salts; there can be MOST_HOT at most
    same = ["id", "t1", "t2"]
    hot = places.where(F.col("n_rows") >= hot_bound(places)).select(*[F.col(c).alias(f"_{c}") for c in same], F.lit(True).alias("hot"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    own = own.join(F.broadcast(hot), on, "left").drop("_id", "_t1", "_t2")
    own = own.withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lost = places.join(F.broadcast(hot), on, "left").select(*[F.col(c).alias(f"_{c}") for c in same], "gone", F.explode(salts).alias("_salt"))
    joined = own.join(lost, [*on, F.col("salt") == F.col("_salt")], "left")
    text = F.coalesce("text", F.lit(""))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(without(split_lines(F.col("text")), F.col("gone")), "\n"))
    n_lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return joined.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)], n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, row, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'none')) >= 3),
judged AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id IS DISTINCT FROM r.last AS gone FROM lines l LEFT JOIN repeated r ON r.key = l.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row
"""
