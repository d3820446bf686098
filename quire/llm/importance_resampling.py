"""Target-distribution importance resampling with hashed n-gram features (operator 12).

A streaming CRC ring reads each document once: it keeps the running zlib state of the last n starts, extends each of
them by a blank and the next word, and emits every state's bucket, so that no run of words is ever built. Buckets are counted
over the corpus and over the target texts; a bucket's gain is the log ratio of its two smoothed shares; a document's
weight is the mean gain of its features, its score the weight with a Gumbel number seeded by its id. Drawing the highest
scores draws without replacement in proportion to the weights.

Each task counts its documents into one array of buckets, so at most n_buckets rows a task are shuffled, and n_buckets numbers
reach the driver. Ranks come from a range sort over all tasks of the documents that a histogram of the scores leaves in
question, with offsets per range: no task holds a rank's whole order.

Defined results: a null text and one without words has no feature and weight 0; a null doc_id is hashed as the word null
and comes after all others on ties; rows that repeat a doc_id are documents of their own with the same Gumbel number, equal rows
take ranks in any order; texts of any length are read whole; an empty table, or an empty target, gives smoothed gains of the
other alone; other columns of any name are kept unchanged, and those named as a result are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import LOWER, plainly_named, record, small_batches, stored

#: A word is a run of ASCII letters and digits and of all other bytes over 0x7F.
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
RUN = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Features held at a time, and bytes of a text whose words are listed at once.
AT_A_TIME = 1 << 17
_LOWER = bytes(LOWER)


def ring_buckets(words: Iterable[bytes], run: int, n_buckets: int) -> Iterator[np.ndarray]:
    """The buckets of all runs of 1 to run words, in the order of the runs' ends, some at a time."""
    crc32, out = zlib.crc32, []
    ring: list[int] = []  # states of the last starts, the oldest first
    for word in words:
        more = b" " + word
        ring = [crc32(more, state) for state in ring[1 - run :]] if run > 1 else []
        ring.append(crc32(word))
        out += ring
        if len(out) >= AT_A_TIME:
            yield np.array(out, dtype=np.int64) % n_buckets
            out = []
    if out:
        yield np.array(out, dtype=np.int64) % n_buckets


def words_of(text: str | None) -> Iterable[bytes]:
    data = (text or "").encode().translate(_LOWER)
    return WORDS.findall(data) if len(data) < AT_A_TIME else (m.group() for m in WORDS.finditer(data))


def n_words(n_features: int, run: int) -> int:
    """Of a text with so many features: below run words each word ends one more of them than the word before."""
    few = 0
    while few < run and few * (few + 1) // 2 < n_features:
        few += 1
    return few if few < run else few + (n_features - run * (run + 1) // 2) // run


def bucket_counts(texts: DataFrame, run: int = RUN, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the column text; a task emits its buckets once."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for found in ring_buckets(words_of(text.as_py()), run, n_buckets):
                    total += np.bincount(found, minlength=n_buckets)
        held = np.flatnonzero(total)
        yield record(["bucket", "n"], [held.astype(np.int32), total[held]])

    found = texts.select("text").mapInArrow(count, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, source: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets from two tables of bucket counts."""
    per = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    for counts, name in ((source, "s"), (target, "t")):
        per = per.join(counts.select("bucket", F.col("n").alias(name)), "bucket", "left")
    per = per.fillna(0, ["s", "t"])
    total = per.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, more: (F.col(c) + F.lit(more)).cast("double")
    ratio = d("t", 1) * d("all_s", n_buckets) / (d("s", 1) * d("all_t", n_buckets))
    return per.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row of totals


def weighted(docs: DataFrame, gain: list[int], run: int = RUN, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (all of them unless given) with n_features, n_words and weight, named so behind _w_."""
    names = keep if keep is not None else docs.columns
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(f"_w_{n}", T.LongType()) for n in ("n_features", "n_words", "weight")]])
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, dtype=np.int64))
    n_buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), dtype=np.int64)
            for i, text in enumerate(batch.column("text")):
                n = total = 0
                for found in ring_buckets(words_of(text.as_py()), run, n_buckets):
                    n, total = n + len(found), total + int(gains[found].sum())
                out[:, i] = n, n_words(n, run), total // max(1, n)
            yield record([f.name for f in schema.fields], [*[batch.column(c) for c in names], *out])

    return docs.mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) from the first 32 bits of the sha256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """rows with _rank, from 1 in order, null over most. Rows are sorted in ranges over all tasks; equal ones needn't meet."""
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    sort = [*order, F.col("_tie")]
    placed = stored(placed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_i", F.monotonically_increasing_id()))
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    ahead = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_a"))  # a row for each range
    rank = F.col("_a") + place + 1
    return placed.withColumn("_p", part).join(F.broadcast(ahead), "_p").withColumn("_rank", F.when(rank <= most, rank)).drop("_p", "_a", "_i", "_tie")


def resampled(docs: DataFrame, target: DataFrame, run: int = RUN, n_buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (doc_id among them; all unless given) with n_features, weight, score and rank (null where not drawn);
    target has the column text. Texts that aren't kept are not written between the steps."""
    spark = docs.sparkSession
    table = gains(spark, bucket_counts(docs, run, n_buckets), bucket_counts(target, run, n_buckets), n_buckets)
    gain = [0] * n_buckets
    for bucket, value in table.collect():  # as many as there are buckets
        gain[bucket] = value
    new = ("n_features", "weight", "score", "rank")
    names = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    plain, inner = plainly_named(docs, [*names, *["text"][: "text" not in names]])
    inner = inner[: len(names)]
    id_name = inner[names.index("doc_id")]
    rows = weighted(plain, gain, run, inner)
    rows = stored(rows.withColumn("_score", F.col("_w_weight") + gumbel(F.col(id_name), seed)))
    eligible = F.col("_w_n_words") >= least_words
    # scores lie within some ten thousand whole numbers, whatever the corpus
    histogram = sorted(rows.where(eligible).groupBy("_score").agg(F.count("*")).collect(), reverse=True)
    most = percent * sum(n for _, n in histogram) // 100
    above, bar = 0, None
    for score, n in histogram:
        if above >= most:
            break
        above, bar = above + n, score
    open_ = eligible & (F.col("_score") >= bar) if bar is not None else F.lit(False)
    drawn = ranked(rows.where(open_), [F.col("_score").desc(), F.col(id_name).asc_nulls_last()], most)
    rest = rows.where(~open_).withColumn("_rank", F.lit(None).cast("long"))
    out = drawn.unionByName(rest)
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, names, strict=True)], F.col("_w_n_features").alias("n_features"), F.col("_w_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").cast("long").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resampled(docs, target, keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE crc AS (  -- the table of the checksum's remainders of all bytes
  SELECT CAST(i AS BIGINT) AS i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
remainders AS (SELECT list(v ORDER BY i) AS r FROM crc WHERE k = 8),
source AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT kind, row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM source),
runs AS (
  SELECT kind, row, unnest(list_concat(w, list_transform(w[2:], lambda x, i: w[i] || ' ' || x))) AS feature FROM words),
counted AS (SELECT kind, row, feature, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT feature, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || h[2 * i - 1 : 2 * i] AS BIGINT)), lambda state, byte: xor(state >> 8, r[(xor(state, byte) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM counted GROUP BY feature), remainders),
per AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::BIGINT AS t
  FROM (SELECT range::BIGINT AS bucket FROM range(10000)) b LEFT JOIN (SELECT kind, bucket, n FROM counted JOIN hashed USING (feature)) c ON c.bucket = b.bucket GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM per),
weights AS (
  SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, row, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN weights USING (row) WHERE kind = 'd'),
drawn AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM drawn)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
