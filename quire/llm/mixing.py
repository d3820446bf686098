"""Mixing sources to target weights (operator 2), in DataFrame functions only.

Tokens are summed per source, capped targets found by water filling, and each document is taken
floor(rate) times plus once more if a hash of its id falls below the rate's fraction.

Defined results: a null text has size 0 and is taken like any other; a null source is one source of its own, last in
order; a null doc_id is hashed as the word null and the text; rows that repeat a doc_id get the same decision; an empty table gives
an empty result; a source without words has target 0 and rate 0. Other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import WORD_REGEX, cut, quoted

#: Sources whose targets are at most so many rows are joined by broadcast; more by a shuffled join.
BROADCAST_SOURCES = 20_000


def size_of(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of sized (source, size): weights repeat over the sources in code point order.

    All targets share the total by weight; one that would exceed most times its source's size stops there and
    the excess goes to the rest by weight. Sorted by size over weight, the stopped sources are a prefix, found
    with running sums of whole numbers. These windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights)) + 1).cast("long"))
    by = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    per = per.select(
        "*",
        (F.sum("source_size").over(by) - F.col("source_size")).alias("before"),
        (F.sum("w").over(everything) - F.sum("w").over(by) + F.col("w")).alias("w_left"),
        F.sum("source_size").over(everything).alias("total"),
    )
    stops = most * F.col("source_size") * F.col("w_left") < (F.col("total") - most * F.col("before")) * F.col("w")
    per = per.withColumn("stops", stops)
    per = per.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size"))).over(everything), F.lit(0)).alias("stopped"),
        F.sum(F.when(~F.col("stops"), F.col("w"))).over(everything).alias("open_w"),
    )
    share = (F.col("total") - most * F.col("stopped")).cast("double") * F.col("w") / F.col("open_w")
    return per.select("source", "source_size", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def draw(doc_id: F.Column, text: F.Column, seed: int) -> F.Column:
    """A number in [0, 1) from the first 52 bits of the md5 of seed and id; rows without id draw by their text."""
    name = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row, with its columns in keep as _keep_0, _keep_1, ..."""
    sized = docs.select("doc_id", "source", *[F.col(quoted(c)).alias(f"_keep_{i}") for i, c in enumerate(keep or [])], size_of().alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("_draw"))
    per = cut(targets(sized.select("source", "size"), weights, most))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    per = per.withColumnRenamed("source", "_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    n = (whole + F.when(F.col("_draw") < rate - whole, 1).otherwise(0)).cast("long")
    return sized.join(per, F.col("source").eqNullSafe(F.col("_of"))).select("doc_id", "size", "source_size", "target", n.alias("copies"), *[f"_keep_{i}" for i in range(len(keep or []))])


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """docs with every row repeated as often as the mix takes it."""
    taken = copies(docs, weights, most, seed, docs.columns)
    rows = taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w
  FROM sized GROUP BY source),
run AS (
  SELECT *, sum(source_size) OVER o - source_size AS before, sum(w) OVER () - sum(w) OVER o + w AS w_left,
         sum(source_size) OVER () AS total
  FROM per WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT *, 3 * source_size * w_left < (total - 3 * before) * w AS stops FROM run),
sums AS (
  SELECT *, coalesce(sum(CASE WHEN stops THEN source_size END) OVER (), 0) AS stopped,
         sum(CASE WHEN NOT stops THEN w END) OVER () AS open_w FROM stop),
target AS (
  SELECT source, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(total - 3 * stopped AS DOUBLE) * w / CAST(open_w AS DOUBLE) END AS target FROM sums),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix:0:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null:' || coalesce(s.text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rated
"""
