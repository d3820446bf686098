"""Catalog search, facets and enqueueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import links
from quire.operators.library import all_of

ACTIVE_ENDS = ("done", "failed")
BULK_MOST = 500


def joined(entries: DataFrame, kavi: DataFrame, prasanga: DataFrame, publisher: DataFrame) -> DataFrame:
    """Entries with the names of their author, work and publisher; Spark broadcasts dimensions that are small enough."""
    named = lambda d, c: d.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    out = entries
    for d, c in ((kavi, "kavi"), (prasanga, "prasanga"), (publisher, "publisher")):
        out = out.join(named(d, c), f"{c}_id", "left")
    return out.drop("kavi_id", "prasanga_id", "publisher_id")


def matching(search: str | None) -> Column | None:
    """Rows that hold the trimmed search text in one of four columns; % and _ in it are wildcards."""
    if not (search or "").strip():
        return None
    found = F.lit(False)
    for c in ("entry_id", "prasanga_name", "kavi_name", "publisher_name"):
        found |= F.coalesce(F.ilike(F.col(c), F.lit(f"%{search.strip()}%")), F.lit(False))
    return found


def has_link() -> Column:
    return F.coalesce(F.ilike(F.col("kosha_link"), F.lit("http%")), F.lit(False))


def searched(catalog: DataFrame, search: str | None = None, kosha: str = "any", limit: int = 50, offset: int = 0) -> DataFrame:
    link = {"any": None, "has": has_link(), "none": ~has_link()}[kosha]
    return catalog.where(all_of(matching(search), link)).orderBy("id").offset(offset).limit(max(1, min(limit, 200)))


def facets(catalog: DataFrame, search: str | None = None) -> DataFrame:
    """Counts of all, with and without a link under one search, in one pass."""
    return catalog.where(all_of(matching(search))).agg(F.count("*").alias("any"), F.count_if(has_link()).alias("has"), F.count_if(~has_link()).alias("none"))


def described(catalog: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Link kinds, previews and whether an entry can be queued, with the status of its latest queue item."""
    link, kosha = F.col("prati_link"), F.col("kosha_link")
    out = catalog.withColumns({"prati_kind": links.kind(link), "preview_url": links.preview(link), "has_kosha": links.is_url(kosha), "kosha_preview_url": F.when(links.is_url(kosha), links.preview(kosha)), "can_queue": links.kind(link) != "unsupported"})
    if queue is None:
        return out
    last = queue.groupBy(F.col("catalog_entry_id").alias("id")).agg(F.max_by("status", "item_id").alias("queue_status"), F.max("item_id").alias("queue_item_id"))
    return out.join(last, "id", "left")


def enqueue_outcomes(requested: DataFrame, catalog: DataFrame, queue: DataFrame) -> DataFrame:
    """missing, unsupported, already_queued (active or done) or added, for each requested id; failed items may come again."""
    held = queue.where(F.col("status") != "failed").select(F.col("catalog_entry_id").alias("id")).distinct().withColumn("held", F.lit(True))
    rows = requested.join(catalog.select("id", links.kind(F.col("prati_link")).alias("kind")), "id", "left").join(held, "id", "left")
    return rows.select("id", F.when(F.col("kind").isNull(), "missing").when(F.col("kind") == "unsupported", "unsupported").when(F.col("held"), "already_queued").otherwise("added").alias("outcome"))


def bulk_ids(ids: Column) -> Column:
    """Distinct ids in their order, the first 500."""
    return F.slice(F.array_distinct(ids), F.lit(1), F.lit(BULK_MOST))
