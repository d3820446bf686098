"""Latest rows, upserts, anti joins and replacements, as rewrites to new DataFrames (Parquet has no MERGE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; an aggregation, so rows combine before the shuffle and no key is sorted whole."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old doesn't have (insert if absent, resume, unchanged uploads)."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(absent(new.dropDuplicates(keys), old, keys))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: of several new rows of a key the last by order, against old rows a new one whatever the order says."""
    return absent(old, new, keys).unionByName(latest(new, keys, order))


def upserted_if_newer(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest row of each key; at equal times the existing row stays."""
    both = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    return latest(both, keys, [time, "_old"]).drop("_old")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without any row whose keys are in new, then new."""
    return absent(old, new, keys).unionByName(new)


def merged_columns(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Full outer upsert: columns come from new where it has the key, those in keep from old where it has it."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    has_new, has_old = F.col(f"n.{keys[0]}").isNotNull(), F.col(f"o.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(b, a).alias(c)
        return (F.when(has_old, a).otherwise(b) if c in keep else F.when(has_new, b).otherwise(a)).alias(c)

    return o.join(n, on, "full").select(*[pick(c) for c in old.columns])


def ingested(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snippets after an ingest that keeps human work: place and pictures always come from incoming; texts only where
    nobody has touched the snippet and the text differs; outcome is created, updated or kept."""
    e, n = existing.alias("e"), incoming.alias("n")
    both = e.join(n, F.col("e.snippet_id") == F.col("n.snippet_id"), "full")
    old, new = F.col("e.snippet_id").isNotNull(), F.col("n.snippet_id").isNotNull()
    untouched = F.col("e.final_text").isNull() & (F.col("e.suggestion_count") == 0) & F.col("e.working_text").eqNullSafe(F.col("e.ai_text"))
    take = new & (~old | untouched)
    return both.select(
        F.coalesce("n.snippet_id", "e.snippet_id").alias("snippet_id"),
        F.when(new, F.col("n.page_index")).otherwise(F.col("e.page_index")).alias("page_index"),
        F.when(take, F.col("n.ai_text")).otherwise(F.col("e.ai_text")).alias("ai_text"),
        F.when(take, F.col("n.ai_text")).otherwise(F.col("e.working_text")).alias("working_text"),
        F.col("e.final_text").alias("final_text"),
        F.coalesce("e.suggestion_count", F.lit(0).cast("long")).alias("suggestion_count"),
        F.when(new & old, "updated").when(new, "created").otherwise("kept").alias("outcome"),
    )


def synced(snippets: DataFrame, payload: DataFrame, emails: DataFrame) -> DataFrame:
    """Snippets after a one-directional review sync: a final text where there is none yet, else a working text.

    payload: snippet_id, working_text, final_text, finalized_by_email; of rows that repeat a snippet one counts, a final
    text before a working one, then the greatest. emails: email, uid of the payload's own people, the least uid of an
    email. Snippets that aren't known are skipped. applied is finalized, working or none."""
    has_final = payload.withColumn("_has", F.coalesce(F.col("final_text") != "", F.lit(False)))
    s, p = snippets.alias("s"), latest(has_final, ["snippet_id"], ["_has", "final_text", "working_text", "finalized_by_email"]).drop("_has").alias("p")
    who = emails.groupBy(F.lower(F.trim("email")).alias("email")).agg(F.min("uid").alias("by_uid"))
    rows = s.join(p, F.col("s.snippet_id") == F.col("p.snippet_id"), "left").join(who.alias("w"), F.lower(F.trim(F.col("p.finalized_by_email"))) == F.col("w.email"), "left")
    final = F.col("s.final_text").isNull() & F.coalesce(F.col("p.final_text") != "", F.lit(False))
    working = ~final & F.col("s.final_text").isNull() & F.coalesce(F.col("p.working_text") != "", F.lit(False)) & ~F.col("p.working_text").eqNullSafe(F.col("s.working_text"))
    return rows.select(
        F.col("s.snippet_id"),
        F.when(final, F.col("p.final_text")).when(working, F.col("p.working_text")).otherwise(F.col("s.working_text")).alias("working_text"),
        F.when(final, F.col("p.final_text")).otherwise(F.col("s.final_text")).alias("final_text"),
        F.when(final, F.col("w.by_uid")).otherwise(F.col("s.finalized_by")).alias("finalized_by"),
        F.when(final, "finalized").when(working, "working").otherwise("none").alias("applied"),
    )


def sync_counters(done: DataFrame, payload: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row: texts applied in done (see synced), snippets of the payload that aren't known, suggestions sent for known ones."""
    texts = done.agg(F.count_if(F.col("applied") == "finalized").alias("finalizations_applied"), F.count_if(F.col("applied") == "working").alias("working_text_applied"))
    skipped = absent(payload, done, ["snippet_id"]).agg(F.count("*").alias("skipped"))
    sent = suggestions.join(done.select("snippet_id").distinct(), "snippet_id", "left_semi").agg(F.count("*").alias("suggestions_applied"))
    return texts.crossJoin(F.broadcast(skipped)).crossJoin(F.broadcast(sent))  # one row each


def cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of doomed keys."""
    return parents.join(doomed, key, "left_anti"), children.join(doomed, key, "left_anti")
