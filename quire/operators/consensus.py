"""State machines as ordered folds over events: two-reviewer consensus, queue items, publishing, snippet texts, applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip

TERMINAL = ("confirmed", "provisionally_verified", "expert_approved")
#: States of a queue item that the runner goes on with.
PENDING = ("queued", "downloading", "downloaded", "rasterizing", "approved", "ocr_running")
STATUSES = ("pending", "confirmed", "awaiting_second_review", "provisionally_verified", "needs_expert", "expert_approved")


def step(state: dict, reviewer: str, text: str, expert: bool, draft: str) -> tuple[dict, str | None]:
    """One review event on state (status, final_text, pending_text, pending_by): the state after it, and the role in which
    it counted or None if it was rejected. The streaming form runs this; the batch form is the same table in columns."""
    s, d, status = text.strip(), draft.strip(), state["status"]
    if status == "needs_expert":
        return ({**state, "status": "expert_approved", "final_text": s}, "expert") if expert else (state, None)
    if status == "pending":
        if s == d:
            return {**state, "status": "confirmed", "final_text": draft}, "first"
        return {**state, "status": "awaiting_second_review", "pending_text": s, "pending_by": reviewer}, "first"
    if status != "awaiting_second_review" or reviewer == state["pending_by"]:
        return state, None
    if s == state["pending_text"] and s != d:
        return {**state, "status": "provisionally_verified", "final_text": s}, "second"
    return {**state, "status": "needs_expert"}, "second"


START = {"status": "pending", "final_text": None, "pending_text": None, "pending_by": None}


def _next(s: Column, e: Column, draft: Column) -> Column:
    """The state after event e (reviewer, text, is_expert)."""
    t, d, status = e["text"], strip(draft), s["status"]
    pending, second, expert = status == "pending", status == "awaiting_second_review", status == "needs_expert"
    other = second & (e["reviewer"] != s["pending_by"])
    agree = other & (t == s["pending_text"]) & (t != d)
    by_expert = expert & e["is_expert"]
    status_after = (
        F.when(pending & (t == d), "confirmed").when(pending, "awaiting_second_review").when(agree, "provisionally_verified")
        .when(other, "needs_expert").when(by_expert, "expert_approved").otherwise(status)
    )
    final = F.when(pending & (t == d), draft).when(agree | by_expert, t).otherwise(s["final_text"])
    accepted = pending | other | by_expert
    return F.struct(
        status_after.alias("status"), final.alias("final_text"),
        F.when(pending & (t != d), t).otherwise(s["pending_text"]).alias("pending_text"),
        F.when(pending & (t != d), e["reviewer"]).otherwise(s["pending_by"]).alias("pending_by"),
        (s["accepted"] + F.when(accepted, 1).otherwise(0)).alias("accepted"),
        (s["rejected"] + F.when(accepted, 0).otherwise(1)).alias("rejected"),
        F.when(accepted, F.array_union(s["reviewers"], F.array(e["reviewer"]))).otherwise(s["reviewers"]).alias("reviewers"),
    )


def consensus(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Status, final text, accepted and rejected events and reviewers of each snippet, from events (reviewer, text,
    is_expert, draft) in order. An event that the table doesn't allow changes nothing and is counted as rejected."""
    rows = events.withColumn("text", strip(F.col("text")))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "reviewer", "text", "is_expert"))).alias("e"), F.max("draft").alias("draft"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("pending").alias("status"), none.alias("final_text"), none.alias("pending_text"), none.alias("pending_by"), F.lit(0).alias("accepted"), F.lit(0).alias("rejected"), F.array().cast("array<string>").alias("reviewers"))
    state = lists.select(*keys, F.aggregate("e", start, lambda s, e: _next(s, e, F.col("draft"))).alias("s"))
    return state.select(*keys, "s.status", "s.final_text", "s.pending_by", F.col("s.accepted").cast("long").alias("accepted"), F.col("s.rejected").cast("long").alias("rejected"), F.array_join(F.array_sort("s.reviewers"), ",").alias("reviewers"))


def histogram(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("_")).drop("_")


def done_of(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("status").isin(*TERMINAL)).alias("done"), F.count("*").alias("total"))


def next_for(states: DataFrame, reviewer: str) -> DataFrame:
    """The one snippet to offer to reviewer: needs_expert first, then one awaiting a second review of somebody else's
    edit, then pending; within these the longest unchanged, then in seed order. One pass, one row out."""
    other = F.col("pending_by") != reviewer
    tier = F.when(F.col("status") == "needs_expert", 1).when((F.col("status") == "awaiting_second_review") & other, 2).when(F.col("status") == "pending", 3)
    return states.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "updated_at", "seed_no").limit(1)


def queue_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest status of each queue item and whether it is at an end."""
    last = events.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count("*").alias("changes"))
    return last.withColumn("active", ~F.col("status").isin("done", "failed"))


def publish_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Publishing status per item and target from events (status, error, target, progress): the last status, the error of the
    last event, the last target that was named, and progress only while publishing."""
    at = F.struct(*order)
    last = events.groupBy(*keys).agg(F.max_by(F.struct("status", "error", "progress"), at).alias("l"), F.max_by("target", F.when(F.col("target").isNotNull(), at)).alias("target"))
    return last.select(*keys, "l.status", "l.error", "target", F.when(F.col("l.status") == "publishing", F.col("l.progress")).alias("progress"))


def snippet_texts(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Working and final text from audit events (action: ingest, accept_word, finalize, unfinalize; text): a final text is the
    working text too, and reopening takes only the final mark away."""
    lists = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "action", "text"))).alias("e"))
    none = F.lit(None).cast("string")
    fold = F.aggregate(
        "e", F.struct(none.alias("working_text"), none.alias("final_text")),
        lambda s, e: F.struct(
            F.when(e["action"].isin("ingest", "accept_word", "finalize"), e["text"]).otherwise(s["working_text"]).alias("working_text"),
            F.when(e["action"] == "finalize", e["text"]).when(e["action"] == "unfinalize", none).otherwise(s["final_text"]).alias("final_text"),
        ),
    )
    return lists.select(*keys, fold.alias("s")).select(*keys, "s.*")


def applications(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Volunteer application status from events (action): apply and decline only from new, approve and reject only from
    pending; a direct role change approves unless nothing was ever asked."""
    lists = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "action"))).alias("e"))

    def after(s: Column, e: Column) -> Column:
        a = e["action"]
        return (
            F.when((a == "sign_in") & (s == "unset"), "new").when((a == "apply") & (s == "new"), "pending").when((a == "decline") & (s == "new"), "declined")
            .when((a == "approve") & (s == "pending"), "approved").when((a == "reject") & (s == "pending"), "rejected").when((a == "set_role") & (s != "unset"), "approved").otherwise(s)
        )

    return lists.select(*keys, F.aggregate("e", F.lit("unset"), after).alias("application_status"))


def page_gate(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Items awaiting review whose pages are all approved become approved. pages: item_id, approved; items: item_id, status."""
    left = pages.groupBy("item_id").agg(F.count_if("approved").alias("reviewed"), F.count_if(~F.col("approved")).alias("remaining"))
    rows = items.join(left, "item_id", "left").fillna(0, ["reviewed", "remaining"])
    ready = (F.col("status") == "awaiting_review") & (F.col("remaining") == 0) & (F.col("reviewed") > 0)
    return rows.withColumn("status", F.when(ready, "approved").otherwise(F.col("status")))
