"""Tallies of word changes kept up to date as suggestions come, change and go, without counting a snippet again.

Three logs (see snapshot_log), bucketed by snippet: votes, each person's last suggestion for a snippet with the changes it
made; groups, who agrees on each change; counts, a snippet's numbers. A batch finds the changes of its own suggestions only.
What a person said before is subtracted as it was kept, what they say now is added. If a snippet's text or a person's role
has changed, the votes it concerns are taken out and put in anew. The suggested texts are beside the logs, one table a batch,
written where they come and read only when a snippet's text has changed; votes say in which row of which batch theirs is.

The logs take a batch in the order groups, counts, votes, and each takes it once. What is subtracted is read from the votes of
the batch before, so a job that dies between two logs computes the same again. A batch reads the buckets it touches and writes
its own rows. Of suggestions of one person and snippet in a batch the last by ts and id counts; a row with gone set withdraws
theirs. Suggestions for unknown snippets or of unknown people are not counted, and count once both are known and they
come again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.merge import latest
from quire.operators.tally import ATTENTION, EDITORS, changes_of
from quire.sources import scratch
from quire.streaming.snapshot_log import FAN, SnapshotLog

KEY = ["snippet_id", "user_id"]
#: What the votes keep of a suggestion besides the person and the changes: its text is row _row of batch _told.
OWN = (*KEY, "id", "ts", "kind", "_told", "_row")
CHANGE = ["snippet_id", "start", "end", "replacement"]
MEMBERS = "array<struct<ts:timestamp_ntz,id:bigint,user_id:bigint,name:string,role:string,original:string>>"
COUNTS = ("confirms_reviewers", "confirms_guests", "edit_suggestions", "suggestion_count")


class LiveTally:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        log = lambda name, keys: SnapshotLog(spark, f"{path}/{name}", keys, "_batch", buckets=buckets, by=["snippet_id"])
        self.spark, self.votes, self.groups, self.counts = spark, log("votes", KEY), log("groups", CHANGE), log("counts", ["snippet_id"])
        self.texts = scratch.Files(spark, f"{path}/texts")

    # -- texts, which no log moves -------------------------------------------------

    def _text_tables(self, before: int | None = None) -> list[str]:
        """Tables of texts that count: the last one that others went into, and those of batches after it (before a batch)."""
        names = [n for n in self.texts.names() if not n.startswith("_") and (before is None or int(n.split("-")[0]) < before)]
        start = max((n for n in names if n.endswith("-all")), default="")
        return [n for n in names if n == start or n.split("-")[0] > start.split("-")[0]]

    def _texts_of(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """rows (_told, _row, ...) with their texts."""
        paths = [f"{self.texts.path}/{n}" for n in self._text_tables(batch_id)]
        return rows.join(self.spark.read.parquet(*paths).select("_told", "_row", "text"), ["_told", "_row"])

    def _put_texts(self, rows: DataFrame, batch_id: int, kind: str) -> DataFrame:
        """rows written as a table of texts, whose name says their number."""
        name = f"_{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.texts.path}/{name}")
        n = self.spark.read.parquet(f"{self.texts.path}/{name}").count()
        done = f"{batch_id:012d}-{n:012d}-{kind}"
        self.texts.publish(name, done)
        return self.spark.read.parquet(f"{self.texts.path}/{done}")

    def _tidied(self, batch_id: int) -> None:
        """Once most texts are of votes that have changed or gone, the others are written as one table."""
        names, votes = self._text_tables(), self.votes.current()
        if votes is not None and sum(int(n.split("-")[1]) for n in names) > 2 * FAN * sum(r for files in self.votes.manifest().buckets.values() for _, r in files):
            self._put_texts(self._texts_of(votes.where("NOT gone").select("_told", "_row"), batch_id + 1), batch_id, "all")
        for n in set(self.texts.names()) - set(self._text_tables()):
            self.texts.delete(n)

    # -- batches -------------------------------------------------------------------

    def _brought(self, batch: DataFrame, snippets: DataFrame) -> DataFrame:
        """batch (KEY, id, ts, kind, text, gone) with its changes; rows that are withdrawn, or whose snippet isn't known, are gone."""
        if "current_text" in batch.columns:
            held = batch.withColumns({"_base": F.col("current_text"), "_text": F.col("current_text").isNotNull()}).drop("current_text")
        else:
            held = batch.join(snippets.select("snippet_id", F.coalesce("final_text", "working_text").alias("_base"), F.lit(True).alias("_text")), "snippet_id", "left")
        gone = F.coalesce("gone", F.lit(False))
        here = F.coalesce(F.col("_text"), F.lit(False)) & ~gone & F.col("kind").isNotNull()
        # withdrawn texts are neither compared nor kept
        held = held.withColumn("_here", here).withColumns({"_base": F.when(F.col("_here"), F.col("_base")), "text": F.when(~gone, F.col("text"))})
        return held.withColumn("changes", changes_of("_base")).select(*KEY, "id", "ts", "kind", "text", F.when(F.col("_here"), F.col("changes")).alias("changes"), (~F.col("_here")).alias("gone"))

    def _named(self, rows: DataFrame, users: DataFrame) -> DataFrame:
        """rows with the person's name and present role; those of unknown people are gone."""
        named = rows.join(users.select(F.col("id").alias("user_id"), "name", "role", F.lit(True).alias("_user")), "user_id", "left")
        known = ~F.col("gone") & F.coalesce(F.col("_user"), F.lit(False))
        return named.select(*OWN, *[F.when(known, F.col(c)).alias(c) for c in ("name", "role", "changes")], (~known).alias("gone"))

    def _changed(self, rows: DataFrame, snippets: DataFrame, batch_id: int) -> DataFrame:
        """Votes with the changes to their snippets' texts now."""
        base = snippets.select("snippet_id", F.coalesce("final_text", "working_text").alias("_base"))
        known = self._texts_of(rows, batch_id).join(base, "snippet_id").where("kind IS NOT NULL").withColumn("changes", changes_of("_base"))
        return known.select(*OWN, "changes", F.lit(False).alias("gone"))

    def _written(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def apply(self, batch: DataFrame, batch_id: int, snippets: DataFrame, users: DataFrame, texts: DataFrame | None = None, people: DataFrame | None = None) -> None:
        """Takes a batch (KEY, id, ts, kind, text, gone); texts (snippet_id) and people (user_id) have changed since the last one.

        A batch may bring its snippets' current_text, null where a snippet isn't known; then no snippet is joined to it."""
        if batch_id <= self.votes.manifest().batch:
            return
        for n in self.texts.names():  # what a job that died has left
            if n.startswith("_") or int(n.split("-")[0]) >= batch_id:
                self.texts.delete(n)
        own = [*KEY, "id", "ts", "kind", "text", "gone"]
        # texts are written once, where they come, with the changes that they make; all else reads rows without texts
        came = self._brought(batch.select(*own, *[c for c in batch.columns if c == "current_text"]), snippets)
        came = self._put_texts(came.withColumns({"_told": F.lit(batch_id).cast("long"), "_row": F.monotonically_increasing_id()}), batch_id, "batch").drop("text")
        folder = scratch.folder(self.spark)
        came = self._written(self._named(latest(came, KEY, ["ts", "id"]), users), f"{folder}/came")
        new, rows = came.select(*KEY), came.where("NOT gone")
        # a person's votes can be anywhere, a snippet's are in its bucket
        named = new.select("snippet_id") if texts is None else new.select("snippet_id").union(texts.select("snippet_id"))
        buckets = None if people is not None else self.votes.buckets_of(named)
        held = self.votes.current(buckets=buckets)
        before, due = None, None
        if held is not None:
            alive = held.where("NOT gone").drop("_batch")
            before = alive.join(new, KEY, "left_semi")
            if texts is not None or people is not None:
                others = alive.join(new, KEY, "left_anti")
                due = others.where("false")
                if texts is not None:
                    again = others.join(texts.select("snippet_id").distinct(), "snippet_id", "left_semi")
                    before = before.unionByName(again)
                    due = self._changed(again, snippets, batch_id)
                if people is not None:  # their changes stay what they are
                    others = others if texts is None else others.join(texts.select("snippet_id").distinct(), "snippet_id", "left_anti")
                    again = others.join(people.select("user_id").distinct(), "user_id", "left_semi")
                    before = before.unionByName(again)
                    due = again.select(*OWN, "changes", "gone") if texts is None else due.unionByName(again.select(*OWN, "changes", "gone"))
                due = self._written(self._named(due, users), f"{folder}/due")
                rows = rows.unionByName(due.where("NOT gone"))
        signed = rows.withColumn("sign", F.lit(1))
        if before is not None:
            signed = signed.unionByName(before.withColumn("sign", F.lit(-1)))
        signed = self._written(signed.select("snippet_id", "sign", "ts", "id", "user_id", "name", "role", "changes"), f"{folder}/signed")
        batch_no = F.lit(batch_id).cast("long").alias("_batch")
        self.groups.upsert(self._groups_after(signed, buckets).withColumn("_batch", batch_no), batch_id)
        self.counts.upsert(self._counts_after(signed, buckets).withColumn("_batch", batch_no), batch_id)
        kept = came if due is None else came.unionByName(due)
        self.votes.upsert(kept.withColumn("_batch", batch_no), batch_id)
        scratch.Files(self.spark, folder).delete("")
        self._tidied(batch_id)

    def _groups_after(self, signed: DataFrame, buckets: set[int] | None) -> DataFrame:
        """The groups that signed votes touch, with their members after them."""
        each = signed.select("snippet_id", "sign", "ts", "id", "user_id", "name", "role", F.explode("changes").alias("c"))
        member = F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("id").cast("long").alias("id"), F.col("user_id").cast("long").alias("user_id"), "name", "role", F.col("c.original").alias("original"))
        delta = each.groupBy("snippet_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.replacement").alias("replacement")).agg(
            F.collect_list(F.when(F.col("sign") > 0, member)).cast(MEMBERS).alias("added"), F.collect_list(F.when(F.col("sign") < 0, F.col("user_id").cast("long"))).alias("gone"),
        )
        held = self.groups.current(buckets=buckets)
        if held is None:
            return delta.select(*CHANGE, F.array_sort("added").alias("members"))
        rows = delta.join(held.select(*CHANGE, "members"), CHANGE, "left")
        stay = F.filter(F.coalesce("members", F.array().cast(MEMBERS)), lambda m: ~F.array_contains("gone", m["user_id"]))
        return rows.select(*CHANGE, F.array_sort(F.concat(stay, "added")).alias("members"))

    def _counts_after(self, signed: DataFrame, buckets: set[int] | None) -> DataFrame:
        same, guest, sign = F.size("changes") == 0, F.col("role") == "guest", F.col("sign")
        add = lambda c, n: F.sum(F.when(c, sign).otherwise(0)).cast("long").alias(n)
        delta = signed.groupBy("snippet_id").agg(add(same & ~guest, COUNTS[0]), add(same & guest, COUNTS[1]), add(~same, COUNTS[2]), add(F.lit(True), COUNTS[3]))
        held = self.counts.current(buckets=buckets)
        if held is None:
            return delta
        rows = delta.join(held.select("snippet_id", *[F.col(c).alias(f"_{c}") for c in COUNTS]), "snippet_id", "left")
        return rows.select("snippet_id", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c) for c in COUNTS])

    def tallies(self) -> DataFrame | None:
        """(snippet_id, COUNTS, word_changes, attention) of snippets with suggestions, as tally.tallied has them; None before the first."""
        counts, groups = self.counts.current(), self.groups.current()
        if counts is None:
            return None
        counts = counts.where("suggestion_count > 0").drop("_batch")
        if groups is None:
            return counts.select("*", F.lit(None).cast("string").alias("word_changes"), F.lit(False).alias("attention"))
        reviewers = F.filter("members", lambda m: m["role"] != "guest")
        n = lambda c: F.size(c).cast("long")
        rows = groups.where(F.size("members") > 0).select(
            *CHANGE, F.col("members")[0]["original"].alias("original"), F.array_sort(F.transform(reviewers, lambda m: F.struct(m["user_id"].alias("user_id"), m["name"].alias("name"), m["role"].alias("role")))).alias("reviewers"),
            n(F.filter("members", lambda m: m["role"].isin(*EDITORS))).alias("editors"), n(F.filter("members", lambda m: m["role"] == "guest")).alias("guests"), n(reviewers).alias("count"), F.struct(F.col("members")[0]["ts"], F.col("members")[0]["id"]).alias("first"),
        )
        order = F.struct((-F.col("count")).alias("k1"), (-F.col("guests")).alias("k2"), F.col("start").alias("k3"), F.col("first").alias("k4"))
        change = F.struct("start", "end", "original", "replacement", "reviewers", "editors", "guests", "count")
        lists = rows.groupBy("snippet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), change.alias("g")))), lambda x: x["g"]).alias("word_changes"), F.max("count").alias("_most"))
        return counts.join(lists, "snippet_id", "left").withColumn("attention", F.coalesce(F.col("_most") >= ATTENTION, F.lit(False))).drop("_most")
