"""Upserts of streams into a log of bucketed files: a batch writes what it brings, a manifest says what is current.

A key belongs to one bucket. A batch writes its newest row of each key as one table, a file for each bucket that it touches, and
merges a bucket's last files where they have become as large as the files before them (at most FAN times), so a bucket
has a logarithmic number of files and a row is written again a logarithmic number of times, however large the state is.
The manifest lists each bucket's files. It is written whole under another name and becomes current by one rename;
a job that dies before leaves tables that no manifest names, and a batch that the manifest has seen is not applied
again. Tables that no kept manifest names are deleted. Nothing depends on folders of earlier batches.

Defined results: of rows of a key the one with the latest time stays, of equal times the one that came in an earlier batch,
within a batch the one that is last by `ties`; a null time is before all others; rows whose key holds a null are kept
by that key as any other; an empty batch only moves the batch's number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.merge import latest
from quire.sources.scratch import Files

#: Files of a bucket are merged with the one before them if that has at most so many times their rows.
FAN = 2
#: Manifests that stay for readers that have begun.
KEPT = 2


@dataclass
class Manifest:
    """version and batch of the last commit, the rows' schema and each bucket's files as [table, rows], oldest first."""

    version: int = 0
    batch: int = -1
    schema: str | None = None
    buckets: dict[int, list[list]] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(raw["version"], raw["batch"], raw["schema"], {int(k): v for k, v in raw["buckets"].items()})

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    def tables(self) -> set[str]:
        return {t for files in self.buckets.values() for t, _ in files}


def stack_to_merge(rows: list[int]) -> int:
    """How many of a bucket's last files to merge into one, given their rows, the newest last; 1 if none."""
    n, total = 1, rows[-1]
    while n < len(rows) and rows[-n - 1] <= FAN * total:
        n, total = n + 1, total + rows[-n - 1]
    return n


class SnapshotLog:
    """A table of the newest row of each key under path, with one writer at a time and any number of readers.

    by names the columns of the key that decide the bucket, all of them unless given."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str, ties: tuple[str, ...] = (), buckets: int = 64, by: list[str] | None = None) -> None:
        self.spark, self.files, self.keys, self.time, self.ties, self.n_buckets = spark, Files(spark, path), keys, time, list(ties), buckets
        self.by = by or keys
        #: Called after every durable step; tests stop the job there.
        self.after: Callable[[str], None] = lambda step: None

    # -- reading ---------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if not known:
            return Manifest()
        return Manifest.read(self.files.read(f"manifests/{max(known) if version is None else version:012d}.json"))

    def _table(self, schema: T.StructType, of: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.files.path}/data/{t}/_b={b}" for b, tables in of.items() for t in tables]
        return self.spark.read.schema(schema).parquet(*paths)

    def current(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """The newest row of every key (of these buckets), dealt by the columns that decide the bucket; None before the first rows."""
        m = self.manifest(version)
        if m.schema is None:
            return None
        schema = T.StructType.fromJson(json.loads(m.schema))
        asked = {b: f for b, f in m.buckets.items() if buckets is None or b in buckets}
        if not asked:
            return self.spark.createDataFrame([], schema).drop("_seq")
        # dealt once, so that what groups or joins by these columns finds its rows together
        rows = self._table(schema, {b: [t for t, _ in f] for b, f in asked.items()}).repartition(*self.by)
        out = self._merged(rows) if any(len(f) > 1 for f in asked.values()) else rows
        return out.drop("_seq")

    def _merged(self, rows: DataFrame, dealt: Sequence[str] = ()) -> DataFrame:
        return latest(rows.withColumn("_older", -F.col("_seq")), [*dealt, *self.keys], [self.time, "_older", *self.ties]).drop("_older")

    # -- writing ---------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.n_buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows with _p, dealt by it: several parts a bucket where there are more cores than buckets, so that few buckets don't keep
        cores idle and no task holds a whole one. A key is in one part."""
        parts = -(-4 * self.spark.sparkContext.defaultParallelism // self.n_buckets)
        return rows.withColumn("_p", F.pmod(F.xxhash64(*self.by), F.lit(self.n_buckets * parts)).cast("int")).repartition("_p")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """The buckets that rows' keys are in, as many as there are buckets at most."""
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}

    def _write(self, rows: DataFrame, step: str) -> tuple[str, dict[int, int]]:
        """A new table of dealt rows, in a file for each bucket and task; its name, and its rows by bucket."""
        name = uuid.uuid4().hex
        path = f"{self.files.path}/data/{name}"
        # like rows stand together, so that texts of one snippet compress each other
        placed = rows.withColumn("_b", F.pmod("_p", F.lit(self.n_buckets)).cast("int")).drop("_p").sortWithinPartitions("_b", *self.keys)
        placed.write.partitionBy("_b").option("compression", "zstd").parquet(path)
        self.after(step)
        if not any(n.startswith("_b=") for n in self.files.names(f"data/{name}")):
            return name, {}
        counts = self.spark.read.schema("_b int").parquet(path).groupBy("_b").count().collect()  # a row a bucket
        return name, dict(map(tuple, counts))

    def upsert(self, batch: DataFrame, batch_id: int) -> dict[str, int]:
        """Applies a batch once; how many rows it brought and how many were written in all."""
        m = self.manifest()
        if batch_id <= m.batch:
            return {"rows": 0, "written": 0}
        version = m.version + 1
        # rows go to their buckets first, so that finding the newest and writing need no further shuffle
        new = latest(self._dealt(batch), ["_p", *self.keys], [self.time, *self.ties]).select(*batch.columns, "_p").withColumn("_seq", F.lit(version).cast("long"))
        schema = m.schema or json.dumps(T.StructType([T.StructField(f.name, f.dataType) for f in new.drop("_p").schema.fields]).jsonValue())
        name, counts = self._write(new, "rows")
        files = {b: [*m.buckets.get(b, [])] for b in {*m.buckets, *counts}}
        due: dict[int, list[str]] = {}
        for b, n in counts.items():
            files[b].append([name, n])
            if (k := stack_to_merge([r for _, r in files[b]])) > 1:
                due[b] = [t for t, _ in files[b][-k:]]
        written = total = sum(counts.values())
        if due:
            merged, sizes = self._write(self._merged(self._dealt(self._table(T.StructType.fromJson(json.loads(schema)), due)), ["_p"]), "merged")
            for b, tables in due.items():
                files[b] = [*files[b][: -len(tables)], [merged, sizes[b]]]
            written += sum(sizes.values())
        self._commit(Manifest(version, batch_id, schema, files))
        return {"rows": total, "written": written}

    def _commit(self, m: Manifest) -> None:
        temporary = f"manifests/_{uuid.uuid4().hex}"
        self.files.write(temporary, m.text())
        self.after("manifest written")
        self.files.publish(temporary, f"manifests/{m.version:012d}.json")
        self.after("manifest")
        self.prune()

    def prune(self) -> None:
        """Deletes old manifests, those never renamed, and tables that no kept manifest names."""
        known = sorted(self.versions())
        for v in known[:-KEPT]:
            self.files.delete(f"manifests/{v:012d}.json")
            self.after("manifest deleted")
        for n in self.files.names("manifests"):
            if n.startswith("_"):
                self.files.delete(f"manifests/{n}")
        used = set().union(*(self.manifest(v).tables() for v in known[-KEPT:]))
        for t in self.files.names("data"):
            if t not in used:
                self.files.delete(f"data/{t}")
                self.after("table deleted")


def upserting(path: str, keys: list[str], time: str, ties: tuple[str, ...] = (), buckets: int = 64):
    """A foreachBatch function that keeps the newest row of each key in the log under path."""

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        SnapshotLog(batch.sparkSession, path, keys, time, ties, buckets).upsert(batch, batch_id)

    return merge_batch
