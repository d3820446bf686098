"""Pages of a sorted table by cursor: a clustered copy, the key range of each of its files, and keyset paging.

A page is asked for by the last key of the page before, not by a number of rows to skip, so rows that are inserted
meanwhile neither repeat nor push out others, and no page costs more than the first. Added rows are files of their own.
The index has a row a file (least key, greatest key, rows); a page reads the files that its keys can be in, and these are
chosen so that they hold as many rows as it needs: with files sorted into ranges one or two, and one more for each
added file over the same keys.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import Files


class Clustered:
    """Rows under path, sorted by the columns key, which no two rows share."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]) -> None:
        self.spark, self.files, self.key = spark, Files(spark, path), key

    def add(self, rows: DataFrame) -> None:
        """Rows as sorted files; they and their lines of the index become visible together."""
        name = uuid.uuid4().hex
        base = f"{self.files.path}/_{name}"
        rows.repartitionByRange(*self.key).sortWithinPartitions(*self.key).write.parquet(f"{base}/rows")
        written = self.spark.read.schema(rows.schema).parquet(f"{base}/rows")
        k = F.struct(*self.key)
        file = F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1)
        per = written.select(file.alias("file"), k.alias("k")).groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n"))
        per.select(F.concat(F.lit(f"part-{name}/rows/"), "file").alias("file"), "least", "most", "n").coalesce(1).write.parquet(f"{base}/index")
        self.files.publish(f"_{name}", f"part-{name}")

    def parts(self) -> list[str]:
        return [n for n in self.files.names() if n.startswith("part-")]

    def index(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.files.path}/{n}/index" for n in self.parts()])

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.files.path}/{n}/rows" for n in self.parts()])

    def _after(self, column: str, cursor: tuple[Any, ...]):
        """Whether a key is behind cursor, as comparisons of its columns, which reach the scan."""
        out = F.lit(False)
        for i, v in enumerate(cursor):
            same = F.lit(True)
            for k, w in zip(self.key[:i], cursor, strict=False):
                same &= F.col(f"{column}{k}") == F.lit(w)
            out |= same & (F.col(f"{column}{self.key[i]}") > F.lit(v))
        return out & (F.col(f"{column}{self.key[0]}") >= F.lit(cursor[0])) if cursor else F.lit(True)

    def files_of(self, cursor: tuple[Any, ...] | None, n: int) -> list[str]:
        """Files that the next n rows behind cursor are in. At most n files are needed to have n rows, so no more are looked at."""
        index = self.index()
        open_ = index.where(self._after("most.", cursor)) if cursor else index
        ahead = open_ if cursor is None else open_.where(self._after("least.", cursor))
        total, bound = 0, None
        for r in ahead.orderBy("most").limit(n).select("most", "n").collect():
            total += r["n"]
            if total >= n:
                bound = r["most"]
                break
        near = open_ if bound is None else open_.where(F.col("least") <= F.struct(*[F.lit(v).alias(k) for k, v in zip(self.key, bound, strict=True)]))
        return [r["file"] for r in near.select("file").collect()]

    def page(self, cursor: tuple[Any, ...] | None = None, n: int = 50, most: int = 200) -> DataFrame:
        """The next n rows (1 to most) behind cursor, the key of the last row seen, in order; from the first without one."""
        n = max(1, min(n, most))
        names = self.files_of(cursor, n)
        schema = self.rows().schema
        rows = self.spark.read.schema(schema).parquet(*[f"{self.files.path}/{f}" for f in names]) if names else self.spark.createDataFrame([], schema)
        return (rows.where(self._after("", cursor)) if cursor else rows).orderBy(*self.key).limit(n)
