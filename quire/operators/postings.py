"""Substring search by an index of trigrams, with exact verification.

A text's trigrams are those of the text in lower case with two end marks behind it, so that each of its characters begins
one. The index is a table of distinct (gram, id), sorted by gram in ranges over files, so a search for a gram reads the
files whose minima and maxima hold it. A needle of three characters or more stands only in texts that have all its
trigrams; a shorter one in texts with a trigram that begins with it. What is found so is looked up and tested itself.
Added rows bring files of their own; compact() sorts them all into one set of ranges again.

The needle is data of the plan, the candidates are a frame: nothing comes to the driver. Searching is case-insensitive as
lower() has it; an empty needle finds every text; a null text is never found by any other.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import Files

GRAM = 3
#: Stands behind texts and between fields; no text should hold it. Above it there is no character that begins a trigram.
END = "\x00"
SEPARATOR = "\x01"


def joined(fields: list[Column]) -> Column:
    """Fields as one text to search in; a needle can't reach from one into the next."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(f, F.lit("")) for f in fields])


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, its end marked."""
    low = F.lower(text)
    marked = F.concat(low, F.lit(END * (GRAM - 1)))
    n = F.length(low)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(marked, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def runs_of(needle: str, wildcards: bool) -> list[str]:
    """What a text with needle holds letter by letter: all of it, or what stands between its wildcards."""
    return [r for r in (re.split("[%_]+", needle.lower()) if wildcards else [needle.lower()]) if r]


def needle_grams(runs: list[str]) -> list[str]:
    return sorted({r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})


class Index:
    """Postings of (id, text) rows under path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.files = spark, Files(spark, path)

    def add(self, rows: DataFrame) -> None:
        """Adds rows (id, text) that the index doesn't have yet, as files of their own that become visible at once."""
        # a text makes many times its size of trigrams, so texts of a small table are dealt to all cores first
        dealt = rows.select("id", "text").repartition(2 * self.spark.sparkContext.defaultParallelism, "id")
        self._write(dealt.select("id", F.explode(grams(F.col("text"))).alias("gram")))

    def _write(self, pairs: DataFrame) -> str:
        name = uuid.uuid4().hex
        # a gram of all texts is spread over ranges by its ids
        pairs.select("gram", "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{self.files.path}/_{name}")
        self.files.publish(f"_{name}", f"grams-{name}")
        return f"grams-{name}"

    def tables(self) -> list[str]:
        return [n for n in self.files.names() if n.startswith("grams-")]

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.files.path}/{n}" for n in self.tables()])

    def compact(self) -> None:
        """All files as one sorted set. Readers that have begun should have ended."""
        old = self.tables()
        self._write(self.postings().distinct())
        for n in old:
            self.files.delete(n)

    def candidates(self, needle: str, wildcards: bool = False) -> DataFrame | None:
        """Ids of texts that may hold needle; None if any may (an empty needle, or nothing but wildcards)."""
        runs = runs_of(needle, wildcards)
        if not runs:
            return None
        wanted = needle_grams(runs)
        if wanted:
            found = self.postings().where(F.col("gram").isin(*wanted)).distinct()
            return found.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).select("id")
        low = max(runs, key=len)
        # all trigrams from the run itself to the last one that begins with it
        return self.postings().where((F.col("gram") >= low) & (F.col("gram") < low + "\U0010ffff" * GRAM) & F.startswith("gram", F.lit(low))).select("id").distinct()

    def search(self, rows: DataFrame, id_column: str, fields: list[str], needle: str, wildcards: bool = False) -> DataFrame:
        """Rows in one of whose fields needle stands, whatever its case; with wildcards, % and _ in it match as in LIKE."""
        hit = F.lit(False)
        for f in fields:
            own = F.ilike(F.col(f), F.lit(f"%{needle}%")) if wildcards else F.contains(F.lower(F.col(f)), F.lit(needle.lower()))
            hit |= F.coalesce(own, F.lit(not needle))
        ids = self.candidates(needle, wildcards)
        if ids is None:
            return rows.where(hit)
        return rows.join(ids.withColumnRenamed("id", id_column), id_column, "left_semi").where(hit)
