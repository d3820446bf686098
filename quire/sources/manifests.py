"""Manifests of files by path, size and modification time, and the newest complete run, without reading a file.

Sizes and times are those of Spark's own file listing (the binaryFile source; contents are pruned from the scan unless
they are selected), which lists many folders in a job of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.merge import absent


def signature() -> Column:
    """size:mtime in milliseconds."""
    return F.concat_ws(":", F.col("length"), F.unix_millis("modificationTime"))


def listed(spark: SparkSession, folder: str, pattern: str = "*", target: str = "") -> DataFrame:
    """(target, key, path, length, modificationTime, signature) of the files below folder that aren't empty; key is the path within it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    # file:/a and file:///a are the same
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
    key = F.substring(plain(F.col("path")), F.length(plain(F.lit(whole))) + 1, F.length("path"))
    return files.select(F.lit(target).alias("target"), key.alias("key"), "path", "length", "modificationTime", signature().alias("signature"))


def changed(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of now that manifest (target, key, signature) doesn't have as they are: new, or of another size or time."""
    return absent(now, manifest, ["target", "key", "signature"])


def merged(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """manifest with the files that were sent; a file sent again replaces its line."""
    columns = ["target", "key", "signature"]
    return absent(manifest, done, columns[:2]).select(*columns).unionByName(done.select(*columns))


def gone(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Lines of manifest whose file isn't there any more."""
    return absent(manifest, now, ["target", "key"])


def runs(files: DataFrame, result: str = "result.json", needed: tuple[str, ...] = ()) -> DataFrame:
    """(run, changed, complete) of every folder with a result: when it was written, and whether it and all needed files
    are there and not empty."""
    rows = files.select(F.regexp_extract("key", r"^(?:(.*)/)?[^/]*$", 1).alias("run"), F.regexp_extract("key", r"([^/]*)$", 1).alias("name"), "length", "modificationTime")
    has = lambda n: F.max(F.when(F.col("name") == n, F.col("length") > 0))
    whole = F.lit(True)
    for n in (result, *needed):
        whole &= F.coalesce(has(n), F.lit(False))
    return rows.groupBy("run").agg(F.max(F.when(F.col("name") == result, F.col("modificationTime"))).alias("changed"), whole.alias("complete")).where("changed IS NOT NULL")


def newest_run(files: DataFrame, result: str = "result.json", needed: tuple[str, ...] = ()) -> DataFrame:
    """The complete run whose result was written last; of equal times the one that is last by name. One row at most."""
    best = runs(files, result, needed).where("complete").agg(F.max_by("run", F.struct("changed", "run")).alias("run"))
    return best.where("run IS NOT NULL")
