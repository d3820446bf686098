"""Sinks: checkpoints, JSON lines, bundles, texts, ground-truth pairs, reports and logs."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import escaped, percent, safe_name
from quire.operators import export, library
from quire.operators._skew import with_group
from quire.sources.scratch import Files


POINTER = "CURRENT"


def _files(spark: SparkSession, folder: str):
    """Hadoop's view of folder's file system, and a maker of paths in folder."""
    jvm = spark._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    return jvm, path(POINTER).getFileSystem(spark._jsc.hadoopConfiguration()), path


def swapped(df: DataFrame, folder: str) -> str:
    """df written to a new folder under folder and, once complete, made the current one by one rename of the pointer to it.
    Readers see the old rows or the new ones. Old snapshots stay for readers that have begun."""
    spark, name = df.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder.rstrip('/')}/{name}")
    jvm, fs, path = _files(spark, folder)
    out = fs.create(path(f"{POINTER}-{name}"))
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(POINTER).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"{POINTER}-{name}"), path(POINTER), options)
    return f"{folder.rstrip('/')}/{name}"


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that were last made current in folder."""
    name = spark.read.text(f"{folder.rstrip('/')}/{POINTER}").first()["value"]
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def appended(df: DataFrame, path: str, by: str = "book_id") -> None:
    """Pages as they come, one folder per book."""
    df.write.mode("append").partitionBy(by).json(path)


def json_lines(corrections: DataFrame, path: str) -> None:
    """Training rows, three keys each, other scripts as they are."""
    export.training_rows(corrections).write.json(path)


def gzip_bundles(readings: DataFrame, path: str) -> None:
    """One gzip JSON object per book, in folders by book; lines of it are written as they come, in order."""
    lines = export.bundles(readings).repartition("book_id").sortWithinPartitions("book_id", "part", "snippet_id")
    lines.select("book_id", "line").write.partitionBy("book_id").option("compression", "gzip").text(path)


def text_files(lines: DataFrame, path: str) -> DataFrame:
    """Books' texts (see library.book_lines) in folders by book and block of pages, a file each, and the index of the blocks.

    Rows come sorted by book and block and are written as they stand; a block's file is its part of the text, so the files of a
    book one after the other are the whole. The index, a row a block, is written beside them and returned."""
    spark = lines.sparkSession
    out = f"{path.rstrip('/')}/text"
    lines.sortWithinPartitions("book_id", "block", "page_index", "seq", "snippet_id").select("book_id", "block", "value").write.partitionBy("book_id", "block").text(out)
    library.text_blocks(lines).write.parquet(f"{path.rstrip('/')}/index")
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def text_of(spark: SparkSession, path: str, book_id: str) -> Iterator[str]:
    """A book's text from text_files, a block at a time."""
    files = Files(spark, path)
    escaped_id = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(book_id)
    of = f"text/book_id={escaped_id}"
    for block in sorted(files.names(of), key=lambda n: int(n.split("=")[1])):
        for name in files.names(f"{of}/{block}"):
            if not name.startswith(("_", ".")):
                yield files.read(f"{of}/{block}/{name}")


def book_texts(snippets: DataFrame, titles: DataFrame, path: str) -> None:
    """Every book's text as files of blocks in a folder by its title as a file name."""
    names = titles.select("book_id", safe_name(F.col("title")).alias("name"))
    per = snippets.groupBy("book_id").agg(F.count("*").alias("_n")).join(names, "book_id")
    named = with_group(library.book_lines(snippets), per, "book_id", "_n")
    # whole blocks stay in one task and in order, as a file each
    rows = named.repartitionByRange("name", "block").sortWithinPartitions("name", "block", "page_index", "seq", "snippet_id")
    rows.select("name", "block", "value").write.partitionBy("name", "block").text(path)


def archived(spark: SparkSession, texts: str, titles: DataFrame, path: str) -> None:
    """A zip file on the driver with a text file for each book, named by id and title. The texts are those of text_files under
    `texts` and pass through a block at a time; titles come one at a time."""
    named = titles.select("book_id", safe_name(F.coalesce(F.nullif("title", F.lit("")), "book_id")).alias("name"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for row in named.orderBy("book_id").toLocalIterator():
            with out.open(f"{row['book_id']}_{row['name']}.txt", "w", force_zip64=True) as entry:
                for part in text_of(spark, texts, row["book_id"]):
                    entry.write(part.encode())


def pairs(named: DataFrame, read: Callable[[str], bytes | None], write: Callable[[str, bytes], None]) -> DataFrame:
    """Ground-truth pairs (stem, image_path, refined_text) written on the executors; (stem, written) comes back. A missing
    image is skipped; its number stays used. Writes are idempotent by name, so that a task can run again."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for stem, image, text in pdf.itertuples(index=False):
                raw = read(image)
                if raw is not None:
                    suffix = "." + image.rsplit(".", 1)[1] if "." in image.rsplit("/", 1)[-1] else ""
                    write(stem + suffix, raw)
                    write(stem + ".gt.txt", (text or "").encode())
                done.append(raw is not None)
            yield pd.DataFrame({"stem": pdf["stem"], "written": done})

    return named.select("stem", "image_path", "refined_text").mapInPandas(work, "stem string, written boolean")


def report_rows(flagged: DataFrame) -> DataFrame:
    """Lines of an HTML table, one per record, and their order."""
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>"))
    share = F.when(F.col("sim_easyocr_tesseract").isNotNull(), percent(F.col("sim_easyocr_tesseract")))
    cells = [cell(F.col("snippet_id")), cell(F.col("easyocr.text")), cell(F.col("tesseract.text")), cell(F.col("surya.text")), cell(share)]
    return flagged.select("snippet_id", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def memory_stream(samples: DataFrame, path: str, checkpoint: str):
    """A streaming frame of samples appended as CSV."""
    return samples.writeStream.format("csv").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def audit(entries: DataFrame, path: str) -> None:
    entries.select("at", "user_uid", "action", "target", F.to_json("detail").alias("detail")).write.mode("append").parquet(path)
