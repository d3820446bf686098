"""Sinks in two phases, for JSON arrays and gzip bundles that grow page by page, in batches and streams.

Tasks stage their files under names of their own. When all have ended, the driver writes one manifest that names them and
renames it to the commit's number: from then on readers see all of the commit's files, before none. A commit's number is
the batch's in a stream and the caller's in a batch. One that is there already is not made again: what was staged for it is
deleted, so a batch that comes twice changes nothing. A job that fails leaves staged files that no manifest names.

`page_json` writes one JSON array of records for each page of each book, `page_bundle` one gzip JSON object from snippet to
record; both take rows (book_id string, page_index int, key string, record string: JSON), sorted by page within a task or not,
and hold one page at a time if they are sorted. A page that is written again replaces what it had (committed_pages reads
its last commit). Paths are those of any file system that pyarrow knows.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

SCHEMA = "book_id string, page_index int, key string, record string"


@dataclass
class Staged(D.WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class Store:
    def __init__(self, path: str) -> None:
        self.uri = path if "://" in path else f"file://{posixpath.abspath(path)}"

    def open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri)

    def commits(self) -> dict[int, str]:
        fs, root = self.open()
        found = fs.get_file_info(pafs.FileSelector(f"{root}/_commits", allow_not_found=True))
        return {int(f.base_name.removesuffix(".json")): f.path for f in found if f.base_name.endswith(".json")}

    def commit(self, number: int, files: list[dict]) -> bool:
        """Makes files visible as one commit; False, and the files are gone, if the number has been committed."""
        fs, root = self.open()
        if number in self.commits():
            self.drop(files)
            return False
        fs.create_dir(f"{root}/_commits", recursive=True)
        temporary = f"{root}/_commits/_{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as out:
            out.write(json.dumps(files).encode())
        fs.move(temporary, f"{root}/_commits/{number:012d}.json")
        return True

    def drop(self, files: list[dict]) -> None:
        fs, root = self.open()
        for f in files:
            if fs.get_file_info(path := f"{root}/{f['file']}").type == pafs.FileType.File:
                fs.delete_file(path)

    def clean(self) -> None:
        """Deletes files that no commit names: those of tasks that were killed. No job should be writing."""
        fs, root = self.open()
        named = {f["file"] for f in self.listed()}
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        self.drop([{"file": n} for f in found if f.type == pafs.FileType.File and (n := f.path.removeprefix(f"{root}/")) not in named and not n.startswith("_commits/")])

    def listed(self) -> list[dict]:
        fs, _ = self.open()
        out = []
        for number, path in sorted(self.commits().items()):
            with fs.open_input_stream(path) as raw:
                out += [f | {"commit": number} for f in json.loads(raw.read())]
        return out


class _Pages:
    """What batch and stream writers share: staging the pages of a task's rows."""

    bundle = False

    def __init__(self, path: str) -> None:
        self.store = Store(path)

    def staged(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = self.store.open()
        out, at, held = Staged(), None, []

        def flush() -> None:
            if not held:
                return
            book, page = at
            name = f"book={quote(book, safe='')}/page-{page:08d}-{uuid.uuid4().hex}.json{'.gz' if self.bundle else ''}"
            records = [(k, json.loads(r)) for k, r in held]
            text = json.dumps(dict(records) if self.bundle else [r for _, r in records], ensure_ascii=False).encode()
            fs.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as file:
                file.write(gzip.compress(text, mtime=0) if self.bundle else text)
            out.files.append({"file": name, "book_id": book, "page_index": page, "records": len(records)})
            held.clear()

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if (row["book_id"], row["page_index"]) != at:
                        flush()
                        at = row["book_id"], row["page_index"]
                    held.append((row["key"], row["record"]))
            flush()
        except BaseException:
            self.store.drop(out.files)  # the task's own files; another attempt has other names
            raise
        return out


def _files(messages: list) -> list[dict]:
    return [f for m in messages if m is not None for f in m.files]


class _BatchWriter(_Pages, D.DataSourceArrowWriter):
    def __init__(self, path: str, bundle: bool, number: int) -> None:
        super().__init__(path)
        self.bundle, self.number = bundle, number

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.staged(iterator)

    def commit(self, messages: list) -> None:
        self.store.commit(self.number, _files(messages))

    def abort(self, messages: list) -> None:
        self.store.drop(_files(messages))


class _StreamWriter(_Pages, D.DataSourceStreamArrowWriter):
    def __init__(self, path: str, bundle: bool) -> None:
        super().__init__(path)
        self.bundle = bundle

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.staged(iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.store.commit(batchId, _files(messages))

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.store.drop(_files(messages))


class PageJson(D.DataSource):
    bundle = False

    @classmethod
    def name(cls) -> str:
        return "page_json"

    def writer(self, schema, overwrite: bool) -> _BatchWriter:
        if overwrite:
            raise ValueError("pages are added and replaced by commits; write with mode append")
        return _BatchWriter(self.options["path"], self.bundle, int(self.options["commit"]))

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:  # noqa: N802
        return _StreamWriter(self.options["path"], self.bundle)


class PageBundle(PageJson):
    bundle = True

    @classmethod
    def name(cls) -> str:
        return "page_bundle"


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(PageJson)
    spark.dataSource.register(PageBundle)


def page_rows(records: DataFrame, key: str = "snippet_id", columns: list[str] | None = None) -> DataFrame:
    """records (book_id, page_index, ...) as the sinks take them: a page's rows in one task and side by side."""
    kept = columns or [c for c in records.columns if c not in ("book_id", "page_index")]
    rows = records.select("book_id", F.col("page_index").cast("int").alias("page_index"), F.col(key).alias("key"), F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("record"))
    if records.isStreaming:  # a stream's rows can't be sorted; a page's come in one task, a page that alternates with others in several files
        return rows.repartition("book_id", "page_index")
    return rows.repartition("book_id", "page_index").sortWithinPartitions("book_id", "page_index", "key")


def committed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, page_index, commit, file) of every page's files as of its last commit."""
    files = spark.createDataFrame(Store(path).listed(), "book_id string, page_index int, commit long, file string, records long")
    last = F.max("commit").over(W.partitionBy("book_id", "page_index"))
    return files.withColumn("_last", last).where("commit = _last").drop("_last")


def committed_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of schema of all committed pages with book_id, page_index, commit; key too for bundles."""
    pages = committed_pages(spark, path).select("book_id", "page_index", "commit", "file")
    names = [f"{path.rstrip('/')}/{quote(r['file'], safe='/=%')}" if "://" in path else f"{path.rstrip('/')}/{r['file']}" for r in pages.select("file").collect()]  # a name a page
    whole = spark.read.text(names, wholetext=True) if names else spark.createDataFrame([], "value string")
    named = whole.select("value", F.regexp_extract(F.input_file_name(), r"(page-[^/]*)$", 1).alias("_name")) if names else whole.withColumn("_name", F.lit(""))
    rows = named.join(pages.withColumn("_name", F.regexp_extract("file", r"(page-[^/]*)$", 1)), "_name")
    bundles = F.startswith(F.ltrim("value"), F.lit("{"))
    struct = f"struct<{schema}>" if not schema.startswith("struct") else schema
    of_bundle = rows.where(bundles).select("book_id", "page_index", "commit", F.explode(F.from_json("value", f"map<string,{struct}>")).alias("key", "r"))
    of_array = rows.where(~bundles).select("book_id", "page_index", "commit", F.lit(None).cast("string").alias("key"), F.explode(F.from_json("value", f"array<{struct}>")).alias("r"))
    return of_bundle.unionByName(of_array).select("book_id", "page_index", "commit", "key", "r.*")
