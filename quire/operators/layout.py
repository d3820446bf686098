"""Layout on rows: runs with gaps joined (gaps and islands), reading order of snippets, images in frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import images


def runs(profile: DataFrame, key: str, at: str, gap: int, least: int) -> DataFrame:
    """Runs (key, start, end) of positive values of profile (key, at, value), at most gap apart joined, short ones dropped."""
    by = W.partitionBy(key).orderBy(at)
    ink = profile.where("value > 0").select(key, at)
    new = F.coalesce(F.col(at) - F.lag(at).over(by) - 1 > gap, F.lit(True))
    marked = ink.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(by))
    out = marked.groupBy(key, "_run").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"))
    return out.where(F.col("end") - F.col("start") >= least).select(key, "start", "end")


def sequenced(boxes: DataFrame, page: str) -> DataFrame:
    """boxes with their sequence on the page: columns from the left, then from the top."""
    return boxes.withColumn("sequence", F.row_number().over(W.partitionBy(page).orderBy("column_index", "y0")) - 1)


SNIPPETS = "path string, sequence int, column_index int, x0 int, y0 int, x1 int, y1 int"


def sliced(pages: DataFrame) -> DataFrame:
    """Snippet boxes of pages (path, width, height, content: one byte per pixel, row by row)."""

    def slice_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, seq, i, *box) for path, w, h, raw in pdf.itertuples(index=False) for seq, i, box in images.snippets(np.frombuffer(raw, np.uint8).reshape(h, w))]
            yield pd.DataFrame(rows, columns=["path", "sequence", "column_index", "x0", "y0", "x1", "y1"])

    return pages.select("path", "width", "height", "content").mapInPandas(slice_pages, SNIPPETS)


def _per_image(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(row) for each row, giving tuples of schema's columns, a batch's together."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([work(row) for row in pdf.itertuples(index=False)], columns=names)

    return rows.mapInPandas(run, schema)


PAGES = "path string, width int, height int, content binary"


def _grey(row) -> np.ndarray:
    return np.frombuffer(row.content, np.uint8).reshape(row.height, row.width)


def trimmed(crops: DataFrame) -> DataFrame:
    """crops (path, width, height, content) down to their ink with a margin."""

    def work(row):
        out = images.trimmed(_grey(row))
        return row.path, out.shape[1], out.shape[0], np.ascontiguousarray(out).tobytes()

    return _per_image(crops.select("path", "width", "height", "content"), work, PAGES)
