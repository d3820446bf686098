"""Corpus pipeline: language ID, n-gram Jaccard join, secret scans, mixing to target weights, best-fit packing.

Each stage works on all rows that its predecessor kept and returns the columns of documents, the last one pieces with
their places. Stages are written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard_join, language_id, mixing, packing, secrets
from quire.llm.common import quoted, stored, with_month_intervals, without_month_intervals

#: Documents whose best language has a lower mean probability are rejected; four languages' chance level is 0.25.
LEAST_SCORE = 0.3
REDACTED = "[REDACTED]"
#: What the stages add to rows for themselves is named so.
OWN = "_quire_"


def own_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(quoted(c)) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letter in them (null texts too), or no language that stands out.

    Repeated rows are judged alike; every other row and column is returned as it came."""
    names = f"{OWN}lang_pred", f"{OWN}score"
    kept = language_id.predicted(without_month_intervals(docs), language_id.learned(docs), names).where((F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE))
    return with_month_intervals(own_columns(kept, docs), docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked documents: the smallest doc_id's, a null one last; of rows that repeat an
    id in a component one stays, of rows that repeat it in different components each. Rows without words stay."""
    return with_month_intervals(jaccard_join.without_duplicates(without_month_intervals(docs)), docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in the texts; no document goes. n_chars, if there is such a column, follows the text.

    Null texts stay null, repeated rows are changed alike, every other column is returned as it came."""
    clean = secrets.scanned(without_month_intervals(docs), redact=REDACTED, prefix=OWN)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col(f"{OWN}spans") != "", F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return with_month_intervals(own_columns(clean, docs), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources' words come near their targets.

    Rows are taken whole, each a number of times that its id (or, without one, its text) decides; see mixing.py."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places; every row, repeated or without id or text, is a document of its own; see packing.py."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("secret_scans", scan_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Learned and hash-based stages; tests/llm/test_pipeline.py holds each stage against a plain version on small rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
