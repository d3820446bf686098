"""Sources: run files, corrections over many runs, page images, memory logs, gzip bundles, tables of other stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.export import bundle_members

READING = "struct<text:string,avg_confidence:double>"
# The schema is declared: a run of one engine lacks fields that inference would drop.
RECORD_DDL = (
    "book_id string, page_number int, side string, paragraph_sequence int, column_index int, bbox array<int>, image_patch_path string, page_image_path string, "
    f"easyocr {READING}, tesseract {READING}, surya {READING}, refined struct<text:string,model:string>, "
    "flags struct<single_engine:string,disagreement:boolean,majority_agreement:boolean,low_confidence:boolean,surya_suspect:boolean,refine_failed:string,"
    "similarity:struct<easyocr_tesseract:double,easyocr_surya:double,tesseract_surya:double>>"
)
MEMORY_LOG = "at timestamp, process string, rss_mb double, available_mb double"


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of run files, each one JSON array; a file that can't be read as one gives no rows."""
    rows = spark.read.schema(RECORD_DDL + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def tagged_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Correction rows of all runs with the name of the run's folder; columns that a run lacks are null."""
    rows = spark.read.option("mergeSchema", True).parquet(glob)
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3))


def combined(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def page_files(spark: SparkSession, folder: str, first: int | None = None, pattern: str = "*.tif") -> DataFrame:
    """Page images in order of their names, the first ones if asked; contents are read only where selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).orderBy("path")
    return files.limit(first) if first is not None else files


def newest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The folder of the run file that was changed last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").load(folder)
    return files.agg(F.max_by(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.struct("modificationTime", "path")).alias("run"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose first 1024 bytes hold the PDF mark."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(F.instr(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), "%PDF") > 0)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Rows (snippet_id, readings) of gzip bundles: one JSON object each, in lines of some members (see export.bundles) or in one."""
    fields = f"map<string,struct<easyocr:{READING},tesseract:{READING},surya:{READING}>>"
    return spark.read.text(path).select(F.explode(F.from_json(bundle_members(F.col("value")), fields)).alias("snippet_id", "readings"))


def memory_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MEMORY_LOG).option("header", True).csv(folder)


def table(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A parameterised query over registered tables."""
    return spark.sql(sql, args=args)


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of another store, given a driver on the class path; pass partitionColumn and bounds for a parallel read."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()
