"""Files: JSON lines of requests and results, background texts, trees, and tables that runs append to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = (
    "custom_id string, error string, response struct<status_code:int,body:struct<id:string,created:bigint,model:string,"
    "choices:array<struct<index:int,message:struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>,finish_reason:string>>,"
    "usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>>"
)


def write_requests(requests: DataFrame, path: str, column: str = "request") -> None:
    """One JSON object per line."""
    requests.select(column).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines, parsed; a broken line keeps its text and nulls."""
    return parse_results(spark.read.text(path).select(F.col("value").alias("line")))


def parse_results(lines: DataFrame, line: str = "line") -> DataFrame:
    """The fields of each result line behind its other columns; a broken line gets nulls."""
    return lines.withColumn("_r", F.from_json(F.col(line), RESULT)).select(*lines.columns, "_r.*")


def fetch_results(spark: SparkSession, status: str, path: str) -> DataFrame:
    """By the status of a batch: its results if completed, an error if it ended otherwise, none while it runs."""
    if status in ("failed", "expired", "cancelled"):
        raise RuntimeError(f"batch {status}")
    return read_results(spark, path) if status == "completed" else spark.createDataFrame([], f"line string, {RESULT}")


def _plain_name(name: Column) -> Column:
    """File names come with percent signs for some marks."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_backgrounds(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, text) of a folder of texts named by question."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("_f"))
    return files.select(F.regexp_replace(_plain_name(F.col("_f")), r"\.txt$", "").alias("question_id"), F.col("value").alias("text"))


def read_trees(spark: SparkSession, folder: str) -> DataFrame:
    """(muni, tree_json), one file per municipality; the key is the file's name."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("_f"))
    return files.select(F.regexp_replace(_plain_name(F.col("_f")), r"\.json$", "").alias("muni"), F.col("value").alias("tree_json"))


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sheet saved as CSV, with a declared schema; blanks are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("multiLine", True).csv(path)


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    """To an accumulated table (results, errors, embeddings, queue), partitioned if asked for."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def catalogue(spark: SparkSession, path: str, by: str = "muni") -> DataFrame:
    """What an appended table already holds."""
    return spark.read.parquet(path).select(by).distinct()


STATUS = "run string, batch_id string, needs_work boolean, written_at timestamp"


def write_status(spark: SparkSession, path: str, run: str, batch_id: str | None, needs_work: bool) -> None:
    """What a run leaves for the next one: the batch it waits for, and whether there is work left. Appended; the latest row counts."""
    row = spark.createDataFrame([(run, batch_id, needs_work)], "run string, batch_id string, needs_work boolean")
    row.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_status(spark: SparkSession, path: str, run: str) -> tuple[str | None, bool]:
    """(batch id, whether there is work) of a run; (None, True) for one that has left nothing."""
    try:
        rows = spark.read.schema(STATUS).parquet(path)
    except AnalysisException:  # no run has written yet
        return None, True
    last = rows.where(F.col("run") == run).orderBy(F.desc("written_at")).limit(1).collect()
    return (last[0]["batch_id"], last[0]["needs_work"]) if last else (None, True)


class FolderSubmitter:
    """Submits a batch as JSON lines in a folder of its own; its id is a hash of its requests, so the same batch has the same id."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def submit(self, requests: DataFrame, column: str = "request") -> str:
        parts = requests.agg(F.count("*"), F.sum(F.xxhash64(column).cast("decimal(38,0)"))).first()
        batch_id = f"batch_{parts[0]}_{int(parts[1] or 0) & (1 << 64) - 1:016x}"
        write_requests(requests, f"{self.folder}/{batch_id}", column)
        return batch_id
