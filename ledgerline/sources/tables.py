"""State tables and rewritten tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import mask_secrets
from ledgerline.functions.versions import relative_name
from ledgerline.schemas import HISTORY, TASK, names


def history_rows(outcomes: DataFrame) -> DataFrame:
    """Outcomes (service, version, filename, status, message, ts, event_id) as history rows.

    Secrets in messages are masked.
    """
    return outcomes.select(
        F.col("event_id").cast("bigint").alias("f_id"),
        F.col("service").alias("f_service_name"),
        F.col("version").alias("f_version"),
        relative_name("version", "filename").alias("f_script_file_name"),
        F.col("status").alias("f_status"),
        mask_secrets("message").alias("f_message"),
        F.col("ts").cast("timestamp_ntz").alias("f_create_time"),
    )


def append_history(history: DataFrame, path: str) -> None:
    history.select(names(HISTORY)).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def stream_history(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """History as a stream of newly added files."""
    reader = spark.readStream.schema(HISTORY)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_task(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A rewritten table to a path that holds nothing yet; whoever reads it switches afterwards."""
    df.write.mode("errorifexists").parquet(path)
