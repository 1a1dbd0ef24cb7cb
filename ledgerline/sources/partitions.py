"""UPDATE and DELETE on a table stored in partitions: only those with matching rows are written again.

The predicate is evaluated once over its own columns, which gives the folders that
hold a row it is true for: at most as many as the table has partitions, which Spark
lists on the driver anyhow. Those alone are read in full, changed as by
``apply_update`` and ``apply_delete``, and put in place with Spark's dynamic
partition overwrite, without a shuffle: a task writes the partitions it reads. Files of
other partitions stay as they are.

Spark moves new files in place when the job commits, so lost executors do no harm.
Readers that run at that moment may see partitions of both states, as with any table
of plain files. A partition that loses all rows loses its folder as well. Predicates that
are unknown for a row do not touch it. A table without rows stays without rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.evolve import apply_delete, apply_update


@dataclass(frozen=True)
class PartitionedTable:
    """Where a table lies, its columns (those of partitions included) and what it is partitioned by."""

    spark: SparkSession
    path: str
    schema: T.StructType
    partition_by: tuple[str, ...]

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)


def write_partitioned(df: DataFrame, path: str, partition_by: Sequence[str]) -> PartitionedTable:
    """``df`` as a new table; tasks get whole partitions, big ones are split by adaptive execution."""
    hinted = df.hint("rebalance", *map(F.col, partition_by))
    hinted.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return PartitionedTable(df.sparkSession, path, df.schema, tuple(partition_by))


def _folders(table: PartitionedTable, predicate: Column) -> tuple[list[str], list[str]]:
    """Folders with a row the predicate is true for, and those of them without any other row."""
    hit = F.coalesce(predicate, F.lit(False))
    found = (
        table.read()
        .select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), hit.alias("hit"))
        .groupBy("folder")
        .agg(F.bool_or("hit").alias("touched"), F.bool_and("hit").alias("whole"))
        .filter("touched")
        .collect()
    )
    return [row.folder for row in found], [row.folder for row in found if row.whole]


def _path(folder: str) -> str:
    """A folder as paths are written: Spark gives the names of files as URIs."""
    parts = urlsplit(folder)
    return f"{parts.scheme}://{parts.netloc}{unquote(parts.path)}"


def _rewrite(table: PartitionedTable, folders: Sequence[str], change) -> None:
    if not folders:
        return
    touched = (
        table.spark.read.schema(table.schema).option("basePath", table.path).parquet(*map(_path, folders)).select(table.schema.names)
    )
    writer = change(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*table.partition_by).parquet(table.path)


def update_partitions(table: PartitionedTable, predicate: Column, values: Mapping[str, Column]) -> list[str]:
    """The table of ``apply_update``. Returns the folders that were written again.

    A partition column cannot get a new value: the row would have to move.
    """
    moved = {c.upper() for c in values} & {c.upper() for c in table.partition_by}
    if moved:
        raise ValueError(f"partition columns keep their values: {sorted(moved)}")
    folders, _ = _folders(table, predicate)
    _rewrite(table, folders, lambda df: apply_update(df, predicate, values))
    return sorted(map(_path, folders))


def delete_from_partitions(table: PartitionedTable, predicate: Column) -> list[str]:
    """The table of ``apply_delete``. Returns the folders that were written again or removed."""
    folders, whole = _folders(table, predicate)
    _rewrite(table, [f for f in folders if f not in set(whole)], lambda df: apply_delete(df, predicate))
    # Dynamic overwrite leaves a partition that gets no rows alone, so an emptied one goes by itself.
    for folder in map(_path, whole):
        path = table.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.spark._jsc.hadoopConfiguration()).delete(path, True)
    return sorted(map(_path, folders))
