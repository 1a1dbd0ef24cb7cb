"""Script trees ``<service>/<db_type>/<version>/<file>`` as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.versions import is_version

def _path_below(path: Column, root: str) -> Column:
    """Part of a file path after the root folder, whatever scheme the path has."""
    root = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.substring_index(path, f"{root}/", -1)


def _with_parts(files: DataFrame, root: str) -> DataFrame:
    parts = F.split(_path_below(F.col("path"), root), "/")
    return (
        files.withColumn("_parts", parts)
        .filter(F.size("_parts") >= 4)
        .withColumns(
            {
                "service": F.col("_parts")[0],
                "db_type": F.col("_parts")[1],
                "version": F.col("_parts")[2],
                "filename": F.element_at("_parts", -1),
                "depth": F.size("_parts"),
            }
        )
        .drop("_parts")
    )


def scan_scripts(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of all files in version directories: service, db_type, version, filename, depth.

    Only paths are used, so file contents are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return (
        _with_parts(files, root)
        .filter(is_version("version"))
        .select("service", "db_type", "version", "filename", "depth")
    )


def scan_script_text(spark: SparkSession, root: str, suffix: str = ".sql") -> DataFrame:
    """Scripts with their whole text in ``text``."""
    files = (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .text(root, wholetext=True, recursiveFileLookup=True)
        .select(F.col("value").alias("text"), F.url_decode("_metadata.file_path").alias("path"))
    )
    return _with_parts(files, root).select("service", "db_type", "version", "filename", "depth", "text")


def parse_change_lists(files: DataFrame, text: str = "text") -> DataFrame:
    """``items`` from JSON text: a map from field to JSON value per item, in order.

    The list is NULL when the text is no JSON list, an item is NULL when it is
    no object. Values keep their JSON type, which the rules look at.
    """
    return files.withColumn("items", F.try_variant_get(F.try_parse_json(text), "$", "array<map<string,variant>>"))


def item_fields(items: DataFrame) -> DataFrame:
    """``item`` maps spread into text columns, beside the other columns."""
    fields = [
        "db_name", "table_name", "object_type", "operation_type", "object_name", "object_property",
        "object_comment", "new_name",
    ]
    return items.withColumns({f: F.col("item").getItem(f).cast("string") for f in fields}).drop("item")


def change_items(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per change item with its fields as text, ``file_id`` and ``ord``."""
    parsed = parse_change_lists(files, text)
    return item_fields(parsed.select("file_id", F.posexplode("items").alias("ord", "item")))


def scan_change_lists(spark: SparkSession, root: str) -> DataFrame:
    """Items of all ``.json`` scripts below a root."""
    files = scan_script_text(spark, root, ".json").withColumn(
        "file_id", F.concat_ws("/", "service", "db_type", "version", "filename")
    )
    return change_items(files)
