"""Small helpers that the operators of this package share."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import run_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lowered and every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_broadcast(df: DataFrame) -> bool:
    """Whether Spark, which knows the size of the stored ``df``, broadcasts it in a join."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names, and its path there."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def ship_package(spark: SparkSession) -> None:
    """Gives Python workers this package, as ``--py-files`` would, from the shared folder, once per context."""
    context = spark.sparkContext
    if getattr(context, "_ledgerline_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    folder = run_folder(spark, "code")
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/ledgerline.zip") as out:
        out.write(archive.getvalue())
    context.addPyFile(f"{folder}/ledgerline.zip")
    context._ledgerline_shipped = True
