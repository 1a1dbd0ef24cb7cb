"""Facts about columns, from Spark tables or from the catalog of a database."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schemas import COLUMN_FACTS
from ledgerline.session import store

# Spark types and the type name their values have in every dialect.
_TYPE_NAMES = {
    T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT",
    T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.DecimalType: "DECIMAL", T.BooleanType: "BOOLEAN",
    T.StringType: "VARCHAR", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "DATETIME",
}


def column_facts(tables: Mapping[tuple[str, str], DataFrame], dialect: str = "mariadb") -> DataFrame:
    """Facts of the columns of DataFrames by ``(db, table)``, from their schemas alone."""
    rows = []
    for (db, table), df in tables.items():
        for position, column in enumerate(df.schema):
            kind = column.dataType
            length = f"{kind.precision},{kind.scale}" if isinstance(kind, T.DecimalType) else None
            rows.append(
                (
                    dialect, db, table, column.name, position, _TYPE_NAMES.get(type(kind), kind.simpleString().upper()),
                    length, False, column.nullable, None, None, None, None, column.metadata.get("comment"),
                )
            )
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, COLUMN_FACTS)


def _footer_reader():
    """A function made here travels with the job, to workers that do not have this package."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        names = ["path", "ordinal", "column_name", "arrow_type", "is_nullable"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            rows = []
            for path in batch["path"].to_pylist():
                local = path.removeprefix("file:") if path.startswith("file:") else path
                files, name = (pafs.LocalFileSystem(), "/" + local.lstrip("/")) if "://" not in local else pafs.FileSystem.from_uri(path)
                with files.open_input_file(name) as source:
                    schema = pq.read_schema(source)
                rows += [(path, k, field.name, str(field.type), field.nullable) for k, field in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    return footers


# Arrow types and the type name their values have in every dialect.
_ARROW_NAMES = {
    "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "bool": "BOOLEAN",
    "string": "VARCHAR", "large_string": "VARCHAR", "binary": "BLOB", "date32[day]": "DATE",
}


def stored_facts(spark: SparkSession, root: str, dialect: str = "mariadb", db_name: str = "", files_per_task: int = 8) -> DataFrame:
    """Facts of the columns of all Parquet tables (``<name>.parquet``, a file or a folder of part files) below a folder.

    The footers are read in tasks, some files each, and merged by table: the number of
    tables does not matter to the driver. A column is nullable if it is in any file; its
    type and place are those of the table's first file by name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    files = store(files, "table-files")
    n_tasks = max(1, -(-files.count() // files_per_task))
    found = files.repartition(n_tasks, "path").mapInArrow(_footer_reader(), "path string, ordinal int, column_name string, arrow_type string, is_nullable boolean")
    below = F.regexp_extract("path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1)
    merged = found.groupBy(below.alias("table_name"), "column_name").agg(
        F.min(F.struct("path", "ordinal", "arrow_type")).alias("first"), F.max("is_nullable").alias("is_nullable")
    )
    arrow, names = F.col("first.arrow_type"), F.create_map(*(F.lit(x) for pair in _ARROW_NAMES.items() for x in pair))
    precision = F.regexp_extract(arrow, r"^decimal128\((\d+, ?\d+)\)$", 1)
    data_type = (
        F.when(precision != "", "DECIMAL").when(arrow.startswith("timestamp") & arrow.contains("tz="), "TIMESTAMP").when(arrow.startswith("timestamp"), "DATETIME")
        .otherwise(F.coalesce(F.try_element_at(names, arrow), F.upper(arrow)))
    )
    void = F.lit(None).cast("string")
    return merged.select(
        F.lit(dialect).alias("dialect"), F.lit(db_name).alias("db_name"), "table_name", "column_name", F.col("first.ordinal").alias("ordinal"),
        data_type.alias("data_type"), F.when(precision != "", F.replace(precision, F.lit(" "), F.lit(""))).alias("type_length"), F.lit(False).alias("is_unsigned"), "is_nullable",
        *[void.alias(name) for name in ("identity", "charset", "collate", "column_default", "comment")],
    )


# Fields of the catalog of dm8, by the names that the others use.
_DM8_FIELDS = {
    "TABLE_SCHEMA": "OWNER", "ORDINAL_POSITION": "COLUMN_ID", "CHARACTER_MAXIMUM_LENGTH": "DATA_LENGTH", "COLUMN_DEFAULT": "DATA_DEFAULT",
    "IS_NULLABLE": "NULLABLE",
}


def catalog_facts(columns: DataFrame, dialect: str) -> DataFrame:
    """Facts from rows of a database's column catalog, whatever the case of its field names."""
    have = {c.upper(): c for c in columns.columns}
    if dialect == "dm8":
        have |= {name: have[own] for name, own in _DM8_FIELDS.items() if own in have and name not in have}

    def field(name: str, cast: str = "string"):
        return F.col(have[name]).cast(cast) if name in have else F.lit(None).cast(cast)

    data_type = F.upper(field("DATA_TYPE"))
    if dialect == "kdb9":
        data_type = F.when(data_type == "USER-DEFINED", F.upper(field("COLUMN_TYPE"))).otherwise(data_type)
    return columns.select(
        F.lit(dialect).alias("dialect"),
        field("TABLE_SCHEMA").alias("db_name"),
        field("TABLE_NAME").alias("table_name"),
        field("COLUMN_NAME").alias("column_name"),
        field("ORDINAL_POSITION", "int").alias("ordinal"),
        data_type.alias("data_type"),
        F.coalesce(field("CHARACTER_MAXIMUM_LENGTH"), field("NUMERIC_PRECISION")).alias("type_length"),
        F.coalesce(field("COLUMN_TYPE").rlike("(?i)unsigned"), F.lit(False)).alias("is_unsigned"),
        F.upper(field("IS_NULLABLE")).isin("YES", "Y").alias("is_nullable"),
        field("EXTRA").alias("identity"),
        field("CHARACTER_SET_NAME").alias("charset"),
        field("COLLATION_NAME").alias("collate"),
        field("COLUMN_DEFAULT").alias("column_default"),
        field("COLUMN_COMMENT").alias("comment"),
    )


def read_catalog(spark: SparkSession, url: str, dialect: str, **options: str) -> DataFrame:
    """Facts of all tables of a database in one query over JDBC. Needs its driver on the class path."""
    rows = (
        spark.read.format("jdbc")
        .options(url=url, query=f"SELECT * FROM {'ALL_TAB_COLUMNS' if dialect == 'dm8' else 'INFORMATION_SCHEMA.COLUMNS'}", **options)
        .load()
    )
    return catalog_facts(rows, dialect)
