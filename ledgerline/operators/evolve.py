"""Changes to one table, each harmless when it is made again.

A change never touches stored rows: it returns a new plan, and Catalyst folds
a whole list of column changes into one projection over the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.types import default_text, spark_type, text_length
from ledgerline.operators.quality import constraint_violations
from ledgerline.session import store


def find_column(df: DataFrame, name: str) -> str | None:
    """The column's own spelling; names compare without case, as catalogs do."""
    return next((c for c in df.columns if c.upper() == name.upper()), None)


def add_column(df: DataFrame, name: str, data_type: T.DataType | str, default: Any = None) -> DataFrame:
    if find_column(df, name):
        return df
    return df.withColumn(name, F.lit(default).cast(data_type))


def modify_column(df: DataFrame, name: str, data_type: T.DataType | str) -> DataFrame:
    """Change the type; a value that does not fit becomes NULL, see :func:`lossy_casts`."""
    found = find_column(df, name)
    return df.withColumn(found, F.col(found).try_cast(data_type)) if found else df


def lossy_casts(df: DataFrame, name: str, data_type: T.DataType | str, length: int | None = None) -> DataFrame:
    """Rows whose value a change of type would lose: it does not fit, or comes back as another.

    ``length`` is what a text may have in characters; a longer one is cut by the database.
    """
    found = find_column(df, name)
    if found is None:
        return df.limit(0)
    value = F.col(found)
    cast = value.try_cast(data_type)
    kind = df.schema[found].dataType
    # A number may be written in another way as text, but has to come back as itself.
    changed = F.lit(False) if isinstance(kind, T.StringType) else F.coalesce(cast.try_cast(kind) != value, F.lit(True))
    too_long = F.length(cast.cast("string")) > length if length is not None else F.lit(False)
    return df.filter(value.isNotNull() & (cast.isNull() | changed | too_long))


def rename_column(df: DataFrame, name: str, new_name: str) -> DataFrame:
    found = find_column(df, name)
    if found is None:
        return df
    if find_column(df, new_name) not in (None, found):
        raise ValueError(f"column {new_name} exists already")
    return df.withColumnRenamed(found, new_name)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    found = find_column(df, name)
    return df.drop(found) if found else df


def apply_update(df: DataFrame, predicate: Column, values: Mapping[str, Column]) -> DataFrame:
    """New values where the predicate holds; all see the row as it was."""
    return df.withColumns(
        {c: F.when(predicate, value).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, value in values.items()}
    )


def apply_delete(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def apply_insert(df: DataFrame, rows: DataFrame, defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """``rows`` added, with defaults or NULL in the columns they lack."""
    missing = {
        c: F.lit(value).cast(df.schema[c].dataType)
        for c, value in (defaults or {}).items()
        if c not in rows.columns
    }
    rows = rows.withColumns(missing) if missing else rows
    typed = rows.select([F.col(c).cast(df.schema[c].dataType) for c in df.columns if c in rows.columns])
    return df.unionByName(typed, allowMissingColumns=True)


def apply_user_step(df: DataFrame, step: Callable[[DataFrame], DataFrame], tolerate_errors: bool = False) -> tuple[DataFrame, str | None]:
    """A user's own DataFrame step. Returns the table and the text of a tolerated error.

    A lazy step fails only when it runs, so tolerating errors means running it
    here; its result is stored, and what follows reads that.
    """
    if not tolerate_errors:
        return step(df), None
    try:
        return store(step(df), "user-step"), None
    except Exception as error:  # whatever the user's step raises
        # Spark's own messages may begin with an empty line.
        return df, next((line.strip() for line in str(error).splitlines() if line.strip()), type(error).__name__)


@dataclass(frozen=True)
class BatchStep:
    """A user's own step over Arrow batches (or pandas frames), for what columns cannot express.

    ``function`` gets an iterator over the batches of one task and yields others; it never
    sees more than a batch at a time, nor can it rely on which rows share one.
    ``adds`` and ``drops`` name the columns it brings or replaces and those it removes; all others it has
    to keep as they are, whatever the changes made before it.
    """

    function: Callable[[Iterator[Any]], Iterator[Any]]
    adds: Mapping[str, T.DataType | str] = field(default_factory=dict)
    drops: Sequence[str] = ()
    pandas: bool = False

    def schema_after(self, schema: T.StructType) -> T.StructType:
        gone = {name.upper() for name in (*self.drops, *self.adds)}
        kept = [f for f in schema.fields if f.name.upper() not in gone]
        added = T.StructType()
        for name, kind in self.adds.items():
            data_type = T.StructType.fromDDL(f"c {kind}")["c"].dataType if isinstance(kind, str) else kind
            added = added.add(name, data_type)
        return T.StructType([*kept, *added.fields])

    def __call__(self, df: DataFrame) -> DataFrame:
        schema, function = self.schema_after(df.schema), self.function
        if self.pandas:
            return df.mapInPandas(function, schema)
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # By name, so that a step may yield columns in any order.
            for batch in function(batches):
                yield batch.select(names)

        return df.mapInArrow(run, schema)


@dataclass
class ReplayResult:
    """Tables by ``(db, table)`` after a replay, and what was found on the way."""

    tables: dict[tuple[str, str], DataFrame]
    constraint_breaks: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)
    lossy_casts: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)
    tolerated_errors: list[str] = field(default_factory=list)


OPERATIONS = {
    "COLUMN": {"ADD", "MODIFY", "RENAME", "DROP"},
    "INDEX": {"ADD", "RENAME", "DROP"},
    "UNIQUE INDEX": {"ADD", "RENAME", "DROP"},
    "CONSTRAINT": {"ADD", "RENAME", "DROP"},
    "TABLE": {"RENAME", "DROP"},
    "DB": {"DROP"},
}


def _verified(item: Mapping[str, str]) -> tuple[str, str]:
    kind, operation = item["object_type"].upper(), item["operation_type"].upper()
    if operation not in OPERATIONS.get(kind, ()):
        raise ValueError(f"{operation} {kind} is not supported: {dict(item)}")
    if operation == "RENAME" and not item.get("new_name"):
        raise ValueError(f"RENAME needs new_name: {dict(item)}")
    return kind, operation


def _change_column(df: DataFrame, operation: str, item: Mapping[str, str]) -> DataFrame:
    name, prop = item["object_name"], item.get("object_property", "")
    if operation == "ADD":
        return add_column(df, name, spark_type(prop), default_text(prop))
    if operation == "MODIFY":
        return modify_column(df, name, spark_type(prop))
    if operation == "RENAME":
        return rename_column(df, name, item["new_name"])
    return drop_column(df, name)


def replay_changes(
    tables: Mapping[tuple[str, str], DataFrame],
    changes: Sequence[Mapping[str, str] | tuple[str, str, Callable[[DataFrame], DataFrame] | str]],
    tolerate_errors: bool = False,
    steps: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> ReplayResult:
    """Tables after an ordered list of changes.

    A change is a change item, or ``(db, table, step)`` for a user's own step: a function of
    a DataFrame, a :class:`BatchStep`, or the name of a script whose step is in ``steps``.
    Changes of absent tables are skipped, except that a column or a constraint
    cannot be added to one. Indexes have no counterpart in Spark and only get
    their item checked. Violations of an added constraint and values lost to a
    change of type come back as DataFrames, nothing is raised for them.
    """
    result = ReplayResult(dict(tables))
    for change in changes:
        if isinstance(change, tuple):
            db, table, step = change
            step = (steps or {})[step] if isinstance(step, str) else step
            result.tables[db, table], error = apply_user_step(result.tables[db, table], step, tolerate_errors)
            if error is not None:
                result.tolerated_errors.append(f"{db}.{table}: {error}")
            continue
        kind, operation = _verified(change)
        db, table, name = change["db_name"], change["table_name"], change["object_name"]
        here = result.tables.get((db, table))
        if here is None and operation == "ADD" and kind in ("COLUMN", "CONSTRAINT"):
            raise ValueError(f"table {db}.{table} does not exist: {dict(change)}")
        if kind == "COLUMN" and here is not None:
            if operation == "MODIFY" and find_column(here, name):
                prop = change["object_property"]
                result.lossy_casts[db, table, name] = lossy_casts(here, name, spark_type(prop), text_length(prop))
            result.tables[db, table] = _change_column(here, operation, change)
        elif kind == "CONSTRAINT" and operation == "ADD":
            siblings = {t: df for (d, t), df in result.tables.items() if d == db}
            result.constraint_breaks[db, table, name] = constraint_violations(
                here, change["object_property"], siblings
            )
        elif kind == "TABLE" and here is not None:
            del result.tables[db, table]
            if operation == "RENAME":
                if (db, change["new_name"]) in result.tables:
                    raise ValueError(f"table {db}.{change['new_name']} exists already")
                result.tables[db, change["new_name"]] = here
        elif kind == "DB":
            result.tables = {key: df for key, df in result.tables.items() if key[0] != db}
    return result
