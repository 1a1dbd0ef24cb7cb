"""Rules on script trees, statements, change items and table definitions.

Every rule returns its violations as rows of one schema. Nothing is raised and
no rule hides what another finds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import (
    database_of_switch,
    default_value,
    family,
    has_illegal_characters,
    is_blank_statement,
    leading_type_length,
    per_dialect,
    statement_object,
    statement_verb,
    switches_database,
    type_name,
)
from ledgerline.functions.versions import (
    INIT_FILE,
    compare_versions,
    has_script_extension,
    is_strict_script_name,
    is_version,
    script_number,
)
from ledgerline.operators.skew import key_counts
from ledgerline.session import store

ERROR, WARN = "error", "warn"

# The forms of names, by what is named.
NAME_PATTERNS = {
    "table": r"\At_[a-z0-9_]{1,62}\z",
    "index": r"\Aidx_[a-z0-9_]{1,60}\z",
    "unique_index": r"\Auk_[a-z0-9_]{1,61}\z",
}

# Column types that take no default, integer types that take no
# length, table options a definition may hold.
NO_DEFAULT_TYPES = ["TEXT", "MEDIUMTEXT", "LONGTEXT", "BLOB", "JSON"]
NO_LENGTH_TYPES = ["INT", "INTEGER", "TINYINT", "SMALLINT", "BIGINT"]
TABLE_OPTIONS = {
    "mariadb": [
        "DEFAULT", "ENGINE", "AUTO_INCREMENT", "CHARSET", "CHARACTER", "COLLATE", "COMMENT", "ROW_FORMAT",
        "AVG_ROW_LENGTH", "MAX_ROWS", "MIN_ROWS", "PACK_KEYS", "CHECKSUM", "DELAY_KEY_WRITE",
        "CONNECTION", "DATA", "INDEX", "SET",
    ],
    "dm8": [],
    "kdb9": [],
}

# Statements allowed besides the one that switches the database,
# as verb and object, or the verb alone where any object will do.
_IN_BOTH_KINDS = [
    "CREATE TABLE", "CREATE UNIQUE INDEX", "CREATE INDEX", "CREATE VIEW", "CREATE OR REPLACE VIEW", "INSERT",
]
_IN_UPDATES = ["UPDATE", "DELETE", "DROP INDEX", "DROP TABLE", "DROP VIEW", "ALTER TABLE"]
_DM8_ONLY = ["SET IDENTITY_INSERT", "COMMENT ON TABLE", "COMMENT ON COLUMN"]
ALLOWED_STATEMENTS = {
    ("mariadb", "init"): _IN_BOTH_KINDS,
    ("mariadb", "update"): [*_IN_BOTH_KINDS, *_IN_UPDATES, "RENAME"],
    ("dm8", "init"): [*_IN_BOTH_KINDS, *_DM8_ONLY],
    ("dm8", "update"): [*_IN_BOTH_KINDS, *_IN_UPDATES, *_DM8_ONLY],
    ("kdb9", "init"): _IN_BOTH_KINDS,
    ("kdb9", "update"): [*_IN_BOTH_KINDS, *_IN_UPDATES],
}

# What a change item must hold.
REQUIRED_ITEM_FIELDS = [
    "db_name", "table_name", "object_type", "operation_type", "object_name", "object_property", "object_comment",
]
OBJECT_TYPES = ["COLUMN", "INDEX", "UNIQUE INDEX", "CONSTRAINT", "TABLE", "DB"]
OPERATION_TYPES = ["ADD", "DROP", "MODIFY", "RENAME"]


def violation(
    df: DataFrame,
    rule: str | Column,
    severity: str | Column = ERROR,
    db_name: str | Column | None = None,
    table_name: str | Column | None = None,
    object_name: str | Column | None = None,
    file_id: str | Column | None = None,
    detail: str | Column | None = None,
) -> DataFrame:
    """Rows of ``df`` as violations. Strings name columns, except rule and severity."""

    def value(given: str | Column | None) -> Column:
        if given is None:
            return F.lit(None)
        return F.col(given) if isinstance(given, str) else given

    columns = {
        "rule": F.lit(rule) if isinstance(rule, str) else rule,
        "severity": F.lit(severity) if isinstance(severity, str) else severity,
        "db_name": value(db_name),
        "table_name": value(table_name),
        "object_name": value(object_name),
        "file_id": value(file_id),
        "detail": value(detail),
    }
    return df.select([column.cast("string").alias(name) for name, column in columns.items()])


def union_all(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def _broken_rules(df: DataFrame, rules: Sequence[tuple[Column, str]], **where) -> DataFrame:
    """One violation per broken rule of a row; all rules are tested in one pass over ``df``."""
    return violation(_with_broken(df, rules), F.col("_rule"), **where)


def _with_broken(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """A row per broken rule, which ``_rule`` names.

    An outer explode, since Spark puts a filter below a plain one that tests all rules once more.
    """
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for condition, rule in rules]))
    return df.withColumn("_rule", F.explode_outer(broken)).filter("_rule IS NOT NULL")


# --- script trees ---------------------------------------------------------


def _file(*parts: str) -> Column:
    return F.concat_ws("/", *parts)


def file_name_rules(scripts: DataFrame) -> DataFrame:
    """Subdirectories, files that are no scripts, and script names of the wrong form."""
    direct = F.col("depth") == 4
    script = has_script_extension("filename")
    return _broken_rules(
        scripts.filter(is_version("version")),
        [
            (F.col("depth") > 4, "subdirectory_in_version"),
            (direct & ~script, "unknown_file"),
            (
                direct & script & (F.col("filename") != INIT_FILE) & ~is_strict_script_name("filename"),
                "bad_script_name",
            ),
        ],
        object_name="filename",
        file_id=_file("service", "db_type", "version", "filename"),
    )


def duplicate_numbers(scripts: DataFrame) -> DataFrame:
    """Script numbers that more than one file of a version has, with first and last file name."""
    numbered = scripts.filter(
        is_version("version") & (F.col("depth") == 4) & is_strict_script_name("filename")
    ).withColumn("seq", script_number("filename"))
    return (
        numbered.groupBy("service", "db_type", "version", "seq")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.min("filename").alias("first_file"),
            F.max("filename").alias("last_file"),
        )
        .filter(F.col("n_files") > 1)
    )


def duplicate_number_rule(scripts: DataFrame) -> DataFrame:
    return violation(
        duplicate_numbers(scripts),
        "duplicate_script_number",
        object_name="seq",
        file_id=_file("service", "db_type", "version"),
        detail=F.concat_ws(", ", "first_file", "last_file"),
    )


def missing_init_rule(versions: DataFrame) -> DataFrame:
    """Versions (of a version index) without ``init.sql``."""
    return violation(
        versions.filter(F.col("has_init") == 0),
        "missing_init",
        file_id=_file("service", "db_type", "version"),
    )


def empty_version_rule(listed: DataFrame, versions: DataFrame) -> DataFrame:
    """Listed version directories (service, db_type, version) in which no file is."""
    key = ["service", "db_type", "version"]
    return violation(
        listed.filter(is_version("version")).join(versions.select(key), key, "left_anti"),
        "empty_version",
        file_id=_file(*key),
    )


def bad_version_rule(comparisons: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs that cannot be compared since one side is no version."""
    broken = comparisons.filter(compare_versions(left, right).isNull())
    return violation(broken, "not_a_version", detail=F.concat_ws(" : ", left, right))


# --- statements -----------------------------------------------------------


def statements_to_check(statements: DataFrame) -> DataFrame:
    return statements.filter(~is_blank_statement("sql"))


def supported(df: DataFrame) -> DataFrame:
    return df.filter(family("dialect").isNotNull())


def unsupported_dialects(statements: DataFrame) -> DataFrame:
    """Files of databases that no rule is known for; nothing else is said about them."""
    files = statements.filter(family("dialect").isNull()).select("dialect", "file_kind", "file_id").distinct()
    return violation(files, "unsupported_dialect", file_id="file_id", detail="dialect")


def first_statement_rule(statements: DataFrame) -> DataFrame:
    """Files whose first statement does not switch the database.

    The first statement is the least position of a file of one kind: a
    number found by a hash aggregation, then met by the statement itself. Null
    names of files or kinds, and files without positions, meet their like.
    """
    checked = supported(statements_to_check(statements))
    file = ["dialect", "file_kind", "file_id"]
    places = store(checked.groupBy(*file).agg(F.min("ord").alias("ord")), "first-statements")
    at = [*file, "ord"]
    places = places.select(*[F.col(c).alias(f"_{c}") for c in at])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at])
    first = checked.join(places, same).groupBy(*file).agg(F.min("sql").alias("sql"))
    return violation(
        first.filter(~switches_database("sql", "dialect")), "first_statement_must_switch", file_id="file_id", detail="sql"
    )


def statement_allow_list(statements: DataFrame) -> DataFrame:
    """Statements that their dialect and kind of file do not allow.

    The list is a few dozen fixed entries, so it is part of the filter and
    needs neither a join nor a shuffle. A statement is looked up by its words
    once with its object and once without.
    """
    entries = [f"{d} {kind} {words}" for (d, kind), allowed in ALLOWED_STATEMENTS.items() for words in allowed]
    with_object = F.concat_ws(" ", family("dialect"), "file_kind", statement_verb("sql"), statement_object("sql"))
    without_object = F.concat_ws(" ", family("dialect"), "file_kind", statement_verb("sql"))
    allowed = with_object.isin(entries) | without_object.isin(entries) | switches_database("sql", "dialect")
    return violation(
        supported(statements_to_check(statements)).filter(~allowed),
        "statement_not_allowed",
        object_name=F.concat_ws(" ", statement_verb("sql"), statement_object("sql")),
        file_id="file_id",
        detail="sql",
    )


def current_database(
    statements: DataFrame,
    switched_to: Column,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
) -> DataFrame:
    """``current_db`` per row: the database of the last switch at or before it.

    ``chunk`` must not decrease along ``order``. Windows run within a chunk; a
    second window over one row per chunk carries the last switch of earlier
    chunks in, so a long file is worked on by as many tasks as it has chunks.
    """
    keys, chunk_key = list(keys), [*keys, "_chunk"]
    rows = statements.withColumns({"_switch": switched_to, "_chunk": chunk})
    last_of_chunk = rows.groupBy(*chunk_key).agg(
        F.max_by("_switch", F.when(F.col("_switch").isNotNull(), F.struct(*order))).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_chunk.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    so_far = Window.partitionBy(*chunk_key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("_own", F.last("_switch", ignorenulls=True).over(so_far))
        .join(carried, chunk_key)
        .withColumn("current_db", F.coalesce("_own", "_carried"))
        .drop("_switch", "_chunk", "_own", "_carried")
    )


def statement_databases(statements: DataFrame, chunk_size: int = 65_536) -> DataFrame:
    """Database in force at each statement of a file."""
    return current_database(
        statements,
        database_of_switch("sql", "dialect"),
        ["dialect", "file_id"],
        ["ord"],
        F.floor(F.col("ord") / chunk_size),
    )


# --- change items ---------------------------------------------------------


def change_rules(files: DataFrame) -> DataFrame:
    """Change files that are no JSON list or an empty one, items that are no object, missing or non-text
    fields, unknown object and operation types, and the rules on the columns that items add.

    ``files``: file_id, dialect and ``items``, arrays of maps from field to JSON value. All of it is one
    pass: a text is parsed once, a value looked at once. A file without items is one row without ``ord``.
    """
    rows = files.select(
        "file_id", "dialect", F.col("items").isNull().alias("_no_list"), F.posexplode_outer("items").alias("ord", "item")
    )
    value = {field: F.col("item").getItem(field) for field in REQUIRED_ITEM_FIELDS}
    # A field that is there has a value, if only JSON's null.
    described = rows.select(
        "file_id", "dialect", "ord", "_no_list", F.col("item").isNotNull().alias("_is_object"),
        *[F.schema_of_variant(v).alias(f"_kind_{field}") for field, v in value.items()],
        *[v.cast("string").alias(field) for field, v in value.items()],
    )
    for part, parsed in _ADDED_PARTS.items():
        described = described.withColumn(part, F.when(_adds_column(), parsed("object_property")))

    def text(field: str) -> Column:
        return F.when(F.col(f"_kind_{field}") == "STRING", F.col(field))

    is_item, is_object = F.col("ord").isNotNull(), F.col("_is_object")
    rules: list[tuple[Column, str]] = [
        (F.col("_no_list"), "not_a_json_list"),
        (~F.col("_no_list") & ~is_item, "empty_change_list"),
        (is_item & ~is_object, "item_not_an_object"),
    ]
    for field in REQUIRED_ITEM_FIELDS:
        rules.append((is_object & F.col(f"_kind_{field}").isNull(), f"missing_field:{field}"))
        rules.append((F.col(f"_kind_{field}") != "STRING", f"field_not_text:{field}"))
    rules.append((~text("object_type").isin(OBJECT_TYPES), "unknown_object_type"))
    rules.append((~text("operation_type").isin(OPERATION_TYPES), "unknown_operation_type"))
    column_rules = _column_conditions()
    of_column = F.col("_rule").isin([rule for _, rule in column_rules])

    def either(on_column: Column, on_item: Column) -> Column:
        return F.when(of_column, on_column).otherwise(on_item)

    return violation(
        _with_broken(described, [*rules, *column_rules]),
        F.col("_rule"),
        db_name=either(F.col("db_name"), text("db_name")),
        table_name=either(F.col("table_name"), text("table_name")),
        object_name=either(F.col("object_name"), text("object_name")),
        file_id=F.when(~of_column, F.col("file_id")),
        detail=either(_column_type(), F.col("ord").cast("string")),
    )


def _adds_column() -> Column:
    return (F.col("object_type") == "COLUMN") & (F.col("operation_type") == "ADD")


# What the property of an added column says.
_ADDED_PARTS = {"data_type": type_name, "type_length": leading_type_length, "column_default": default_value}


def added_columns(items: DataFrame) -> DataFrame:
    """Columns that change items (with ``dialect``) add, in the form the column rules take."""
    return items.filter(_adds_column()).select(
        "dialect",
        "db_name",
        "table_name",
        F.col("object_name").alias("column_name"),
        *[parsed("object_property").alias(part) for part, parsed in _ADDED_PARTS.items()],
    )


# --- names ----------------------------------------------------------------


def table_name_rule(tables: DataFrame) -> DataFrame:
    return violation(
        tables.filter(~F.col("table_name").rlike(NAME_PATTERNS["table"])),
        "table_name",
        WARN,
        "db_name",
        "table_name",
        "table_name",
    )


def index_name_rule(indexes: DataFrame) -> DataFrame:
    wrong = F.when(F.col("kind") == "INDEX", ~F.col("index_name").rlike(NAME_PATTERNS["index"])).when(
        F.col("kind") == "UNIQUE", ~F.col("index_name").rlike(NAME_PATTERNS["unique_index"])
    )
    return violation(indexes.filter(wrong), "index_name", WARN, "db_name", "table_name", "index_name")


def identifier_rule(names: DataFrame, name: str, **where) -> DataFrame:
    """Names with a dot or a foreign quote in them; ``names`` has ``dialect``."""
    return violation(
        names.filter(has_illegal_characters(name, "dialect")), "illegal_character", object_name=name, **where
    )


# --- table definitions ----------------------------------------------------

TABLE = ["dialect", "db_name", "table_name"]


def duplicate_rules(
    tables: DataFrame, columns: DataFrame, indexes: DataFrame
) -> DataFrame:
    """Tables (per file), columns, indexes and primary keys defined more than once.

    ``tables`` may hold ``option_names``: every option as written, repeats included.
    """
    def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return key_counts(df, keys).filter(F.col("n_rows") > 1)

    copies = F.concat(F.col("n_rows").cast("string"), F.lit(" times"))
    named = indexes.filter(F.col("kind").isin("INDEX", "UNIQUE"))
    # A number among index columns is a prefix length, not a column.
    parts = indexes.select(*TABLE, "index_name", F.explode("columns").alias("column_name")).filter(
        ~F.col("column_name").rlike(r"^\d+$")
    )
    reports = [
        violation(
            repeated(tables, [*TABLE, "file_id"]), "duplicate_table", ERROR,
            "db_name", "table_name", "table_name", "file_id", copies,
        ),
        violation(
            repeated(columns, [*TABLE, "column_name"]), "duplicate_column", ERROR,
            "db_name", "table_name", "column_name", None, copies,
        ),
        violation(
            repeated(named, [*TABLE, "index_name"]), "duplicate_index", ERROR,
            "db_name", "table_name", "index_name", None, copies,
        ),
        violation(
            repeated(indexes.filter(F.col("kind") == "PRIMARY"), TABLE), "duplicate_primary_key", ERROR,
            "db_name", "table_name", None, None, copies,
        ),
        violation(
            repeated(parts, [*TABLE, "index_name", "column_name"]), "duplicate_index_column", ERROR,
            "db_name", "table_name", "column_name", None, F.concat_ws(", ", "index_name", copies),
        ),
    ]
    if "option_names" in tables.columns:
        options = tables.select(*TABLE, "file_id", F.explode("option_names").alias("option"))
        reports.append(
            violation(
                repeated(options, [*TABLE, "file_id", "option"]), "duplicate_option", ERROR,
                "db_name", "table_name", "option", "file_id", copies,
            )
        )
    return union_all(reports)


def key_rules(
    tables: DataFrame,
    indexes: DataFrame,
    allow_none_primary_key: bool = False,
    allow_foreign_key: bool = False,
) -> DataFrame:
    """Tables without a primary key, and tables with a foreign key."""
    flags = (
        tables.select(*TABLE, F.lit(1).alias("is_table"), F.lit(0).alias("primary"), F.lit(0).alias("foreign"))
        .unionByName(
            indexes.select(
                *TABLE,
                F.lit(0).alias("is_table"),
                (F.col("kind") == "PRIMARY").cast("int").alias("primary"),
                (F.col("kind") == "FOREIGN").cast("int").alias("foreign"),
            )
        )
        .groupBy(*TABLE)
        .agg(*[F.max(c).alias(c) for c in ("is_table", "primary", "foreign")])
        .filter(F.col("is_table") == 1)
    )
    rules = [
        (F.col("primary") == 0, "primary_key_missing"),
        (F.col("foreign") == 1, "foreign_key_present"),
    ]
    severities = {
        "primary_key_missing": WARN if allow_none_primary_key else ERROR,
        "foreign_key_present": WARN if allow_foreign_key else ERROR,
    }
    severity = F.when(F.col("_rule") == "primary_key_missing", severities["primary_key_missing"]).otherwise(
        severities["foreign_key_present"]
    )
    return _broken_rules(flags, rules, severity=severity, db_name="db_name", table_name="table_name")


def key_column_membership(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """Key and index columns that their table does not have."""
    # Numbers go before the explode: a filter on its rows would be tested on all columns too.
    names = F.filter("columns", lambda name: ~name.rlike(r"^\d+$"))
    used = indexes.filter(F.col("kind") != "FOREIGN").select(*TABLE, "index_name", F.explode(names).alias("column_name"))
    unknown = used.join(columns.select(*TABLE, "column_name"), [*TABLE, "column_name"], "left_anti")
    return violation(
        unknown, "key_column_unknown", ERROR, "db_name", "table_name", "column_name", None, "index_name"
    )


def index_table_exists(indexes: DataFrame, tables: DataFrame) -> DataFrame:
    """Indexes on tables that are not defined."""
    unknown = indexes.join(tables.select(*TABLE), TABLE, "left_anti")
    return violation(unknown, "index_table_unknown", ERROR, "db_name", "table_name", "index_name")


def comment_rules(comments: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """dm8: empty comments, and comments on tables or columns that do not exist. Others keep comments in definitions."""
    comments = comments.filter(F.col("dialect") == "dm8")
    empty = comments.filter(F.coalesce(F.btrim("comment", F.lit(" '")), F.lit("")) == "")
    on_table = comments.filter(F.col("column_name").isNull())
    on_column = comments.filter(F.col("column_name").isNotNull())
    return union_all(
        [
            violation(empty, "comment_empty", ERROR, "db_name", "table_name", "column_name"),
            violation(
                on_table.join(tables.select(*TABLE), TABLE, "left_anti"),
                "comment_table_unknown", ERROR, "db_name", "table_name",
            ),
            violation(
                on_column.join(columns.select(*TABLE, "column_name"), [*TABLE, "column_name"], "left_anti"),
                "comment_column_unknown", ERROR, "db_name", "table_name", "column_name",
            ),
        ]
    )


def _column_type() -> Column:
    return F.concat_ws(" ", F.upper("data_type"), "type_length")


def _column_conditions() -> list[tuple[Column, str]]:
    data_type, length = F.upper("data_type"), F.col("type_length")
    dm8 = F.col("dialect") == "dm8"
    has_default = F.col("column_default").isNotNull() & (F.upper("column_default") != "NULL")
    return [
        (data_type.isin(NO_DEFAULT_TYPES) & has_default, "default_on_text"),
        (dm8 & (data_type == "CHAR"), "char_type"),
        (
            dm8 & (data_type == "VARCHAR") & ~F.coalesce(F.upper(length).endswith(" CHAR"), F.lit(False)),
            "varchar_length",
        ),
        (dm8 & data_type.isin(NO_LENGTH_TYPES) & length.isNotNull(), "integer_length"),
    ]


def column_rules(columns: DataFrame) -> DataFrame:
    """Rules on one column's type, length and default."""
    return _broken_rules(
        columns,
        _column_conditions(),
        db_name="db_name",
        table_name="table_name",
        object_name="column_name",
        detail=_column_type(),
    )


def text_in_index(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """dm8 indexes on a TEXT column."""
    used = indexes.filter((F.col("dialect") == "dm8") & F.col("kind").isin("INDEX", "UNIQUE")).select(
        *TABLE, "index_name", F.explode("columns").alias("column_name")
    )
    texts = columns.filter((F.col("dialect") == "dm8") & (F.upper("data_type") == "TEXT")).select(*TABLE, "column_name")
    return violation(
        used.join(texts, [*TABLE, "column_name"], "left_semi"),
        "text_in_index", ERROR, "db_name", "table_name", "column_name", None, "index_name",
    )


def table_option_rule(tables: DataFrame) -> DataFrame:
    """Table options that the dialect does not allow."""
    named = tables.select(*TABLE, "file_id", F.explode(F.map_keys("options")).alias("option"))
    allowed = per_dialect(
        "dialect", lambda d: F.upper("option").isin(TABLE_OPTIONS[d]) if TABLE_OPTIONS[d] else F.lit(False)
    )
    return violation(
        named.filter(~allowed), "table_option", ERROR, "db_name", "table_name", "option", "file_id"
    )

