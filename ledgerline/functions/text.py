"""Names, statements and secrets in text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.versions import _col

# Keys whose quoted value is hidden, and what replaces the value.
SECRET_PATTERN = r"""(?i)("|')(password|sentinelPassword)("|'):([ ]*)("|')([^"']*)("|')"""
SECRET_REPLACEMENT = "$1$2$3:$4$5*****$7"

# Fixed values per dialect: the quote that may surround a name, the characters
# a name may not hold, and the statement that switches the database.
NAME_QUOTE = {"mariadb": "`", "dm8": '"', "kdb9": "`"}
ILLEGAL_IN_NAME = {"mariadb": "[.\"']", "dm8": "[.`']", "kdb9": "[.\"']"}
SWITCH_PATTERN = {
    "mariadb": r"(?is)^\s*USE\s+(\S.*)$",
    "dm8": r"(?is)^\s*SET\s+SCHEMA\s+(\S.*)$",
    "kdb9": r"(?is)^\s*SET\s+SEARCH_PATH\s+TO\s+(\S.*)$",
}
DIALECTS = ("mariadb", "dm8", "kdb9")
# Databases that follow the rules of another.
FAMILY = {"mysql": "mariadb", "tidb": "mariadb", "goldendb": "mariadb"}


def family(dialect: Column | str) -> Column:
    """The dialect whose rules a database follows, whatever the case of its name; NULL for one that is not supported."""
    name = F.lower(_col(dialect))
    result = F.when(name.isin(*DIALECTS), name)
    for other, own in FAMILY.items():
        result = result.when(name == other, own)
    return result


def per_dialect(dialect: Column | str, expression) -> Column:
    """``expression(name)`` of whichever dialect the row names; NULL for others."""
    if isinstance(dialect, str) and (known := FAMILY.get(dialect, dialect)) in DIALECTS:
        return expression(known)
    dialect = family(dialect)
    result = F.when(dialect == DIALECTS[0], expression(DIALECTS[0]))
    for name in DIALECTS[1:]:
        result = result.when(dialect == name, expression(name))
    return result


def mask_secrets(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), SECRET_PATTERN, SECRET_REPLACEMENT)


def clean_identifier(name: Column | str, dialect: Column | str) -> Column:
    """Name without surrounding quotes, blanks, line ends and semicolons."""
    name = _col(name)
    return per_dialect(dialect, lambda d: F.btrim(name, F.lit(f" {NAME_QUOTE[d]}\n;")))


def clean_column_name(name: Column | str, dialect: Column | str) -> Column:
    """As :func:`clean_identifier`, without a prefix length such as ``(191)``."""
    head = F.substring_index(_col(name), "(", 1)
    return per_dialect(dialect, lambda d: F.btrim(head, F.lit(f" {NAME_QUOTE[d]}\n")))


def has_illegal_characters(name: Column | str, dialect: Column | str) -> Column:
    """True when the cleaned name holds a dot or a quote of another kind."""
    return per_dialect(dialect, lambda d: clean_identifier(name, d).rlike(ILLEGAL_IN_NAME[d]))


def object_name(qualified: Column | str) -> Column:
    """Last part of ``db.object``."""
    return F.substring_index(_col(qualified), ".", -1)


def type_length(type_text: Column | str) -> Column:
    """Text inside the first parentheses of a type; NULL without any."""
    type_text = _col(type_text)
    return F.when(
        type_text.rlike(r"\([^)]*\)"),
        F.trim(F.regexp_extract(type_text, r"\(([^)]*)\)", 1)),
    )


def type_name(column_property: Column | str) -> Column:
    """Type word at the head of a column property."""
    return F.regexp_extract(_col(column_property), r"^\s*(\w+)", 1)


def leading_type_length(column_property: Column | str) -> Column:
    """Length right after the type of a column property; NULL without one."""
    column_property = _col(column_property)
    return F.when(column_property.rlike(r"^\s*\w+\s*\("), type_length(column_property))


def default_value(column_property: Column | str) -> Column:
    """Value after DEFAULT in a column property without its quotes; NULL when there is no DEFAULT."""
    column_property = _col(column_property)
    value = F.regexp_extract(column_property, r"(?i)\bDEFAULT\s+('[^']*'|\"[^\"]*\"|[^\s,]+)", 1)
    return F.when(value != "", F.btrim(value, F.lit("'\"")))


def is_unsigned(type_rest: Column | str) -> Column:
    """Whether the text after type and length starts with UNSIGNED."""
    return _col(type_rest).rlike(r"(?i)^\s*UNSIGNED")


def strip_existence_clause(sql: Column | str) -> Column:
    """Statement without IF EXISTS and IF NOT EXISTS."""
    return F.trim(F.regexp_replace(_col(sql), r"(?i)\bIF\s+(NOT\s+)?EXISTS\b", ""))


def is_blank_statement(sql: Column | str) -> Column:
    """Nothing but white space, or a lone semicolon."""
    return _col(sql).rlike(r"^\s*;?\s*$")


def statement_verb(sql: Column | str) -> Column:
    return F.upper(F.regexp_extract(_col(sql), r"^\s*(\w+)", 1))


def statement_object(sql: Column | str) -> Column:
    """The keyword after the verb, with the words that belong to OR, ON and UNIQUE."""
    words = F.regexp_extract(_col(sql), r"(?i)^\s*\w+\s+(OR\s+\w+\s+\w+|ON\s+\w+|UNIQUE\s+\w+|\w+)", 1)
    return F.upper(F.regexp_replace(words, r"\s+", " "))


def switches_database(sql: Column | str, dialect: Column | str) -> Column:
    """Whether a statement is the dialect's way to switch the database."""
    return per_dialect(dialect, lambda d: _col(sql).rlike(SWITCH_PATTERN[d]))


def database_of_switch(sql: Column | str, dialect: Column | str) -> Column:
    """Database a switching statement names; NULL for any other statement."""
    sql = _col(sql)

    def named(d: str) -> Column:
        target = F.regexp_extract(sql, SWITCH_PATTERN[d], 1)
        return F.when(target != "", clean_identifier(target, d))

    return per_dialect(dialect, named)


def text_to_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text."""
    return _col(text).cast("binary")


def json_extract(text: Column | str, *paths: str) -> Column:
    """One value per JSON path: the value itself for one path, an array for more."""
    values = [F.get_json_object(_col(text), path) for path in paths]
    return values[0] if len(values) == 1 else F.array(*values)


def event_time_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")
