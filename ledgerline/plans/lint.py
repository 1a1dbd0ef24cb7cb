"""All rules over scripts, statements, change items and table definitions in one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.versions import from_version
from ledgerline.operators import rules
from ledgerline.operators.ledger import verdict
from ledgerline.operators.selection import CHECK_ALL, checked_versions, version_index
from ledgerline.session import store


def layout_report(scripts: DataFrame, listed_versions: DataFrame | None = None) -> DataFrame:
    """File names, numbers, ``init.sql`` and empty versions of script trees. The version index is stored."""
    versions = store(version_index(scripts).select("service", "db_type", "version", "has_init"), "version-index")
    reports = [
        rules.file_name_rules(scripts),
        rules.duplicate_number_rule(scripts),
        rules.missing_init_rule(versions),
    ]
    if listed_versions is not None:
        reports.append(rules.empty_version_rule(listed_versions, versions))
    return rules.union_all(reports)


def scripts_to_check(scripts: DataFrame, check_type: int = CHECK_ALL, floor: str | None = None) -> DataFrame:
    """Script rows of the versions a check looks at."""
    if check_type == CHECK_ALL and not floor:
        return scripts
    key = ["service", "db_type", "version"]
    kept = checked_versions(version_index(scripts), key[:2], check_type, floor)
    return scripts.join(kept.select(key), key, "left_semi")


def statement_report(statements: DataFrame) -> DataFrame:
    return rules.union_all(
        [rules.unsupported_dialects(statements), rules.first_statement_rule(statements), rules.statement_allow_list(statements)]
    )


def definition_report(
    tables: DataFrame,
    columns: DataFrame,
    indexes: DataFrame,
    comments: DataFrame | None = None,
    allow_none_primary_key: bool = False,
    allow_foreign_key: bool = False,
) -> DataFrame:
    """Names, keys, columns, options and comments of table definitions."""
    reports = [
        rules.duplicate_rules(tables, columns, indexes),
        rules.key_rules(tables, indexes, allow_none_primary_key, allow_foreign_key),
        rules.key_column_membership(indexes, columns),
        rules.index_table_exists(indexes, tables),
        rules.column_rules(columns),
        rules.text_in_index(indexes, columns),
        rules.table_option_rule(tables),
        rules.table_name_rule(tables),
        rules.index_name_rule(indexes),
    ]
    if comments is not None:
        reports.append(rules.comment_rules(comments, tables, columns))
    return rules.union_all(reports)


def change_report(files: DataFrame) -> DataFrame:
    """Change files: file_id, dialect and ``items`` (array of maps from field to JSON value)."""
    return rules.change_rules(files)


def lint_report(*reports: DataFrame) -> DataFrame:
    """One table of violations from the parts a check covers."""
    return rules.union_all(reports)


def checked_layout(
    scripts: DataFrame, check_type: int = CHECK_ALL, floor: str | None = None, listed_versions: DataFrame | None = None
) -> DataFrame:
    """:func:`layout_report` of the versions a check looks at."""
    if listed_versions is not None:
        listed_versions = listed_versions.filter(from_version("version", floor))
    return layout_report(store(scripts_to_check(scripts, check_type, floor), "checked-scripts"), listed_versions)


def service_verdict(report: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Errors and warnings per service, the first part of ``file_id``; ``services`` without any pass."""
    named = report.filter("file_id IS NOT NULL").withColumn("service", F.substring_index("file_id", "/", 1))
    return verdict(named, ["service"], services)


def lint_verdict(report: DataFrame) -> DataFrame:
    """Errors and warnings per rule; :func:`service_verdict` has them per service."""
    return verdict(report, ["rule"])
