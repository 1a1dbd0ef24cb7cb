"""Schema checks for many services: replay the upgrade path, then compare."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.diff import row_difference, schema_diff
from ledgerline.operators.evolve import ReplayResult, replay_changes
from ledgerline.operators.facts import replay
from ledgerline.operators.ledger import verdict
from ledgerline.operators.rules import ERROR, violation
from ledgerline.operators.selection import (
    CHECK_ALL,
    DEFAULT_DIALECT,
    checked_versions,
    numbered,
    replay_roles,
    source_choice,
    version_index,
)
from ledgerline.operators.skew import ROWS_PER_TASK
from ledgerline.session import store

SCOPE = ["service", "dialect"]
VARIANTS = ["dialect"]  # few to a table


def replay_path(
    base: Mapping[tuple[str, str], DataFrame],
    changes_by_version: Mapping[str, Sequence[Mapping[str, Any] | tuple[str, str, Callable | str]]],
    tolerate_errors: bool = False,
    steps: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> ReplayResult:
    """Tables of the first version taken through the changes of every later one, in version order.

    ``steps`` holds the users' own steps by the names of their scripts.
    """
    def parts(version: str) -> list[int]:
        numbers = [int(part) for part in version.split(".")]
        while len(numbers) > 1 and numbers[-1] == 0:
            numbers.pop()
        return numbers

    ordered = [change for version in sorted(changes_by_version, key=parts) for change in changes_by_version[version]]
    return replay_changes(base, ordered, tolerate_errors, steps)


def upgrade_install_differences(upgraded: DataFrame, installed: DataFrame) -> DataFrame:
    """Column facts that the upgrade path and a fresh install do not share, as violations."""
    columns = [*SCOPE, "db_name", "table_name", "column_name", "data_type"]
    differing = row_difference(installed.select(columns), upgraded.select(columns), ["table_name", "db_name", *[c for c in SCOPE if c not in VARIANTS]])
    return violation(
        differing,
        F.when(F.col("n_missing") > 0, "not_after_upgrade").otherwise("not_after_install"),
        ERROR,
        "db_name",
        "table_name",
        "column_name",
        F.concat_ws("/", *SCOPE),
        "data_type",
    )


def dialect_differences(
    facts: DataFrame, dialects: Sequence[str], base: str = DEFAULT_DIALECT, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Schema differences of every other dialect from the base dialect, as violations.

    The base facts are repeated once per dialect, so one comparison covers all.
    """
    others = [d for d in dialects if d != base]
    columns = [*SCOPE, "db_name", "table_name", "column_name", "data_type"]
    base_facts = (
        facts.filter(F.col("dialect") == base)
        .withColumn("dialect", F.explode(F.array(*[F.lit(d) for d in others])))
        .select(columns)
    )
    check_facts = facts.filter(F.col("dialect").isin(others)).select(columns)
    found = schema_diff(base_facts, check_facts, SCOPE, base, "dialect", rows_per_task, VARIANTS)
    return violation(
        found, F.col("kind"), F.col("severity"), "db_name", "table_name", "column_name", F.concat_ws("/", *SCOPE), "detail"
    )


def verify_report(
    base_facts: DataFrame,
    changes: DataFrame,
    installed_facts: DataFrame,
    steps: Sequence[int] | None,
    dialects: Sequence[str],
    base: str = DEFAULT_DIALECT,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Violations of all services and dialects; ``file_id`` is ``service/dialect``.

    The replay stores the facts after the upgrades, which both comparisons use.
    Changes that it could not make are violations as well.
    """
    upgraded, problems = replay(base_facts, changes, steps, SCOPE, VARIANTS)
    refused = violation(
        problems, F.col("problem"), ERROR, "db_name", "table_name", "object_name",
        F.concat_ws("/", *SCOPE), F.concat_ws(" ", "operation_type", "object_type"),
    )
    return (
        upgrade_install_differences(upgraded, installed_facts)
        .unionByName(dialect_differences(upgraded, dialects, base, rows_per_task))
        .unionByName(refused)
    )


def upgrade_inputs(
    scripts: DataFrame,
    installs: DataFrame,
    items: DataFrame,
    dialects: Sequence[str],
    base: str = DEFAULT_DIALECT,
    check_type: int = CHECK_ALL,
    floor: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts at the start, changes in order, facts of a fresh install) of every service and dialect.

    ``scripts``: service, db_type, version, filename, depth. ``installs``: the column facts that
    the install script of each version makes (service, db_type, version, table key, column_name,
    data_type). ``items``: change items of scripts (service, db_type, version, filename, ord, and
    the fields of a change).

    Versions from ``floor`` on, the latest one or two if asked, are looked at. The first
    of these is installed, the scripts of the others are made in order of version, file name and
    item, numbered without bringing a service together; the last one is the fresh install. A
    service without scripts of a dialect is checked with those of ``base``.
    """
    source = ["service", "db_type"]
    chosen = store(checked_versions(version_index(scripts), source, check_type, floor), "checked-versions")
    roles = replay_roles(chosen, source).select(*source, "version", "vkey", "is_base", "is_step", "is_fresh_install")
    choice = source_choice(scripts, dialects, base).filter("db_type IS NOT NULL").withColumnRenamed("wanted", "dialect")
    # One row per version and dialect it stands for.
    roles = store(roles.join(choice.select("service", "db_type", "dialect"), source), "version-roles")
    fact = [*SCOPE, "db_name", "table_name", "column_name", "data_type"]
    installed = installs.join(roles, [*source, "version"])
    ordered = items.join(roles.filter("is_step").select(*source, "version", "vkey").distinct(), [*source, "version"])
    steps = numbered(ordered, [*source, "vkey", "version", "filename", "ord"], "step")
    changes = steps.join(choice.select("service", "db_type", "dialect"), source)
    change = [*SCOPE, "db_name", "table_name", "step", "object_type", "operation_type", "object_name", "new_name", "data_type"]
    return installed.filter("is_base").select(fact), changes.select(change), installed.filter("is_fresh_install").select(fact)


def verify_versions(
    scripts: DataFrame,
    installs: DataFrame,
    items: DataFrame,
    dialects: Sequence[str],
    base: str = DEFAULT_DIALECT,
    check_type: int = CHECK_ALL,
    floor: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """:func:`verify_report` of script trees: what :func:`upgrade_inputs` makes of their versions is replayed and compared."""
    start, changes, fresh = upgrade_inputs(scripts, installs, items, dialects, base, check_type, floor)
    return verify_report(start, changes, fresh, None, dialects, base, rows_per_task)


def verify_verdict(report: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Errors and warnings per service; ``services`` without any pass."""
    return verdict(report.withColumn("service", F.substring_index("file_id", "/", 1)), ["service"], services)
