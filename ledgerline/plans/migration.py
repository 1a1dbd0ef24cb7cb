"""The work each service still has to do, for all services in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.versions import (
    INIT_FILE,
    NUMBER_TYPE,
    anchor_number,
    anchor_version,
    below_all_versions,
    is_script_name,
    relative_name,
    script_key,
    script_number,
    version_key,
)
from ledgerline.operators.selection import DEFAULT_DIALECT, version_index
from ledgerline.operators.skew import ROWS_PER_TASK, lookup
from ledgerline.session import store

INSTALL, UPGRADE = "install", "upgrade"


def service_state(
    versions: DataFrame, task: DataFrame, services: DataFrame, wanted: str, default: str = DEFAULT_DIALECT
) -> DataFrame:
    """One row per configured service that has versions: source, route, versions, anchor."""
    per_source = (
        versions.filter(F.col("db_type").isin(wanted, default))
        .groupBy("service", "db_type")
        .agg(
            F.sum("n_files").alias("n_files"),
            F.count(F.lit(1)).alias("n_versions"),
            F.max(F.struct("vkey", "version", "has_init")).alias("top"),
        )
    )
    chosen = (
        per_source.groupBy("service")
        .agg(
            F.max_by(
                F.struct("db_type", "n_files", "n_versions", "top"), (F.col("db_type") == wanted).cast("int")
            ).alias("source")
        )
        .select("service", "source.*")
    )
    recorded = task.select(
        F.col("f_service_name").alias("service"),
        F.col("f_installed_version").alias("installed_version"),
        F.col("f_script_file_name").alias("anchor"),
    )
    return (
        services.select("service", "ordinal")
        .join(chosen, "service")
        .join(recorded, "service", "left")
        .select(
            "service",
            "ordinal",
            "db_type",
            "n_files",
            "n_versions",
            F.when(F.col("installed_version").isNull(), INSTALL).otherwise(UPGRADE).alias("route"),
            "installed_version",
            # Nothing closed so far: below every version.
            F.when(F.col("installed_version") == "", below_all_versions())
            .otherwise(version_key("installed_version"))
            .alias("installed_vkey"),
            anchor_version("anchor").alias("anchor_version"),
            anchor_number("anchor").alias("anchor_seq"),
            script_key("anchor").alias("anchor_key"),
            F.col("top.version").alias("target_version"),
            F.col("top.vkey").alias("target_vkey"),
            (F.col("top.has_init") == 1).alias("can_install"),
        )
    )


def planning_tables(
    scripts: DataFrame, task: DataFrame, services: DataFrame, wanted: str, default: str = DEFAULT_DIALECT
) -> tuple[DataFrame, DataFrame]:
    """Version index and service state as stored tables, for the steps that share them."""
    versions = store(version_index(scripts), "versions")
    return versions, store(service_state(versions, task, services, wanted, default), "service-state")


def pending_versions(versions: DataFrame, state: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Versions with scripts above the installed one, each with the state of its service."""
    upgrading = state.filter((F.col("route") == UPGRADE) & (F.col("target_vkey") > F.col("installed_vkey"))).select(
        "service",
        "ordinal",
        "db_type",
        "installed_vkey",
        "installed_version",
        "target_version",
        "anchor_version",
        "anchor_seq",
        "anchor_key",
        F.col("n_versions").alias("n_rows"),
    )
    return lookup(
        versions.filter(F.col("n_scripts") > 0).select("service", "db_type", "version", "vkey", "n_files"),
        upgrading,
        ["service", "db_type"],
        ["version"],
        rows_per_task=rows_per_task,
    ).filter(F.col("vkey") > F.col("installed_vkey"))


def live_anchors(pending: DataFrame) -> DataFrame:
    """Services whose anchor lies in their first pending version: service, version, live_seq, live_key."""
    return (
        pending.filter(F.col("anchor_key").isNotNull())
        .groupBy("service", "anchor_version", "anchor_seq", "anchor_key")
        .agg(F.min(F.struct("vkey", "version"))["version"].alias("version"))
        .filter(F.col("version") == F.col("anchor_version"))
        .select("service", "version", F.col("anchor_seq").alias("live_seq"), F.col("anchor_key").alias("live_key"))
    )


def pending_scripts(
    scripts: DataFrame, versions: DataFrame, state: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Scripts above the installed version, without those done before an interruption.

    ``versions`` and ``state`` are stored tables. Which versions are pending is
    worked out on them alone; the list of scripts then meets just those, so
    version numbers are never parsed per script.
    """
    pending = pending_versions(versions, state, rows_per_task)
    wanted = pending.join(live_anchors(pending), ["service", "version"], "left").select(
        "service",
        "db_type",
        "version",
        "vkey",
        "ordinal",
        "installed_version",
        "target_version",
        "live_key",
        F.col("n_files").alias("n_rows"),
    )
    return (
        lookup(
            scripts.filter((F.col("depth") == 4) & is_script_name("filename")).drop("depth"),
            wanted,
            ["service", "db_type", "version"],
            ["filename"],
            rows_per_task=rows_per_task,
        )
        .withColumn("seq", script_number("filename"))
        .filter(F.col("live_key").isNull() | (script_key("filename") > F.col("live_key")))
        .drop("live_key")
    )


def plan_problems(state: DataFrame) -> DataFrame:
    """Services that cannot be planned, one row per reason: what the plan leaves out is here.

    An installed version that is no version cannot be compared; a new service
    whose top version has no install script cannot be installed.
    """
    unreadable = (F.col("route") == UPGRADE) & F.col("installed_vkey").isNull()
    no_install = (F.col("route") == INSTALL) & ~F.col("can_install")
    problem = F.when(unreadable, "installed_version_unreadable").when(no_install, "install_script_missing")
    return (
        state.withColumn("problem", problem)
        .filter(F.col("problem").isNotNull())
        .select("service", "ordinal", "db_type", "problem", "installed_version", "target_version")
    )


def migration_plan(
    scripts: DataFrame,
    task: DataFrame,
    services: DataFrame,
    wanted: str = DEFAULT_DIALECT,
    default: str = DEFAULT_DIALECT,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every script that has to run: the install script of new services, pending ones of others.

    Execution order is (ordinal, vkey, version, number, filename), see
    :func:`~ledgerline.operators.selection.execution_order`; an install script has number -1. The list of scripts is read twice: once to count
    what each version holds, once to pick the pending ones.
    """
    versions, state = planning_tables(scripts, task, services, wanted, default)
    columns = [
        "ordinal", "service", "db_type", "route", "version", "vkey", "seq", "filename", "relative_name",
        "installed_version", "target_version",
    ]
    installs = state.filter((F.col("route") == INSTALL) & F.col("can_install")).select(
        "ordinal",
        "service",
        "db_type",
        "route",
        F.col("target_version").alias("version"),
        version_key("target_version").alias("vkey"),
        F.lit(-1).cast(NUMBER_TYPE).alias("seq"),
        F.lit(INIT_FILE).alias("filename"),
        relative_name("target_version", F.lit(INIT_FILE)).alias("relative_name"),
        "installed_version",
        "target_version",
    )
    upgrades = pending_scripts(scripts, versions, state, rows_per_task).select(
        "ordinal",
        "service",
        "db_type",
        F.lit(UPGRADE).alias("route"),
        "version",
        "vkey",
        "seq",
        "filename",
        relative_name("version", "filename").alias("relative_name"),
        "installed_version",
        "target_version",
    )
    return installs.select(columns).unionByName(upgrades.select(columns))
