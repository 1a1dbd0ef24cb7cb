"""Which versions and scripts there are, and which of them matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.versions import (
    INIT_FILE,
    compare_versions,
    from_version,
    is_script_name,
    is_version,
    script_key,
    script_number,
    version_key,
)
from ledgerline.operators.skew import ROWS_PER_TASK, lookup
from ledgerline.session import store

DEFAULT_DIALECT = "mariadb"

CHECK_LATEST, CHECK_RECENTLY, CHECK_ALL = 1, 2, 3


def service_filter(df: DataFrame, services: Sequence[str] | None) -> DataFrame:
    """Rows of the named services; no names keeps every row."""
    return df.filter(F.col("service").isin(list(services))) if services else df


def upgrade_scripts(scripts: DataFrame) -> DataFrame:
    """Numbered scripts directly inside version directories, with ``seq`` and ``vkey``."""
    return (
        scripts.filter(is_version("version") & (F.col("depth") == 4) & is_script_name("filename"))
        .withColumn("seq", script_number("filename"))
        .withColumn("vkey", version_key("version"))
    )


def version_index(scripts: DataFrame) -> DataFrame:
    """One row per (service, db_type, version): file counts and whether it can install.

    The grouping is on the version text and all buffers are numbers, so this
    is a hash aggregation that shrinks before the shuffle. Later steps order
    versions on this much smaller table.
    """
    is_direct = F.col("depth") == 4
    return (
        scripts.filter(is_version("version"))
        .groupBy("service", "db_type", "version")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum((is_direct & is_script_name("filename")).cast("int")).alias("n_scripts"),
            F.max((is_direct & (F.col("filename") == INIT_FILE)).cast("int")).alias("has_init"),
        )
        .withColumn("vkey", version_key("version"))
    )


def max_version(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest version per key; equal versions written differently give the greater text."""
    return versions.groupBy(*keys).agg(F.max(F.struct("vkey", "version"))["version"].alias("max_version"))


def min_version(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return versions.groupBy(*keys).agg(F.min(F.struct("vkey", "version"))["version"].alias("min_version"))


def version_extremes(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = F.struct("vkey", "version")
    return versions.groupBy(*keys).agg(
        F.min(order)["version"].alias("min_version"),
        F.max(order)["version"].alias("max_version"),
        F.count(F.lit(1)).alias("n_versions"),
    )


def version_steps(versions: DataFrame, keys: Sequence[str], previous: str = "previous_version") -> DataFrame:
    """How each version compares with one recorded beside it."""
    return versions.select(
        *keys, "version", previous, compare_versions("version", previous).alias("comparison")
    )


def latest_n_versions(versions: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` highest versions per key, one row each, with ``recency`` 1 for the highest.

    ``versions`` holds each version once. Spark then keeps ``n`` rows per key
    in every task before it shuffles, so a key with many versions stays small.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.col("vkey").desc(), F.col("version").desc())
    return versions.withColumn("recency", F.row_number().over(newest_first)).filter(F.col("recency") <= n)


def checked_versions(
    versions: DataFrame, keys: Sequence[str], check_type: int = CHECK_ALL, floor: str | None = None
) -> DataFrame:
    """Versions a check looks at: from a floor on, and the latest one or two if asked."""
    kept = versions.filter(from_version("version", floor))
    if check_type == CHECK_ALL:
        return kept
    return latest_n_versions(kept, keys, check_type).drop("recency")


def install_script(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``init.sql`` of the highest version per key; none when that version lacks it."""
    return (
        versions.groupBy(*keys)
        .agg(F.max(F.struct("vkey", "version", "has_init")).alias("top"))
        .filter(F.col("top.has_init") == 1)
        .select(*keys, F.col("top.version").alias("version"), F.lit(INIT_FILE).alias("filename"))
    )


def existing_services(services: DataFrame, scripts: DataFrame) -> DataFrame:
    """Configured services with ``has_scripts``; keeps the configured ``ordinal``."""
    present = scripts.select("service").distinct().withColumn("has_scripts", F.lit(True))
    return services.join(present, "service", "left").fillna(False, ["has_scripts"])


def source_choice(
    scripts: DataFrame, wanted: Sequence[str], default: str = DEFAULT_DIALECT
) -> DataFrame:
    """Per service and wanted dialect: the dialect to read, NULL when neither is there.

    ``n_rows`` is the number of script rows of that source.
    """
    dialects = sorted({*wanted, default})
    services = scripts.groupBy("service").agg(
        *[F.sum(F.when(F.col("db_type") == d, 1)).alias(f"n_{d}") for d in dialects]
    )
    choices = F.array(
        *[
            F.struct(
                F.lit(d).alias("wanted"),
                F.when(F.col(f"n_{d}").isNotNull(), F.lit(d))
                .when(F.col(f"n_{default}").isNotNull(), F.lit(default))
                .alias("db_type"),
                F.coalesce(f"n_{d}", f"n_{default}", F.lit(0)).alias("n_rows"),
            )
            for d in wanted
        ]
    )
    return services.select("service", F.inline(choices))


def select_sources(
    scripts: DataFrame,
    wanted: Sequence[str],
    default: str = DEFAULT_DIALECT,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Script rows per wanted dialect, taken from the default where it has none.

    Rows of a wanted dialect are passed on without a join; only the default
    rows meet the list of services that need them.
    """
    own = scripts.filter(F.col("db_type").isin(list(wanted))).withColumn("wanted", F.col("db_type"))
    borrowing = (
        source_choice(scripts, wanted, default)
        .filter((F.col("db_type") == default) & (F.col("wanted") != default))
        .groupBy("service", "db_type")
        .agg(F.collect_set("wanted").alias("wanted"), F.max("n_rows").alias("n_rows"))
    )
    spread_on = [c for c in scripts.columns if c not in ("service", "db_type")]
    borrowed = lookup(
        scripts.filter(F.col("db_type") == default),
        borrowing,
        ["service", "db_type"],
        spread_on,
        rows_per_task=rows_per_task,
    ).withColumn("wanted", F.explode("wanted"))
    return own.unionByName(borrowed)


def missing_sources(scripts: DataFrame, wanted: Sequence[str], default: str = DEFAULT_DIALECT) -> DataFrame:
    """Services that have neither a wanted dialect nor the default."""
    return source_choice(scripts, wanted, default).filter(F.col("db_type").isNull()).select("service", "wanted")


def replay_roles(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each version does in a check: base of the upgrade path, step on it, fresh install."""
    ends = versions.groupBy(*keys).agg(
        F.min(F.struct("vkey", "version")).alias("first"),
        F.max(F.struct("vkey", "version")).alias("last"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return (
        lookup(versions, ends, keys, ["version"])
        .withColumn("is_base", F.col("version") == F.col("first.version"))
        .withColumn("is_step", ~F.col("is_base"))
        .withColumn("is_fresh_install", F.col("version") == F.col("last.version"))
        .drop("first", "last")
    )


def execution_order(df: DataFrame, *leading: str) -> DataFrame:
    """Rows by version, then script number (none first), then name."""
    return df.orderBy(*leading, "vkey", "version", script_key("filename"), "filename")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """``df`` with its place, 1 to n, in an order of all rows; rows that tie get places next to each other.

    The rows are dealt by ranges, sorted in each, and stored, which fixes where each one
    stands in its range. What is brought together is a count per range, and a row's
    place is that plus the rows of all ranges before.
    """
    # Columns are sorted by as they are; only what is worked out for the order moves besides them.
    made = {f"_order_{k}": c for k, c in enumerate(order) if not isinstance(c, str)}
    keys = [c if isinstance(c, str) else f"_order_{k}" for k, c in enumerate(order)]
    # The upper bits of this id are the range, the lower 33 the place in it.
    placed = df.withColumns(made) if made else df
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*made).withColumn("_place", F.monotonically_increasing_id())
    placed = store(placed, "placed-rows").withColumn("_range", F.shiftright("_place", 33))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    before = store(before, "range-starts")
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(before, "_range").withColumn(name, place).drop("_range", "_place", "_before")


def execution_number(scripts: DataFrame, *leading: str) -> DataFrame:
    """Scripts with their place in :func:`execution_order` as a column."""
    return numbered(scripts, [*leading, "vkey", "version", script_key("filename"), "filename"])


def version_completion(scripts: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    """Last script of each version, whose success closes the version."""
    return (
        scripts.groupBy(*keys, "version")
        .agg(F.max(F.struct(script_key("filename").alias("number"), "filename")).alias("last"), F.count(F.lit(1)).alias("n_scripts"))
        .select(*keys, "version", F.col("last.filename").alias("last_script"), "n_scripts")
    )
