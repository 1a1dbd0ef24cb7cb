"""Joining a big table to a table of one row per key when keys are uneven.

An equi join puts all rows of a key into one task. Adaptive execution splits
such a task only when both sides come straight from a shuffle, which is not so
when the small side is an aggregate. Here the small side is stored first. Spark
then knows its size and broadcasts it if that is small. If it is not and a key
is big, the rows of that key are spread over as many tasks as their number asks
for, and the key's one row is repeated for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.session import store

ROWS_PER_TASK = 4_000_000

SALT = "_salt"
SPLITS = "_splits"


def key_counts(df: DataFrame, keys: Sequence[str], name: str = "n_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def _splits(n: Column, rows_per_task: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(rows_per_task)), F.lit(1)).cast("int")


def lookup(
    big: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "inner",
    count: str = "n_rows",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``big`` joined to ``per_key``, which has one row per key and is stored here.

    ``per_key[count]`` is the number of rows of the key in ``big``, or more;
    the column is used up. The greatest one is seen while the table is stored,
    and without a key above ``rows_per_task`` rows the join is a plain one.
    ``spread_on`` names columns of ``big`` that tell the rows of one key apart.
    They decide the salt, so a task that runs again gives each row the same one.
    """
    keys = list(keys)
    seen = Observation()
    per_key = store(per_key.observe(seen, F.max(count).alias("most")), "per-key")
    if (seen.get["most"] or 0) <= rows_per_task:
        return big.join(per_key.drop(count), keys, how)
    return salted_join(big, per_key, keys, spread_on, how, count, rows_per_task)


def salted_join(
    big: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str,
    count: str,
    rows_per_task: int,
) -> DataFrame:
    """The join of :func:`lookup` with the rows of big keys spread.

    The list of keys above ``rows_per_task`` rows, at most
    ``rows(big) / rows_per_task`` of them, is broadcast if Spark finds it small.
    """
    keys = list(keys)
    hot = (
        per_key.filter(F.col(count) > rows_per_task)
        .select(*keys, _splits(F.col(count), rows_per_task).alias(SPLITS))
    )
    salted = (
        big.join(hot, keys, "left")
        .withColumn(SALT, F.pmod(F.xxhash64(*spread_on), F.coalesce(SPLITS, F.lit(1))).cast("int"))
        .drop(SPLITS)
    )
    repeated = per_key.withColumn(
        SALT, F.explode(F.sequence(F.lit(0), _splits(F.col(count), rows_per_task) - 1))
    ).drop(count)
    return salted.join(repeated, [*keys, SALT], how).drop(SALT)
