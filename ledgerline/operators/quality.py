"""Checks a database makes when a constraint is added, as violations returned as rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, keys: Sequence[str], nulls_allowed: bool = False) -> DataFrame:
    """Keys on more than one row, and keys with a NULL part unless the key is only UNIQUE.

    One row per key: ``n_rows`` and ``reason``. Copies of a key are counted
    before the shuffle.
    """
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    repeated = ~has_null & (F.col("n_rows") > 1)
    reason = F.when(repeated, "duplicate")
    if not nulls_allowed:
        reason = reason.when(has_null, "null")
    return counted.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def orphans(
    child: DataFrame, parent: DataFrame, child_keys: Sequence[str], parent_keys: Sequence[str]
) -> DataFrame:
    """Child keys without a parent, with the number of child rows that hold them.

    The child is reduced to its keys first, so a key on many rows is one row in
    the join. A key with a NULL part refers to nothing and is not checked.
    """
    not_null = F.lit(True)
    for key in child_keys:
        not_null = not_null & F.col(key).isNotNull()
    used = child.filter(not_null).groupBy(*child_keys).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(*[F.col(p).alias(c) for c, p in zip(child_keys, parent_keys)])
    return used.join(known, list(child_keys), "left_anti")


def check_violations(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which a CHECK predicate is false; an unknown result passes."""
    predicate = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~predicate)


_KEY = re.compile(r"(?:CLUSTER\s+)?(PRIMARY\s+KEY|UNIQUE(?:\s+KEY)?)\s*\(([^)]*)\)", re.I)
_REFERENCE = re.compile(r"FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+([\w.`\"]+)\s*\(([^)]*)\)", re.I)
_CHECK = re.compile(r"CHECK\s*\((.*)\)\s*$", re.I | re.S)


def _names(text: str) -> list[str]:
    return [name.strip(' `"') for name in text.split(",")]


def constraint_violations(df: DataFrame, definition: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Rows or keys of ``df`` that break a constraint given by its definition.

    PRIMARY KEY, UNIQUE, FOREIGN KEY (parent looked up in ``tables``) and CHECK.
    """
    reference = _REFERENCE.search(definition)
    if reference:
        parent = reference.group(2).split(".")[-1].strip('`"')
        return orphans(df, (tables or {})[parent], _names(reference.group(1)), _names(reference.group(3)))
    key = _KEY.search(definition)
    if key:
        return key_violations(df, _names(key.group(2)), nulls_allowed=key.group(1).upper().startswith("UNIQUE"))
    check = _CHECK.search(definition)
    if check:
        return check_violations(df, check.group(1))
    raise ValueError(f"not a constraint definition: {definition}")
