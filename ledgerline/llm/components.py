"""Connected components of a table of links, without bringing links together anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import store


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One star step on edges (a > b): neighbours are linked to the least one.

    The least neighbours are stored before the join: with their size known they are
    broadcast if small, and else the many links of a hub can be split.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        least = store(least, f"{name}-least")
        moved = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = store(edges.groupBy("a").agg(F.min("b").alias("least")), f"{name}-least")
        moved = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    # Two-column aggregation: equal edges meet in each task before the shuffle.
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every id has one neighbour below it at most, and ids with one have none above."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); component is the least id it reaches.

    Alternates large-star and small-star steps until each component is a star
    around its least id; each step is written to the shared folder. Null and self
    links are ignored.
    """
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = store(current, name)
    while not _is_settled(current):
        current = store(_star(store(_star(current, True, name), name), False, name), name)
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
