"""Keys and references of tables that only grow, checked on the rows an append brings.

A full check shuffles every row of the table again for each append. Here each
append leaves its keys, counted, in a folder of its own (``append=n``), and later
appends are checked against those: earlier rows are never read. The join to the
earlier keys is written so that Spark can turn the keys of one append into a
runtime Bloom filter on the scan of all others, once these are large.

An append has a number of the caller's, from 1 on. One that runs again, because
its job failed on the way, replaces its own folder, so it is counted once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST, COUNT, APPEND = "_digest", "n_rows", "append"


class _Counts:
    """Keys with their number of rows, a folder for each append."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType):
        self.spark, self.path, self.keys = spark, path, list(keys)
        fields = [T.StructField(DIGEST, T.LongType()), *[T.StructField(k, schema[k].dataType) for k in self.keys]]
        self.schema = T.StructType([*fields, T.StructField(COUNT, T.LongType())])
        # A folder that is always there, so that reading needs no look at storage first.
        self._write(spark.createDataFrame([], self.schema), 0)

    def _write(self, counted: DataFrame, append: int) -> None:
        counted.select(self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{APPEND}={append}")

    def put(self, counted: DataFrame, append: int) -> None:
        if append < 1:
            raise ValueError("appends are numbered from 1 on")
        self._write(counted.withColumn(DIGEST, F.xxhash64(*self.keys)), append)

    def all(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(APPEND, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def of(self, append: int) -> DataFrame:
        return self.all().filter(F.col(APPEND) == append).drop(APPEND)

    def but(self, append: int) -> DataFrame:
        return self.all().filter(F.col(APPEND) != append).drop(APPEND)

    def total(self) -> DataFrame:
        return self.all().groupBy(*self.keys).agg(F.sum(COUNT).alias(COUNT))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal digests find the rows, the keys themselves decide; NULL equals NULL."""
    exact = [left[k].eqNullSafe(right[k]) for k in keys]
    return reduce(lambda a, b: a & b, exact, left[DIGEST] == right[DIGEST])


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


class AppendedKeys:
    """A PRIMARY KEY or UNIQUE constraint on a table that grows by appends.

    ``schema`` is that of the table. ``violations`` gives what
    :func:`ledgerline.operators.quality.key_violations` gives for all appended rows.
    Appends with no rows are allowed; without any append there are no violations.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType, nulls_allowed: bool = False):
        self.keys, self.nulls_allowed = list(keys), nulls_allowed
        self.counts = _Counts(spark, path, keys, schema)

    def add(self, rows: DataFrame, append: int) -> DataFrame:
        """The violations among the keys of this append, with the rows of all appends."""
        self.counts.put(rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias(COUNT)), append)
        new, others = self.counts.of(append), self.counts.but(append)
        met = others.join(new, _same(others, new, self.keys), "left_semi")
        return self._broken(met.unionByName(new).groupBy(*self.keys).agg(F.sum(COUNT).alias(COUNT)))

    def violations(self) -> DataFrame:
        return self._broken(self.counts.total())

    def _broken(self, counted: DataFrame) -> DataFrame:
        has_null = _any_null(self.keys)
        reason = F.when(~has_null & (F.col(COUNT) > 1), "duplicate")
        if not self.nulls_allowed:
            reason = reason.when(has_null, "null")
        return counted.withColumn("reason", reason).filter(F.col("reason").isNotNull())


class AppendedReferences:
    """A FOREIGN KEY between a child and a parent table that both grow by appends.

    Child keys without a parent at the time of their append wait in a folder; a
    parent that comes later settles them. Only those that wait are met by later
    parents, so child rows are read once. ``violations`` gives what
    :func:`ledgerline.operators.quality.orphans` gives for all appended rows.
    """

    def __init__(self, spark: SparkSession, path: str, child_keys: Sequence[str], parent_keys: Sequence[str], child_schema: T.StructType):
        self.keys, self.parent_keys = list(child_keys), list(parent_keys)
        self.child_schema = child_schema
        self.parents = _Counts(spark, f"{path}/parents", child_keys, child_schema)
        self.used = _Counts(spark, f"{path}/used", child_keys, child_schema)
        self.waiting = _Counts(spark, f"{path}/waiting", child_keys, child_schema)

    def add_parents(self, rows: DataFrame, append: int) -> None:
        named = rows.select(
            *[F.col(p).cast(self.child_schema[k].dataType).alias(k) for k, p in zip(self.keys, self.parent_keys)]
        )
        self.parents.put(named.filter(~_any_null(self.keys)).groupBy(*self.keys).agg(F.count(F.lit(1)).alias(COUNT)), append)

    def add_children(self, rows: DataFrame, append: int) -> DataFrame:
        """The keys of this append without a parent so far, with its number of rows."""
        counted = rows.filter(~_any_null(self.keys)).groupBy(*self.keys).agg(F.count(F.lit(1)).alias(COUNT))
        self.used.put(counted, append)
        new, parents = self.used.of(append), self.parents.all()
        # The big side is filtered by the small one first; what is left is at most as many keys.
        known = parents.join(new, _same(parents, new, self.keys), "left_semi")
        self.waiting.put(new.join(known, _same(new, known, self.keys), "left_anti"), append)
        return self.waiting.of(append).drop(DIGEST)

    def violations(self) -> DataFrame:
        waiting, parents = self.waiting.all(), self.parents.all()
        settled = parents.join(waiting, _same(parents, waiting, self.keys), "left_semi")
        left = waiting.join(settled, _same(waiting, settled, self.keys), "left_anti")
        return left.groupBy(*self.keys).agg(F.sum(COUNT).alias(COUNT))
