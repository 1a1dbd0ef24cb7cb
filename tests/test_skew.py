import pytest
from pyspark.sql import functions as F

from ledgerline.operators import skew


@pytest.fixture(scope="module")
def uneven(spark):
    """A third of all rows under one key, NULL keys, and keys of the small side that match nothing."""
    big = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
        F.col("id"),
    )
    per_key = skew.key_counts(big.filter("key is not null"), ["key"]).withColumn("value", F.length("key")).unionByName(
        spark.createDataFrame([("absent", 0, 1)], "key string, n_rows long, value int")
    )
    return big, per_key


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_task", [1, 20, 100, 10_000])
def test_lookup_equals_a_plain_join(uneven, rows, how, rows_per_task):
    big, per_key = uneven
    plain = big.join(per_key.drop("n_rows"), "key", how)
    assert rows(skew.lookup(big, per_key, ["key"], ["id"], how, rows_per_task=rows_per_task)) == rows(plain)


def test_big_key_is_spread(uneven, spark):
    big, per_key = uneven
    joined = skew.salted_join(big, skew.store(per_key, "t"), ["key"], ["id"], "inner", "n_rows", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        counts = (
            joined.filter(F.col("key") == "hot").groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(counts) > 3 and max(r["count"] for r in counts) < 600


def test_without_a_big_key_nothing_is_salted(uneven):
    big, per_key = uneven
    plan = skew.lookup(big, per_key, ["key"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert skew.SALT not in plan
