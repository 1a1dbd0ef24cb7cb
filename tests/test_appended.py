import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quality
from ledgerline.operators.appended import AppendedKeys, AppendedReferences

APPENDS = [
    [(1, "a"), (1, "a"), (2, None), (3, "c")],
    [],
    [(3, "c"), (4, "d"), (2, None), (None, "a"), (None, None)],
    [(3, "c"), (1, None), (4, "e")],
]


def parts(spark):
    return [spark.createDataFrame(rows, "k int, s string") for rows in APPENDS]


@pytest.mark.parametrize("nulls_allowed", [False, True])
def test_appends_give_the_violations_of_one_check(spark, rows, tmp_path, nulls_allowed):
    every = parts(spark)
    checked = AppendedKeys(spark, str(tmp_path), ["k", "s"], every[0].schema, nulls_allowed)
    assert rows(checked.violations()) == []
    found = [rows(checked.add(part, n)) for n, part in enumerate(every, 1)]
    whole = quality.key_violations(every[0].union(every[1]).union(every[2]).union(every[3]), ["k", "s"], nulls_allowed)
    assert rows(checked.violations()) == rows(whole)
    assert found[1] == [] and (3, "c", 3, "duplicate") in found[3] and (3, "c", 2, "duplicate") in found[2]
    assert (1, "a", 2, "duplicate") not in found[3]
    assert (((2, None, 2, "null") in found[2]), ((2, None, 2, "null") in found[3])) == (not nulls_allowed, False)
    # An append that runs again counts once, also for another object on the same folder.
    again = AppendedKeys(spark, str(tmp_path), ["k", "s"], every[0].schema, nulls_allowed)
    assert rows(again.add(every[2], 3)) and rows(again.violations()) == rows(whole)
    with pytest.raises(ValueError):
        again.add(every[0], 0)


def test_parents_that_come_later_settle_children(spark, rows, tmp_path):
    every = [part.select(F.col("k"), "s") for part in parts(spark)]
    parents = [spark.createDataFrame([(n,) for n in ns], "id long") for ns in ([1, 1, None], [4], [])]
    checked = AppendedReferences(spark, str(tmp_path), ["k"], ["id"], every[0].schema)
    assert rows(checked.violations()) == []
    checked.add_parents(parents[0], 1)
    assert rows(checked.add_children(every[0], 1)) == [(2, 1), (3, 1)]
    assert rows(checked.add_children(every[1], 2)) == []
    assert rows(checked.add_children(every[2], 3)) == [(2, 1), (3, 1), (4, 1)]
    checked.add_parents(parents[1], 2)
    checked.add_parents(parents[2], 3)
    assert rows(checked.add_children(every[3], 4)) == [(3, 1)]
    children = every[0].union(every[1]).union(every[2]).union(every[3])
    assert rows(checked.violations()) == rows(quality.orphans(children, parents[0].union(parents[1]), ["k"], ["id"])) == [(2, 2), (3, 3)]


def test_new_keys_become_a_filter_on_the_scan_of_old_ones(spark, tmp_path):
    """With sides too big to broadcast, Spark filters the earlier keys before their shuffle."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    old = {k: spark.conf.get(k, None) for k in changed}
    every = parts(spark)
    checked = AppendedKeys(spark, str(tmp_path), ["k", "s"], every[0].schema)
    checked.add(every[0], 1)
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        plan = checked.add(every[2], 2)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "might_contain" in plan or "mightcontain" in plan.lower(), plan
