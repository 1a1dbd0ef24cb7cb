import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ledger
from ledgerline.schemas import HISTORY, TASK
from ledgerline.sources import tables
from ledgerline.streaming import ledger as stream

NOON = dt.datetime(2024, 1, 1, 12)


def history(spark, entries):
    return spark.createDataFrame(
        [
            (i, s, name.split("/")[0], name, status, None, NOON + dt.timedelta(seconds=sec))
            for i, (s, name, status, sec) in enumerate(entries)
        ],
        HISTORY,
    )


ENTRIES = [
    ("a", "1.0/01-x.sql", "success", 0), ("a", "1.0/02-y.sql", "success", 0), ("a", "1.0/03-z.sql", "failed", 5),
    ("b", "1.0/01-x.sql", "failed", 1), ("c", "2.0/init.sql", "success", 3), ("a", "0.9/09-q.sql", "success", -4),
]


def test_latest_breaks_ties_by_id_and_ignores_failures(spark, rows):
    got = rows(ledger.ledger_latest(history(spark, ENTRIES)), "f_service_name", "f_script_file_name")
    assert got == [("a", "1.0/02-y.sql"), ("c", "2.0/init.sql")]


def test_stream_equals_batch(spark, rows, tmp_path):
    log, state, progress = (str(tmp_path / n) for n in ("log", "state", "progress"))
    everything = []
    for start in range(0, len(ENTRIES), 2):
        part = history(spark, ENTRIES).filter(F.col("f_id").between(start, start + 1))
        tables.append_history(part.coalesce(1), log)
        everything.append(start)
        query = stream.run_to_state(tables.stream_history(spark, log, 1), state, progress)
        query.awaitTermination()
    result = stream.read_state(spark, state, query)
    batch = ledger.ledger_latest(tables.read_history(spark, log))
    assert rows(result.select(batch.columns)) == rows(batch)


def test_stream_in_complete_mode(spark, rows, tmp_path):
    log = str(tmp_path / "log")
    tables.append_history(history(spark, ENTRIES), log)
    query = (
        stream.latest_stream(tables.stream_history(spark, log)).writeStream.outputMode("complete")
        .format("memory").queryName("latest_services").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = ledger.ledger_latest(history(spark, ENTRIES))
    assert rows(spark.table("latest_services")) == rows(batch)


def test_a_batch_that_runs_again_changes_nothing(spark, rows, tmp_path):
    merge = stream.merge_into_state(str(tmp_path))
    first, second = history(spark, ENTRIES[:3]), history(spark, ENTRIES)
    merge(first, 0)
    merge(second, 1)
    once = rows(spark.read.parquet(f"{tmp_path}/batch=1"))
    merge(second, 1)
    assert rows(spark.read.parquet(f"{tmp_path}/batch=1")) == once


def test_logs_are_not_sorted(spark):
    """What reads the whole log are hash aggregations; only last rows and failures are put in order."""
    log = history(spark, ENTRIES)
    for df in (ledger.ledger_latest(log), ledger.fail_fast_prefix(log, F.col("f_status") == "failed", ["f_service_name"], ["f_create_time", "f_id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    seen = []
    real = ledger.store
    ledger.store = lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
    try:
        ledger.ledger_latest(log)
        ledger.outcome_state(outcomes(spark, []))
    finally:
        ledger.store = real
    assert len(seen) == 2 and all("HashAggregate" in plan and "Sort" not in plan for plan in seen)


OUTCOME = "service string, version string, script_file_name string, status string, ts timestamp_ntz, event_id long, target_version string, closes_version boolean"


def outcomes(spark, data):
    return spark.createDataFrame(data, OUTCOME)


def test_task_state_from_late_and_repeated_rows(spark, rows, tmp_path):
    rng = random.Random(4)
    data = [
        (rng.choice(["a", "b", "c", None]), f"1.{k % 5}", f"1.{k % 5}/{k:02d}-x.sql", rng.choice(["success", "failed"]),
         None if k % 11 == 0 else NOON + dt.timedelta(seconds=rng.randrange(6)), rng.choice([k, k, None]), "9", rng.choice([True, False, None]))
        for k in range(60)
    ]
    task = spark.createDataFrame([(1, "a", "1.0", "1.0", "1.0/init.sql", NOON, NOON), (2, "z", "1.0", "1.0", "", NOON, NOON)], TASK)
    log, state, progress = (str(tmp_path / n) for n in ("log", "state", "progress"))
    for part in (data[20:40], data[:25], data[35:], data[10:30]):  # late, and again
        outcomes(spark, part).coalesce(2).write.mode("append").parquet(log)
        arriving = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(log)
        query = stream.run_to_task_state(arriving, state, progress)
        found = stream.read_state(spark, state, query, ledger.STATE_SCHEMA)
    expected = rows(ledger.ledger_apply(task, outcomes(spark, data)))
    assert rows(ledger.task_after(task, found)) == expected
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with very many services
    try:
        assert rows(ledger.ledger_apply(task, outcomes(spark, data))) == expected
        assert rows(ledger.ledger_latest(history(spark, ENTRIES)), "f_script_file_name") == [("1.0/02-y.sql",), ("2.0/init.sql",)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fail_fast(spark, rows):
    data = [("a", 1, "ok"), ("a", 2, "bad"), ("a", 3, "ok"), ("a", 4, "bad"), ("b", 1, "ok"), ("b", 2, "ok"), ("c", 1, "bad"), ("c", 2, "ok")]
    df = spark.createDataFrame(data, "service string, pos int, status string")
    expected = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)]
    for limit in (1, 2, 100):
        kept = ledger.fail_fast_prefix(df, F.col("status") == "bad", ["service"], ["pos"], rows_per_task=limit)
        assert rows(kept, "service", "pos") == expected


@pytest.mark.parametrize("time", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("number", ["bigint", "int"])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_fail_fast_orders_times_and_numbers_as_a_struct(spark, rows, time, number, zone):
    """Null, far and equal times; the hour that clocks skip in spring."""
    written = [None, "0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "2024-03-31 02:30:00",
               "2024-03-31 03:15:00", "5139-01-01 00:00:00", "9999-12-31 23:59:59.999999", "+200000-01-01 00:00:00"]
    numbers = [None, -(1 << 63), -1, 0, (1 << 63) - 1] if number == "bigint" else [None, -(1 << 31), 0, (1 << 31) - 1]
    places = [(t, n) for t in written for n in numbers]
    data = [(f"{k}", t, n, "bad" if i >= k and i % 3 == k % 3 else "ok") for k in range(len(places) + 1) for i, (t, n) in enumerate(places)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(data, f"service string, written string, n {number}, status string")
        df = df.withColumn("ts", F.col("written").cast(time)).cache()
        bad = F.col("status") == "bad"
        stops = df.groupBy("service").agg(F.min(F.when(bad, F.struct("ts", "n"))).alias("stop"))
        expected = df.join(stops, "service").filter(F.col("stop").isNull() | (F.struct("ts", "n") <= F.col("stop"))).drop("stop")
        columns = ["service", "written", "n", "status"]
        assert rows(ledger.fail_fast_prefix(df, bad, ["service"], ["ts", "n"]), *columns) == rows(expected, *columns)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_fail_fast_of_null_and_far_places(spark, rows):
    far = dt.datetime(9999, 12, 31)
    data = [("a", None, 1, "ok"), ("a", NOON, None, "ok"), ("a", NOON, 1, "bad"), ("a", NOON, 2, "ok"), ("b", None, 1, "bad"),
            ("b", NOON, 1, "ok"), ("c", NOON, 1, "ok"), ("c", far, 1, "bad"), ("c", far, 2, "ok")]
    df = spark.createDataFrame(data, "service string, ts timestamp_ntz, event_id long, status string")
    kept = ledger.fail_fast_prefix(df, F.col("status") == "bad", ["service"], ["ts", "event_id"])
    expected = [data[i] for i in (0, 1, 2, 4, 6, 7)]
    assert rows(kept, *df.columns) == sorted(expected, key=repr)


def test_fail_fast_across_services(spark, rows):
    df = spark.createDataFrame([(0, "ok"), (1, "ok"), (1, "bad"), (2, "ok"), (3, "bad")], "ordinal int, status string")
    bad = F.col("status") == "bad"
    assert rows(ledger.fail_fast_services(df, bad, "ordinal"), "ordinal") == [(0,), (1,), (1,)]
    fine = df.filter(~bad)
    assert ledger.fail_fast_services(fine, bad, "ordinal").count() == 3


def test_failed_script_does_not_close_its_version(spark):
    task = spark.createDataFrame([(1, "a", "1.0", "1.0", "1.0/init.sql", NOON, NOON)], TASK)
    outcomes = spark.createDataFrame(
        [
            ("a", "1.1", "1.1/01-a.sql", "success", NOON + dt.timedelta(hours=1), 1, "1.2", False),
            ("a", "1.1", "1.1/02-b.sql", "failed", NOON + dt.timedelta(hours=2), 2, "1.2", True),
            ("new", "3.0", "3.0/init.sql", "failed", NOON, 3, "3.0", True),
        ],
        "service string, version string, script_file_name string, status string, ts timestamp_ntz, event_id long, "
        "target_version string, closes_version boolean",
    )
    row = ledger.ledger_apply(task, outcomes).collect()
    assert len(row) == 1
    assert (row[0].f_id, row[0].f_installed_version, row[0].f_target_version, row[0].f_script_file_name) == (
        1, "1.0", "1.0", "1.1/01-a.sql",
    )
    assert row[0].f_update_time == NOON + dt.timedelta(hours=1) and row[0].f_create_time == NOON


def test_renames(spark, rows):
    assert ledger.compose_renames([("a", "b"), ("b", "c"), ("x", ""), ("q", "a")]) == {"a": "c", "b": "c", "q": "a"}
    df = spark.createDataFrame([("a", 1), ("d", 2)], "service string, n int")
    assert rows(ledger.rename_keys(df, {"a": "c"}, "service")) == [("c", 1), ("d", 2)]
    table = spark.createDataFrame([("a", "d")], "old_name string, new_name string")
    assert rows(ledger.rename_collisions(df, table, "service")) == [("d", 2)]
    assert rows(ledger.rename_keys(df, {}, "service")) == [("a", 1), ("d", 2)]


def test_history_rows_mask_secrets(spark):
    outcome = spark.createDataFrame(
        [("a", "1.0", "01-x.sql", "failed", '{"password": "p"}', NOON, 7)],
        "service string, version string, filename string, status string, message string, ts timestamp_ntz, event_id long",
    )
    row = tables.history_rows(outcome).first()
    assert (row.f_id, row.f_script_file_name, row.f_message) == (7, "1.0/01-x.sql", '{"password": "*****"}')


def test_verdict(spark, rows):
    df = spark.createDataFrame([("a", "error"), ("a", "warn"), ("b", "warn")], "service string, severity string")
    assert rows(ledger.verdict(df, ["service"])) == [("a", 1, 1, True), ("b", 0, 1, False)]
