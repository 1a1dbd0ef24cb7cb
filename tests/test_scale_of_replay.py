"""How often rows move and how many tasks they are dealt to, in replays, differences and written trees."""

import pytest
from pyspark.sql import DataFrameWriter

from ledgerline import session
from ledgerline.operators import diff, facts, lineage, selection
from queries import roles

FACTS = "service string, db_name string, table_name string, column_name string, data_type string"
CHANGE = (
    "service string, db_name string, table_name string, step int, object_type string, operation_type string, object_name string, "
    "new_name string, data_type string"
)


def test_facts_and_changes_move_once(spark, monkeypatch):
    base = spark.createDataFrame([("s", "d", f"t{k}", "a", "INT") for k in range(20)], FACTS)
    changes = [("s", "d", f"t{k}", 1, "COLUMN", "MODIFY", "a", None, "TEXT") for k in range(20)]
    monkeypatch.setattr(facts, "FEW_CHANGES", 0, raising=False)
    plans = {}
    real = facts.store

    def store(df, name, *by):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name, *by)

    monkeypatch.setattr(facts, "store", store)
    after = facts.replay_facts(base, spark.createDataFrame(changes, CHANGE), None, ["service"])
    assert {row["data_type"] for row in after.collect()} == {"TEXT"}
    assert sum(plan.count("Exchange hashpartitioning") for plan in plans.values()) == 1


def test_jobs_do_not_grow_with_chains(spark, monkeypatch):
    counts = []
    for n in (3, 40):
        base = spark.createDataFrame([("s", "d", f"t{k}", "a", "INT") for k in range(n)], FACTS)
        renames = [("s", "d", f"t{k}", 1, "TABLE", "RENAME", f"t{k}", f"t{k + 1}", None) for k in range(n)]
        stored = []
        monkeypatch.setattr(lineage, "store", lambda df, name, *by, real=lineage.store: stored.append(name) or real(df, name, *by))
        after = facts.replay_facts(base, spark.createDataFrame(renames, CHANGE), None, ["service"])
        assert {row["table_name"] for row in after.collect()} == {f"t{k + 1}" for k in range(n)}
        counts.append(len(stored))
        monkeypatch.undo()
    assert counts[0] == counts[1] <= 3


@pytest.mark.parametrize("end_is_taken", [True, False])
def test_databases_too_long_for_a_task_end_the_same(spark, rows, end_is_taken):
    present = spark.createDataFrame([("d", f"t{k}") for k in range(6 + end_is_taken)] + [("e", "x")], "db_name string, name string")
    renames = [("d", f"t{k}", 1, "RENAME", f"t{k + 1}", k) for k in range(6)] + [("d", "t2", 2, "DROP", None, 8), ("e", "x", 1, "RENAME", "y", 9)]
    events = spark.createDataFrame(renames, "db_name string, name string, step int, operation string, new string, change_id long")
    short, long = (lineage.table_spans(events, present, ["db_name"], n) for n in (1000, 4))
    assert rows(short[1]) == rows(long[1])
    in_span = [sorted(r for r in rows(spans) if r[1] is not None) for spans, _ in (short, long)]
    gone = [{r[2] for r in rows(spans) if r[1] is None} for spans, _ in (short, long)]
    assert repr(in_span[0]) == repr(in_span[1])
    assert gone[0] == gone[1] == {"t2" if end_is_taken else "t1"}


def test_tables_with_a_null_key_that_change_names_are_gone(spark, rows):
    base = spark.createDataFrame([(None, "d", "t", "a", "INT"), (None, "d", "u", "a", "INT"), ("s", "d", "t", "a", "INT")], FACTS)
    renames = spark.createDataFrame([(None, "d", "t", 1, "TABLE", "RENAME", "t", "u", None)], CHANGE)
    assert rows(facts.replay_facts(base, renames, None, ["service"]), "service") == [("s",)]


@pytest.mark.parametrize("compare", [diff.table_diff, diff.schema_diff])
def test_many_facts_are_dealt_to_many_tasks(spark, monkeypatch, compare):
    base = spark.createDataFrame([("d", f"t{k}", "a", "INT") for k in range(30)], "db_name string, table_name string, column_name string, data_type string")
    monkeypatch.setattr(diff, "FACTS_PER_TASK", 3, raising=False)
    plans, real = [], diff.store
    monkeypatch.setattr(diff, "store", lambda df, name, *by: plans.append(df) or real(df, name, *by))
    found = compare(base, base.filter("table_name <> 't7'"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*plans, found]]
    assert [row["table_name"] for row in found.collect()] == ["t7"]
    assert any("hashpartitioning" in plan and ", 20), REPARTITION_BY_NUM" in plan for plan in plans)


def test_known_columns_are_not_stored(spark, rows, monkeypatch):
    known = spark.createDataFrame([("s", "d", "t", "a", "INT")] * 2, FACTS)
    monkeypatch.setattr(facts, "store", None)
    wanted = known.select("service", "db_name", "table_name").limit(1)
    assert rows(facts.existing_tables(wanted, known, ["service"]), "is_present") == [(True,)]


def test_trees_are_written_by_many_tasks(spark, tmp_path):
    texts = spark.range(64).groupBy("id").count().selectExpr("concat('svc-', id, '/dm8/1.0/init.sql') AS path", "'x' AS text")
    spark.sparkContext.setJobGroup("tree", "tree")
    roles.write_tree(texts, f"{tmp_path}/tree")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("tree") for s in tracker.getJobInfo(job).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(list((tmp_path / "tree").rglob("init.sql"))) == 64
    assert sum(s.numTasks >= 8 for s in stages if s) >= 1


def test_renames_to_names_that_nothing_else_mentions_are_not_folded(spark, rows, monkeypatch):
    base = spark.createDataFrame([("s", "d", f"t{k}", c, "INT") for k in range(3) for c in "ab"], FACTS)
    changes = [("s", "d", f"t{k}", 1, "COLUMN", "RENAME", "a", "x", None) for k in range(3)]
    changes += [("s", "d", "t0", 1, "COLUMN", "MODIFY", "b", None, "TEXT"), ("s", "d", "t2", 2, "COLUMN", "RENAME", "b", "X", None)]
    folded = []
    monkeypatch.setattr(facts, "fold_linked", lambda df, *names, real=facts.fold_linked: folded.append(df) or real(df, *names))
    after, problems = facts.replay(base, spark.createDataFrame(changes, CHANGE), None, ["service"])
    found = [("t0", "b", "TEXT"), ("t0", "x", "INT"), ("t1", "b", "INT"), ("t1", "x", "INT"), ("t2", "b", "INT"), ("t2", "x", "INT")]
    assert rows(after, "table_name", "column_name", "data_type") == found
    assert rows(problems, "table_name", "step", "object_name", "new_name", "problem") == [("t2", 2, "b", "X", "new_name_taken")]
    assert {row["table_name"] for row in folded[0].collect()} == {"t2"}


def test_changes_not_made_are_told_as_they_are_written(spark, rows):
    base = spark.createDataFrame([(None, "d", "t", "a", "INT"), ("s", "d", "t", "a", "INT"), ("s", "d", "t", "b", "INT")], FACTS)
    changes = [
        ("s", "d", "t", 1, "Column", "rename", "a", "B", None, "w1"), ("s", "d", "t", 1, "VIEW", "ADD", "v", None, None, "w2"),
        ("s", "d", "t", 2, "COLUMN", "Frob", "a", None, None, "w3"), ("s", "d", "t", 2, "COLUMN", "ADD", "a", None, "X", "w4"),
        (None, "d", "t", None, "column", "DROP", "a", None, None, "w5"), ("s", "d", "t", 3, None, "ADD", "a", None, "X", "w6"),
    ]
    changes = spark.createDataFrame(changes, CHANGE + ", who string")
    after, problems = facts.replay(base, changes, None, ["service"], ["service"])
    assert rows(after) == rows(base)
    reasons = {"w1": "new_name_taken", "w2": "unknown_change", "w3": "unknown_change", "w4": "several_changes_in_a_step", "w5": "step_missing", "w6": "unknown_change"}
    assert rows(problems) == sorted(((*row, reasons[row["who"]]) for row in changes.collect()), key=repr)


def test_columns_of_an_order_move_once(spark, monkeypatch):
    plans, real = [], selection.store
    monkeypatch.setattr(selection, "store", lambda df, name, *by: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name, *by))
    placed = selection.numbered(spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int"), ["name", "n"])
    assert sorted(tuple(row) for row in placed.collect()) == [("a", 1, 1), ("b", 2, 2)]
    assert "_order_" not in plans[0]


def test_files_shuffled_for_a_stored_table_go(spark, monkeypatch):
    setting, seen, real = spark.conf.get(session.SHUFFLE_CLEANUP, None), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(session.SHUFFLE_CLEANUP, None)) or real(self, path))
    assert session.store(spark.range(1000).repartition(4, "id"), "dealt").count() == 1000
    assert seen == ["true"] and spark.conf.get(session.SHUFFLE_CLEANUP, None) == setting


def test_both_sides_of_a_schema_difference_move_once(spark, rows):
    columns = "db_name string, table_name string, column_name string, data_type string"
    base = [("d", "t", "a", "INT"), ("d", "t", "A", "INT"), ("d", "t", "b", "INT"), ("d", "t", None, "INT"), (None, "t", "a", "INT"), ("d", None, "a", "INT"), ("d", "u", "a", "INT")]
    check = [("d", "t", "a", "TEXT"), ("d", "t", "c", "INT"), (None, "t", "b", "INT"), ("d", "", "a", "INT")]
    base, check = spark.createDataFrame(base, columns), spark.createDataFrame(check, columns)
    found, apart = diff.schema_diff(base, check), diff.schema_diff(base, check, rows_per_task=1)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(found) == rows(apart) and len(rows(found)) == 8
    assert rows(diff.column_diff(base, check)) == rows(diff.column_diff(base, check, rows_per_task=1))
