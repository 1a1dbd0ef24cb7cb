import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evolve, facts, quality
from ledgerline.plans.verify import replay_path, verify_report


def item(kind, op, name, prop="", new_name="", table="t_user", db="app"):
    return {
        "db_name": db, "table_name": table, "object_type": kind, "operation_type": op, "object_name": name,
        "object_property": prop, "object_comment": "", "new_name": new_name,
    }


@pytest.fixture()
def users(spark):
    return spark.createDataFrame([(1, "ann", "7"), (2, None, "x"), (3, "cy", None)], "f_id long, f_name string, f_age string")


CHANGES = [
    item("COLUMN", "ADD", "f_state", "INT DEFAULT 1"),
    item("column", "modify", "F_AGE", "INT"),
    item("COLUMN", "RENAME", "f_name", "VARCHAR(10)", "f_label"),
    item("COLUMN", "DROP", "f_absent"),
    item("UNIQUE INDEX", "ADD", "uk_x", "f_id"),
]


def test_changes_in_order(users, rows):
    result = evolve.replay_changes({("app", "t_user"): users}, CHANGES)
    table = result.tables["app", "t_user"]
    assert table.columns == ["f_id", "f_label", "f_age", "f_state"]
    assert rows(table) == [(1, "ann", 7, 1), (2, None, None, 1), (3, "cy", None, 1)]
    assert rows(result.lossy_casts["app", "t_user", "F_AGE"], "f_id") == [(2,)]


def test_changes_made_twice_change_nothing_more(users, rows):
    once = evolve.replay_changes({("app", "t_user"): users}, CHANGES).tables["app", "t_user"]
    twice = evolve.replay_changes({("app", "t_user"): users}, CHANGES + CHANGES).tables["app", "t_user"]
    assert twice.schema == once.schema and rows(twice) == rows(once)


def test_changes_become_one_projection(users):
    table = evolve.replay_changes({("app", "t_user"): users}, CHANGES).tables["app", "t_user"]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1


@pytest.mark.parametrize(
    "change",
    [
        item("COLUMN", "RENAME", "f_name"), item("TABLE", "ADD", ""), item("DB", "RENAME", "", new_name="x"),
        item("VIEW", "DROP", "v"), item("INDEX", "MODIFY", "i"), item("COLUMN", "RENAME", "f_name", new_name="F_ID"),
        item("COLUMN", "ADD", "f_x", "INT", table="t_absent"),
    ],
)
def test_changes_that_cannot_be_made(users, change):
    with pytest.raises(ValueError):
        evolve.replay_changes({("app", "t_user"): users}, [change])


def test_tables_and_databases(users):
    tables = {("app", "t_user"): users, ("app", "t_old"): users, ("other", "t_user"): users}
    result = evolve.replay_changes(
        tables,
        [
            item("TABLE", "RENAME", "", new_name="t_person"), item("TABLE", "DROP", "", table="t_old"),
            item("TABLE", "DROP", "", table="t_absent"), item("DB", "DROP", "", db="other"),
        ],
    )
    assert set(result.tables) == {("app", "t_person")}


def test_update_delete_insert(users, rows, spark):
    changed = evolve.apply_update(users, F.col("f_id") > 1, {"f_name": F.lit("z"), "f_age": F.col("f_name")})
    assert rows(changed) == [(1, "ann", "7"), (2, "z", None), (3, "z", "cy")]
    kept = evolve.apply_delete(users, F.col("f_name") == "ann")
    assert rows(kept, "f_id") == [(2,), (3,)]
    seeds = spark.createDataFrame([(9,)], "f_id int")
    added = evolve.apply_insert(users, seeds, {"f_age": 0})
    assert added.schema == users.schema and rows(added.filter("f_id = 9")) == [(9, None, "0")]


def test_user_steps(users, rows):
    def upper(df):
        return df.withColumn("f_name", F.upper("f_name"))

    def broken(df):
        return df.withColumn("f_name", F.raise_error(F.lit("boom")))

    steps = [("app", "t_user", upper), ("app", "t_user", broken), item("COLUMN", "DROP", "f_age")]
    result = evolve.replay_changes({("app", "t_user"): users}, steps, tolerate_errors=True)
    assert rows(result.tables["app", "t_user"], "f_id", "f_name") == [(1, "ANN"), (2, None), (3, "CY")]
    assert len(result.tolerated_errors) == 1 and result.tolerated_errors[0].startswith("app.t_user")
    strict = evolve.replay_changes({("app", "t_user"): users}, steps[1:2]).tables["app", "t_user"]
    with pytest.raises(Exception, match="boom"):
        strict.collect()


def test_constraints(users, spark, rows):
    orders = spark.createDataFrame([(1, 1), (2, 5), (3, None), (3, 5)], "f_id int, f_user_id long")
    tables = {("app", "t_user"): users, ("app", "t_order"): orders}
    result = evolve.replay_changes(
        tables,
        [
            item("CONSTRAINT", "ADD", "fk", "FOREIGN KEY (`f_user_id`) REFERENCES app.t_user (f_id)", table="t_order"),
            item("CONSTRAINT", "ADD", "pk", "PRIMARY KEY (f_id)", table="t_order"),
            item("CONSTRAINT", "ADD", "uk", "UNIQUE (f_user_id)", table="t_order"),
            item("CONSTRAINT", "ADD", "ck", "CHECK (f_user_id > 1)", table="t_order"),
            item("CONSTRAINT", "DROP", "ck", table="t_order"),
        ],
    )
    broken = {name: rows(df) for (_, _, name), df in result.constraint_breaks.items()}
    assert broken == {"fk": [(5, 2)], "pk": [(3, 2, "duplicate")], "uk": [(5, 2, "duplicate")], "ck": [(1, 1)]}
    nulls = quality.key_violations(orders, ["f_user_id"])
    assert rows(nulls) == [(5, 2, "duplicate"), (None, 1, "null")]


def test_versions_are_replayed_in_version_order(users):
    path = {"1.10": [item("COLUMN", "DROP", "f_x")], "1.9": [item("COLUMN", "ADD", "f_x", "INT")], "1.2.0": [item("COLUMN", "DROP", "f_x")]}
    assert "f_x" not in replay_path({("app", "t_user"): users}, path).tables["app", "t_user"].columns


FACTS = "db_name string, table_name string, column_name string, data_type string"
CHANGE = (
    "db_name string, table_name string, step int, object_type string, operation_type string, object_name string, "
    "new_name string, data_type string"
)


def test_changes_of_many_tables(spark, rows):
    base = spark.createDataFrame(
        [("d", "t_a", "x", "INT"), ("d", "t_a", "y", "INT"), ("d", "t_b", "x", "INT"), ("d", "t_c", "x", "INT")], FACTS
    )
    changes = spark.createDataFrame(
        [
            ("d", "t_a", 1, "COLUMN", "ADD", "X", None, "TEXT"),
            ("d", "t_a", 1, "COLUMN", "ADD", "z", None, "TEXT"),
            ("d", "t_a", 1, "COLUMN", "MODIFY", "y", None, "BIGINT"),
            ("d", "t_b", 1, "TABLE", "RENAME", "t_b", "t_bb", None),
            ("d", "t_c", 1, "TABLE", "DROP", "t_c", None, None),
            ("d", "t_absent", 1, "COLUMN", "ADD", "q", None, "INT"),
            ("d", "t_a", 2, "COLUMN", "RENAME", "z", "zz", None),
            ("d", "t_a", 2, "COLUMN", "DROP", "x", None, None),
            ("d", "t_bb", 2, "COLUMN", "MODIFY", "absent", None, "INT"),
            ("d", "t_c", 2, "COLUMN", "ADD", "w", None, "INT"),
        ],
        CHANGE,
    )
    after = facts.replay_facts(base, changes)
    assert rows(after) == [("d", "t_a", "y", "BIGINT"), ("d", "t_a", "zz", "TEXT"), ("d", "t_bb", "x", "INT")]
    assert facts.step_conflicts(changes).count() == 0
    assert rows(facts.step_conflicts(changes.unionByName(changes.limit(1))), "object_name", "n_changes") == [("X", 2)]


def test_changes_that_cannot_be_made_are_listed(spark, rows):
    base = spark.createDataFrame([("d", "t_a", "x", "INT"), ("d", "t_a", "y", "INT"), ("d", "t_b", "x", "INT"), ("e", "t_e", "x", "INT")], FACTS)
    changes = spark.createDataFrame(
        [
            ("d", "t_a", 1, "COLUMN", "RENAME", "x", "Y", None),
            ("d", "t_b", 1, "TABLE", "RENAME", "t_b", "t_a", None),
            ("d", "t_a", 7, "COLUMN", "MODIFY", "y", None, "TEXT"),
            ("d", "t_b", 7, "COLUMN", "MODIFY", "x", None, "TEXT"),
            ("d", "t_b", 7, "COLUMN", "DROP", "X", None, None),
            ("d", "t_a", 8, "COLUMN", "RENAME", "x", None, None),
            ("d", "t_a", 8, "VIEW", "ADD", "v", None, None),
            ("d", "t_a", 9, "INDEX", "ADD", "i", None, None),
            ("e", None, 9, "DB", "DROP", "e", None, None),
            ("d", "t_a", None, "COLUMN", "DROP", "x", None, None),
        ],
        CHANGE,
    )
    after = facts.replay_facts(base, changes)
    assert rows(after) == [("d", "t_a", "x", "INT"), ("d", "t_a", "y", "TEXT"), ("d", "t_b", "x", "INT")]
    assert rows(facts.change_problems(changes), "table_name", "problem") == [
        ("t_a", "new_name_missing"), ("t_a", "step_missing"), ("t_a", "unknown_change"),
        ("t_b", "several_changes_in_a_step"), ("t_b", "several_changes_in_a_step"),
    ]


def test_no_change_is_dropped_or_doubled_unseen(spark, rows):
    base = spark.createDataFrame(
        [("d", t, c, "INT") for t in ("t_a", "t_b", "t_c", "t_d", "t_e", "t_f", "t_g") for c in ("a", "b")], FACTS
    )
    changes = spark.createDataFrame(
        [
            # Onto a column that is there; two columns to one name; an addition of the name.
            ("d", "t_a", 1, "COLUMN", "RENAME", "a", "B", None),
            ("d", "t_b", 1, "COLUMN", "RENAME", "a", "c", None),
            ("d", "t_b", 1, "COLUMN", "RENAME", "b", "C", None),
            ("d", "t_c", 1, "COLUMN", "RENAME", "a", "c", None),
            ("d", "t_c", 1, "COLUMN", "ADD", "c", None, "INT"),
            # A table renamed in the step that changes its columns, and one dropped in it.
            ("d", "t_d", 1, "TABLE", "RENAME", "t_d", "t_dd", None),
            ("d", "t_d", 1, "COLUMN", "ADD", "z", None, "INT"),
            ("d", "t_e", 1, "TABLE", "DROP", "t_e", None, None),
            ("d", "t_e", 1, "COLUMN", "ADD", "z", None, "INT"),
            # f stays, as a is taken, so g cannot become f.
            ("d", "t_f", 1, "TABLE", "RENAME", "t_f", "t_a", None),
            ("d", "t_g", 1, "TABLE", "RENAME", "t_g", "t_f", None),
            # Done before, or of a table that is not there: no effect.
            ("d", "t_a", 2, "COLUMN", "RENAME", "absent", "b", None),
            ("d", "t_absent", 2, "TABLE", "RENAME", "t_absent", "t_a", None),
            ("d", "t_a", 3, "COLUMN", "RENAME", "a", "c", None),
        ],
        CHANGE,
    )
    after, problems = facts.replay(base, changes)
    assert rows(after, "table_name", "column_name") == [
        ("t_a", "b"), ("t_a", "c"), *[(t, c) for t in ("t_b", "t_c", "t_d", "t_f", "t_g") for c in ("a", "b")],
    ]
    expected = [
        ("t_a", "a", "new_name_taken"), ("t_b", "a", "new_name_given_twice"), ("t_b", "b", "new_name_given_twice"),
        ("t_c", "a", "new_name_given_twice"), ("t_c", "c", "new_name_given_twice"),
        ("t_d", "t_d", "table_renamed_in_the_step"), ("t_d", "z", "table_renamed_in_the_step"),
        ("t_f", "t_f", "new_name_taken"), ("t_g", "t_g", "new_name_taken"),
    ]
    assert rows(problems, "table_name", "object_name", "problem") == expected
    assert rows(facts.change_problems(changes, facts=base), "table_name", "object_name", "problem") == expected
    both = [df.withColumns({"service": F.lit("s"), "dialect": F.lit("mariadb")}) for df in (base, changes)]
    report = verify_report(*both, both[0], None, ["mariadb", "dm8"])
    listed = report.filter(F.col("rule").isin("new_name_taken", "new_name_given_twice", "table_renamed_in_the_step"))
    assert rows(listed, "table_name", "object_name", "rule") == expected


def test_losses_of_a_change_of_type(spark, rows):
    df = spark.createDataFrame([(1, 12.7, "ab"), (2, 12.0, "abc"), (3, None, None)], "k int, n double, s string")
    from ledgerline.operators import evolve

    assert rows(evolve.lossy_casts(df, "N", "int"), "k") == [(1,)]
    assert rows(evolve.lossy_casts(df, "s", "string", 2), "k") == [(2,)]
    assert rows(evolve.lossy_casts(df, "n", "string"), "k") == []


def test_tables_on_facts(spark, rows):
    base = spark.createDataFrame([("d", "t_a", "x", "INT")], FACTS)
    new = spark.createDataFrame([("d", "t_a", "q", "INT"), ("d", "t_n", "x", "INT"), ("e", "t_n", "x", "INT")], FACTS)
    created = facts.create_tables(base, new)
    assert rows(created, "db_name", "table_name") == [("d", "t_a"), ("d", "t_n"), ("e", "t_n")]
    assert rows(facts.create_tables(created, new)) == rows(created)
    assert rows(facts.drop_databases(created, ["E"]), "db_name") == [("d",), ("d",)]
    wanted = spark.createDataFrame([("d", "t_a", "X"), ("d", "t_a", "nope")], "db_name string, table_name string, column_name string")
    assert rows(facts.existing_columns(wanted, base), "column_name", "is_present") == [("X", True), ("nope", False)]
    names = spark.createDataFrame([("D",), ("z",)], "db_name string")
    assert rows(facts.existing_databases(names, base)) == [("D", True), ("z", False)]
