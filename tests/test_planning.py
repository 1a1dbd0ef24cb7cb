import pytest
from pyspark.sql import functions as F

from ledgerline.functions.versions import version_key
from ledgerline.operators import ledger, selection
from ledgerline.plans.migration import migration_plan
from ledgerline.schemas import SCRIPTS, TASK

TASK_ROW = "f_service_name string, f_installed_version string, f_target_version string, f_script_file_name string"


def script_rows(tree, service="svc", db_type="mariadb"):
    return [
        (service, db_type, version, name, 4) for version, names in tree.items() for name in names
    ]


def plan_of(spark, trees, tasks, ordinals=None, **options):
    rows = [row for (service, db_type), tree in trees.items() for row in script_rows(tree, service, db_type)]
    scripts = spark.createDataFrame(rows, SCRIPTS)
    names = ordinals or sorted({service for service, _ in trees})
    services = spark.createDataFrame(list(enumerate(names)), "ordinal int, service string")
    task = spark.createDataFrame([(i, s, v, v, a, None, None) for i, (s, (v, a)) in enumerate(tasks.items())], TASK)
    return migration_plan(scripts, task, services, **options)


def pending(spark, tree, installed, anchor=""):
    plan = plan_of(spark, {("svc", "mariadb"): tree}, {"svc": (installed, anchor)})
    ordered = selection.execution_order(plan, "ordinal").collect()
    return [r.relative_name for r in ordered]


@pytest.mark.parametrize(
    "tree, installed, expected",
    [
        ({"1.0.0": ["init.sql", "01-old.sql"], "1.1.0": ["01-new.sql"], "1.2.0": ["01-newer.sql"]}, "1.1.0", ["1.2.0/01-newer.sql"]),
        ({"1.0.0": ["init.sql", "01-add.sql"]}, "1.0.0", []),
        (
            {"1.0.0": ["init.sql"], "1.1.0": ["02-b.sql", "01-a.sql"], "1.2.0": ["01-c.sql"]},
            "1.0.0",
            ["1.1.0/01-a.sql", "1.1.0/02-b.sql", "1.2.0/01-c.sql"],
        ),
        ({"1.0.0": ["init.sql"], "1.1.0": ["init.sql"]}, "1.0.0", []),
        ({"1.9.0": ["01-a.py"], "1.10.0": ["01-b.json"]}, "1.8", ["1.9.0/01-a.py", "1.10.0/01-b.json"]),
        ({"1.1": ["10-b.sql", "9-a.sql", "readme.md", "x.sql"], "latest": ["01-z.sql"]}, "1.0", ["1.1/9-a.sql", "1.1/10-b.sql"]),
    ],
)
def test_pending(spark, tree, installed, expected):
    assert pending(spark, tree, installed) == expected


@pytest.mark.parametrize(
    "tree, anchor, expected",
    [
        ({"1.1.0": ["01-a.sql", "02-b.sql", "03-c.sql"]}, "1.1.0/01-a.sql", ["1.1.0/02-b.sql", "1.1.0/03-c.sql"]),
        ({"1.1.0": ["01-a.sql", "02-b.sql"]}, "1.1.0/02-b.sql", []),
        ({"1.1.0": ["01-a.sql", "02-b.sql"]}, "1.1.0/init.sql", ["1.1.0/01-a.sql", "1.1.0/02-b.sql"]),
        ({"1.2.0": ["01-a.sql", "02-b.sql"]}, "1.1.0/02-done.sql", ["1.2.0/01-a.sql", "1.2.0/02-b.sql"]),
        (
            {"1.1.0": ["01-a.sql", "02-b.sql"], "1.2.0": ["01-c.sql"]}, "1.1.0/01-a.sql",
            ["1.1.0/02-b.sql", "1.2.0/01-c.sql"],
        ),
        (
            {"1.1.5": ["01-x.sql"], "1.2.0": ["01-a.sql", "02-b.sql"]}, "1.2.0/01-a.sql",
            ["1.1.5/01-x.sql", "1.2.0/01-a.sql", "1.2.0/02-b.sql"],
        ),
        # A version of nothing but init.sql does no work, so it does not come first.
        ({"1.1.5": ["init.sql"], "1.2.0": ["01-a.sql", "02-b.sql"]}, "1.2.0/01-a.sql", ["1.2.0/02-b.sql"]),
        # Numbers of any length are told apart.
        (
            {"1.1": ["1" * 39 + "-a.sql", "2" * 39 + "-b.sql", "09-c.sql", "0" * 50 + "7-d.sql", "1" * 40 + "-e.sql"]}, "1.1/" + "1" * 39 + "-a.sql",
            ["1.1/" + "2" * 39 + "-b.sql", "1.1/" + "1" * 40 + "-e.sql"],
        ),
        # The anchor counts by text, not by value.
        ({"1.2.0": ["01-a.sql", "02-b.sql"]}, "1.2/01-a.sql", ["1.2.0/01-a.sql", "1.2.0/02-b.sql"]),
    ],
)
def test_resume(spark, tree, anchor, expected):
    assert pending(spark, tree, "1.0.0", anchor) == expected


def test_install_takes_the_highest_version_only(spark, rows):
    trees = {
        ("a", "mariadb"): {"1.9.0": ["init.sql"], "1.10.0": ["init.sql", "01-x.sql"]},
        ("b", "mariadb"): {"1.0.0": ["init.sql"], "2.0.0": ["01-x.sql"]},
        ("c", "mariadb"): {"1.0.0": ["init.sql"]},
    }
    plan = plan_of(spark, trees, {"c": ("1.0.0", "1.0.0/init.sql")})
    assert rows(plan, "service", "route", "relative_name") == [("a", "install", "1.10.0/init.sql")]


def test_target_version_counts_versions_without_work(spark):
    trees = {("a", "mariadb"): {"1.1": ["01-x.sql"], "1.2": ["init.sql"]}}
    assert plan_of(spark, trees, {"a": ("1.0", "")}).first().target_version == "1.2"


def test_wanted_dialect_falls_back_and_services_keep_their_order(spark):
    trees = {
        ("svc-a", "mariadb"): {"1.1": ["01-m.sql"]},
        ("svc-b", "mariadb"): {"1.1": ["01-m.sql"]},
        ("svc-b", "dm8"): {"1.1": ["01-d.sql"]},
        ("svc-c", "mariadb"): {"1.1": ["01-m.sql"]},
        ("svc-d", "kdb9"): {"1.1": ["01-k.sql"]},
    }
    tasks = {s: ("1.0", "") for s in ("svc-a", "svc-b", "svc-c", "svc-d")}
    plan = plan_of(spark, trees, tasks, ["svc-c", "svc-a", "svc-b", "svc-d"], wanted="dm8")
    ordered = selection.execution_order(plan, "ordinal").collect()
    assert [(r.service, r.db_type) for r in ordered] == [("svc-c", "mariadb"), ("svc-a", "mariadb"), ("svc-b", "dm8")]


def test_plan_is_the_same_when_every_key_is_split(spark, rows):
    tree = {f"1.{i}": [f"{j:02d}-x.sql" for j in range(1, 6)] for i in range(1, 20)}
    trees = {("hot", "mariadb"): tree, ("cold", "mariadb"): {"1.1": ["01-x.sql"]}}
    tasks = {"hot": ("1.3", "1.4/02-x.sql"), "cold": ("1.0", "")}
    plain = rows(plan_of(spark, trees, tasks))
    split = rows(plan_of(spark, trees, tasks, rows_per_task=7))
    assert plain == split and len(plain) == 16 * 5 - 2 + 1


def test_sources(spark, rows):
    scripts = spark.createDataFrame(
        script_rows({"1.0": ["init.sql"]}, "a", "mariadb")
        + script_rows({"1.0": ["init.sql", "01-a.sql"]}, "b", "mariadb")
        + script_rows({"1.0": ["init.sql"]}, "b", "dm8")
        + script_rows({"1.0": ["init.sql"]}, "c", "kdb9"),
        SCRIPTS,
    )
    for limit in (1, 100):
        got = rows(selection.select_sources(scripts, ["mariadb", "dm8"], rows_per_task=limit), "service", "db_type", "wanted", "filename")
        assert got == [
            ("a", "mariadb", "dm8", "init.sql"), ("a", "mariadb", "mariadb", "init.sql"), ("b", "dm8", "dm8", "init.sql"),
            ("b", "mariadb", "mariadb", "01-a.sql"), ("b", "mariadb", "mariadb", "init.sql"),
        ]
    assert rows(selection.missing_sources(scripts, ["dm8"])) == [("c", "dm8")]


def test_latest_versions_and_roles(spark, rows):
    names = ["1.9", "1.10", "1.2", "1.10.1"]
    df = spark.createDataFrame([("s", n) for n in names], "service string, version string").withColumn(
        "vkey", version_key("version")
    )
    assert rows(selection.latest_n_versions(df, ["service"], 2), "version", "recency") == [("1.10", 2), ("1.10.1", 1)]
    assert rows(selection.checked_versions(df, ["service"], selection.CHECK_ALL, "1.10"), "version") == [("1.10",), ("1.10.1",)]
    assert rows(selection.checked_versions(df, ["service"], selection.CHECK_LATEST), "version") == [("1.10.1",)]
    assert rows(selection.max_version(df, ["service"])) == [("s", "1.10.1")]
    assert rows(selection.min_version(df, ["service"])) == [("s", "1.2")]
    roles = rows(selection.replay_roles(df, ["service"]), "version", "is_base", "is_step", "is_fresh_install")
    assert roles == [
        ("1.10", False, True, False), ("1.10.1", False, True, True), ("1.2", True, False, False), ("1.9", False, True, False),
    ]


def test_plan_after_everything_ran_is_empty(spark):
    trees = {
        ("a", "mariadb"): {"1.0": ["init.sql"], "1.1": ["01-a.sql", "02-b.sql"], "1.10": ["01-c.sql"]},
        ("b", "mariadb"): {"1.0": ["init.sql"], "2.0": ["init.sql", "01-x.sql"]},
    }
    rows = [r for (s, d), tree in trees.items() for r in script_rows(tree, s, d)]
    scripts = spark.createDataFrame(rows, SCRIPTS)
    services = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal int, service string")
    task = spark.createDataFrame([(1, "a", "1.0", "1.0", "1.0/init.sql", None, None)], TASK)
    plan = migration_plan(scripts, task, services)
    last = selection.version_completion(plan).select("service", "version", "last_script")
    outcomes = plan.join(last, ["service", "version"]).select(
        "service", "version", F.col("relative_name").alias("script_file_name"), F.lit("success").alias("status"),
        F.timestamp_micros((F.substring_index("version", ".", -1).cast("long") * 100 + F.col("seq") + 10).cast("long")).cast("timestamp_ntz").alias("ts"),
        F.monotonically_increasing_id().alias("event_id"), "target_version",
        (F.col("filename") == F.col("last_script")).alias("closes_version"),
    )
    after = ledger.ledger_apply(task, outcomes)
    state = {r.f_service_name: (r.f_installed_version, r.f_script_file_name) for r in after.collect()}
    assert state == {"a": ("1.10", "1.10/01-c.sql"), "b": ("2.0", "2.0/init.sql")}
    assert migration_plan(scripts, after, services).count() == 0
