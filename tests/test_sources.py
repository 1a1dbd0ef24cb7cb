import pytest

from ledgerline.functions.text import is_blank_statement
from ledgerline.operators.evolve import add_column
from ledgerline.operators.selection import existing_services, service_filter
from ledgerline.plans.lint import layout_report
from ledgerline.sources import catalog, scripts, tables


@pytest.fixture()
def tree(tmp_path):
    files = {
        "svc a/mariadb/1.0.0/init.sql": "USE app;\nCREATE TABLE t (f INT);",
        "svc a/mariadb/1.0.0/sub/deep.sql": "x",
        "svc a/mariadb/1.10.0/01-a.sql": "USE app",
        "svc a/mariadb/1.10.0/02-b.json": '[{"db_name": "d", "object_name": "f"}, {"db_name": "e", "new_name": "g"}]',
        "svc a/mariadb/latest/01-a.sql": "x",
        "svc-b/dm8/2.0/03-c.py": "print()",
        "README.md": "no script",
    }
    for name, text in files.items():
        path = tmp_path / "scripts" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "scripts")


@pytest.mark.parametrize("prefix", ["", "file:"])
def test_inventory(spark, rows, tree, prefix):
    assert rows(scripts.scan_scripts(spark, prefix + tree)) == [
        ("svc a", "mariadb", "1.0.0", "deep.sql", 5), ("svc a", "mariadb", "1.0.0", "init.sql", 4),
        ("svc a", "mariadb", "1.10.0", "01-a.sql", 4), ("svc a", "mariadb", "1.10.0", "02-b.json", 4),
        ("svc-b", "dm8", "2.0", "03-c.py", 4),
    ]


def test_inventory_reads_no_contents(spark, tree):
    plan = scripts.scan_scripts(spark, tree)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_whole_texts_and_change_lists(spark, rows, tree):
    text = scripts.scan_script_text(spark, tree)
    assert rows(text.filter("filename = 'init.sql'"), "service", "text") == [("svc a", "USE app;\nCREATE TABLE t (f INT);")]
    assert text.filter(is_blank_statement("text")).count() == 0
    assert rows(scripts.scan_change_lists(spark, tree), "file_id", "ord", "db_name", "object_name", "new_name") == [
        ("svc a/mariadb/1.10.0/02-b.json", 0, "d", "f", None), ("svc a/mariadb/1.10.0/02-b.json", 1, "e", None, "g"),
    ]
    assert "subdirectory_in_version" in {r.rule for r in layout_report(scripts.scan_scripts(spark, tree)).collect()}


def test_services(spark, rows, tree):
    services = spark.createDataFrame([(0, "svc-c"), (1, "svc a"), (2, "svc-b")], "ordinal int, service string")
    found = existing_services(services, scripts.scan_scripts(spark, tree)).orderBy("ordinal")
    assert [(r.service, r.has_scripts) for r in found.collect()] == [("svc-c", False), ("svc a", True), ("svc-b", True)]
    assert rows(service_filter(services, ["svc-b", "svc-x"]), "service") == [("svc-b",)]
    assert service_filter(services, None).count() == 3


def test_column_facts(spark):
    df = spark.createDataFrame([], "f_id bigint not null, f_price decimal(10,2), f_at timestamp_ntz, f_name string")
    facts = catalog.column_facts({("app", "t_a"): df}, "kdb9")
    got = [(r.ordinal, r.column_name, r.data_type, r.type_length, r.is_nullable) for r in facts.orderBy("ordinal").collect()]
    assert got == [
        (0, "f_id", "BIGINT", None, False), (1, "f_price", "DECIMAL", "10,2", True), (2, "f_at", "DATETIME", None, True),
        (3, "f_name", "VARCHAR", None, True),
    ]


def test_catalog_rows(spark):
    rows = spark.createDataFrame(
        [("app", "t_a", "f_x", 1, "USER-DEFINED", "tinyint unsigned", "NO"), ("app", "t_a", "f_y", 2, "int", "int", "YES")],
        "table_schema string, table_name string, COLUMN_NAME string, ordinal_position long, data_type string, column_type string, is_nullable string",
    )
    facts = catalog.catalog_facts(rows, "kdb9").orderBy("ordinal").collect()
    assert [(r.column_name, r.data_type, r.is_unsigned, r.is_nullable) for r in facts] == [
        ("f_x", "TINYINT UNSIGNED", True, False), ("f_y", "INT", False, True),
    ]


def test_rewritten_tables_go_to_a_new_place(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    tables.write_table(spark.range(3), old)
    tables.write_table(add_column(spark.read.parquet(old), "f_state", "int", 1), new)
    assert spark.read.parquet(new).columns == ["id", "f_state"]
    with pytest.raises(Exception):
        tables.write_table(spark.range(1), old)
