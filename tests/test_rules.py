import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import rules
from ledgerline.plans import lint
from ledgerline.schemas import COLUMN_FACTS, COMMENT_FACTS, INDEX_FACTS, SCRIPTS, STATEMENTS, TABLE_FACTS
from ledgerline.sources.scripts import change_items, parse_change_lists


def columns(spark, entries, dialect="mariadb"):
    """(table, column, type, length, default)"""
    return spark.createDataFrame(
        [(dialect, "app", t, c, i, kind, length, False, True, None, None, None, default, None) for i, (t, c, kind, length, default) in enumerate(entries)],
        COLUMN_FACTS,
    )


def tables(spark, names, dialect="mariadb", options=None):
    return spark.createDataFrame([(dialect, "app", n, "f1", options or {}) for n in names], TABLE_FACTS)


def indexes(spark, entries, dialect="mariadb"):
    return spark.createDataFrame([(dialect, "app", t, n, kind, cols) for t, n, kind, cols in entries], INDEX_FACTS)


def found(df):
    return sorted((r.rule, r.severity, r.table_name, r.object_name) for r in df.collect())


def test_clean_definitions(spark):
    for dialect, length in (("mariadb", "64"), ("kdb9", "64"), ("dm8", "64 CHAR")):
        report = lint.definition_report(
            tables(spark, ["t_user"], dialect),
            columns(spark, [("t_user", "f_id", "BIGINT", None, None), ("t_user", "f_name", "VARCHAR", length, "")], dialect),
            indexes(spark, [("t_user", "PRIMARY", "PRIMARY", ["f_id"]), ("t_user", "idx_name", "INDEX", ["f_name", "191"])], dialect),
        )
        assert found(report) == []


def test_keys(spark):
    here = tables(spark, ["t_user", "t_order"])
    keys = indexes(spark, [("t_order", "PRIMARY", "PRIMARY", ["f_id"]), ("t_order", "fk", "FOREIGN", ["f_user_id"])])
    assert found(rules.key_rules(here, keys)) == [
        ("foreign_key_present", "error", "t_order", None), ("primary_key_missing", "error", "t_user", None),
    ]
    allowed = found(rules.key_rules(here, keys, allow_none_primary_key=True, allow_foreign_key=True))
    assert [severity for _, severity, _, _ in allowed] == ["warn", "warn"]


def test_text_defaults(spark):
    entries = [("t", f"f_{kind}_{default}", kind, None, default) for kind in ("TEXT", "JSON", "VARCHAR") for default in (None, "NULL", "null", "")]
    assert [name for _, _, _, name in found(rules.column_rules(columns(spark, entries)))] == ["f_JSON_", "f_TEXT_"]


@pytest.mark.parametrize(
    "kind, length, default, rule",
    [
        ("CHAR", "8", None, "char_type"), ("VARCHAR", "64", None, "varchar_length"), ("VARCHAR", None, None, "varchar_length"),
        ("INT", "11", None, "integer_length"), ("TEXT", None, "", "default_on_text"), ("VARCHAR", "64 char", None, None),
        ("BIGINT", None, None, None),
    ],
)
def test_dm8_columns(spark, kind, length, default, rule):
    got = [r for r, _, _, _ in found(rules.column_rules(columns(spark, [("t", "f", kind, length, default)], "dm8")))]
    assert got == ([rule] if rule else [])
    other = found(rules.column_rules(columns(spark, [("t", "f", kind, length, default)], "mariadb")))
    assert [r for r, _, _, _ in other] == (["default_on_text"] if rule == "default_on_text" else [])


def test_indexes(spark):
    cols = columns(spark, [("t_doc", "f_id", "BIGINT", None, None), ("t_doc", "f_text", "TEXT", None, None)], "dm8")
    keys = indexes(
        spark,
        [
            ("t_doc", "PRIMARY", "PRIMARY", ["f_absent"]), ("t_doc", "idx_a", "INDEX", ["f_text", "10"]),
            ("t_none", "uk_x", "UNIQUE", ["f_id"]), ("t_doc", "idx_a", "INDEX", ["f_id", "f_id"]),
        ],
        "dm8",
    )
    here = tables(spark, ["t_doc"], "dm8")
    assert found(rules.key_column_membership(keys, cols)) == [
        ("key_column_unknown", "error", "t_doc", "f_absent"), ("key_column_unknown", "error", "t_none", "f_id"),
    ]
    assert found(rules.index_table_exists(keys, here)) == [("index_table_unknown", "error", "t_none", "uk_x")]
    assert found(rules.text_in_index(keys, cols)) == [("text_in_index", "error", "t_doc", "f_text")]
    assert found(rules.duplicate_rules(here, cols, keys)) == [
        ("duplicate_index", "error", "t_doc", "idx_a"), ("duplicate_index_column", "error", "t_doc", "f_id"),
    ]


def test_names(spark):
    assert found(rules.table_name_rule(tables(spark, ["t_ok", "T_user", "user", "t_" + "x" * 63, "t_" + "x" * 62]))) == [
        ("table_name", "warn", "T_user", "T_user"), ("table_name", "warn", "t_" + "x" * 63, "t_" + "x" * 63),
        ("table_name", "warn", "user", "user"),
    ]
    keys = indexes(spark, [("t", "idx_a", "INDEX", []), ("t", "uk_a", "INDEX", []), ("t", "uk_b", "UNIQUE", []), ("t", "idx_b", "UNIQUE", []), ("t", "P", "PRIMARY", [])])
    assert [name for _, _, _, name in found(rules.index_name_rule(keys))] == ["idx_b", "uk_a"]


def test_options_and_duplicates(spark):
    assert found(rules.table_option_rule(tables(spark, ["t_a"], options={"ENGINE": "x", "TABLESPACE": "y"}))) == [
        ("table_option", "error", "t_a", "TABLESPACE")
    ]
    assert len(found(rules.table_option_rule(tables(spark, ["t_a"], "dm8", {"ENGINE": "x"})))) == 1
    twice = tables(spark, ["t_a", "t_a"]).withColumn("option_names", F.array(F.lit("ENGINE"), F.lit("ENGINE")))
    cols = columns(spark, [("t_a", "f", "INT", None, None)] * 2)
    keys = indexes(spark, [("t_a", "PRIMARY", "PRIMARY", ["f"]), ("t_a", "PRIMARY", "PRIMARY", ["g"])])
    assert [rule for rule, _, _, _ in found(rules.duplicate_rules(twice, cols, keys))] == [
        "duplicate_column", "duplicate_option", "duplicate_primary_key", "duplicate_table",
    ]


def test_comments(spark):
    notes = spark.createDataFrame(
        [("dm8", "app", "t_a", None, "'x'"), ("dm8", "app", "t_b", None, "'x'"), ("dm8", "app", "t_a", "f", " '' "), ("dm8", "app", "t_a", "g", "'x'")],
        COMMENT_FACTS,
    )
    report = rules.comment_rules(notes, tables(spark, ["t_a"], "dm8"), columns(spark, [("t_a", "f", "INT", None, None)], "dm8"))
    assert sorted((r.rule, r.table_name, r.object_name) for r in report.collect()) == [
        ("comment_column_unknown", "t_a", "g"), ("comment_empty", "t_a", "f"), ("comment_table_unknown", "t_b", None),
    ]


def statements(spark, entries):
    """(dialect, kind, file, [sql, ...])"""
    return spark.createDataFrame([(d, k, f, i, sql) for d, k, f, sqls in entries for i, sql in enumerate(sqls)], STATEMENTS)


SWITCH = {"mariadb": "USE app", "dm8": "SET SCHEMA app", "kdb9": "SET SEARCH_PATH TO app"}


@pytest.mark.parametrize("dialect", list(SWITCH))
def test_statements(spark, dialect):
    shared = ["CREATE TABLE t (f INT)", "create unique index uk_a on t (f)", "CREATE INDEX i ON t (f)", "CREATE VIEW v AS SELECT 1", "CREATE OR REPLACE VIEW v AS SELECT 1", "INSERT INTO t VALUES (1)"]
    updates = ["ALTER TABLE t ADD f INT", "DROP INDEX i", "DROP TABLE t", "DROP VIEW v", "UPDATE t SET f = 1", "DELETE FROM t"]
    never = ["CREATE DATABASE d", "CREATE UNIQUE TABLE t", "COMMENT ON VIEW v IS 'x'", "USE", "SET x TO y", "CREATE OR DROP VIEW v", "DROP DATABASE d", "ALTER VIEW v", "SELECT 1"]
    rename, comment, identity = "RENAME TABLE a TO b", "COMMENT ON TABLE t IS 'x'", "SET IDENTITY_INSERT t ON"
    rejected = {
        "init": [*updates, *never, rename, *([] if dialect == "dm8" else [comment, identity])],
        "update": [*never, *([] if dialect == "mariadb" else [rename]), *([] if dialect == "dm8" else [comment, identity])],
    }
    everything = [SWITCH[dialect], *shared, *updates, *never, rename, comment, identity, SWITCH[dialect], ";", "  "]
    for kind in ("init", "update"):
        report = rules.statement_allow_list(statements(spark, [(dialect, kind, "f", everything)]))
        assert sorted(r.detail for r in report.collect()) == sorted(rejected[kind])


def test_first_statement(spark):
    df = statements(
        spark,
        [
            ("mariadb", "init", "good", [";", "USE `app`;", "CREATE TABLE t (f INT)"]), ("mariadb", "init", "bad", ["CREATE TABLE t (f INT)", "USE app"]),
            ("dm8", "update", "wrong", ["USE app"]), ("dm8", "update", "also wrong", ["SET IDENTITY_INSERT t ON"]),
        ],
    )
    assert sorted(r.file_id for r in rules.first_statement_rule(df).collect()) == ["also wrong", "bad", "wrong"]


def test_first_statement_of_files_without_name_or_kind(spark, rows):
    df = statements(
        spark,
        [("mariadb", "init", None, ["CREATE TABLE a (f INT)", "USE app"]), ("mariadb", None, "f", ["CREATE TABLE b (f INT)"]),
         ("dm8", None, None, ["CREATE TABLE c (f INT)"]), ("kdb9", None, None, ["SET SEARCH_PATH TO app"])],
    )
    df = df.unionByName(df.limit(1).select(F.lit("dm8").alias("dialect"), F.lit("init").alias("file_kind"), F.lit("g").alias("file_id"),
                                           F.lit(None).cast(df.schema["ord"].dataType).alias("ord"), F.lit("CREATE TABLE d (f INT)").alias("sql")))
    assert rows(rules.first_statement_rule(df), "file_id", "detail") == [
        ("f", "CREATE TABLE b (f INT)"), ("g", "CREATE TABLE d (f INT)"), (None, "CREATE TABLE a (f INT)"), (None, "CREATE TABLE c (f INT)"),
    ]


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_current_database(spark, chunk):
    sqls = ["INSERT 1", "USE a", "INSERT 2", "INSERT 3", "USE b", "INSERT 4", "INSERT 5", "INSERT 6"]
    df = statements(spark, [("mariadb", "init", "f", sqls), ("mariadb", "init", "g", sqls[2:5])])
    got = {(r.file_id, r.ord): r.current_db for r in rules.statement_databases(df, chunk).collect()}
    assert [got["f", i] for i in range(8)] == [None, "a", "a", "a", "b", "b", "b", "b"]
    assert [got["g", i] for i in range(3)] == [None, None, "b"]


def test_change_files(spark, rows):
    good = '{"db_name":"d","table_name":"t","object_type":"COLUMN","operation_type":"ADD","object_name":"f","object_property":"INT","object_comment":""}'
    texts = {
        "good": f"[{good}]", "empty": "[]", "object": good, "broken": "[{", "number": f"[{good}, 3]",
        "null": f'[{good.replace(chr(34) + "INT" + chr(34), "null")}]', "missing": '[{"db_name":"d"}]',
        "kinds": f'[{good.replace("COLUMN", "VIEW").replace("ADD", "add")}]',
    }
    files = parse_change_lists(spark.createDataFrame(list(texts.items()), "file_id string, text string"))
    files = files.withColumn("dialect", F.lit("dm8"))
    report = {}
    for r in lint.change_report(files).collect():
        report.setdefault(r.file_id, []).append(r.rule)
    assert {k: sorted(v) for k, v in report.items()} == {
        "empty": ["empty_change_list"], "object": ["not_a_json_list"], "broken": ["not_a_json_list"],
        "number": ["item_not_an_object"], "null": ["field_not_text:object_property"],
        "missing": sorted(f"missing_field:{f}" for f in rules.REQUIRED_ITEM_FIELDS[1:]),
        "kinds": ["unknown_object_type", "unknown_operation_type"],
    }
    items = change_items(files.filter("file_id in ('good', 'null')").select("file_id", "text"))
    assert rows(items, "file_id", "ord", "object_name", "object_property", "new_name") == [
        ("good", 0, "f", "INT", None), ("null", 0, "f", None, None),
    ]


def test_layout(spark):
    listing = [
        ("1.0", "init.sql", 4), ("1.0", "01-a.sql", 4), ("1.0", "01-b.json", 4), ("1.1", "1-a.sql", 4), ("1.1", "notes.md", 4),
        ("1.1", "init.sql", 5), ("latest", "x.txt", 4), ("1.2", "init.sql", 4), ("1.2", "01-a.py", 4), ("1.2", "02-a.py", 4),
    ]
    scripts = spark.createDataFrame([("svc", "mariadb", *entry) for entry in listing], SCRIPTS)
    listed = spark.createDataFrame([("svc", "mariadb", v) for v in ("1.0", "1.1", "1.2", "1.3", "tmp")], "service string, db_type string, version string")
    report = lint.layout_report(scripts, listed)
    assert sorted((r.rule, r.file_id.split("/", 2)[2]) for r in report.collect()) == [
        ("bad_script_name", "1.1/1-a.sql"), ("duplicate_script_number", "1.0"), ("empty_version", "1.3"),
        ("missing_init", "1.1"), ("subdirectory_in_version", "1.1/init.sql"), ("unknown_file", "1.1/notes.md"),
    ]
    assert {r.version for r in lint.scripts_to_check(scripts, 1).collect()} == {"1.2"}
    assert {r.version for r in lint.scripts_to_check(scripts, 3, "1.1").collect()} == {"1.1", "1.2"}


def test_versions_that_cannot_be_compared(spark):
    df = spark.createDataFrame([("v1.0.0", "1.0.0"), ("1.0", "1.1")], "a string, b string")
    assert [r.detail for r in rules.bad_version_rule(df, "a", "b").collect()] == ["v1.0.0 : 1.0.0"]


def test_identifiers(spark):
    df = spark.createDataFrame([("mariadb", "schema.t"), ("mariadb", "`t`"), ("dm8", "`t`")], "dialect string, name string")
    assert sorted(r.object_name for r in rules.identifier_rule(df, "name").collect()) == ["`t`", "schema.t"]


def test_added_columns_are_checked(spark):
    item = '{"db_name":"d","table_name":"t","object_type":"COLUMN","operation_type":"ADD","object_name":"%s","object_property":"%s","object_comment":""}'
    wanted = [("a", "VARCHAR(64)"), ("b", "VARCHAR(64 CHAR) DEFAULT ''"), ("c", "TEXT DEFAULT ''"), ("d", "TEXT DEFAULT NULL"), ("e", "INT COMMENT '(1)'"), ("f", "BIGINT(20) NOT NULL")]
    text = "[" + ",".join(item % pair for pair in wanted) + "]"
    files = parse_change_lists(spark.createDataFrame([("x", text)], "file_id string, text string")).withColumn("dialect", F.lit("dm8"))
    assert sorted((r.rule, r.object_name) for r in lint.change_report(files).collect()) == [
        ("default_on_text", "c"), ("integer_length", "f"), ("varchar_length", "a"),
    ]


def test_change_files_are_parsed_once(spark, rows):
    texts = [
        ("a", "dm8", '[{"db_name":"d","table_name":5,"object_type":"COLUMN","operation_type":"ADD","object_name":"f","object_property":"CHAR(2)","object_comment":""}, 7]'),
        ("b", "mariadb", "[]"), ("b", "mariadb", "[]"), (None, "dm8", None),
    ]
    files = parse_change_lists(spark.createDataFrame(texts, "file_id string, dialect string, text string"))
    report = lint.change_report(files)
    assert rows(report) == sorted(
        [
            ("field_not_text:table_name", "error", "d", None, "f", "a", "0"), ("char_type", "error", "d", "5", "f", None, "CHAR 2"),
            ("item_not_an_object", "error", None, None, None, "a", "1"), ("empty_change_list", "error", None, None, None, "b", None),
            ("empty_change_list", "error", None, None, None, "b", None), ("not_a_json_list", "error", None, None, None, None, None),
        ],
        key=repr,
    )
    assert "Union" not in str(report._jdf.queryExecution().optimizedPlan())


def test_layout_reads_scripts_once_for_the_version_index(spark, tmp_path):
    spark.createDataFrame([("svc", "mariadb", "1.0", "01-a.sql", 4)], SCRIPTS).write.parquet(str(tmp_path / "scripts"))
    scripts = spark.read.parquet(str(tmp_path / "scripts"))
    report = lint.layout_report(scripts, scripts.select("service", "db_type", "version"))
    plan = str(report._jdf.queryExecution().optimizedPlan())
    # Names, numbers and the listed versions; the index comes from storage.
    assert plan.count("has_init") and not re.search(r"max\(.*has_init|AS has_init", plan)
