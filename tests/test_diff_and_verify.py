import pytest
from pyspark.sql import functions as F

from ledgerline.operators import diff
from ledgerline.plans import verify

FACTS = "db_name string, table_name string, column_name string, data_type string"


@pytest.mark.parametrize("limit", [1, 1000])
def test_schema_diff(spark, rows, limit):
    base = spark.createDataFrame(
        [("d", "t_a", "f_id", "BIGINT"), ("d", "t_a", "f_b", "BOOLEAN"), ("d", "t_a", "f_c", "INT"), ("d", "t_gone", "x", "INT"), ("d", "t_Case", "x", "INT")], FACTS
    )
    check = spark.createDataFrame(
        [("d", "t_a", "F_ID", "INT"), ("d", "t_a", "f_b", "boolean"), ("d", "t_a", "f_new", "INT"), ("d", "t_new", "x", "INT"), ("d", "t_case", "x", "INT")], FACTS
    )
    got = rows(diff.schema_diff(base, check, (), "mariadb", "kdb9", limit), "table_name", "column_name", "kind", "severity", "detail")
    assert got == sorted(
        [
            ("t_gone", None, "missing_table", "error", None), ("t_Case", None, "missing_table", "error", None),
            ("t_new", None, "extra_table", "warn", None), ("t_case", None, "extra_table", "warn", None),
            ("t_a", "F_C", "only_in_base", "error", None), ("t_a", "F_NEW", "only_in_check", "error", None),
            ("t_a", "F_B", "category_mismatch", "warn", "BOOLEAN -> BOOLEAN"),
        ],
        key=repr,
    )
    assert rows(diff.table_diff(base, check)) == [r for r in rows(diff.schema_diff(base, check)) if r[2] is None]
    assert diff.column_diff(base, check, (), "mariadb", "kdb9", limit).count() == 3
    assert rows(diff.schema_diff(base, base)) == []


def test_row_difference_counts_copies_and_nulls(spark, rows):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "n int, s string")
    b = spark.createDataFrame([("x", 2), ("x", 2), (None, 1), ("y", 3)], "s string, n int")
    assert rows(diff.row_difference(a, b)) == [(1, None, 1, 0), (2, "x", 0, 1)]
    assert rows(diff.upgrade_equals_install(a, a)) == []
    assert rows(diff.name_difference(a.select("n"), b.select("n").filter("n > 1"))) == [(1,)]


SERVICE_FACTS = "service string, dialect string, " + FACTS
CHANGES = (
    "service string, dialect string, db_name string, table_name string, step int, object_type string, "
    "operation_type string, object_name string, new_name string, data_type string"
)


def test_verify(spark, rows):
    base = spark.createDataFrame(
        [(s, d, "db", "t_a", "f_id", "BIGINT") for s in ("good", "bad") for d in ("mariadb", "kdb9")], SERVICE_FACTS
    )
    changes = [
        (s, d, "db", "t_a", 1, "COLUMN", "ADD", "f_x", None, "INT") for s in ("good", "bad") for d in ("mariadb", "kdb9")
        if (s, d) != ("bad", "kdb9")
    ]
    fresh = base.unionByName(base.withColumn("column_name", F.lit("f_x")).withColumn("data_type", F.lit("INT")))
    report = verify.verify_report(base, spark.createDataFrame(changes, CHANGES), fresh, [1], ["mariadb", "kdb9"])
    assert rows(report, "rule", "object_name", "file_id") == [
        ("not_after_upgrade", "f_x", "bad/kdb9"), ("only_in_base", "F_X", "bad/kdb9"),
    ]
    assert rows(verify.verify_verdict(report)) == [("bad", 2, 0, True)]
