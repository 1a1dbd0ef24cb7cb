from functools import cmp_to_key

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import versions as V


def compared(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(V.compare_versions("a", "b")).collect()]


def test_compare_cases(spark):
    cases = [
        ("7.3", "7.3", 0), ("7.3", "7.21", -1), ("7.21", "7.3", 1), ("30.8", "30.7.99", 1), ("6", "6.0.0", 0),
        ("6", "6.0.0.5", -1), ("12.5.3", "12.5", 1), ("x7", "7", None), ("7", "", None), ("0", "0.0.0", 0), ("0.0.1", "0", 1), ("07.3", "7.3", 0),
        ("1." + "9" * 40, "1.1" + "0" * 40, -1), ("2." + "0" * 30, "2", 0), ("1.00000000000000000000002", "1.3", -1),
    ]
    assert compared(spark, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_sort(spark):
    df = spark.createDataFrame([("5.40",), ("31.1",), ("5.8.2",), ("5.8",)], "v string")
    assert [r.v for r in df.orderBy(V.version_key("v")).collect()] == ["5.8", "5.8.2", "5.40", "31.1"]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("1.0", True), ("1.0.0", True), ("1.4.20.1", True), ("v1.0.0", False), ("1.0.0-beta", False), ("latest", False),
        ("", False), ("1..0", False), ("+1", False), ("1_0", False), ("1.0\n", False),
    ],
)
def test_version_names(spark, name, expected):
    assert spark.range(1).select(V.is_version(F.lit(name))).first()[0] is expected


def test_numbers_and_parts_of_script_names(spark):
    names = [
        ("04-fill.sql", 4), ("77-move.py", 77), ("008-keys.json", 8), ("shop/kdb9/7.3/31-rows.sql", 31), ("init.sql", None),
        ("fill.sql", None), ("4-fill.csv", None),
        ("20240101120000-b.sql", 20240101120000), ("9" * 50 + "-b.sql", int("9" * 38)),
    ]
    df = spark.createDataFrame([(n,) for n, _ in names], "n string")
    got = {r[0]: r[1] for r in df.select("n", V.script_number("n")).collect()}
    assert got == dict(names)
    longer = [("3-a.sql",), ("0012-a.sql",), ("9" * 50 + "-a.sql",), ("1" + "0" * 50 + "-a.sql",)]
    ordered = spark.createDataFrame(longer[::-1], "n string").orderBy(V.script_key("n")).collect()
    assert [(r.n,) for r in ordered] == longer and spark.range(1).select(V.script_key(F.lit("init.sql"))).first()[0] is None
    row = spark.range(1).select(
        V.file_extension(F.lit("a/01-x.tar.py")),
        V.file_extension(F.lit(".hidden")),
        V.relative_name(F.lit("1.2"), F.lit("01-a.sql")),
        V.anchor_version(F.lit("1.2/01-a.sql")),
        V.anchor_version(F.lit("")),
        V.anchor_number(F.lit("1.2/07-a.sql")),
        V.anchor_number(F.lit("1.2/init.sql")),
        V.is_strict_script_name(F.lit("1-a.sql")),
        V.is_strict_script_name(F.lit("01-a.sql")),
    ).first()
    assert tuple(row) == (".py", "", "1.2/01-a.sql", "1.2", None, 7, -1, False, True)


versions = st.lists(st.integers(0, 12), min_size=1, max_size=4).map(lambda ns: ".".join(map(str, ns)))


def padded(a, b):
    x, y = ([int(n) for n in v.split(".")] for v in (a, b))
    size = max(len(x), len(y))
    x, y = x + [0] * (size - len(x)), y + [0] * (size - len(y))
    return (x > y) - (x < y)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(versions, versions), min_size=20, max_size=60))
def test_compare_pads_with_zeros(spark, pairs):
    assert compared(spark, pairs) == [padded(a, b) for a, b in pairs]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(versions, min_size=5, max_size=40, unique=True))
def test_order_is_the_padded_order(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = [r.v for r in df.orderBy(V.version_key("v"), "v").collect()]
    assert got == sorted(sorted(names), key=cmp_to_key(padded))
