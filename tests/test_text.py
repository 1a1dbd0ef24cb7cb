import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as TX
from ledgerline.functions.types import default_text, spark_type, type_category


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"password": "x1"}', '{"password": "*****"}'),
        ("{'PassWord':'x1', 'a': 'b'}", "{'PassWord':'*****', 'a': 'b'}"),
        ('{"sentinelPassword":   "q"}', '{"sentinelPassword":   "*****"}'),
        ('{"pass": "x1"}', '{"pass": "x1"}'),
    ],
)
def test_mask_secrets(spark, text, expected):
    assert value(spark, TX.mask_secrets(F.lit(text))) == expected


def test_identifiers(spark):
    clean = lambda name, d="mariadb": value(spark, TX.clean_identifier(F.lit(name), d))
    bad = lambda name, d="mariadb": value(spark, TX.has_illegal_characters(F.lit(name), d))
    assert clean("`t_user`") == "t_user"
    assert clean("t_user;") == "t_user"
    assert clean('"t_user"', "dm8") == "t_user"
    assert value(spark, TX.clean_column_name(F.lit("`f_name`(191)"), "mariadb")) == "f_name"
    assert [bad(n) for n in ("schema.t_user", '"t_user"', "'t_user'", "t_user")] == [True, True, True, False]
    assert [bad(n, "dm8") for n in ('"t_user"', "`t_user`")] == [False, True]
    assert value(spark, TX.object_name(F.lit("db.t_user"))) == "t_user"


def test_type_strings(spark):
    length = lambda text: value(spark, TX.type_length(F.lit(text)))
    assert [length(t) for t in ("VARCHAR(64)", "(64 CHAR)", "(10,2)", "BIGINT")] == ["64", "64 CHAR", "10,2", None]
    assert value(spark, TX.is_unsigned(F.lit(" unsigned NOT NULL"))) is True
    assert value(spark, TX.is_unsigned(F.lit("NOT NULL"))) is False


@pytest.mark.parametrize(
    "name, dialect, expected",
    [
        ("INT", "mariadb", "IntegerType"), ("bigint", "mariadb", "IntegerType"), ("BOOLEAN", "mariadb", "IntegerType"),
        ("DECIMAL", "mariadb", "FixedPointType"), ("DOUBLE", "mariadb", "FloatingPointType"), ("BIT", "mariadb", "BitValueType"),
        ("LONGTEXT", "mariadb", "StringType"), ("DATETIME", "mariadb", "DateAndTimeType"), ("GEOMETRY", "mariadb", "UNKNOWN"),
        ("REAL", "mariadb", "UNKNOWN"), ("REAL", "dm8", "FloatingPointType"), ("BYTE", "dm8", "IntegerType"),
        ("BOOLEAN", "dm8", "UNKNOWN"), ("MEDIUMTEXT", "dm8", "UNKNOWN"), ("CLOB", "dm8", "StringType"),
        ("BOOLEAN", "kdb9", "BooleanType"), ("JSON", "kdb9", "UNKNOWN"), ("INT", "other", "UNKNOWN"),
    ],
)
def test_type_category(spark, name, dialect, expected):
    df = spark.createDataFrame([(name, dialect)], "data_type string, dialect string")
    assert df.select(type_category("data_type", "dialect")).first()[0] == expected


def test_user_defined_type(spark):
    df = spark.createDataFrame([("USER-DEFINED", "tinyint")], "data_type string, column_type string")
    assert df.select(type_category("data_type", "kdb9", "column_type")).first()[0] == "IntegerType"


def test_statements(spark):
    verb = lambda sql: value(spark, TX.statement_verb(F.lit(sql)))
    target = lambda sql: value(spark, TX.statement_object(F.lit(sql)))
    assert verb(" create table t(x int)") == "CREATE"
    assert target("create table t(x int)") == "TABLE"
    assert target("CREATE or  replace view v AS SELECT 1") == "OR REPLACE VIEW"
    assert target("CREATE OR DROP VIEW v") == "OR DROP VIEW"
    assert target("CREATE UNIQUE INDEX i ON t (a)") == "UNIQUE INDEX"
    switched = lambda sql, d: value(spark, TX.database_of_switch(F.lit(sql), d))
    assert switched("USE `app`;", "mariadb") == "app"
    assert switched('SET SCHEMA "app";', "dm8") == "app"
    assert switched("set search_path to app", "kdb9") == "app"
    assert switched("SET IDENTITY_INSERT t ON", "dm8") is None
    assert value(spark, TX.strip_existence_clause(F.lit("DROP TABLE IF EXISTS t"))).split() == ["DROP", "TABLE", "t"]
    assert value(spark, TX.strip_existence_clause(F.lit("CREATE TABLE if not exists t"))).split() == ["CREATE", "TABLE", "t"]
    assert [value(spark, TX.is_blank_statement(F.lit(s))) for s in ("", " ;\n", "a")] == [True, True, False]


def test_values(spark):
    assert bytes(value(spark, TX.text_to_bytes(F.lit("é")))) == "é".encode()
    assert value(spark, TX.json_extract(F.lit('{"a": {"b": 3}}'), "$.a.b")) == "3"
    assert value(spark, TX.json_extract(F.lit('{"a": 1}'), "$.a", "$.c")) == ["1", None]
    assert value(spark, TX.event_time_text(F.lit("2024-01-02 03:04:05.6").cast("timestamp_ntz"))) == "2024-01-02 03:04:05"


@pytest.mark.parametrize(
    "prop, expected, default",
    [
        ("VARCHAR(64) NOT NULL DEFAULT ''", "string", ""), ("bigint", "bigint", None), ("INT UNSIGNED DEFAULT 7", "bigint", "7"),
        ("DECIMAL(10,2)", "decimal(10,2)", None), ("BIT(1)", "boolean", None), ("BIT(8)", "binary", None),
        ("DATETIME DEFAULT NULL", "timestamp_ntz", None), ("TINYINT DEFAULT '3'", "tinyint", "3"),
    ],
)
def test_spark_types(prop, expected, default):
    assert spark_type(prop).simpleString() == expected
    assert default_text(prop) == default
