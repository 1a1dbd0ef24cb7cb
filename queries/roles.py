"""The parts that the given tables play: scripts, state, history, statements and facts.

Orders are versions of their customer's service and lineitems the scripts of a
version; events are outcomes, statements or change files; orders and lineitems
also stand for table and column definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.versions import is_version, version_key
from ledgerline.operators.ledger import FAILED, SUCCESS

WANTED, DEFAULT = "dm8", "mariadb"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _service(key: str) -> Column:
    return F.concat(F.lit("svc-"), _text(key))


def _dialect_of_priority() -> Column:
    first = F.substring("o_orderpriority", 1, 1)
    return F.when(first == "1", "dm8").when(first == "2", "kdb9").otherwise("mariadb")


def _version_of_order() -> Column:
    date = F.concat_ws(".", F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"))
    return (
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") > 400000), F.concat(F.lit("v"), date))
        .when(
            (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "4-NOT SPECIFIED"),
            F.concat(date, F.lit(".0")),
        )
        .when(
            (F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_totalprice") > 300000),
            F.concat(date, F.lit(".12345678901234567890")),
        )
        .otherwise(date)
    )


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service, db_type, version, status and key of every order."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        _service("o_custkey").alias("service"),
        _dialect_of_priority().alias("db_type"),
        _version_of_order().alias("version"),
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount"
    )
    extension = F.when(F.col("l_returnflag") == "A", ".sql").when(F.col("l_returnflag") == "R", ".py").otherwise(".json")
    part = F.concat(F.lit("p"), _text("l_partkey"))
    filename = (
        F.when(F.col("l_linenumber") == 7, "init.sql")
        .when(
            (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 6),
            F.concat(F.lit("notes-"), part, F.lit(".md")),
        )
        .when((F.col("l_linenumber") == 5) & (F.col("l_discount") >= 0.05), F.concat(F.lit("20240101120000-"), part, extension))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("5-"), part, extension))
        .otherwise(F.concat(F.lpad(_text("l_linenumber"), 2, "0"), F.lit("-"), part, extension))
    )
    return (
        order_versions(spark, sf_dir)
        .join(lines, "o_orderkey")
        .select(
            "service",
            "db_type",
            "version",
            filename.alias("filename"),
            F.when(F.col("l_discount") >= 0.1, 5).otherwise(4).alias("depth"),
        )
    )


def script_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a root, and texts, of a tree of scripts with a version per part type of a supplier."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("number")).agg(
        F.count("*").alias("n"), F.max("l_quantity").cast("int").alias("size"), F.min("l_partkey").alias("part")
    )
    version = F.when(F.col("part") % 7 == 0, F.lit("latest")).otherwise(F.concat(F.lit("1."), _text("number")))
    dialect = F.when(F.col("part") % 3 == 0, "dm8").otherwise("mariadb")
    name = (
        F.when(F.col("number") == 1, "init.sql").when(F.col("size") % 5 == 0, F.concat(F.lit("sub/0"), _text("number"), F.lit("-deep.sql")))
        .when(F.col("number") == 4, F.concat(F.lit("04-change "), _text("part"), F.lit(".json"))).otherwise(F.concat(F.lit("0"), _text("number"), F.lit("-rows.sql")))
    )
    text = F.when(
        name.endswith(".json"), F.concat(F.lit('[{"db_name": "db", "object_name": "f_'), _text("n"), F.lit('"}, {"new_name": "f_'), _text("size"), F.lit('"}]'))
    ).otherwise(F.concat(F.lit("USE db;\nINSERT INTO t_"), _text("part"), F.lit(" VALUES ("), _text("n"), F.lit(");\n")))
    return lines.select(F.concat_ws("/", _service("l_suppkey"), dialect, version, name).alias("path"), text.alias("text"))


def write_tree(texts: DataFrame, folder: str) -> str:
    """Writes each text (path, text) to its path below a new folder; the root that Spark reads it from."""

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        local = "/" + folder.removeprefix("file:").lstrip("/")
        files, root = (pafs.LocalFileSystem(), local) if folder.startswith(("file:", "/")) else pafs.FileSystem.from_uri(folder)
        made = None
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["text"].to_pylist()):
                above = path.rpartition("/")[0]
                if above != made:
                    files.create_dir(f"{root}/{above}", recursive=True)
                    made = above
                with files.open_output_stream(f"{root}/{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    # Texts are few bytes and many files: as many tasks as a shuffle has, whatever the bytes. A folder's files come one after the other.
    n_tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(n_tasks, F.substring_index("path", "/", 1)).sortWithinPartitions("path")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of all segments but one are the configured services."""
    return (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_mktsegment") != "MACHINERY")
        .select(F.col("c_custkey").cast("int").alias("ordinal"), _service("c_custkey").alias("service"))
    )


def task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed is the highest finished version; the anchor lies in the lowest open one.

    Some services have closed no version yet, and some hold text that is none.
    """
    versions = (
        order_versions(spark, sf_dir).filter(is_version("version")).withColumn("vkey", version_key("version"))
    )
    order = F.struct("vkey", "version")
    finished, open_ = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    return (
        versions.groupBy(F.col("service").alias("f_service_name"))
        .agg(
            F.max(F.when(finished, order))["version"].alias("f_installed_version"),
            F.min(F.when(open_, order))["version"].alias("anchor"),
        )
        .filter(F.col("f_installed_version").isNotNull())
        .withColumn(
            "f_installed_version",
            F.when(F.col("f_service_name").endswith("77"), "")
            .when(F.col("f_service_name").endswith("88"), "latest")
            .otherwise(F.col("f_installed_version")),
        )
        .select(
            F.xxhash64("f_service_name").alias("f_id"),
            "f_service_name",
            "f_installed_version",
            F.col("f_installed_version").alias("f_target_version"),
            F.coalesce(F.concat(F.col("anchor"), F.lit("/03-done.sql")), F.lit("")).alias("f_script_file_name"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("f_create_time"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("f_update_time"),
        )
    )


def event_number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes of scripts; an error is a failure."""
    return event_outcomes(table(spark, sf_dir, "events"))


def event_outcomes(events: DataFrame) -> DataFrame:
    version = F.concat_ws(".", F.lit("1"), F.month("ts"), F.day("ts"))
    failed = F.col("event_type") == "error"
    return events.select(
        "event_id",
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").cast("int").alias("ordinal"),
        _service("user_id").alias("service"),
        version.alias("version"),
        F.concat(
            F.lpad(event_number().cast("string"), 2, "0"), F.lit("-"), F.col("event_type"), F.lit(".sql")
        ).alias("filename"),
        F.when(failed, FAILED).otherwise(SUCCESS).alias("status"),
        F.when(
            failed, F.concat(F.lit('{"user": "u1", "Password": "s'), _text("event_id"), F.lit('"}'))
        ).alias("message"),
    )



def _dialect_of_user() -> Column:
    dialects = F.array(*[F.lit(d) for d in ("mariadb", "dm8", "kdb9")])
    return F.element_at(dialects, (F.col("user_id") % 3 + 1).cast("int"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("number")
    k = number.cast("string")
    kind, event = F.col("dialect"), F.col("event_type")
    sql = (
        F.when((event == "signup") & (kind == "mariadb"), F.concat(F.lit("USE `db_"), k, F.lit("`;")))
        .when((event == "signup") & (kind == "dm8"), F.concat(F.lit('SET SCHEMA "db_'), k, F.lit('";')))
        .when(event == "signup", F.concat(F.lit("set search_path  to db_"), k))
        .when(event == "view", F.concat(F.lit("CREATE OR REPLACE VIEW v_"), k, F.lit(" AS SELECT 1")))
        .when((event == "click") & (number < 50), F.concat(F.lit("CREATE TABLE IF NOT EXISTS t_"), k, F.lit(" (f_id INT)")))
        .when(event == "click", F.concat(F.lit("ALTER TABLE t_"), k, F.lit(" DROP COLUMN IF EXISTS f_x")))
        .when((event == "purchase") & (number < 30), F.concat(F.lit("INSERT INTO t_"), k, F.lit(" VALUES (1)")))
        .when((event == "purchase") & (number < 60), F.concat(F.lit("update t_"), k, F.lit(" set f_id = 1")))
        .when((event == "purchase") & (number < 90), F.concat(F.lit("DROP DATABASE db_"), k))
        .when(event == "purchase", F.lit(" ; "))
        .when(number < 50, F.concat(F.lit("COMMENT ON TABLE t_"), k, F.lit(" IS 'x'")))
        .otherwise(F.concat(F.lit("RENAME TABLE t_"), k, F.lit(" TO t_x")))
    )
    return (
        table(spark, sf_dir, "events")
        .withColumns({"dialect": _dialect_of_user(), "number": event_number()})
        .select(
            F.when(F.col("user_id") % 37 == 0, "oracle")
            .when((kind == "mariadb") & (F.col("user_id") % 2 == 0), "tidb")
            .otherwise(kind)
            .alias("dialect"),
            F.when(F.col("event_id") % 2 == 0, "init").otherwise("update").alias("file_kind"),
            _service("user_id").alias("file_id"),
            F.col("event_id").cast("int").alias("ord"),
            sql.alias("sql"),
        )
    )


def change_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change files, most with something wrong in them."""
    number = F.col("number")
    k = number.cast("string")
    event = F.col("event_type")

    def item(object_type: str, object_property: str, tail: str) -> Column:
        return F.concat(
            F.lit('[{"db_name": "db_'), k, F.lit('", "table_name": "t_'), _text("user_id"),
            F.lit(f'", "object_type": "{object_type}", "operation_type": "ADD", "object_name": "f_'), k,
            F.lit(f'", "object_property": {object_property}{tail}}}]'),
        )

    comment = ', "object_comment": ""'
    text = (
        F.when(
            (event == "signup") & (number < 50), item("COLUMN", '"VARCHAR(64) DEFAULT \'\'"', comment)
        )
        .when(event == "signup", item("COLUMN", '"TEXT NOT NULL default \'x\'"', comment))
        .when(event == "view", item("VIEW", '""', comment))
        .when(event == "click", item("INDEX", '"f_1"', ""))
        .when(event == "purchase", item("COLUMN", "5", comment))
        .when(number < 50, F.lit("[]"))
        .otherwise(F.lit('{"db_name": "x"}'))
    )
    return table(spark, sf_dir, "events").withColumn("number", event_number()).select(
        _text("event_id").alias("file_id"), _dialect_of_user().alias("dialect"), text.alias("text")
    )


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "T_").otherwise("t_")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        "o_orderdate",
        _dialect_of_priority().alias("dialect"),
        F.concat(F.lit("db_"), F.lower("o_orderstatus")).alias("db_name"),
        F.concat(prefix, _text("o_orderkey")).alias("table_name"),
        _service("o_custkey").alias("file_id"),
    )


def definition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, and the name that a unique key of theirs would have."""
    return _definitions(spark, sf_dir).select(
        "dialect", "db_name", "table_name", F.concat(F.lit("UK_"), _text("o_orderkey")).alias("index_name")
    )


def column_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("l_quantity").cast("int").cast("string")
    flags = F.concat("l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.concat(F.lit("f_"), _text("l_linenumber")).alias("column_name"),
        F.col("l_linenumber").alias("ordinal"),
        F.when(flags == "AF", "BIGINT")
        .when(flags == "AO", "VARCHAR")
        .when(flags == "NF", "TEXT")
        .when(flags == "NO", "CHAR")
        .when(flags == "RF", "INT")
        .otherwise("DECIMAL")
        .alias("type_word"),
        "l_quantity",
        F.when(F.col("l_quantity") <= 15, F.lit(None).cast("string"))
        .when(F.col("l_quantity") <= 30, size)
        .otherwise(F.concat(size, F.lit(" CHAR")))
        .alias("type_length"),
        F.when(F.col("l_discount") < 0.03, F.lit(None).cast("string"))
        .when(F.col("l_discount") < 0.06, "null")
        .otherwise("")
        .alias("column_default"),
    )
    return (
        _definitions(spark, sf_dir)
        .select("o_orderkey", "dialect", "db_name", "table_name")
        .join(lines, "o_orderkey")
        .select(
            "dialect", "db_name", "table_name", "column_name", "ordinal",
            F.when(F.col("l_quantity") > 40, F.lower("type_word")).otherwise(F.col("type_word")).alias("data_type"),
            "type_length", "column_default",
        )
    )


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order; costly open orders define theirs twice."""
    large = F.col("o_totalprice") > 250000
    names = F.when(large, F.array(F.lit("ENGINE"), F.lit("TABLESPACE"), F.lit("ENGINE"))).otherwise(
        F.array(F.lit("ENGINE"), F.lit("comment"))
    )
    copies = F.when(large & (F.col("o_orderstatus") == "P"), 2).otherwise(1)
    return (
        _definitions(spark, sf_dir)
        .withColumn("option_names", names)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        .select(
            "dialect",
            "db_name",
            "table_name",
            "file_id",
            "option_names",
            F.map_from_entries(
                F.transform(F.array_distinct("option_names"), lambda name: F.struct(name, F.lit("x")))
            ).alias("options"),
        )
    )


def index_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary key on all tables but open ones, and one more key on every table."""
    priority = F.col("o_orderpriority")
    kind = F.when(priority == "2-HIGH", "UNIQUE").when(priority == "5-LOW", "FOREIGN").otherwise("INDEX")
    prefix = F.when(F.col("o_orderstatus") == "O", "uk_").otherwise("idx_")
    primary = F.when(
        F.col("o_orderstatus") != "P",
        F.struct(
            F.lit("PRIMARY").alias("index_name"), F.lit("PRIMARY").alias("kind"), F.array(F.lit("f_1")).alias("columns")
        ),
    )
    other = F.struct(
        F.concat(prefix, _text("o_orderkey")).alias("index_name"),
        kind.alias("kind"),
        F.array(
            F.concat(F.lit("f_"), F.month("o_orderdate").cast("string")), F.lit("f_2"), F.lit("10")
        ).alias("columns"),
    )
    table_name = F.when(
        F.col("o_totalprice") < 20000, F.concat(F.lit("t_absent_"), _text("o_orderkey"))
    ).otherwise(F.col("table_name"))
    return (
        _definitions(spark, sf_dir)
        .withColumn("table_name", table_name)
        .withColumn("_index", F.explode(F.array_compact(F.array(primary, other))))
        .select("dialect", "db_name", "table_name", "_index.*")
    )


def comment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_table = F.col("o_orderpriority") == "1-URGENT"
    return _definitions(spark, sf_dir).select(
        "dialect",
        "db_name",
        F.when(F.col("o_totalprice") < 20000, F.concat(F.lit("t_absent_"), _text("o_orderkey")))
        .otherwise(F.col("table_name"))
        .alias("table_name"),
        F.when(~on_table, F.concat(F.lit("f_"), F.month("o_orderdate").cast("string"))).alias("column_name"),
        F.when(F.col("o_totalprice") > 450000, " '' ").otherwise(F.concat(F.lit("'"), "o_orderpriority", F.lit("'"))).alias("comment"),
    )


# --- facts of services over versions, for verification ---------------------


# Type words by code; codes sort as the words do.
_TYPE_WORDS = ["BIGINT", "BOOLEAN", "DATETIME", "INT", "TEXT", "VARCHAR"]
_TYPE_OF_FLAGS = {"AF": "BIGINT", "AO": "VARCHAR", "NF": "TEXT", "NO": "DATETIME", "RF": "INT"}


def service_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct columns of a supplier's tables, with least and greatest type word and size.

    Numbers are grouped and text is made of the groups.
    """
    flags = F.concat("l_returnflag", "l_linestatus")
    code = F.lit(_TYPE_WORDS.index("BOOLEAN"))
    for pair, word in _TYPE_OF_FLAGS.items():
        code = F.when(flags == pair, _TYPE_WORDS.index(word)).otherwise(code)
    words = F.array(*[F.lit(word) for word in _TYPE_WORDS])
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_partkey", F.col("l_linenumber").alias("number"))
        .agg(F.min(code).alias("least"), F.max(code).alias("greatest"), F.max("l_quantity").alias("size"))
        .select(
            _service("l_suppkey").alias("service"),
            F.concat(F.lit("t_"), _text("l_partkey")).alias("table_name"),
            F.concat(F.lit("f_"), _text("number")).alias("column_name"),
            "number",
            words[F.col("least")].alias("old_type"),
            words[F.col("greatest")].alias("new_type"),
            "size",
        )
    )


VERIFY_DIALECTS = ["mariadb", "dm8", "kdb9"]


def _for_dialects(df: DataFrame) -> DataFrame:
    return df.withColumn("dialect", F.explode(F.array(*[F.lit(d) for d in VERIFY_DIALECTS])))


def base_service_facts(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """Columns 1 to 5 exist from the first version; kdb9 lacks tables whose first column is small."""
    absent = (F.col("dialect") == "kdb9") & (F.col("number") == 1) & (F.col("size") < 5)
    return (
        _for_dialects(service_columns(spark, sf_dir) if columns is None else columns)
        .filter((F.col("number") <= 5) & ~absent)
        .select("service", "dialect", F.lit("db").alias("db_name"), "table_name", "column_name", F.col("old_type").alias("data_type"))
    )


def service_changes(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """Step 1 changes columns 1 to 4 and adds column 6, step 2 renames column 5 and adds column 7."""
    number, size = F.col("number"), F.col("size")
    return (
        _for_dialects(service_columns(spark, sf_dir) if columns is None else columns)
        .filter(~((F.col("dialect") == "dm8") & (number == 6) & (size > 45)))
        .select(
            "service",
            "dialect",
            F.lit("db").alias("db_name"),
            "table_name",
            F.when(number.isin(5, 7), 2).otherwise(1).alias("step"),
            F.when((number == 4) & (size > 40), "TABLE").otherwise("COLUMN").alias("object_type"),
            F.when(number >= 6, "ADD")
            .when(number == 5, "RENAME")
            .when(number == 4, "DROP")
            .when(number == 3, "MODIFY")
            .otherwise("ADD")
            .alias("operation_type"),
            F.col("column_name").alias("object_name"),
            F.when(number == 5, "f_five").alias("new_name"),
            F.col("new_type").alias("data_type"),
        )
    )


def faulty_changes(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """The changes of services, and more that nobody can make."""
    columns = service_columns(spark, sf_dir) if columns is None else columns
    sound = service_changes(spark, sf_dir, columns)
    number = F.col("number")
    large = _for_dialects(columns).filter((F.col("size") > 48) & number.isin(2, 5, 7))
    bad = large.select(
        "service", "dialect", F.lit("db").alias("db_name"), "table_name",
        F.when(number == 2, 1).when(number == 5, 3).otherwise(2).alias("step"),
        F.when(number == 7, "TABLE").otherwise("COLUMN").alias("object_type"),
        F.when(number == 7, "TRUNCATE").when(number == 5, "RENAME").otherwise("ADD").alias("operation_type"),
        F.when(number == 2, F.col("column_name")).otherwise("f_99").alias("object_name"),
        F.lit(None).cast("string").alias("new_name"),
        F.col("new_type").alias("data_type"),
    )
    return sound.unionByName(bad)


def chained_renames(facts: DataFrame) -> DataFrame:
    """Step 1 moves each table of a service to the next name; step 2 moves the first table again.

    The last table of a service with an odd key stays, so the whole chain is blocked.
    """
    number = F.substring_index("table_name", "_", -1).cast("int")
    following = F.lead("table_name").over(Window.partitionBy("service").orderBy("number"))
    tables = facts.select("service", "db_name", "table_name").distinct().withColumn("number", number)
    is_odd = F.substring_index("service", "-", -1).cast("int") % 2 == 1
    named = tables.withColumns({"next": following, "is_odd": is_odd, "first": F.min("number").over(Window.partitionBy("service"))})
    change = [F.lit("TABLE").alias("object_type"), F.lit("RENAME").alias("operation_type"), F.col("table_name").alias("object_name")]
    first = named.withColumn("new_name", F.coalesce("next", F.when(~F.col("is_odd"), "t_free"))).filter("new_name IS NOT NULL")
    again = named.filter("number = first").withColumn("table_name", F.coalesce("next", F.lit("t_free"))).withColumn("new_name", F.lit("t_first"))
    void = F.lit(None).cast("string").alias("data_type")
    return first.select("service", "db_name", "table_name", F.lit(1).alias("step"), *change, "new_name", void).unionByName(
        again.select("service", "db_name", "table_name", F.lit(2).alias("step"), *change, "new_name", void)
    )


def installed_service_facts(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> DataFrame:
    """What a fresh install of the last version would give, had nobody made a mistake."""
    number = F.col("number")
    return (
        _for_dialects(service_columns(spark, sf_dir) if columns is None else columns)
        .filter(number != 4)
        .select(
            "service",
            "dialect",
            F.lit("db").alias("db_name"),
            "table_name",
            F.when(number == 5, "f_five").otherwise(F.col("column_name")).alias("column_name"),
            F.when(number.isin(3, 6, 7), F.col("new_type")).otherwise(F.col("old_type")).alias("data_type"),
        )
    )


def service_trees(spark: SparkSession, sf_dir: str, columns: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scripts, install facts and change items of versions 1.8 (below the floor) to 2.0.

    The changes of services are the scripts of 1.10 and 2.0; additions come before drops, as
    they do when a step makes both. A third of the services has no scripts for kdb9.
    """
    columns = service_columns(spark, sf_dir) if columns is None else columns
    present = ~((F.col("db_type") == "kdb9") & (F.substring_index("service", "-", -1).cast("int") % 3 == 0))
    fact = ["service", "db_type", "version", "db_name", "table_name", "column_name", "data_type"]

    def at(df: DataFrame, version: Column) -> DataFrame:
        return df.withColumnRenamed("dialect", "db_type").withColumn("version", version).filter(present)

    base, fresh = base_service_facts(spark, sf_dir, columns), installed_service_facts(spark, sf_dir, columns)
    early = base.filter(F.col("column_name") == "f_1").withColumn("column_name", F.lit("f_early"))
    installs = at(base, F.lit("1.9")).unionByName(at(fresh, F.lit("2.0"))).unionByName(at(early, F.lit("1.8")))
    number = F.substring_index("object_name", "_", -1).cast("int")
    items = at(service_changes(spark, sf_dir, columns), F.when(F.col("step") == 1, "1.10").otherwise("2.0"))
    # The first version's own changes are not made: its install script has them.
    unmade = at(service_changes(spark, sf_dir, columns).filter(number == 1).withColumn("operation_type", F.lit("DROP")), F.lit("1.9"))
    place = F.when(number == 4, 9).otherwise(number)
    items = items.unionByName(unmade).withColumn("ord", place)
    items = items.withColumn("filename", F.concat(F.lit("0"), place.cast("string"), F.lit("-change.json")))
    scripts = (
        columns.select("service").distinct().withColumn("dialect", F.explode(F.array(*[F.lit(d) for d in VERIFY_DIALECTS])))
        .withColumn("versions", F.array(*[F.lit(v) for v in ("1.8", "1.9", "1.10", "2.0", "next")]))
    )
    scripts = at(scripts, F.explode("versions")).withColumns({"filename": F.lit("init.sql"), "depth": F.lit(4)})
    return scripts.select("service", "db_type", "version", "filename", "depth"), installs.select(fact), items.drop("step")
