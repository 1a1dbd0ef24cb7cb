"""Every query: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text as TX
from ledgerline.functions import versions as V
from ledgerline.functions.types import type_category
from ledgerline.operators import appended, diff, evolve, facts, ledger, quality, rules, selection
from ledgerline.plans import lint, migration, verify
from ledgerline.session import run_folder, store
from ledgerline.sources import catalog
from ledgerline.sources import scripts as script_source
from ledgerline.sources.partitions import delete_from_partitions, update_partitions, write_partitioned
from ledgerline.sources.tables import append_history, history_rows, read_history
from ledgerline.streaming import ledger as ledger_stream_jobs
from queries import roles
from queries.roles import DEFAULT, WANTED, table

Query = Callable[[SparkSession, str], DataFrame]

SOURCE = ["service", "db_type"]
RENAMES = [("svc-1", "svc-one"), ("svc-2", "svc-3"), ("svc-one", "svc-first"), ("svc-7", "")]
NAMED_SERVICES = ["svc-1", "svc-2", "svc-30", "svc-absent"]
FLOOR = "1998.6"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.version_index(roles.scripts(spark, sf_dir))


def _order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        roles.order_versions(spark, sf_dir)
        .filter(V.is_version("version"))
        .select("service", "version")
        .distinct()
        .withColumn("vkey", V.version_key("version"))
    )


# --- versions and scripts -------------------------------------------------


def version_index(spark, sf_dir):
    return _index(spark, sf_dir).drop("vkey")


def version_names(spark, sf_dir):
    return (
        roles.order_versions(spark, sf_dir)
        .groupBy("service")
        .agg(
            F.sum(V.is_version("version").cast("int")).alias("n_versions"),
            F.sum((~V.is_version("version")).cast("int")).alias("n_others"),
        )
    )


def version_extremes(spark, sf_dir):
    return selection.version_extremes(_order_versions(spark, sf_dir), ["service"])


def version_compare(spark, sf_dir):
    """Each order's version against the date of each of its lines, written as a version."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        "l_linenumber",
        F.concat_ws(".", F.year("l_shipdate"), F.month("l_shipdate"), F.lit("0")).alias("previous_version"),
    )
    versions = roles.order_versions(spark, sf_dir).select("o_orderkey", "version").join(lines, "o_orderkey")
    steps = selection.version_steps(versions, ["o_orderkey", "l_linenumber"])
    return steps.withColumn("comparison", F.col("comparison").cast("string"))


def version_order(spark, sf_dir):
    """Versions in order, with the key that orders them as text."""
    return (
        _order_versions(spark, sf_dir)
        .orderBy("vkey", "version", "service")
        .select("service", "version", V.version_of_key("vkey").alias("normal_version"))
    )


def versions_from(spark, sf_dir):
    return _order_versions(spark, sf_dir).filter(V.from_version("version", FLOOR)).drop("vkey")


def latest_n_versions(spark, sf_dir):
    return selection.latest_n_versions(_order_versions(spark, sf_dir), ["service"], 2).drop("vkey")


def checked_versions(spark, sf_dir):
    return selection.checked_versions(_index(spark, sf_dir), SOURCE, selection.CHECK_LATEST, FLOOR).select(
        *SOURCE, "version"
    )


def script_names(spark, sf_dir):
    name = "filename"
    return roles.scripts(spark, sf_dir).select(
        "service",
        V.relative_name("version", name).alias("relative_name"),
        V.anchor_number(name).alias("seq"),
        V.file_extension(name).alias("extension"),
        V.is_script_name(name).alias("is_script"),
        V.is_strict_script_name(name).alias("is_strict"),
    )


def service_filter(spark, sf_dir):
    return selection.service_filter(roles.services(spark, sf_dir), NAMED_SERVICES)


def existing_services(spark, sf_dir):
    started = roles.order_versions(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
    return selection.existing_services(roles.services(spark, sf_dir), started).orderBy("ordinal")


def install_script(spark, sf_dir):
    return selection.install_script(_index(spark, sf_dir), SOURCE)


def source_choice(spark, sf_dir):
    return selection.source_choice(roles.scripts(spark, sf_dir), ["dm8", "kdb9"], DEFAULT)


def select_sources(spark, sf_dir):
    return selection.select_sources(roles.scripts(spark, sf_dir), ["mariadb", "dm8", "kdb9"], DEFAULT)


def missing_sources(spark, sf_dir):
    return selection.missing_sources(
        roles.scripts(spark, sf_dir).filter(F.col("db_type") != "mariadb"), ["dm8", "kdb9"], DEFAULT
    )


def document_sources(spark, sf_dir):
    """Documents as sources: language wanted per source site, English by default."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("source").alias("service"), F.col("lang").alias("db_type"), "doc_id", "n_chars"
    )
    return selection.select_sources(documents, ["fr", "de"], "en")


def replay_roles(spark, sf_dir):
    return selection.replay_roles(_order_versions(spark, sf_dir), ["service"]).drop("vkey")


# --- planning and state ---------------------------------------------------


def _plan_inputs(spark, sf_dir):
    return roles.scripts(spark, sf_dir), roles.task(spark, sf_dir), roles.services(spark, sf_dir)


def service_state(spark, sf_dir):
    scripts, task, services = _plan_inputs(spark, sf_dir)
    return migration.service_state(selection.version_index(scripts), task, services, WANTED, DEFAULT).drop(
        "installed_vkey", "target_vkey", "anchor_key"
    )


def plan_problems(spark, sf_dir):
    """Services that the plan has to leave out, and why."""
    _, state = migration.planning_tables(*_plan_inputs(spark, sf_dir), WANTED, DEFAULT)
    return migration.plan_problems(state)


def migration_plan(spark, sf_dir):
    scripts, task, services = _plan_inputs(spark, sf_dir)
    return migration.migration_plan(scripts, task, services, WANTED, DEFAULT).drop("vkey")


def execution_order(spark, sf_dir):
    """Scripts of all versions in the order they would run."""
    scripts = selection.upgrade_scripts(roles.scripts(spark, sf_dir))
    return selection.execution_order(scripts, *SOURCE).drop("vkey", "depth")


def _script_tree(spark, sf_dir):
    return roles.write_tree(roles.script_texts(spark, sf_dir), run_folder(spark, "script-tree"))


def scan_scripts(spark, sf_dir):
    """Inventory of a written tree of scripts."""
    return script_source.scan_scripts(spark, _script_tree(spark, sf_dir))


def scan_script_text(spark, sf_dir):
    """SQL scripts of that tree with their texts."""
    return script_source.scan_script_text(spark, _script_tree(spark, sf_dir))


def scan_change_lists(spark, sf_dir):
    """Change items of the JSON scripts of that tree."""
    items = script_source.scan_change_lists(spark, _script_tree(spark, sf_dir))
    return items.select("file_id", "ord", "db_name", "object_name", "new_name")


def stored_facts(spark, sf_dir):
    """Columns of the given tables, from the footers of their files."""
    facts_ = catalog.stored_facts(spark, sf_dir).select("table_name", "column_name", "ordinal", "data_type", "is_nullable")
    return facts_.filter(~F.col("data_type").contains("<"))


def execution_number(spark, sf_dir):
    """The same order as a number of each script."""
    scripts = selection.upgrade_scripts(roles.scripts(spark, sf_dir))
    return selection.execution_number(scripts, *SOURCE).select(*SOURCE, "version", "filename", "number")


def pending_scripts(spark, sf_dir):
    """Pending scripts of services that were not interrupted."""
    scripts, task, services = _plan_inputs(spark, sf_dir)
    task = task.withColumn("f_script_file_name", F.lit(""))
    versions, state = migration.planning_tables(scripts, task, services, WANTED, DEFAULT)
    return migration.pending_scripts(scripts, versions, state).drop("vkey")


def resume_skip(spark, sf_dir):
    """Anchors that lie in the first pending version, where scripts are skipped."""
    tables = migration.planning_tables(*_plan_inputs(spark, sf_dir), WANTED, DEFAULT)
    return migration.live_anchors(migration.pending_versions(*tables)).drop("live_key")


def has_work(spark, sf_dir):
    return ledger.has_work(migration_plan(spark, sf_dir), roles.services(spark, sf_dir))


def version_completion(spark, sf_dir):
    return selection.version_completion(selection.upgrade_scripts(roles.scripts(spark, sf_dir)), SOURCE)


def task_lookup(spark, sf_dir):
    return ledger.task_lookup(roles.task(spark, sf_dir), roles.services(spark, sf_dir)).select(
        "service", "ordinal", "f_installed_version", "f_script_file_name"
    )


def history(spark, sf_dir):
    return history_rows(roles.outcomes(spark, sf_dir))


def history_append(spark, sf_dir):
    """History appended in two runs and read back."""
    folder = run_folder(spark, "history")
    for half in (0, 1):
        append_history(history_rows(roles.outcomes(spark, sf_dir).filter(F.col("event_id") % 2 == half)), folder)
    return read_history(spark, folder)


def ledger_latest(spark, sf_dir):
    return ledger.ledger_latest(history(spark, sf_dir))


def fail_fast_prefix(spark, sf_dir):
    outcomes = roles.outcomes(spark, sf_dir).select("service", "ts", "event_id", "status")
    return ledger.fail_fast_prefix(outcomes, F.col("status") == ledger.FAILED, ["service"], ["ts", "event_id"])


def fail_fast_services(spark, sf_dir):
    """The first service, by number, with a failure worth more than 495 stops the later ones."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    failed = (F.col("event_type") == "error") & (F.col("value") > 495)
    return ledger.fail_fast_services(events, failed, "user_id")


def rename_keys(spark, sf_dir):
    renames = ledger.compose_renames(RENAMES)
    return ledger.rename_keys(
        roles.task(spark, sf_dir).select("f_service_name", "f_installed_version"), renames, "f_service_name"
    )


def rename_collisions(spark, sf_dir):
    return ledger.rename_collisions(roles.task(spark, sf_dir), ledger.compose_renames(RENAMES), "f_service_name")


def _closing_outcomes(outcomes):
    """Outcomes of which a purchase closes its version."""
    return outcomes.select(
        "service",
        "version",
        V.relative_name("version", "filename").alias("script_file_name"),
        "status",
        "ts",
        "event_id",
        F.lit("9.9.9").alias("target_version"),
        F.col("filename").endswith("-purchase.sql").alias("closes_version"),
    )


def ledger_apply(spark, sf_dir):
    """State after the outcomes of all events."""
    return ledger.ledger_apply(roles.task(spark, sf_dir), _closing_outcomes(roles.outcomes(spark, sf_dir))).drop("f_id")


def task_stream(spark, sf_dir):
    """State after all events read as a stream: two runs, the second with late rows and some of the first again."""
    events = table(spark, sf_dir, "events")
    folder = run_folder(spark, "task-stream")
    arriving = f"{folder}/events"
    first = F.col("event_id") % 3 < 2
    # Late rows lie among those of the first run, one in five of which comes twice.
    for part in (events.filter(first), events.filter(~first | (F.col("event_id") % 5 == 0))):
        part.repartition(4, "event_id").write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
        query = ledger_stream_jobs.run_to_task_state(
            _closing_outcomes(roles.event_outcomes(stream)), f"{folder}/state", f"{folder}/progress"
        )
        state = ledger_stream_jobs.read_state(spark, f"{folder}/state", query, ledger.STATE_SCHEMA)
    return ledger.task_after(roles.task(spark, sf_dir), state).drop("f_id")


def ledger_stream(spark, sf_dir):
    """State from the events read as a stream; equals ``ledger_latest``."""
    schema = table(spark, sf_dir, "events").schema
    # A table is a file or a folder of part files; a stream reads folders, which the pattern may stand for.
    path = f"{sf_dir}/events.parquet"
    is_file = table(spark, sf_dir, "events").select("_metadata.file_path").limit(1).filter(F.col("file_path").endswith("/events.parquet"))
    reader = spark.readStream.schema(schema)
    events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if is_file.count() else reader.parquet(path)
    folder = run_folder(spark, "ledger-stream")
    query = ledger_stream_jobs.run_to_state(
        history_rows(roles.event_outcomes(events)), f"{folder}/state", f"{folder}/progress"
    )
    return ledger_stream_jobs.read_state(spark, f"{folder}/state", query)


# --- text -----------------------------------------------------------------


def mask_secrets(spark, sf_dir):
    """Whole props and whole document texts with a secret of each beside them."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(
            F.col("props"), F.lit(", {'PASSWORD':  'x"), F.col("value").cast("int").cast("string"),
            F.lit('\', "sentinelPassword":"'), F.col("event_type"), F.lit('", "user": "u"}'),
        ).alias("text"),
    )
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit('{"password": "'), F.col("source"), F.lit('"} '), F.col("text")).alias("text"),
    )
    return events.unionByName(documents).select("id", TX.mask_secrets("text").alias("masked"))


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        TX.json_extract("props", "$.k").alias("k"),
        F.concat_ws(",", TX.json_extract("props", "$.k", "$.absent")).alias("both"),
    )


def text_to_bytes(spark, sf_dir):
    """Bytes of every document's whole text: their number and digest."""
    data = TX.text_to_bytes("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(data).alias("n_bytes"), F.md5(data).alias("digest")
    )


def event_time_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", TX.event_time_text("ts").alias("time_text"))


def _written_names(spark, sf_dir) -> DataFrame:
    """Part names written the way statements may write them."""
    named = F.concat(F.regexp_replace("p_name", " ", "_"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") < 20, "mariadb").when(F.col("p_size") < 35, "dm8").otherwise("kdb9").alias("dialect"),
        F.when(F.col("p_type") == "STANDARD", F.concat(F.lit(" `"), named, F.lit("`;\n")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit('"'), named, F.lit('"')))
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("db."), named))
        .when(F.col("p_type") == "PROMO", F.concat(named, F.lit("(191)")))
        .otherwise(named)
        .alias("written"),
    )


def identifiers(spark, sf_dir):
    return _written_names(spark, sf_dir).select(
        "p_partkey",
        TX.clean_identifier("written", "dialect").alias("name"),
        TX.clean_column_name("written", "dialect").alias("column_name"),
        TX.object_name("written").alias("object_name"),
        TX.has_illegal_characters("written", "dialect").alias("is_illegal"),
    )


def type_parts(spark, sf_dir):
    """Length, sign and category of types written out in full."""
    columns = roles.column_facts(spark, sf_dir)
    written = F.concat(
        "data_type", F.coalesce(F.concat(F.lit("("), "type_length", F.lit(")")), F.lit("")),
        F.when(F.col("column_default").isNull(), " unsigned NOT NULL").otherwise(" NOT NULL"),
    )
    rest = F.regexp_replace("written", r"^\w+(\([^)]*\))?", "")
    return columns.withColumn("written", written).select(
        "table_name",
        "column_name",
        "written",
        TX.type_length("written").alias("length"),
        TX.is_unsigned(rest).alias("is_unsigned"),
        type_category("data_type", "dialect").alias("category"),
    )


def statement_parts(spark, sf_dir):
    return roles.statements(spark, sf_dir).select(
        "file_id",
        "ord",
        TX.is_blank_statement("sql").alias("is_blank"),
        TX.statement_verb("sql").alias("verb"),
        TX.statement_object("sql").alias("object"),
        TX.database_of_switch("sql", "dialect").alias("database"),
        TX.strip_existence_clause("sql").alias("bare_sql"),
    )


# --- rules ----------------------------------------------------------------


def current_database(spark, sf_dir):
    return rules.statement_databases(roles.statements(spark, sf_dir), 1024).select("file_id", "ord", "current_db")


def statement_report(spark, sf_dir):
    """Both rules on statements, which are derived once and stored."""
    return lint.statement_report(store(roles.statements(spark, sf_dir), "statements"))


def change_items(spark, sf_dir):
    return script_source.change_items(roles.change_files(spark, sf_dir))


def change_report(spark, sf_dir):
    return lint.change_report(script_source.parse_change_lists(roles.change_files(spark, sf_dir)))


def duplicate_numbers(spark, sf_dir):
    return rules.duplicate_numbers(roles.scripts(spark, sf_dir))


def layout_report(spark, sf_dir):
    """All rules on script trees, which are derived once and stored."""
    listed = roles.order_versions(spark, sf_dir).select("service", "db_type", "version").distinct()
    return lint.layout_report(store(roles.scripts(spark, sf_dir), "scripts"), listed)


def checked_layout(spark, sf_dir):
    """Rules on the latest version of each script tree from a floor on."""
    scripts = store(roles.scripts(spark, sf_dir), "scripts")
    return lint.checked_layout(scripts, selection.CHECK_LATEST, FLOOR)


def service_verdict(spark, sf_dir):
    """Whether each service passes the checks of its latest versions and of its statements."""
    report = lint.lint_report(checked_layout(spark, sf_dir), statement_report(spark, sf_dir))
    return lint.service_verdict(report, roles.services(spark, sf_dir))


def identifier_rule(spark, sf_dir):
    return rules.identifier_rule(_written_names(spark, sf_dir), "written", detail="dialect")


def _definitions(spark, sf_dir):
    return roles.table_facts(spark, sf_dir), roles.column_facts(spark, sf_dir), roles.index_facts(spark, sf_dir)


def duplicate_definitions(spark, sf_dir):
    return rules.duplicate_rules(*_definitions(spark, sf_dir))


def key_rules(spark, sf_dir):
    tables, _, indexes = _definitions(spark, sf_dir)
    return rules.key_rules(tables, indexes, allow_none_primary_key=False, allow_foreign_key=True)


def key_column_membership(spark, sf_dir):
    _, columns, indexes = _definitions(spark, sf_dir)
    return rules.key_column_membership(indexes, columns)


def index_table_exists(spark, sf_dir):
    tables, _, indexes = _definitions(spark, sf_dir)
    return rules.index_table_exists(indexes, tables)


def comment_rules(spark, sf_dir):
    tables, columns, _ = _definitions(spark, sf_dir)
    return rules.comment_rules(roles.comment_facts(spark, sf_dir), tables, columns)


def column_rules(spark, sf_dir):
    return rules.column_rules(roles.column_facts(spark, sf_dir))


def text_in_index(spark, sf_dir):
    _, columns, indexes = _definitions(spark, sf_dir)
    return rules.text_in_index(indexes, columns)


def table_option_rule(spark, sf_dir):
    return rules.table_option_rule(roles.table_facts(spark, sf_dir))


def naming_rules(spark, sf_dir):
    tables, _, indexes = _definitions(spark, sf_dir)
    return rules.table_name_rule(tables).unionByName(rules.index_name_rule(indexes))


def lint_report(spark, sf_dir):
    """All rules on all script trees, statements, change files and definitions.

    A dozen rules read the definitions, so those are derived once and stored.
    """
    tables, columns, indexes = (store(df, "definitions") for df in _definitions(spark, sf_dir))
    definitions = lint.definition_report(
        tables, columns, indexes, roles.comment_facts(spark, sf_dir), allow_foreign_key=True
    )
    return lint.lint_report(
        layout_report(spark, sf_dir), statement_report(spark, sf_dir), change_report(spark, sf_dir), definitions
    )


def lint_verdict(spark, sf_dir):
    return lint.lint_verdict(lint_report(spark, sf_dir))


# --- changes to tables ----------------------------------------------------

ORDER_CHANGES = [
    {"object_type": "COLUMN", "operation_type": "ADD", "object_name": "o_channel", "object_property": "VARCHAR(16) DEFAULT 'web'"},
    {"object_type": "COLUMN", "operation_type": "ADD", "object_name": "O_CustKey", "object_property": "INT"},
    {"object_type": "COLUMN", "operation_type": "MODIFY", "object_name": "o_totalprice", "object_property": "BIGINT"},
    {"object_type": "COLUMN", "operation_type": "RENAME", "object_name": "o_orderpriority", "object_property": "VARCHAR(16)",
     "new_name": "o_priority"},
    {"object_type": "COLUMN", "operation_type": "DROP", "object_name": "o_orderstatus", "object_property": ""},
    {"object_type": "COLUMN", "operation_type": "DROP", "object_name": "o_absent", "object_property": ""},
    {"object_type": "INDEX", "operation_type": "ADD", "object_name": "idx_cust", "object_property": "o_custkey"},
    {"object_type": "TABLE", "operation_type": "RENAME", "object_name": "orders", "object_property": "", "new_name": "t_order"},
]


def _items(changes, table_name="orders"):
    return [
        {"db_name": "shop", "table_name": table_name, "object_comment": "", "new_name": "", **change} for change in changes
    ]


def evolve_orders(spark, sf_dir):
    """Orders after the changes of three versions, given out of order."""
    changes = _items(ORDER_CHANGES)
    by_version = {"1.10.0": changes[6:], "1.9.0": changes[3:6], "1.2": changes[:3]}
    result = verify.replay_path({("shop", "orders"): table(spark, sf_dir, "orders")}, by_version)
    return result.tables["shop", "t_order"]


def lossy_casts(spark, sf_dir):
    """Prices that a change to a small integer type would lose."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return evolve.lossy_casts(lines, "l_extendedprice", "smallint")


def lossy_lengths(spark, sf_dir):
    """Names that a change to a shorter text type would cut."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return evolve.lossy_casts(parts, "p_name", "string", 14)


def lossy_short_lengths(spark, sf_dir):
    """Names that a change to a type of nine characters would cut."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return evolve.lossy_casts(parts, "p_name", "string", 9)


def modify_column(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    narrowed = evolve.modify_column(evolve.modify_column(lines, "L_PARTKEY", "tinyint"), "l_linenumber", "bigint")
    return evolve.modify_column(narrowed, "l_partkey", "string")


def apply_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return evolve.apply_update(
        orders,
        (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000),
        {"o_orderpriority": F.lit("1-URGENT"), "o_totalprice": F.col("o_totalprice") + 1},
    )


def apply_delete(spark, sf_dir):
    """Deletes where a predicate is true; rows for which it is unknown stay."""
    orders = table(spark, sf_dir, "orders")
    unknown_for_open = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 250000)
    return evolve.apply_delete(orders, unknown_for_open)


def apply_insert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    seeds = table(spark, sf_dir, "customer").select(
        (-F.col("c_custkey") - 1).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey")
    )
    return evolve.apply_insert(orders, seeds, {"o_orderstatus": "N", "o_totalprice": 0})


def user_step(spark, sf_dir):
    """A user's cleaning step between two column changes, and one that fails and is tolerated."""
    def clean(df: DataFrame) -> DataFrame:
        return df.withColumn("p_name", F.initcap("p_name"))

    def broken(df: DataFrame) -> DataFrame:
        return df.withColumn("p_name", F.col("p_name").cast("int") + F.raise_error(F.lit("not clean")).cast("int"))

    items = _items(
        [
            {"object_type": "COLUMN", "operation_type": "RENAME", "object_name": "p_name", "object_property": "", "new_name": "p_label"},
            {"object_type": "COLUMN", "operation_type": "DROP", "object_name": "p_retailprice", "object_property": ""},
        ],
        "part",
    )
    changes = [("shop", "part", clean), ("shop", "part", broken), *items]
    result = evolve.replay_changes({("shop", "part"): table(spark, sf_dir, "part")}, changes, tolerate_errors=True)
    return result.tables["shop", "part"]


def batch_steps(spark, sf_dir):
    """Two steps over batches, named by their scripts, between changes of columns in two versions."""
    def initials(batches):
        for batch in batches:
            words = [name.split() for name in batch["p_label"].to_pylist()]
            yield batch.append_column("p_initials", pa.array(["".join(w[0] for w in ws) for ws in words], pa.string()))

    def classes(frames):
        for frame in frames:
            yield frame.assign(p_class=(frame["p_size"] // 10).astype("Int64")).drop(columns="p_size")

    steps = {
        "1.9/02-initials.py": evolve.BatchStep(initials, {"p_initials": "string"}),
        "1.10/01-classes.py": evolve.BatchStep(classes, {"p_class": "bigint"}, ["p_size"], pandas=True),
    }
    items = _items(
        [
            {"object_type": "COLUMN", "operation_type": "RENAME", "object_name": "p_name", "object_property": "", "new_name": "p_label"},
            {"object_type": "COLUMN", "operation_type": "DROP", "object_name": "p_retailprice", "object_property": ""},
            {"object_type": "COLUMN", "operation_type": "MODIFY", "object_name": "p_class", "object_property": "VARCHAR(8)"},
        ],
        "part",
    )
    by_version = {
        "1.10": [("shop", "part", "1.10/01-classes.py"), items[2]],
        "1.9": [items[0], ("shop", "part", "1.9/02-initials.py"), items[1]],
    }
    result = verify.replay_path({("shop", "part"): table(spark, sf_dir, "part")}, by_version, steps=steps)
    return result.tables["shop", "part"]


def _orders_by_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("placed", F.year("o_orderdate"))
    return write_partitioned(orders, run_folder(spark, "orders-by-year"), ["placed"])


def partition_update(spark, sf_dir):
    """Orders stored by year, after dear ones of two years were made urgent."""
    stored = _orders_by_year(spark, sf_dir)
    dear = F.col("placed").isin(1996, 1998) & (F.col("o_totalprice") > 100000)
    update_partitions(stored, dear, {"o_orderpriority": F.lit("1-URGENT"), "o_totalprice": F.col("o_totalprice") + 1})
    return stored.read()


def partition_delete(spark, sf_dir):
    """Orders stored by year, without those of one year and some of another."""
    stored = _orders_by_year(spark, sf_dir)
    gone = (F.col("placed") == 1995) | ((F.col("placed") == 1997) & (F.col("o_orderstatus") != "F"))
    delete_from_partitions(stored, gone)
    return stored.read()


def replay_facts(spark, sf_dir):
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    base = roles.base_service_facts(spark, sf_dir, columns)
    return facts.replay_facts(base, roles.faulty_changes(spark, sf_dir, columns), None, verify.SCOPE, verify.VARIANTS)


def change_problems(spark, sf_dir):
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    base = roles.base_service_facts(spark, sf_dir, columns)
    return facts.change_problems(roles.faulty_changes(spark, sf_dir, columns), verify.SCOPE, base, verify.VARIANTS).drop("new_name", "data_type")


def _renamed_chains(spark, sf_dir):
    base = roles.base_service_facts(spark, sf_dir).filter(F.col("dialect") == "mariadb").drop("dialect")
    base = store(base, "chain-facts")
    return facts.replay(base, roles.chained_renames(base), scope=["service"])


def rename_chains(spark, sf_dir):
    """Every table of a service takes the name of the next one, in one step; some chains end on a taken name."""
    return _renamed_chains(spark, sf_dir)[0]


def rename_problems(spark, sf_dir):
    """The renames of those chains that end on a taken name: all of them."""
    return _renamed_chains(spark, sf_dir)[1].select("service", "table_name", "step", "new_name", "problem")


def create_and_drop_tables(spark, sf_dir):
    """Facts of one dialect's tables: some renamed, some dropped, those of another dialect created."""
    columns = roles.column_facts(spark, sf_dir).select("db_name", "table_name", "column_name", "data_type", "dialect")
    here = columns.filter(F.col("dialect") == "mariadb").drop("dialect")
    names = facts.tables_of(here)
    renamed = facts.rename_tables(
        here,
        names.filter(F.col("table_name").startswith("T_")).withColumn("new_name", F.lower("table_name")),
    )
    kept = facts.drop_tables(renamed, names.filter(F.col("table_name").endswith("7")))
    created = facts.create_tables(kept, columns.filter(F.col("dialect") != "kdb9").drop("dialect"))
    return facts.drop_databases(created, ["DB_F"])


def upgrade_equals_install(spark, sf_dir):
    """Differences between the upgraded orders and a direct install: none."""
    installed = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_totalprice").cast("bigint").alias("o_totalprice"),
        "o_orderdate",
        F.col("o_orderpriority").alias("o_priority"),
        F.lit("web").alias("o_channel"),
    )
    return diff.upgrade_equals_install(evolve_orders(spark, sf_dir), installed)


def install_differences(spark, sf_dir):
    """The same comparison with an install that changes, lacks and repeats a few orders."""
    upgraded, key = evolve_orders(spark, sf_dir), F.col("o_orderkey")
    price = F.when(key % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    installed = upgraded.filter(key % 1500 != 3).withColumn("o_totalprice", price)
    return diff.upgrade_equals_install(upgraded, installed.unionByName(installed.filter(key % 2000 == 5)))


def row_difference(spark, sf_dir):
    """Lines of two flags compared as multisets of supplier and quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity")
    return diff.row_difference(
        lines.filter(F.col("l_returnflag") == "A").drop("l_returnflag"),
        lines.filter(F.col("l_returnflag") == "R").drop("l_returnflag"),
    )


def name_difference(spark, sf_dir):
    """Customers with a finished order and no open one."""
    orders = table(spark, sf_dir, "orders")
    return diff.name_difference(
        orders.filter(F.col("o_orderstatus") == "F").select("o_custkey"),
        orders.filter(F.col("o_orderstatus") == "P").select("o_custkey"),
    )


# --- checks on rows -------------------------------------------------------


def key_violations(spark, sf_dir):
    return quality.key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def null_key_violations(spark, sf_dir):
    """Customers as parts of a key that is NULL for some orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("owner"),
        F.year("o_orderdate").alias("placed"),
    )
    return quality.key_violations(orders, ["owner", "placed"])


def orphans(spark, sf_dir):
    """Parts on order lines that are absent from the list of small parts."""
    small = table(spark, sf_dir, "part").filter(F.col("p_size") < 25)
    return quality.orphans(table(spark, sf_dir, "lineitem"), small, ["l_partkey"], ["p_partkey"])


def appended_keys(spark, sf_dir):
    """Keys of order lines that arrive year by year; a large discount leaves a key without a line number."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_discount") < 0.1, F.col("l_linenumber")).alias("l_linenumber"),
        F.year("l_shipdate").alias("shipped"),
    )
    checked = appended.AppendedKeys(spark, run_folder(spark, "line-keys"), ["l_orderkey", "l_linenumber"], lines.schema)
    parts = [F.col("shipped") < 1994, F.col("shipped").between(1994, 1996), ~(F.col("shipped") <= 1996) | F.col("shipped").isNull()]
    for append, part in enumerate(parts, 1):
        checked.add(lines.filter(part), append)
    return checked.violations()


def appended_orphans(spark, sf_dir):
    """Parts on order lines that are absent from the small parts, both arriving in turns."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    small = table(spark, sf_dir, "part").filter(F.col("p_size") < 25)
    checked = appended.AppendedReferences(spark, run_folder(spark, "line-parts"), ["l_partkey"], ["p_partkey"], lines.schema)
    checked.add_parents(small.filter(F.col("p_size") < 12), 1)
    checked.add_children(lines.filter(F.col("l_linenumber") <= 3), 1)
    checked.add_parents(small.filter(F.col("p_size") >= 12), 2)
    checked.add_children(lines.filter(F.col("l_linenumber") > 3), 2)
    return checked.violations()


def constraint_violations(spark, sf_dir):
    """Orders whose customer is not among the configured ones, by a written definition."""
    return quality.constraint_violations(
        table(spark, sf_dir, "orders"),
        "FOREIGN KEY (o_custkey) REFERENCES customer (c_custkey)",
        {"customer": table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "MACHINERY")},
    )


def check_violations(spark, sf_dir):
    return quality.constraint_violations(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"),
        "CHECK (l_quantity < 45 or l_discount > 0.05)",
    )


# --- schemas --------------------------------------------------------------


def schema_diff(spark, sf_dir):
    """Base facts of one dialect against freshly installed facts of another."""
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    base = roles.base_service_facts(spark, sf_dir, columns).filter(F.col("dialect") == "mariadb")
    check = roles.installed_service_facts(spark, sf_dir, columns).filter(F.col("dialect") == "kdb9")
    return diff.schema_diff(base, check, ["service"], "mariadb", "kdb9")


def table_diff(spark, sf_dir):
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    base = roles.base_service_facts(spark, sf_dir, columns).filter(F.col("dialect") == "mariadb")
    check = roles.base_service_facts(spark, sf_dir, columns).filter(F.col("dialect") == "kdb9")
    return diff.table_diff(base, check, ["service"])


def existing_columns(spark, sf_dir):
    """Whether the column a change names is there, for all changes at once."""
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    wanted = roles.service_changes(spark, sf_dir, columns).select(
        *verify.SCOPE, "db_name", "table_name", F.upper("object_name").alias("column_name")
    )
    return facts.existing_columns(wanted, roles.base_service_facts(spark, sf_dir, columns), verify.SCOPE)


def existing_tables(spark, sf_dir):
    """How many changes name each table, and whether it is there."""
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    named = roles.service_changes(spark, sf_dir, columns).groupBy(*verify.SCOPE, "db_name", "table_name").agg(F.count("*").alias("n_changes"))
    return facts.existing_tables(named, roles.base_service_facts(spark, sf_dir, columns), verify.SCOPE)


def existing_constraints(spark, sf_dir):
    """Whether each defined table has the unique key that is named after it."""
    wanted = roles.definition_names(spark, sf_dir)
    return facts.existing_constraints(wanted, roles.index_facts(spark, sf_dir), ["dialect"])


def existing_databases(spark, sf_dir):
    """How many defined tables lie in a database that the other facts hold."""
    names = roles.table_facts(spark, sf_dir).select(F.upper("db_name").alias("db_name"))
    known = roles.column_facts(spark, sf_dir).filter(F.col("db_name") != "db_p")
    return facts.existing_databases(names, known).groupBy("db_name", "is_present").agg(F.count(F.lit(1)).alias("n_tables"))


def verify_report(spark, sf_dir):
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    return verify.verify_report(
        roles.base_service_facts(spark, sf_dir, columns),
        roles.faulty_changes(spark, sf_dir, columns),
        roles.installed_service_facts(spark, sf_dir, columns),
        None,
        roles.VERIFY_DIALECTS,
    )


def verify_verdict(spark, sf_dir):
    every = table(spark, sf_dir, "supplier").select(F.concat(F.lit("svc-"), F.col("s_suppkey").cast("string")).alias("service"))
    return verify.verify_verdict(verify_report(spark, sf_dir), every)


def verify_versions(spark, sf_dir):
    """Upgrade paths of all services from version 1.9 on, for dialects they have no scripts of as well."""
    columns = store(roles.service_columns(spark, sf_dir), "service-columns")
    return verify.verify_versions(*roles.service_trees(spark, sf_dir, columns), roles.VERIFY_DIALECTS, floor="1.9")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        migration_plan, plan_problems, execution_order, pending_scripts, resume_skip, service_state, has_work, version_index, version_names,
        version_extremes, version_compare, version_order, versions_from, latest_n_versions, checked_versions,
        script_names, service_filter, existing_services, install_script, source_choice, select_sources,
        missing_sources, document_sources, replay_roles, version_completion, task_lookup, history, history_append, ledger_latest,
        fail_fast_prefix, fail_fast_services, rename_keys, rename_collisions, ledger_apply, ledger_stream, task_stream,
        mask_secrets, json_extract, text_to_bytes, event_time_text, identifiers, type_parts, statement_parts,
        current_database, statement_report, change_items, change_report, duplicate_numbers, layout_report,
        identifier_rule, duplicate_definitions, key_rules, key_column_membership, index_table_exists, comment_rules,
        column_rules, text_in_index, table_option_rule, naming_rules, lint_report, lint_verdict, evolve_orders,
        lossy_casts, lossy_lengths, modify_column, apply_update, apply_delete, apply_insert, user_step, replay_facts, change_problems,
        rename_chains, rename_problems,
        create_and_drop_tables, upgrade_equals_install, row_difference, name_difference, key_violations,
        null_key_violations, orphans, constraint_violations, check_violations, schema_diff, table_diff,
        existing_columns, existing_tables, existing_constraints, existing_databases, verify_report, verify_verdict, verify_versions,
        install_differences, lossy_short_lengths, scan_scripts, scan_script_text, scan_change_lists, stored_facts,
        execution_number, checked_layout, service_verdict, batch_steps, partition_update, partition_delete, appended_keys, appended_orphans,
    )
}
