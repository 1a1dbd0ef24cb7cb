"""The shape of physical plans, without broadcasts that only small test data allows."""

import re

import pytest

from queries.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan_of(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cache = {}

    def plan(name):
        if name not in cache:
            df = QUERIES[name](spark, DATA)
            cache[name] = df._jdf.queryExecution().executedPlan().toString()
        return cache[name]

    yield plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "ledger_stream"])
def test_no_cross_join_no_python_and_no_single_partition(plan_of, name):
    plan = plan_of(name)
    assert not re.search(r"CartesianProduct|NestedLoop|Python|Pandas", plan)
    # A global minimum, read as a scalar, is the one thing that ends in one task.
    assert "SinglePartition" not in plan or name == "fail_fast_services"


@pytest.mark.parametrize(
    "name",
    [
        "history", "mask_secrets", "json_extract", "text_to_bytes", "identifiers", "statement_parts", "change_items",
        "change_report", "evolve_orders", "modify_column", "lossy_casts", "apply_update", "apply_delete", "apply_insert",
        "user_step", "check_violations", "table_option_rule", "naming_rules", "service_filter",
    ],
)
def test_row_wise_work_needs_no_shuffle(plan_of, name):
    assert "Exchange" not in plan_of(name)


@pytest.mark.parametrize("name", ["key_violations", "row_difference", "ledger_latest", "version_names", "key_rules"])
def test_one_shuffle_after_a_partial_aggregation(plan_of, name):
    plan = plan_of(name)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "partial_" in plan


def test_recent_versions_are_limited_before_the_shuffle(plan_of):
    assert "WindowGroupLimit" in plan_of("latest_n_versions") and ", Partial" in plan_of("latest_n_versions")


def test_columns_and_filters_reach_the_scan(plan_of):
    schema = lambda name: re.search(r"ReadSchema: struct<([^>]*)>", plan_of(name)).group(1)
    assert schema("key_violations") == "l_orderkey:bigint,l_linenumber:int"
    assert "o_orderstatus" not in schema("evolve_orders")
    assert "GreaterThanOrEqual" in plan_of("check_violations") or "PushedFilters: [" in plan_of("check_violations")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan_of("name_difference"))


def test_evolution_is_one_projection_over_the_scan(plan_of):
    assert len(re.findall(r"Project", plan_of("evolve_orders"))) == 1


def test_scripts_are_joined_on_the_version_and_parsed_once(plan_of):
    plan = plan_of("migration_plan")
    assert re.search(r"SortMergeJoin \[service[^,]*, db_type[^,]*, version", plan)
    assert "WindowExec" not in plan and "Window " not in plan
