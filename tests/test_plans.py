"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest

from bindings.queries import QUERIES
from conftest import SF
from vigil.plans import firewall, patch, proxy
from vigil.sinks import tables as sinks
from vigil.sources import tables as sources

# Trained while their plan is built; what they train with is the ML library's own.
MODELS = {n for n in QUERIES if n.startswith("cmd_")} | {
    "dga_model_eval", "dga_forest_eval", "dga_logistic_eval", "dga_flagged_clients",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("db")
    sinks.append_path(tables["v_proxy"], str(root / "proxysg"))
    tables["v_fw"].drop("date").write.parquet(str(root / "fw"))
    return {n: sources.read_table(spark, str(root / n)) for n in ("proxysg", "fw")}


def test_dates_prune_folders(stored):
    plan = plan_of(sources.date_slice(stored["proxysg"], "2024-01-10", "2024-01-12").select("host"))
    assert "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<host:string>" in plan
    prefixed = plan_of(sources.date_prefix(stored["proxysg"], "2024-01-1").select("host"))
    assert "date_format" in prefixed.split("PartitionFilters: [")[1]
    whole = stored["proxysg"].count()
    assert 0 < sources.date_prefix(stored["proxysg"], "2024-01-1").count() < whole


def test_filters_and_columns_reach_the_scan(stored):
    plan = plan_of(firewall.denied_ports(stored["fw"]))
    assert "EqualTo(action,DENY)" in plan and "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<action:string,proto:string,dstport:bigint>" in plan


def test_top_transfers_skips_row_groups(stored):
    df = proxy.top_transfers(stored["proxysg"])
    assert "DataFilters: [isnotnull(csbytes" in plan_of(df)


def test_dashboard_ranks_before_it_gathers(stored, tables):
    for df in (firewall.dashboard_rows(stored["fw"]), patch.dashboard_rows(tables["v_sccm"])):
        assert plan_of(df).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("PythonUDF", "ArrowEval", "BatchEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
