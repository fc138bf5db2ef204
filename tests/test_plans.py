"""Plan lint over every registered query (sf0.001): the shapes that would
break at scale must not appear.

* no cartesian product / nested-loop join (no cross joins);
* no Python on executors at all;
* every single-partition exchange is fed by a partial aggregate (global
  aggregates are partial per task first; no global window or sort gathers rows);
* scans of the driver tables read only the columns the query needs.
"""

import re

import pyarrow.parquet as pq
import pytest

from scoreline.plans import all_queries

from .conftest import SF_SMALL

QUERIES = all_queries()
SCAN = re.compile(r"FileScan parquet \[([^\]]*)\].*?Location: \w+\(\d+ paths?\)\[file:([^\],]*)")


def plan_of(spark, name):
    return QUERIES[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shapes(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan and "MapInArrow" not in plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_" in lines[i + 1], f"{name}: single-partition exchange without partial aggregate"
    for cols, path in SCAN.findall(plan):
        if path.startswith(SF_SMALL):
            total = len(pq.read_schema(path).names)
            read = len([c for c in cols.split(",") if c.strip()])
            assert read < total or total <= 3, f"{name}: reads all {total} columns of {path}"


def test_aggregations_are_partial_before_shuffle(spark):
    for name in ("nation_stats", "head_to_head", "standings", "squad_kpis", "value_rollup", "team_names"):
        plan = plan_of(spark, name)
        # a partial aggregate under every shuffle of an aggregation: at least
        # one (partial, final) pair of aggregate nodes
        aggs = plan.count("HashAggregate(") + plan.count("SortAggregate(")
        assert aggs >= 2 and aggs % 2 == 0, name


def test_top_k_per_group_uses_group_limit(spark):
    for name in ("head_to_head_top", "features_lookup", "ranking_metrics"):
        assert "WindowGroupLimit" in plan_of(spark, name), name


def test_top_n_is_take_ordered(spark):
    plan = plan_of(spark, "best_thirds")
    assert "TakeOrderedAndProject" in plan


def test_filter_pushed_into_scan(spark):
    plan = plan_of(spark, "stage_matches")
    assert "PushedFilters: [IsNotNull(l_orderkey)" in plan
