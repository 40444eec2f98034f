"""Plan-shape guards for the scale design (exchanges, pushdown, no cross joins)."""

import os
import re

import pytest

from loglens.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)


def test_flagship_one_shuffle_on_session_and_pushdown(spark):
    df = catalog.QUERIES["classify_logs"](spark, SF)
    plan = plan_of(df)
    hashed = [e for e in exchanges(plan) if e.startswith("hashpartitioning")]
    on_session = [e for e in hashed if "session_id" in e or "conv_id" in e]
    assert len(on_session) == 1, hashed
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scoring_has_no_pair_join(spark):
    for name in ("hybrid_scores", "cosine_topk", "best_category"):
        plan = plan_of(catalog.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_lexical_scores_moves_no_text(spark):
    plan = plan_of(catalog.QUERIES["lexical_scores"](spark, SF))
    assert exchanges(plan) == []
    assert plan.count("Scan parquet") == 1  # documents once; the benchmark went into the broadcast


def test_column_pruning_on_text_tables(spark):
    plan = plan_of(catalog.QUERIES["session_rollup"](spark, SF))
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
