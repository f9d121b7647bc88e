"""Plans stay scalable: no joins without an equality, no explicit hints, filters and columns reach the scan."""

import io
from contextlib import redirect_stdout

import pytest
from settings import SF_DIR
from pyspark.sql import functions as F

from palisade.operators import inventory, ranking
from palisade.plans.catalog import CATALOG

# these start jobs of their own before they return a plan
EAGER = set()


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(CATALOG) - EAGER))
def test_no_join_without_equality(spark, name):
    plan = plan_of(CATALOG[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(tables):
    plan = plan_of(inventory.tenant_scope(tables.customer.withColumnRenamed("c_nationkey", "organization_id"), 7)
                   .select("c_custkey"))
    assert "EqualTo(c_nationkey,7)" in plan and "struct<c_custkey:bigint,c_nationkey:int>" in plan


def test_small_top_k_is_cut_before_the_shuffle(tables):
    df = ranking.top_per_group(tables.events, ["event_type"], [F.col("ts"), F.col("event_id")], 10)
    plan = plan_of(df)
    assert plan.index("WindowGroupLimit") and "Partial" in plan


def test_pages_are_taken_without_a_full_sort(tables):
    assert "TakeOrderedAndProject" in plan_of(ranking.page(tables.events, [F.desc("ts"), F.col("event_id")], 10))


def test_nothing_is_pinned_to_a_machine(spark):
    """Library code sets no broadcast hints and keeps no executor-local checkpoints."""
    import pathlib

    import palisade

    for path in pathlib.Path(palisade.__file__).parent.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "F.broadcast(" not in text and "crossJoin" not in text, path
