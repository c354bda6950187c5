"""Plan shapes: no Python per row, no cartesian products, pruned scans, top-k."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from wayfarer.plans import binding, olap

LAZY = [*olap.PACK, "recode_map", "hhmm_to_minutes", "strip_title", "corr_matrix", "validate", "null_profile", "top_k_per_group"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_stays_in_the_jvm_without_cartesian(spark, sf_dir, name):
    shown = plan(entry.queries()[name](spark, sf_dir))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in shown


def test_unused_dimensions_are_not_joined(spark, sf_dir):
    assert "Join" not in plan(olap.payment_usage(binding.star(spark, sf_dir)))
    assert "customer" not in plan(olap.delay_by_airline_class(binding.star(spark, sf_dir)))


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    shown = plan(olap.delayed_over_15(binding.star(spark, sf_dir)))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in shown


def test_fact_is_folded_before_the_late_join(spark, sf_dir):
    shown = plan(olap.delayed_over_15(binding.star(spark, sf_dir)))
    join, scan = shown.index("Join"), shown.index("l_quantity")
    assert shown[join:scan].count("HashAggregate") >= 2


def test_filters_are_pushed(spark, sf_dir):
    shown = plan(entry.queries()["filter_in_and"](spark, sf_dir))
    assert "PushedFilters" in shown


def test_top_k_is_a_bounded_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(entry.queries()["top_k"](spark, sf_dir))
    assert "WindowGroupLimit" in plan(entry.queries()["top_k_per_group"](spark, sf_dir))


def test_late_texts_are_those_of_the_star(spark, sf_dir):
    """Every column of every view, and no text made below a join."""
    columns = list(dict.fromkeys(c for v in ("fact", "flight", "airline", "service", "passenger") for c in binding.VIEWS[v][1]))
    late, plain = binding.late_flat(spark, sf_dir, columns), binding.star(spark, sf_dir).flat(columns)
    assert late.columns == columns and late.exceptAll(plain).isEmpty() and plain.exceptAll(late).isEmpty()
    plan = binding.late_flat(spark, sf_dir, ["Seat_Comfort", "Seat_Type", "Class"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Excellent" in plan and "Excellent" not in plan[plan.index("Join"):]
