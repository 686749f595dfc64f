"""Plan shapes that matter at scale."""

from __future__ import annotations

import re

import pytest

from ledgerloom.operators import reports
from ledgerloom.operators.extract import extract
from ledgerloom.plans.queries import QUERIES
from ledgerloom.sources import derived
from ledgerloom.sources.tables import load


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_join_python_or_single_partition(name, spark, sf_dir):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", plan)
    # One-row aggregates may end in one partition, windows and sorts must not.
    for block in re.findall(r"(?:Window|Sort) \[[^\n]*\n[^\n]*Exchange SinglePartition", plan):
        raise AssertionError(block)


def test_extraction_is_map_only(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    assert "Exchange" not in _plan(extract(docs))


def test_scans_are_pruned(spark, sf_dir):
    plan = _plan(reports.job_counts(derived.jobs(spark, sf_dir)))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    plan = _plan(derived.invoices(spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "l_discount" not in plan and "l_shipdate" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = _plan(reports.failure_reasons(derived.jobs(spark, sf_dir)))
    # The status is made from two columns, so the filter cannot reach the files, but the scan is narrow.
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan
    plan = _plan(load(spark, sf_dir, "orders").filter("o_orderkey < 10").select("o_orderkey"))
    assert "LessThan(o_orderkey,10)" in plan


def test_page_takes_top_rows_only(spark, sf_dir):
    listing = reports.listing(derived.invoices(spark, sf_dir), derived.suppliers(spark, sf_dir))
    assert "TakeOrderedAndProject" in _plan(reports.page(listing, 20, 40))


def test_printed_invoices_number_no_lines(spark, sf_dir):
    """Sums need no position, and printed lines are put in order in their invoice's row."""
    for made in (derived.invoices, derived.invoice_texts, derived.reply_texts, derived.supplier_sightings):
        assert "Window" not in _plan(made(spark, sf_dir))
    assert "Window" in _plan(derived.items(spark, sf_dir))
