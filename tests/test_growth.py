"""Costly rows keep all cores busy whatever a file's splits, and are computed once."""

import pytest

import __spark_entry__ as entry

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["part_runs", "drafts_mended"])
def test_rows_of_one_split_are_dealt_over_all_cores(spark, name):
    assert entry.queries()[name](spark, SMALLEST).rdd.getNumPartitions() >= 4


def test_missing_numbers_are_computed_once(spark):
    plan = entry.queries()["uncovered_by_source"](spark, SMALLEST)._jdf.queryExecution().optimizedPlan().toString()
    steps = [line.split("(", 1)[0].strip(" :+-") for line in plan.split("\n") if "array_except" in line]
    assert len(steps) == 1 and steps[0].startswith("Generate explode"), steps


def test_cells_of_one_split_are_dealt_over_all_cores(spark):
    from reportloom.plans import catalog

    assert catalog.fit_cells(spark, SMALLEST).where("not is_header").rdd.getNumPartitions() >= 4
