"""Shape of the physical plans: what must not appear in any of them, and what must."""

import os

import pytest

import __spark_entry__ as entry_module

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
TRAINING = {"q32_gbt_cv", "q33_search"}


def plan_of(spark, name):
    df = entry_module.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - TRAINING))
def test_no_nested_loops_and_no_row_udfs(spark, name):
    plan = plan_of(spark, name)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["q25_stft_db", "q26_dwt", "q27_energy_share", "q28_decimate", "q31_quantise"])
def test_kernel_runs_once(spark, name):
    assert plan_of(spark, name).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name, evaluations", [("q47_wav_headers", 3), ("q47_wav_formats", 1), ("q41_wav_catalog", 3)])
def test_files_are_encoded_once(spark, name, evaluations):
    """Each Python evaluation in a task is a process: one encodes, one reads the heads, one the long headers."""
    assert plan_of(spark, name).count("ArrowEvalPython") == evaluations


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "q06_file_lookup")
    assert "EqualTo(event_type,error)" in plan and "EqualTo(event_type,view)" in plan
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "embedding" not in plan_of(spark, "q22_folds")
    assert "text" not in plan_of(spark, "q20_confusion_ids").split("ReadSchema")[-1]


def test_roc_needs_two_shuffles_at_most(spark):
    plan = plan_of(spark, "q15_roc")
    assert plan.count("Exchange hashpartitioning") <= 2
