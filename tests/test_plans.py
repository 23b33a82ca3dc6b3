"""Plan-shape guarantees that matter at scale, checked on the physical plans."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
# training / writing / streaming queries run jobs while they are built
EAGER = {"l1_train_forest", "l2_train_gbt", "l3_train_boosted", "l4_soft_vote", "l5_search",
         "l6_cross_validate", "l7_evaluate_train_test", "l8_train_end_to_end", "l8_train_production", "d1_predict",
         "d6_score_file", "d7_score_stream", "d7_score_stream_versions", "s9_model_store", "s8_convert_files",
         "s5_write_predictions", "s6_write_errors", "s1_read_table_csv", "s2_read_table_json",
         "m2_assemble", "m4_median_impute", "m5_mode_impute", "m7_standardize", "m8_one_hot",
         "p17_encode_label_sorted"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


# the operators of the optional subpackage have their own tests
OPTIONAL = {q for q in E.queries() if q == "pipeline" or (q.startswith("op") and q[2].isdigit())}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - EAGER - OPTIONAL))
def test_no_pairwise_join_and_no_python(spark, name):
    plan = _plan(spark, name)
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def test_month_filter_reaches_the_scan(spark):
    plan = _plan(spark, "p8_filter_month")
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_join_reads_only_needed_columns(spark):
    plan = _plan(spark, "j1_attach_validation")
    scan_lines = [ln for ln in plan.splitlines() if "documents.parquet" in ln]
    assert scan_lines and all("text:" not in ln for ln in scan_lines)


def test_flagship_has_no_key_shuffle(spark):
    plan = _plan(spark, "decree_vs_label_confusion")
    assert "hashpartitioning" not in plan          # one map stage + a global partial aggregate
    assert "partial_count" in plan
