"""Co-located storage and one-pass status: plans and awkward rows."""

import contextlib
import io

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wirefold.operators.coverage import index_status, status_in_one_pass
from wirefold.plans import bindings
from wirefold.plans.colocated import write_colocated_run


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_stored_tables_join_without_exchange_or_sort(spark):
    plan = plan_of(bindings.QUERIES["colocated_facts"](spark, SF_SMALL))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_stored_tables_keep_nulls_repeats_and_empty_ones(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None)]
    df = spark.createDataFrame(rows, "k long, v string")
    got = write_colocated_run({"full": df, "empty": df.limit(0)}, ["k"], buckets=4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got["full"].collect()), key=key) == sorted(rows, key=key)
    assert got["empty"].columns == ["k", "v"] and got["empty"].count() == 0
    assert got["full"].join(got["empty"], "k").count() == 0


def test_each_input_is_read_once(spark):
    plan = plan_of(bindings.QUERIES["status_one_pass"](spark, SF_SMALL))
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 1


def test_same_rows_as_a_scan_per_metric(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", None, True), (None, 2, False), (None, 3, None), ("b", None, True)],
                               "why string, n long, ok boolean")
    one = status_in_one_pass([(df, [("all", F.lit(True)), ("ok", F.col("ok"), F.col("why")),
                                    ("sum", F.lit(True), F.col("why"), F.col("n")), ("none", F.lit(False))])])
    each = index_status([("all", df, None), ("ok", df.where("ok"), "why"), ("sum", df, "why", "n"), ("none", df.where("false"), None)])
    rows = lambda d: sorted(((r.metric, r.reason, r.n or 0) for r in d.collect()), key=str)
    assert rows(one) == rows(each)
    assert status_in_one_pass([(df.limit(0), [("all", F.lit(True))])]).count() == 0
