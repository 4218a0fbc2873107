
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from latebound import operators as op
from latebound.plans import QUERIES, catalog


@pytest.fixture(scope="module")
def att(spark):
    return catalog.attributed_lines(spark, SF01)


def test_causes_partition_lines(att):
    total = att.count()
    by_cause = op.attribution_summary(att).agg(F.sum("lines")).first()[0]
    assert by_cause == total
    assert att.where(F.col("cause").isNull()).count() == 0


def test_monthly_revenue_adds_up(att):
    monthly = op.late_revenue_monthly(att).agg(F.sum("revenue")).first()[0]
    total = att.agg(F.sum("price")).first()[0]
    assert round(monthly, 2) == float(total)


def test_decile_sizes_differ_by_at_most_one(spark, att):
    dec = op.seller_blame_deciles(att, catalog.fixture.products(spark, SF01)).collect()
    sizes = [r["members"] for r in dec]
    assert max(sizes) - min(sizes) <= 1
    ordered = sorted(dec, key=lambda r: r["decile"])
    assert all(a["max_share"] <= b["min_share"] for a, b in zip(ordered, ordered[1:]))


def test_repartitioned_input_gives_same_result(spark, att):
    a = op.rfm_scores(op.seller_profile(op.seller_month(att)))
    b = op.rfm_scores(op.seller_profile(op.seller_month(att.repartition(5, "order_id"))),
                      rows_per_range=97)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bulky_groups_have_higher_seller_share(spark, att):
    groups = op.fulfilment_priority_groups(att, catalog.fixture.products(spark, SF01)).collect()
    share = {(r["category"], r["size_band"]): r["seller_share"] for r in groups}
    cats = {c for c, _ in share}
    assert len(cats) == 6 and all(share[(c, "bulky")] > share[(c, "regular")] for c in cats)


def test_planted_directions(spark, att):
    prof = op.seller_profile(op.seller_month(att))
    gap = op.tenure_gap(prof).first()
    assert gap["gap_all"] > 0 and gap["gap_late"] > 0
    ret = {(r["label"], r["k"]): r["retention"] for r in
           op.cohort_retention(op.seller_month(att), op.first_month_cohorts(prof), 24).collect()}
    assert ret[("severe", 12)] < ret[("excellent", 12)]


LINE_GRAIN = ["delay_attribution", "late_revenue_monthly", "seller_month", "regional_bottlenecks",
              "tenure_vs_delay", "tenure_gap", "spec_delay_correlation", "cohort_retention",
              "fulfilment_priority_groups", "first_month_cohorts"]


def _subtrees_below_single_partition(plan: str):
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            sub = []
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-")) <= depth:
                    break
                sub.append(nxt)
            yield sub


@pytest.mark.parametrize("name", LINE_GRAIN)
def test_no_single_partition_over_lines(spark, name):
    """No operator moves the line fact into one task: below any
    SinglePartition exchange an aggregate comes before the fact scan."""
    df = QUERIES[name](spark, SF01)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for sub in _subtrees_below_single_partition(plan):
        text = "\n".join(sub)
        if "lineitem" not in text:
            continue
        first_agg = min((k for k, l in enumerate(sub) if "HashAggregate" in l), default=len(sub))
        first_scan = min(k for k, l in enumerate(sub) if "lineitem" in l)
        assert first_agg < first_scan, text


def test_scans_are_pruned(spark):
    df = QUERIES["delay_attribution"](spark, SF01)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "l_shipdate" not in plan and "c_acctbal" not in plan


def test_single_partition_check_detects_a_global_window(spark, att):
    from pyspark.sql import Window

    bad = att.withColumn("rn", F.row_number().over(Window.orderBy("order_id", "line_no", "seller_id")))
    bad.write.format("noop").mode("overwrite").save()
    plan = bad._jdf.queryExecution().executedPlan().toString()
    flagged = []
    for sub in _subtrees_below_single_partition(plan):
        if any("lineitem" in line for line in sub):
            first_agg = min((k for k, x in enumerate(sub) if "HashAggregate" in x), default=len(sub))
            first_scan = min(k for k, x in enumerate(sub) if "lineitem" in x)
            flagged.append(first_agg > first_scan)
    assert flagged and all(flagged)


@pytest.mark.parametrize("sf", [SF01, "/root/testdata/sf0.1"])
def test_fact_is_never_broadcast(spark, sf):
    """Joins stream the line fact and build from the dimension side; a
    broadcast of the fact would collect it on the driver."""
    df = QUERIES["delay_attribution"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-")) <= depth:
                    break
                assert "lineitem" not in nxt, plan


@pytest.mark.parametrize("name", LINE_GRAIN)
def test_fact_shuffles_are_pre_aggregated(spark, name):
    """Every hash exchange above the line fact moves partial aggregates,
    never raw lines: a hot key is reduced map-side first."""
    df = QUERIES[name](spark, SF01)
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    checked = 0
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        sub = []
        for nxt in lines[i + 1:]:
            if len(nxt) - len(nxt.lstrip(" :+-")) <= depth:
                break
            sub.append(nxt)
        if any("lineitem" in x for x in sub):
            first_op = next(x for x in sub if "Project" not in x and "Filter" not in x)
            assert "HashAggregate" in first_op, "\n".join([line] + sub[:4])
            checked += 1
    assert checked > 0 or "lineitem" not in "\n".join(lines)
