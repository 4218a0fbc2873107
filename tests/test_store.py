"""Prepared canonical tables give the same answers as the derived ones."""

import uuid

from conftest import SF001
from latebound.plans import QUERIES, catalog
from latebound.session import checkpoint_root


def test_prepared_store_same_results(spark):
    names = ["delay_attribution", "late_revenue_monthly", "black_sellers_rfm", "regional_bottlenecks",
             "seller_blame_deciles", "cohort_retention"]
    before = {n: sorted(map(tuple, QUERIES[n](spark, SF001).collect()), key=str) for n in names}
    store = f"{checkpoint_root(spark)}/test-store-{uuid.uuid4().hex}"
    prepared = catalog.prepare(spark, SF001, store)
    plan = catalog.attributed_lines(spark, prepared)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
    after = {n: sorted(map(tuple, QUERIES[n](spark, prepared).collect()), key=str) for n in names}
    assert after == before
    # the raw folder is still read as it is
    assert sorted(map(tuple, QUERIES["delay_attribution"](spark, SF001).collect()), key=str) == before["delay_attribution"]
    # seller analyses start from the written aggregate: no scan of the lines
    for n in ("black_sellers_rfm", "tenure_vs_delay", "first_month_cohorts", "seller_penalty_ranking", "good_seller_badge"):
        assert "/lines" not in QUERIES[n](spark, prepared)._jdf.queryExecution().executedPlan().toString(), n


def test_new_files_are_seen(spark, tmp_path):
    import shutil

    src = tmp_path / "sf"
    src.mkdir()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        (src / f"{t}.parquet").mkdir()
        shutil.copy(f"{SF001}/{t}.parquet", src / f"{t}.parquet" / "a.parquet")
    count = lambda: sum(r["lines"] for r in QUERIES["delay_attribution"](spark, str(src)).collect())
    before = count()
    shutil.copy(f"{SF001}/lineitem.parquet", src / "lineitem.parquet" / "b.parquet")
    assert count() == 2 * before


def test_intermediates_are_deleted(spark):
    import glob

    from latebound.session import intermediates

    folders = lambda: set(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/latebound/*"))
    before = folders()
    with intermediates():
        rows = QUERIES["rfm_scores"](spark, SF001).collect()
        assert rows and folders() > before
    assert folders() == before


def test_prepared_fact_prunes_months(spark, tmp_path):
    from pyspark.sql import functions as F

    from latebound.sources import fixture
    from latebound.sources.store import months_between_filter, read_canonical, write_canonical

    write_canonical(fixture.canonical(spark, SF001), str(tmp_path / "store"))
    c = read_canonical(spark, str(tmp_path / "store"))
    picked = months_between_filter(c.lines, "1996-01", "1996-06")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    months = {r[0] for r in picked.select(F.date_format("ordered_at", "yyyy-MM")).distinct().collect()}
    assert months and all("1996-01" <= m <= "1996-06" for m in months)
    assert c.lines.count() == fixture.fulfilment_lines(spark, SF001).count()


def test_appended_month_leaves_other_files_alone(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from latebound.sources import append_lines, fixture
    from latebound.sources.fixture import Canonical
    from latebound.sources.store import read_canonical, write_canonical

    whole = fixture.canonical(spark, SF001)
    last = F.col("ordered_at") >= F.lit("2001-06-20").cast("timestamp_ntz")
    early, late = whole.lines.where(~last), whole.lines.where(last)
    assert early.count() and late.count()
    path = str(tmp_path / "store")
    write_canonical(Canonical(early, whole.sellers, whole.customers, whole.products, whole.cities), path)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs
                if f.endswith(".parquet")}

    before = files()
    months = append_lines(late, path)
    after = files()
    touched = {f for f in {*before, *after} if before.get(f) != after.get(f)}
    assert months and touched and all(any(f"order_month={m}/" in f for m in months) for f in touched)
    assert any("/seller_month/" in f for f in touched) and any("/lines/" in f for f in touched)
    store = read_canonical(spark, path)
    for n in ("delay_attribution", "seller_month", "black_sellers_rfm", "cohort_retention"):
        assert sorted(map(tuple, QUERIES[n](spark, store).collect()), key=str) == sorted(
            map(tuple, QUERIES[n](spark, SF001).collect()), key=str), n
    assert append_lines(late.limit(0), path) == [] and files() == after
