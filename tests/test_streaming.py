"""The streaming first-month monitor ends in the batch cohort table."""

import datetime as dt
import os
import subprocess
import sys
import time

import pytest

from conftest import SF001
from latebound.plans import catalog
from latebound.streaming import first_month as fm

SCHEMA = "seller_id {}, ordered_at timestamp, late int, cents long"


def day(y, m, d):
    return dt.datetime(y, m, d, tzinfo=dt.timezone.utc)


def put(spark, path, rows, kind="long", files=1):
    spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(files).write.mode("append").parquet(path)
    time.sleep(1.1)  # a file stream takes files in the order of their times


def stream(spark, path, kind="long"):
    return spark.readStream.schema(SCHEMA.format(kind)).parquet(path)


@pytest.mark.parametrize("options", [{}, {"files_per_trigger": 2, "delay": "4000 days"}])
def test_stream_replay_equals_batch(spark, options):
    att = catalog.attributed_lines(spark, SF001)
    got = fm.replay_first_month(spark, att.repartition(5), **options)
    want = catalog.q_first_month_cohorts(spark, SF001).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_earlier_month_arriving_later_moves_the_first_month_back(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, src, [(7, day(2020, 3, 5), 1, 1000), (7, day(2020, 3, 6), 0, 500)])
    first = fm.label_records(fm.run_monitor(stream(spark, src), root, "30 days")).collect()
    assert [(r["first_month"], r["delivered"], r["late"]) for r in first] == [("2020-03", 2, 1)]
    put(spark, src, [(7, day(2020, 2, 20), 0, 200), (7, day(2020, 2, 21), None, 300)])
    got = fm.label_records(fm.run_monitor(stream(spark, src), root, "30 days")).collect()
    assert [(r["first_month"], r["delivered"], r["late"], r["first_revenue"]) for r in got] == [("2020-02", 1, 0, 5.0)]


@pytest.mark.parametrize("files", [1, 3])
def test_late_lines_do_not_depend_on_the_file_layout(spark, tmp_path, files):
    """A line older than the watermark goes whether it shares a file with a newer one or not."""
    src, root = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, src, [(1, day(2020, 5, 20), 0, 100)])
    fm.run_monitor(stream(spark, src), root, "2 days")
    put(spark, src, [(1, day(2020, 5, 21), 0, 100), (1, day(2020, 5, 1), 1, 100), (2, day(2020, 5, 21), 0, 1)], files=files)
    got = {r["seller_id"]: (r["delivered"], r["late"]) for r in
           fm.label_records(fm.run_monitor(stream(spark, src), root, "2 days")).collect()}
    assert got == {1: (2, 0), 2: (1, 0)}


@pytest.mark.parametrize("zone", ["America/Sao_Paulo", "Pacific/Auckland"])
@pytest.mark.parametrize("span", ["1 day", "30 days"])
def test_months_are_those_of_the_local_calendar(spark, zone, span):
    from helpers import frame, line
    from latebound import operators as op

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [line(i, seller, line_no=i, month=m, day=d, deliver=20 if i % 2 else 5)
                for i, (seller, m, d) in enumerate([(1, 0, -9), (1, 0, 21), (2, 0, 22), (2, 1, 18), (3, 1, -9), (3, 2, 19), (4, 0, 21)])]
        att = op.delay_attribution(op.enrich(frame(spark, rows)))
        want = op.first_month_cohorts(op.seller_profile(op.seller_month(att)))
        got = fm.replay_first_month(spark, att, span=span)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
        assert {r["seller_id"]: r["first_month"] for r in got.collect()} == {1: "2020-01", 2: "2020-02", 3: "2020-02", 4: "2020-01"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_string_ids_and_known_sellers(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, src, [("old", day(2020, 5, 2), 1, 100), ("new", day(2020, 5, 3), 1, 100)], "string")
    known = spark.createDataFrame([("old", 2019 * 12)], "seller_id string, first_m int")
    got = fm.label_records(fm.run_monitor(stream(spark, src, "string"), root), known).collect()
    assert [(r["seller_id"], r["label"]) for r in got] == [("new", "severe")]


def test_runs_from_another_folder(tmp_path):
    """Workers need nothing of the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "import __spark_entry__ as e\n"
            "from latebound.session import local_session\n"
            f"print('ROWS', e.queries()['first_month_cohorts_stream'](local_session(2, 2), {SF001!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
