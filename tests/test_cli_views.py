"""SQL views, the result sink and the command line."""

from conftest import SF001
from latebound.plans import QUERIES
from latebound.plans.views import register_views
from latebound.sources import write_result


def test_views_answer_like_operators(spark):
    register_views(spark, SF001, prefix="t_")
    via_sql = {r["cause"]: r["n"] for r in spark.sql(
        "SELECT cause, count(*) AS n FROM t_lines GROUP BY cause").collect()}
    via_op = {r["cause"]: r["lines"] for r in QUERIES["delay_attribution"](spark, SF001).collect()}
    assert via_sql == via_op
    assert spark.sql("SELECT count(*) FROM t_seller_profile").first()[0] == \
        spark.sql("SELECT count(DISTINCT seller_id) FROM t_lines").first()[0]


def test_write_result_parquet_and_csv(spark, tmp_path):
    df = QUERIES["tenure_vs_delay"](spark, SF001)
    write_result(df, str(tmp_path / "p"))
    write_result(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.parquet(str(tmp_path / "p")).count() == df.count()
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == df.count()


def test_cli_list(capsys):
    from latebound.__main__ import main

    assert main(["list"]) == 0
    assert "black_sellers_rfm" in capsys.readouterr().out
