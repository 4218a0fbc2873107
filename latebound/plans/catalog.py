"""Named queries: each is ``(spark, source) -> DataFrame`` over the whole
tables. ``source`` is a folder of the driver's tables, from which the canonical
fixture is derived, or a :class:`Canonical` handle (a prepared store, or a
user's own tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..session import materialize
from ..sources import fixture
from ..sources.fixture import Canonical

Source = str | Canonical
Query = Callable[[SparkSession, Source], DataFrame]


def prepare(spark: SparkSession, sf_dir: str, store: str) -> Canonical:
    """Derive the canonical tables of ``sf_dir`` once, write them to
    ``store`` and return the handle that queries take instead of a folder."""
    from ..sources.store import read_canonical, write_canonical

    write_canonical(fixture.canonical(spark, sf_dir), store)
    return read_canonical(spark, store)


def attributed_lines(spark: SparkSession, source: Source, granularity: str = "day") -> DataFrame:
    lines = source.lines if isinstance(source, Canonical) else fixture.fulfilment_lines(spark, source)
    return op.delay_attribution(op.enrich(lines, granularity))


def sellers(spark: SparkSession, source: Source) -> DataFrame:
    return source.sellers if isinstance(source, Canonical) else fixture.sellers(spark, source)


def customers(spark: SparkSession, source: Source) -> DataFrame:
    return source.customers if isinstance(source, Canonical) else fixture.customers(spark, source)


def products(spark: SparkSession, source: Source) -> DataFrame:
    return source.products if isinstance(source, Canonical) else fixture.products(spark, source)


def cities(spark: SparkSession, source: Source) -> DataFrame:
    return source.cities if isinstance(source, Canonical) else fixture.cities(spark, source)


def seller_months(spark: SparkSession, source: Source) -> DataFrame:
    if isinstance(source, Canonical) and source.seller_month is not None:
        return source.seller_month
    return op.seller_month(attributed_lines(spark, source))


def profile(spark: SparkSession, source: Source) -> DataFrame:
    return op.seller_profile(seller_months(spark, source))


def cohorts(spark: SparkSession, source: Source) -> DataFrame:
    return op.first_month_cohorts(profile(spark, source))


def q_delay_attribution(spark, sf_dir):
    return op.attribution_summary(attributed_lines(spark, sf_dir))


def q_delay_attribution_lines(spark, sf_dir):
    return attributed_lines(spark, sf_dir).select(
        "order_id", "line_no", "product_id", "seller_id", "dispatch_delay", "delivery_delay",
        "late", "dispatch_late", "ship_days", "cause", "seller_days", "carrier_days")


def q_late_revenue_monthly(spark, sf_dir):
    return op.late_revenue_monthly(attributed_lines(spark, sf_dir)).orderBy("month")


def q_seller_month(spark, sf_dir):
    sm = seller_months(spark, sf_dir)
    return sm.withColumn("revenue", F.col("revenue").cast("double"))


def q_rfm_scores(spark, sf_dir):
    return op.rfm_scores(profile(spark, sf_dir))


def q_black_sellers_rfm(spark, sf_dir):
    return op.black_sellers_rfm(profile(spark, sf_dir)).orderBy(F.desc("monetary"), "seller_id")


def q_city_cleanse(spark, sf_dir):
    return op.city_cleanse(sellers(spark, sf_dir), cities(spark, sf_dir)).select(
        "seller_id", "city_raw", "state", "city_key", "city")


def q_city_unmatched(spark, sf_dir):
    return op.unmatched_cities(customers(spark, sf_dir), cities(spark, sf_dir))


def q_regional_bottlenecks(spark, sf_dir):
    return op.regional_bottlenecks(attributed_lines(spark, sf_dir), sellers(spark, sf_dir),
                                   cities(spark, sf_dir), role="seller", level="city")


def q_regional_bottlenecks_rollup(spark, sf_dir):
    return op.regional_bottlenecks(attributed_lines(spark, sf_dir), sellers(spark, sf_dir),
                                   cities(spark, sf_dir), role="seller", level="rollup")


def q_regional_bottlenecks_customer(spark, sf_dir):
    return op.regional_bottlenecks(attributed_lines(spark, sf_dir), customers(spark, sf_dir),
                                   cities(spark, sf_dir), role="customer", level="state")


def q_seller_blame_shares(spark, sf_dir):
    return op.seller_blame_shares(attributed_lines(spark, sf_dir), products(spark, sf_dir))


def q_seller_blame_deciles(spark, sf_dir):
    return op.seller_blame_deciles(attributed_lines(spark, sf_dir), products(spark, sf_dir)).orderBy("decile")


def q_category_blame_deciles(spark, sf_dir):
    return op.seller_blame_deciles(attributed_lines(spark, sf_dir), products(spark, sf_dir),
                                   n=4, grain="category")


def q_spec_delay_correlation(spark, sf_dir):
    return op.spec_delay_correlation(attributed_lines(spark, sf_dir), products(spark, sf_dir))


def q_tenure_vs_delay(spark, sf_dir):
    b = F.col("bucket")
    rank = F.when(b == "1", 1).when(b == "2-6", 2).when(b.startswith("7-"), 3).otherwise(4)
    return op.tenure_vs_delay(profile(spark, sf_dir)).orderBy(rank)


def q_tenure_gap(spark, sf_dir):
    return op.tenure_gap(profile(spark, sf_dir))


def q_first_month_cohorts(spark, sf_dir):
    return cohorts(spark, sf_dir).drop("first_m")


def _retention(spark, sf_dir, horizon):
    # Only what the labels need, so the distinct order count is pruned; both
    # tables are read more than once and written first.
    sm = seller_months(spark, sf_dir)
    if not isinstance(sf_dir, Canonical) or sf_dir.seller_month is None:
        sm = materialize(sm.drop("orders"), "seller_month").withColumn("orders", F.lit(None).cast("long"))
    labels = materialize(op.first_month_cohorts(op.seller_profile(sm)).select("seller_id", "first_m", "label"), "cohorts")
    return op.cohort_retention(sm, labels, horizon=horizon)


def q_cohort_retention(spark, sf_dir):
    return _retention(spark, sf_dir, 24).orderBy("label", "k")


def q_cohort_retention_active(spark, sf_dir):
    return _retention(spark, sf_dir, None)


def q_cohort_long_term_retention(spark, sf_dir):
    return op.long_term_retention(_retention(spark, sf_dir, 24), k=12)


def q_first_month_cohorts_stream(spark, sf_dir):
    from ..streaming import replay_first_month

    return replay_first_month(spark, attributed_lines(spark, sf_dir))


def q_seller_penalty_ranking(spark, sf_dir):
    return op.seller_penalty_ranking(profile(spark, sf_dir)).orderBy("adjusted_rank")


def q_fulfilment_priority_groups(spark, sf_dir):
    return op.fulfilment_priority_groups(attributed_lines(spark, sf_dir), products(spark, sf_dir))


def q_new_seller_watchlist(spark, sf_dir):
    return op.new_seller_watchlist(cohorts(spark, sf_dir))


def q_good_seller_badge(spark, sf_dir):
    return op.good_seller_badge(profile(spark, sf_dir))


def q_black_sellers_caused(spark, sf_dir):
    return op.black_sellers_rfm(profile(spark, sf_dir), basis="caused")


def q_regional_bottlenecks_customer_city(spark, sf_dir):
    return op.regional_bottlenecks(attributed_lines(spark, sf_dir), customers(spark, sf_dir),
                                   cities(spark, sf_dir), role="customer", level="city")


def q_regional_bottlenecks_customer_rollup(spark, sf_dir):
    return op.regional_bottlenecks(attributed_lines(spark, sf_dir), customers(spark, sf_dir),
                                   cities(spark, sf_dir), role="customer", level="rollup")


def q_seller_blame_deciles_min5(spark, sf_dir):
    return op.seller_blame_deciles(attributed_lines(spark, sf_dir), products(spark, sf_dir), min_late=5)


def q_tenure_vs_delay_active(spark, sf_dir):
    return op.tenure_vs_delay(profile(spark, sf_dir), basis="active")


def q_signup_month_cohorts(spark, sf_dir):
    return op.signup_month_cohorts(seller_months(spark, sf_dir), fixture.signups(spark, sf_dir)).drop("first_m")


def q_delay_attribution_seconds(spark, sf_dir):
    return op.attribution_summary(attributed_lines(spark, sf_dir, granularity="second"))


def q_fulfilment_priority_groups_volume(spark, sf_dir):
    return op.fulfilment_priority_groups(attributed_lines(spark, sf_dir), products(spark, sf_dir), bulk_volume=400)


def q_city_matched_fuzzy(spark, sf_dir):
    return op.city_matched_fuzzy(customers(spark, sf_dir), cities(spark, sf_dir)).select(
        "customer_id", "city_raw", "state", "city_key", "city", "distance", "candidates")


def q_regional_bottlenecks_fuzzy(spark, sf_dir):
    return op.regional_bottlenecks(attributed_lines(spark, sf_dir), customers(spark, sf_dir),
                                   cities(spark, sf_dir), role="customer", level="city", max_distance=2)


def q_seller_late_streaks(spark, sf_dir):
    return op.seller_late_streaks(attributed_lines(spark, sf_dir))


def q_black_sellers_streaks(spark, sf_dir):
    return op.streak_black_sellers(op.rfm_scores(profile(spark, sf_dir)),
                                   op.seller_late_streaks(attributed_lines(spark, sf_dir)))


def _lives(spark, sf_dir):
    # what lifetimes and labels need, written once: both are read more than once
    return materialize(profile(spark, sf_dir).select(
        "seller_id", "first_m", "last_m", "first_delivered", "first_late", "first_revenue"), "profile")


def q_cohort_survival(spark, sf_dir):
    p = _lives(spark, sf_dir)
    return op.cohort_survival(p, op.first_month_cohorts(p))


def q_cohort_logrank(spark, sf_dir):
    p = _lives(spark, sf_dir)
    return op.cohort_logrank(p, op.first_month_cohorts(p))


def q_tenure_gap_interval(spark, sf_dir):
    return op.tenure_gap_interval(profile(spark, sf_dir))


def q_late_revenue_trend(spark, sf_dir):
    # a few hundred rows, read several times
    return op.late_revenue_trend(materialize(op.late_revenue_monthly(attributed_lines(spark, sf_dir)), "monthly"))


def q_seller_blame_deciles_shrunk(spark, sf_dir):
    return op.seller_blame_deciles_shrunk(attributed_lines(spark, sf_dir), products(spark, sf_dir)).orderBy("decile")


def q_orders_by_region(spark, sf_dir):
    return op.orders_by_region(attributed_lines(spark, sf_dir), sellers(spark, sf_dir))


def q_tenure_gap_matched(spark, sf_dir):
    categories = op.main_category(attributed_lines(spark, sf_dir), products(spark, sf_dir))
    return op.tenure_gap_matched(profile(spark, sf_dir), categories, sellers(spark, sf_dir))


def q_spec_delay_rank_correlation(spark, sf_dir):
    return op.spec_delay_rank_correlation(attributed_lines(spark, sf_dir), products(spark, sf_dir))


def _lanes(spark, sf_dir):
    return op.lane_table(attributed_lines(spark, sf_dir), sellers(spark, sf_dir), customers(spark, sf_dir))


def q_lane_effects(spark, sf_dir):
    return op.lane_effects(_lanes(spark, sf_dir))


def q_lane_excess(spark, sf_dir):
    return op.lane_excess(_lanes(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "delay_attribution": q_delay_attribution,
    "delay_attribution_lines": q_delay_attribution_lines,
    "late_revenue_monthly": q_late_revenue_monthly,
    "seller_month": q_seller_month,
    "rfm_scores": q_rfm_scores,
    "black_sellers_rfm": q_black_sellers_rfm,
    "city_cleanse": q_city_cleanse,
    "city_unmatched": q_city_unmatched,
    "regional_bottlenecks": q_regional_bottlenecks,
    "regional_bottlenecks_rollup": q_regional_bottlenecks_rollup,
    "regional_bottlenecks_customer": q_regional_bottlenecks_customer,
    "seller_blame_shares": q_seller_blame_shares,
    "seller_blame_deciles": q_seller_blame_deciles,
    "category_blame_deciles": q_category_blame_deciles,
    "spec_delay_correlation": q_spec_delay_correlation,
    "tenure_vs_delay": q_tenure_vs_delay,
    "tenure_gap": q_tenure_gap,
    "first_month_cohorts": q_first_month_cohorts,
    "first_month_cohorts_stream": q_first_month_cohorts_stream,
    "cohort_retention": q_cohort_retention,
    "cohort_retention_active": q_cohort_retention_active,
    "cohort_long_term_retention": q_cohort_long_term_retention,
    "seller_penalty_ranking": q_seller_penalty_ranking,
    "fulfilment_priority_groups": q_fulfilment_priority_groups,
    "new_seller_watchlist": q_new_seller_watchlist,
    "good_seller_badge": q_good_seller_badge,
    "black_sellers_caused": q_black_sellers_caused,
    "regional_bottlenecks_customer_city": q_regional_bottlenecks_customer_city,
    "regional_bottlenecks_customer_rollup": q_regional_bottlenecks_customer_rollup,
    "seller_blame_deciles_min5": q_seller_blame_deciles_min5,
    "tenure_vs_delay_active": q_tenure_vs_delay_active,
    "signup_month_cohorts": q_signup_month_cohorts,
    "delay_attribution_seconds": q_delay_attribution_seconds,
    "fulfilment_priority_groups_volume": q_fulfilment_priority_groups_volume,
    "city_matched_fuzzy": q_city_matched_fuzzy,
    "regional_bottlenecks_fuzzy": q_regional_bottlenecks_fuzzy,
    "seller_late_streaks": q_seller_late_streaks,
    "black_sellers_streaks": q_black_sellers_streaks,
    "cohort_survival": q_cohort_survival,
    "cohort_logrank": q_cohort_logrank,
    "tenure_gap_interval": q_tenure_gap_interval,
    "late_revenue_trend": q_late_revenue_trend,
    "seller_blame_deciles_shrunk": q_seller_blame_deciles_shrunk,
    "orders_by_region": q_orders_by_region,
    "tenure_gap_matched": q_tenure_gap_matched,
    "spec_delay_rank_correlation": q_spec_delay_rank_correlation,
    "lane_effects": q_lane_effects,
    "lane_excess": q_lane_excess,
}
