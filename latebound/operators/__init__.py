"""DataFrame operators. Each takes and returns DataFrames; none collects
data to the driver beyond bounded samples, per-range counts and scalars."""

from .actions import fulfilment_priority_groups, seller_penalty_ranking
from .bootstrap import gap_replicates, tenure_gap_interval
from .cohorts import (cohort_retention, first_month_cohorts, long_term_retention, new_seller_watchlist,
                      signup_month_cohorts)
from .deciles import (blame_by_grain, seller_blame_deciles, seller_blame_deciles_shrunk, seller_blame_shares,
                      shrunk_shares, spec_delay_correlation)
from .facts import attribution_summary, delay_attribution, enrich, seller_month, seller_profile
from .lanes import fit_lanes, lane_effects, lane_excess, lane_table
from .matching import main_category, tenure_gap_matched
from .monthly import late_revenue_monthly
from .orders import order_bitmaps, orders_by_region
from .rank_correlation import rank_correlation, spec_delay_rank_correlation
from .ranking import global_row_number, ntile, rows_at
from .regions import city_cleanse, city_matched_fuzzy, regional_bottlenecks, unmatched_cities
from .rfm import black_sellers_rfm, rfm_scores
from .streaks import seller_late_streaks, streak_black_sellers
from .survival import cohort_logrank, cohort_survival
from .tenure import good_seller_badge, tenure_gap, tenure_vs_delay
from .trend import late_revenue_trend

__all__ = [
    "attribution_summary", "black_sellers_rfm", "blame_by_grain", "city_cleanse", "city_matched_fuzzy",
    "cohort_logrank", "cohort_retention", "cohort_survival", "delay_attribution", "enrich", "first_month_cohorts",
    "fit_lanes", "fulfilment_priority_groups", "gap_replicates", "global_row_number", "good_seller_badge",
    "lane_effects", "lane_excess", "lane_table", "late_revenue_monthly", "late_revenue_trend", "long_term_retention", "main_category", "new_seller_watchlist", "ntile", "order_bitmaps",
    "orders_by_region", "rank_correlation", "regional_bottlenecks", "rfm_scores", "rows_at", "seller_blame_deciles",
    "seller_blame_deciles_shrunk", "seller_blame_shares", "seller_late_streaks", "seller_month",
    "seller_penalty_ranking", "seller_profile", "shrunk_shares", "signup_month_cohorts", "spec_delay_correlation", "spec_delay_rank_correlation",
    "streak_black_sellers", "tenure_gap", "tenure_gap_interval", "tenure_gap_matched", "tenure_vs_delay", "unmatched_cities",
]
