"""Column expressions shared by the operators (built-in functions only)."""

from .city import city_key
from .dates import add_days, day_diff, month_index, month_label
from .rates import count_true, int_sum, money_out, money_sum, ratio

__all__ = [
    "add_days", "city_key", "count_true", "day_diff", "int_sum", "money_out",
    "money_sum", "month_index", "month_label", "ratio",
]
