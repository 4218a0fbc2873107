"""Scans and sinks: raw Parquet readers and the canonical fixture tables."""

from .buckets import map_buckets, write_buckets
from .fixture import Canonical, canonical, cities, customers, fulfilment_lines, products, sellers
from .mapping import map_lines, read_text_table
from .raw import read_city_lookup, read_table, write_result
from .store import append_lines, read_canonical, write_canonical

__all__ = [
    "Canonical", "append_lines", "canonical", "cities", "customers", "fulfilment_lines", "map_buckets", "map_lines", "products",
    "read_canonical", "read_city_lookup", "read_table", "read_text_table", "sellers", "write_buckets",
    "write_canonical", "write_result",
]
