"""Structured Streaming form of the new-seller monitoring."""

from .first_month import first_month_monitor, label_records, line_events, replay_first_month

__all__ = ["first_month_monitor", "label_records", "line_events", "replay_first_month"]
