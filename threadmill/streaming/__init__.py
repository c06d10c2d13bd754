"""Streaming."""

from threadmill.streaming.watch import backfill, follow  # noqa: F401
