"""Structured Streaming forms of the stateful operators."""

from .jobs import event_cutoff, read_log, stream_archive, stream_auction, stream_intraday, stream_latest_quotes

__all__ = ["event_cutoff", "read_log", "stream_archive", "stream_auction", "stream_intraday", "stream_latest_quotes"]
