"""Streaming over append-only logs, an extension beyond the batch operators."""

from .prediction_log import append_stream, bucket_counts, compact, latest_predictions, read_entries, read_log

__all__ = ["append_stream", "bucket_counts", "compact", "latest_predictions", "read_entries", "read_log"]
