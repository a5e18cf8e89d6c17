"""Streaming block maxima (ST1)."""

from __future__ import annotations

from pluvio.plans.registry import query
from pluvio.streaming.blockmax import stream_block_maxima


@query(
    "stream_block_maxima",
    "ST1 A1",
    "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, max(value) AS value "
    "FROM events GROUP BY 1, 2",
)
def stream_block_maxima_query(spark, sf):
    """Arrivals (events) read as a stream: daily maximum value per user."""
    return stream_block_maxima(spark, sf, "user_id", "ts", "value", "1 day", "1 day", glob="events.parquet")
