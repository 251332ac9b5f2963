"""Facts of a time window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.entity import cut


def when_of(memories: DataFrame) -> Column:
    """The time of a fact, to the second: event_time if it is given (null if it can't be read), else created_at."""
    if "event_ts" in memories.columns:
        given = F.coalesce("event_ts", "created_at")
    else:
        given = F.when(F.col("event_time").isNotNull(), F.col("event_time").try_cast("timestamp")).otherwise(F.col("created_at"))
    return F.date_trunc("second", given)


def checked_bound(value: str | None) -> str | None:
    if value is None:
        return None
    text = value.strip()
    try:
        datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError("time bounds must be ISO-8601") from e
    return text


def window(memories: DataFrame, start: str | None = None, end: str | None = None, recent_first: bool = True, limit: int | None = 20) -> DataFrame:
    """id and time of active facts from ``start`` to ``end``, both inclusive, at least one given.

    Order: time (falling, or rising), importance falling, id; all in no order without a limit.
    """
    start, end = checked_bound(start), checked_bound(end)
    if start is None and end is None:
        raise ValueError("start or end is required")
    found = memories.filter("status = 'active'").withColumn("at", when_of(memories))
    if start is not None:
        found = found.filter(F.col("at") >= F.lit(start).try_cast("timestamp"))
    if end is not None:
        found = found.filter(F.col("at") <= F.lit(end).try_cast("timestamp"))
    order = F.desc("at") if recent_first else F.asc("at")
    return cut(found.select("id", "at", "importance"), limit, 100, order, F.desc("importance"), "id")
