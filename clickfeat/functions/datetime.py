"""Date and time parts of the click time (F1-F9). All built-in expressions: no UDF."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import DATE_TIME_PARTS, DAY_SECONDS, SECONDS, TIME


def epoch_seconds(ts: Column | str) -> Column:
    """Timestamp -> whole epoch seconds (F7); session time zone UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_timestamp(ts)


def seconds_of_day(delta: Column) -> Column:
    """Time difference in seconds -> its seconds-within-a-day part (F8)."""
    return F.pmod(delta, F.lit(DAY_SECONDS))


def parse_click_time(s: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """String -> timestamp."""
    s = F.col(s) if isinstance(s, str) else s
    return F.to_timestamp(s, fmt)


def hour_of_day(ts: Column) -> Column:
    """Fractional hour h + m/60 + s/3600, computed in double and stored as float."""
    return (F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0).cast("float")


def _angle(hod: Column) -> Column:
    # phase of the day from the float hour, widened back to double
    return (hod.cast("double") - 12.0) / 24.0 * (2.0 * math.pi)


def date_time_columns(time_col: str = TIME, parts: Sequence[str] = DATE_TIME_PARTS) -> list[Column]:
    """Columns for the requested date parts (F1-F6); Monday is weekday 0."""
    ts = F.col(time_col)
    hod = hour_of_day(ts)
    exprs = {
        "year": F.year(ts),
        "month": F.month(ts),
        "weekday": F.weekday(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
        "hour_of_day": hod,
        "hour_of_day_sin": F.sin(_angle(hod)).cast("float"),
        "hour_of_day_cos": F.cos(_angle(hod)).cast("float"),
    }
    unknown = [p for p in parts if p not in exprs]
    if unknown:
        raise ValueError(f"unknown date parts: {unknown}")
    out = []
    for p in parts:
        e = exprs[p]
        out.append((e if p.startswith("hour_of_day") else e.cast("int")).alias(p))
    return out


def date_time_features(df: DataFrame, time_col: str = TIME, parts: Sequence[str] = DATE_TIME_PARTS) -> DataFrame:
    """Add the date parts as columns (one projection, no shuffle)."""
    return df.select("*", *date_time_columns(time_col, parts))


def with_epoch_seconds(df: DataFrame, time_col: str = TIME, out: str = SECONDS) -> DataFrame:
    """Add ``click_time_int_seconds``."""
    return df.withColumn(out, epoch_seconds(time_col).cast("int"))
