"""Retention and first-seen with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelode import rules


def within_retention(
    df: DataFrame, time: Column | str, now: Column, hours: int = rules.RETENTION_HOURS
) -> DataFrame:
    """Rows at most `hours` old at `now`; rows without a time go, future rows stay."""
    stamp = F.col(time) if isinstance(time, str) else time
    return df.filter(stamp >= now - F.expr(f"INTERVAL {hours} HOURS"))


def stream_dedup(
    stream: DataFrame,
    key: Sequence[str],
    time: str,
    hours: int = rules.RETENTION_HOURS,
    lateness: str | None = None,
) -> DataFrame:
    """First row to arrive per key and window of `hours`, with the window's start.

    Windows lie side by side, so which (key, window_start) come out does not depend on how the
    stream is cut into batches. State of a window goes once the watermark has passed it; `lateness`
    (as long as the window, if not given) bounds how far rows may be out of order. Later rows, and
    rows without a time, go. This bounds the state, it does not replace `first_per_key` over the
    whole history.
    """
    stamped = stream.withColumn(time, F.col(time).cast("timestamp"))
    late = stamped.withWatermark(time, lateness or f"{hours} hours")
    # The window carries the watermark from here on; a stream may have one such column.
    windowed = late.withColumn("_window", F.window(time, f"{hours} hours")).withMetadata(time, {})
    first = windowed.dropDuplicates([*key, "_window"])
    return first.withColumn("window_start", F.col("_window.start")).drop("_window")


def stream_first_seen(
    stream: DataFrame, key: Sequence[str], time: str, hours: int = rules.RETENTION_HOURS
) -> DataFrame:
    """First row to arrive per key, until the key has expired: no border cuts what lies close together.

    A key is remembered from the row that came out until the watermark, which is `hours` behind the
    latest time seen in earlier batches, has passed that row's time by `hours`. So rows of a key less than
    `hours` apart never both come out, however the stream is cut, as long as none is `hours` late; a row that
    late goes. A key that comes again comes out again once it is forgotten, which is two to three times
    `hours` after and, unlike the windows of `stream_dedup`, depends on the batches: within one batch a key has
    one row at most. Rows without a time go.
    """
    stamped = stream.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull())
    return stamped.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark(list(key))
