"""Streaming forms of the ledgers: events arrive in any order within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Cols = list[str]


def charged_once(events: DataFrame, key: Cols, at: str, late: str = "15 minutes") -> DataFrame:
    """The first event of each charge id to arrive; replays within the watermark are dropped, and ids forgotten after it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def month_totals(events: DataFrame, owner: Cols, at: str, spent: str, late: str = "1 day") -> DataFrame:
    """What each owner spent by UTC month; a month is final once the watermark has passed it."""
    return events.withWatermark(at, late).groupBy(*owner, F.date_format(at, "yyyy-MM").alias("month")).agg(F.sum(spent).alias("spent"))


def anchored_limit(failures: DataFrame, owner: str, at: str, seconds: int = 900, most: int = 5) -> DataFrame:
    """owner, at, window_start, n_in_window, blocked of each failure; the state is the open window, gone when it ends.

    Windows begin at the first failure outside the last one. Failures of one batch are taken in order of time;
    an owner's state is (start, count), however many failures there are.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        times = sorted(t for f in frames for t in f["_t"])
        starts, counts = [], []
        for t in times:
            start, n = (t, 1) if start is None or t - start >= seconds else (start, n + 1)
            starts.append(start)
            counts.append(n)
        state.update((start, n))
        state.setTimeoutTimestamp(max((start + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({owner: [key[0]] * len(times), "at": times, "window_start": starts, "n_in_window": counts, "blocked": [c >= most for c in counts]})

    use = failures.withWatermark(at, f"{seconds} seconds").withColumn("_t", F.unix_timestamp(at).cast("long")).select(owner, at, "_t")
    kind = use.schema[owner].dataType.simpleString()
    return use.groupBy(owner).applyInPandasWithState(fold, f"{owner} {kind}, at long, window_start long, n_in_window long, blocked boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def reservations(events: DataFrame, key: str, at: str, ttl: int = 900) -> DataFrame:
    """events (key, at, action: reserve, spend or release) to one outcome a key: spent, released, or expired `ttl` seconds after it was reserved."""

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [name[0]], "outcome": ["expired"]})
            return
        rows = sorted((t, a) for f in frames for t, a in zip(f["_t"], f["action"], strict=True))
        out = None
        for t, action in rows:
            if action == "reserve":
                since = t if since is None else since  # again under the same key: the first holds
            elif since is not None:
                out = "expired" if t - since >= ttl else {"spend": "spent", "release": "released"}[action]
                since = None
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since,))
            state.setTimeoutTimestamp(max((since + ttl) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [name[0]], "outcome": [out]})

    use = events.withWatermark(at, "0 seconds").withColumn("_t", F.unix_timestamp(at).cast("long")).select(key, at, "action", "_t")
    kind = use.schema[key].dataType.simpleString()
    return use.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, outcome string", "since long", "append", GroupStateTimeout.EventTimeTimeout)
