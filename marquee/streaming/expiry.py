"""Streams with state that ends: repeats within a watermark, and request limits whose records expire."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def without_repeats(rows: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key; on a stream a key is forgotten ``late`` after it came, and rows later than that are dropped.

    On a table the first by time counts, whatever the distance.
    """
    if rows.isStreaming:
        return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    first = F.min_by(F.struct(*rows.columns), F.struct(ts, F.xxhash64(*rows.columns)))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("_r")).select("_r.*")


@dataclasses.dataclass(frozen=True)
class Limits:
    """Requests of a key in a window and in a short one (microseconds); a window begins with a request and ends ``window`` later."""

    requests: int = 100
    window: int = 15 * 60 * 1_000_000
    burst: int = 10
    burst_window: int = 60 * 1_000_000


def _decided(times: np.ndarray, state: tuple[int, int, int, int] | None, limits: Limits) -> tuple[list[tuple[bool, int, int]], tuple[int, int, int, int]]:
    """allowed, remaining and reset of a key's requests in order of time, and its record (count, reset, burst count, burst reset) afterwards."""
    out = []
    count, reset, burst, burst_reset = state or (0, -1, 0, -1)
    for now in times.tolist():
        if now > burst_reset:
            burst, burst_reset = 0, now + limits.burst_window
        if now > reset:
            count, reset = 0, now + limits.window
        if burst >= limits.burst or count >= limits.requests:
            out.append((False, max(0, limits.requests - count), reset))
            continue
        count, burst = count + 1, burst + 1
        out.append((True, limits.requests - count, reset))
    return out, (count, reset, burst, burst_reset)


_OUT = "{key} {kind}, ts timestamp, request long, allowed boolean, remaining int, reset timestamp"


def _answered(key: tuple, rows: pd.DataFrame, state, limits: Limits, name: str):
    rows = rows.sort_values(["ts", "request"], kind="stable")
    micros = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    decided, record = _decided(micros, state, limits)
    allowed, remaining, reset = zip(*decided, strict=True)
    out = pd.DataFrame({name: key[0], "ts": rows["ts"].to_numpy(), "request": rows["request"].to_numpy(), "allowed": allowed, "remaining": np.array(remaining, "int32"), "reset": pd.to_datetime(np.array(reset), unit="us")})
    return out, record


def limited(requests: DataFrame, key: str, limits: Limits = Limits(), late: str = "1 minute") -> DataFrame:
    """``key``, ts, request, allowed, remaining and reset of every request (``key``, ts, request: a number).

    On a stream a key's record is kept until the watermark has passed both its windows and then forgotten, as nothing of it
    counts any more. Requests of a key count in the order of ts and request within a batch; on a table in one pass over all.
    A null key is a key; a key's requests of a batch (on a table: of the table) pass one task in Arrow batches sorted by time.
    """
    schema = _OUT.format(key=key, kind=dict(requests.dtypes)[key])
    rows = requests.select(key, "ts", "request")
    if not requests.isStreaming:

        def whole(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return _answered(k, part, None, limits, key)[0]

        return rows.groupBy(key).applyInPandas(whole, schema)

    def batch(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, record = _answered(k, pd.concat(list(parts)), tuple(state.get) if state.exists else None, limits, key)
        state.update(record)
        ends = max(record[1], record[3]) // 1000 + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield out

    grouped = rows.withWatermark("ts", late).groupBy(key)
    return grouped.applyInPandasWithState(batch, schema, "count long, reset long, burst long, burst_reset long", "append", GroupStateTimeout.EventTimeTimeout)
