"""Admission facts of a stream that need what came before: repeated templates, bursts and rows seen already.

Each is a stateful operator whose state is a few numbers a key and goes once event time has passed its window, so a stream may run for
ever. Rows of a micro-batch are taken in order of time and id, and a row older than the watermark of its stream doesn't come at
all: with rows in order between batches, decisions are those of the batch operators of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Rows of a key that are sorted at once; all rows of a key and batch are needed in order, as three numbers each.
FIELDS = ["id", "at"]


def _in_order(chunks: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, times) of a key's rows of one batch, by time and id; nothing else of them is held."""
    parts = [(c["id"].to_numpy(np.int64), c["at"].to_numpy(np.int64)) for c in chunks]
    ids, at = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    order = np.lexsort((ids, at))
    return ids[order], at[order]


def _keyed(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """``id``, ``at`` in microseconds of the row's ``ts``, with the stream's watermark."""
    rows = stream.withWatermark("ts", delay).where("ts is not null and id is not null")
    return rows.withColumn("at", F.unix_micros("ts"))


def _expiring(window_us: int, fold: Callable, out: list[str]):
    """A step that folds rows into the state and lets the state go when the watermark is a window past its last row."""

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({c: pd.Series(dtype=object) for c in out})
            return
        ids, at = _in_order(chunks)
        told, held = fold(state.get if state.exists else None, ids, at)
        state.update(held)
        # The watermark may be past the window already; the state then goes at the next chance.
        state.setTimeoutTimestamp(max(int(at[-1] + window_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({c: v for c, v in zip(out, [*([k] * len(ids) for k in key), ids, *told], strict=True)})

    return step


def rolling_template(stream: DataFrame, window_us: int, least: int, delay: str = "1 hour") -> DataFrame:
    """(template, sender, id, n_window, drop) of ``id, ts, template, sender``: rows of the pair in the window that ends with the row.

    The row is dropped from the ``least``-th on. The state holds the times inside the window.
    """

    def fold(held, ids, at):
        old = np.array(held[0] if held else [], np.int64)
        every = np.concatenate((old, at))
        # Rows of the same time count together, as a range window has them.
        n = np.searchsorted(every, at, "right") - np.searchsorted(every, at - window_us, "left")
        kept = every[every >= every[-1] - window_us]
        return (n, n >= least), (kept.tolist(),)

    out = ["template", "sender", "id", "n_window", "drop"]
    grouped = _keyed(stream, ["template", "sender"], delay).select("template", "sender", "ts", *FIELDS).groupBy("template", "sender")
    return grouped.applyInPandasWithState(_expiring(window_us, fold, out), "template string, sender string, id long, n_window long, drop boolean", "times array<long>", "append", "EventTimeTimeout")


def burst_collapse(stream: DataFrame, gap_us: int, delay: str = "1 hour") -> DataFrame:
    """(handle, id, keep) of ``id, ts, handle``: false for a row at most ``gap_us`` after the handle's last one, which it refreshes."""

    def fold(held, ids, at):
        before = np.concatenate(([held[0] if held else at[0] - gap_us - 1], at[:-1]))
        return (at - before > gap_us,), (int(at[-1]),)

    out = ["handle", "id", "keep"]
    grouped = _keyed(stream, ["handle"], delay).select("handle", "ts", *FIELDS).groupBy("handle")
    return grouped.applyInPandasWithState(_expiring(gap_us, fold, out), "handle string, id long, keep boolean", "last long", "append", "EventTimeTimeout")


def seen_in_day(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(hash, day, id, first) of ``id, ts, hash``: whether the row is the first of its hash on its UTC day of the session's zone."""

    def fold(held, ids, at):
        first = np.zeros(len(ids), bool)
        first[0] = held is None
        return (first,), (True,)

    out = ["hash", "day", "id", "first"]
    rows = _keyed(stream, ["hash"], delay).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).select("hash", "day", "ts", *FIELDS)
    return rows.groupBy("hash", "day").applyInPandasWithState(_expiring(86_400_000_000, fold, out), "hash string, day string, id long, first boolean", "seen boolean", "append", "EventTimeTimeout")
