"""Structured Streaming over ledgers: admission with side outputs, throttled alerts and once-only rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from memloom.operators import admission
from memloom.sources import ledger


def watch(spark: SparkSession, path: str, ddl: str = ledger.EVENT, files: int = 100) -> DataFrame:
    """A stream of a folder's JSON lines, at most ``files`` new files a micro-batch."""
    read = spark.readStream.schema(ledger.schema_of(ddl)).option("columnNameOfCorruptRecord", ledger.BROKEN)
    return read.option("maxFilesPerTrigger", files).json(path)


def cascade(stream: DataFrame, out: str, checkpoint: str, admit: Callable[[DataFrame], DataFrame] = admission.admit) -> StreamingQuery:
    """Admit each micro-batch: rows passed to ``out/passed``, others to ``out/held``, broken lines to ``out/broken``.

    A batch writes to folders of its own id and overwrites them, so a batch run again after a failure
    changes nothing.
    """

    def step(rows: DataFrame, batch: int) -> None:
        verdicts = admit(rows.where(f"{ledger.BROKEN} is null").drop(ledger.BROKEN)).persist()
        verdicts.where("decision = 'PASS'").write.mode("overwrite").parquet(f"{out}/passed/batch={batch}")
        admission.quarantine(verdicts).write.mode("overwrite").parquet(f"{out}/held/batch={batch}")
        rows.where(f"{ledger.BROKEN} is not null").select(ledger.BROKEN).write.mode("overwrite").parquet(f"{out}/broken/batch={batch}")
        verdicts.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state of keys older than ``delay`` goes."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def throttle(stream: DataFrame, window_us: int = 3_600_000_000) -> DataFrame:
    """(source, reason, at, suppressed) of rows ``source, reason, at`` (microseconds).

    A key's first row is emitted and opens a window; rows inside it are counted only, and the row
    that opens the next window tells how many. The state is two numbers a key.
    """

    def step(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, held = state.get if state.exists else (None, 0)
        # A key's rows of one batch may come in several chunks; only their times are held, in order.
        times, told = np.sort(np.concatenate([np.zeros(0, np.int64), *(c["at"].to_numpy(np.int64) for c in chunks)])), []
        for at in times.tolist():
            if opened is None or at - opened >= window_us:
                told.append((*key, at, held))
                opened, held = at, 0
            else:
                held += 1
        yield pd.DataFrame(told, columns=["source", "reason", "at", "suppressed"])
        state.update((opened, held))

    out = "source string, reason string, at long, suppressed long"
    return stream.groupBy("source", "reason").applyInPandasWithState(step, out, "opened long, held long", "append", "NoTimeout")
