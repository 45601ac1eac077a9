"""G20 with ``reset`` on a stream: running total, count and average per key
that start anew at rows marked as resets.

Rows of a key may come out of order, so they wait in the key's state until
the watermark has passed them (an event-time timer wakes the key); then they
are taken in order of (time, step), all at once, and every row is given out with
the meter after it.  State per key is the meter and the rows that still wait, which the
watermark's delay bounds.  Values are summed as whole units of 10^-6, so
sums do not depend on how rows fell into batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqforge.operators.metrics import exact
from seqforge.operators.ranking import running

UNITS = 10**6
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "key string, step long, ts timestamp, total double, count long, average double"


#: A waiting row in the state, and how many of them are stored or given out at once.
WAITING = np.dtype([("us", "<i8"), ("step", "<i8"), ("units", "<i8"), ("reset", "?")])
CHUNK = 1 << 16


class ResetMeter(StatefulProcessor):
    """(total, count) of a key and the rows that the watermark has not passed.

    These lie packed in chunks, by the time of a chunk's first row; one timer
    stands at the earliest of them, so that a row costs no call to the state of
    its own and the rows that wait are read once when the watermark moves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meter = handle.getValueState("meter", "total long, count long, chunks long, wake long")
        self.waiting = handle.getMapState("waiting", "first long, chunk long", "rows binary")

    def _meter(self) -> tuple[int, int, int, int | None]:
        return tuple(self.meter.get()) if self.meter.exists() else (0, 0, 0, None)

    def _wait(self, rows: np.ndarray, chunks: int) -> int:
        """Store rows; the number of chunks so far."""
        for at in range(0, len(rows), CHUNK):
            some = rows[at:at + CHUNK]
            self.waiting.updateValue((int(some["us"].min()) // 1000, chunks), (some.tobytes(),))
            chunks += 1
        return chunks

    def _wake(self, old: int | None, new: int | None) -> int | None:
        """The key's one timer, moved to ``new``."""
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key, rows, timerValues):
        total, count, chunks, wake = self._meter()
        first, now = wake, timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            new = np.zeros(len(pdf), WAITING)
            for c in WAITING.names:
                new[c] = pdf[c].astype(WAITING[c])  # an error where a value is missing
            new = new[new["us"] // 1000 > now]
            if len(new):
                chunks = self._wait(new, chunks)
                least = int(new["us"].min()) // 1000
                first = least if first is None else min(first, least)
        self.meter.update((total, count, chunks, self._wake(wake, first)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        total, count, chunks, wake = self._meter()
        kept, ready, rest = [], [], []
        for first, chunk in sorted(tuple(k) for k in self.waiting.keys()):
            if first > now:
                kept.append(first)
                continue
            rows = np.frombuffer(self.waiting.getValue((first, chunk))[0], WAITING)
            passed = rows["us"] // 1000 <= now
            ready.append(rows[passed])
            rest.append(rows[~passed])
            self.waiting.removeKey((first, chunk))
        if not ready:
            return iter(())
        rows, rest = np.concatenate(ready), np.concatenate(rest)
        chunks = self._wait(rest, chunks)
        if len(rest):
            kept.append(int(rest["us"].min()) // 1000)
        rows = rows[np.lexsort((rows["reset"], rows["units"], rows["step"], rows["us"]))]
        sums, counts = metered(rows["units"], rows["reset"], total, count)
        self.meter.update((int(sums[-1]), int(counts[-1]), chunks, self._wake(None if wake <= now else wake, min(kept, default=None))))
        return (self._given(key[0], rows[at:at + CHUNK], sums[at:at + CHUNK], counts[at:at + CHUNK]) for at in range(0, len(rows), CHUNK))

    @staticmethod
    def _given(key, rows, sums, counts) -> pd.DataFrame:
        total = np.array([int(s) / UNITS for s in sums]) if np.abs(sums).max() >= 1 << 53 else sums / UNITS
        return pd.DataFrame({"key": key, "step": rows["step"], "ts": pd.to_datetime(rows["us"], unit="us", utc=True),
                             "total": total, "count": counts, "average": total / counts})

    def close(self) -> None:
        pass


def metered(units: np.ndarray, reset: np.ndarray, total: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(total, count) after each row, from a meter that stands at ``total, count``."""
    place = np.arange(1, len(units) + 1)
    since = np.maximum.accumulate(np.where(reset, place, 0))  # the last reset so far, 0: none
    before = np.append(np.int64(-total), np.cumsum(units) - units)  # what does not count, by that reset
    return np.cumsum(units) - before[since], np.where(since > 0, place - since + 1, place + count)


def reset_meter_stream(stream: DataFrame, key: str, step: str, ts: str, value: str, reset: str,
                       watermark: str = "1 hour") -> DataFrame:
    """Streaming ``(key, step, ts, total, count, average)`` after each row; a
    row whose ``reset`` is true starts its key's meter anew.  Rows later than the
    watermark are dropped, as Spark's own windows do; a null reset is false."""
    units = (exact(F.col(value), 6) * UNITS).cast("long")
    s = stream.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(ts).cast("timestamp").alias("ts"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), units.alias("units"),
                      F.coalesce(F.col(reset), F.lit(False)).alias("reset")).withWatermark("ts", watermark)
    return s.groupBy("key").transformWithStateInPandas(ResetMeter(), ROWS, "append", "EventTime")


def reset_meter(df: DataFrame, key: str, step: str, ts: str, value: str, reset: str) -> DataFrame:
    """The batch form: running sums (range-bucketed) within the rows since the last reset."""
    d = df.select(F.col(key).cast("string").alias("key"), F.col(step).cast("long").alias("step"), F.col(ts).cast("timestamp").alias("ts"),
                  exact(F.col(value), 6).alias("_v"), F.lit(1).cast("long").alias("_one"),
                  F.coalesce(F.col(reset), F.lit(False)).cast("long").alias("_r"))
    d = running(d, ["key"], ["ts", "step"], sums=("_r",)).withColumnRenamed("cum__r", "_part").drop("_r_total")
    d = running(d, ["key", "_part"], ["ts", "step"], sums=("_v", "_one"))
    total = F.col("cum__v").cast("double")
    return d.select("key", "step", "ts", total.alias("total"), F.col("cum__one").alias("count"), (total / F.col("cum__one")).alias("average"))


def run_reset_meter(spark: SparkSession, source: DataFrame, out: str, checkpoint: str, **cols) -> DataFrame:
    """Run the meter over what a streaming source has now, into a parquet
    sink.  Rows that the watermark has not passed wait in the checkpoint for a
    later call."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # arbitrary state needs this store
    try:
        q = (reset_meter_stream(source, **cols).writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(ROWS).parquet(out)
