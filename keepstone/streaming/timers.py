"""Changes that wait until things are quiet: files that are still arriving, writes that follow a run of clicks.

Every key has a timer in the state store. A change sets it back, and when it runs out the whole run of changes becomes one
row: a file that has settled, or one write. Time is that of the changes, so what comes out doesn't depend on how they were
dealt to batches, and a query that stops goes on from its checkpoint with all that waits.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Quiet(StatefulProcessor):
    """Open runs of a key, each (first, last, changes, payload of the last change), as arrays in order of time.

    A key has more than one open run only while changes come that are further apart than the quiet time, but not yet
    behind the watermark.
    """

    def __init__(self, quiet_ms: int, payload: T.DataType):
        self.quiet, self.payload = quiet_ms, payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        whole = T.ArrayType(T.LongType())
        fields = [T.StructField(n, whole) for n in ("first", "last", "changes")]
        self.handle = handle
        self.runs = handle.getValueState("runs", T.StructType([*fields, T.StructField("payload", T.ArrayType(self.payload))]))

    def _held(self) -> list[tuple]:
        return list(zip(*self.runs.get(), strict=True)) if self.runs.exists() else []

    def _keep(self, runs: list[tuple]) -> None:
        if runs:
            self.runs.update(tuple(list(c) for c in zip(*runs, strict=True)))
        else:
            self.runs.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._held()
        new = [(r["_ms"], r["_ms"], 1, r["_payload"]) for r in rows]
        merged: list[tuple] = []
        for first, last, n, payload in sorted(before + new, key=lambda r: (r[0], r[1], repr(r[3]))):
            if merged and first - merged[-1][1] <= self.quiet:
                a, b, m, p = merged[-1]
                merged[-1] = (a, max(b, last), m + n, payload if (last, repr(payload)) >= (b, repr(p)) else p)
            else:
                merged.append((first, last, n, payload))
        due, was = {r[1] + self.quiet for r in merged}, {r[1] + self.quiet for r in before}
        for t in was - due:
            self.handle.deleteTimer(t)
        for t in due - was:
            self.handle.registerTimer(t)
        self._keep(merged)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = expiredTimerInfo.getExpiryTimeInMs() - self.quiet
        held = self._held()
        self._keep([r for r in held if r[1] > over])
        for first, last, n, payload in held:
            if last <= over:
                yield Row(**{f"_k{i}": k for i, k in enumerate(key)}, _first=first, _last=last, changes=n, _payload=payload)

    def close(self) -> None:
        pass


def when_quiet(stream: DataFrame, keys: list[str], time: str, payload: str, seconds: float, late: str) -> DataFrame:
    """(keys, first, last, changes, payload): a row for each run of changes of a key after which ``seconds`` were quiet.

    The payload is that of the last change (of changes at one moment the greatest by its text). A run is given out once
    the watermark (the latest time seen less ``late``) is behind its end and the quiet time; changes that come even later
    than that are dropped.
    """
    kind = stream.schema[payload].dataType
    fields = [T.StructField(f"_k{i}", stream.schema[k].dataType) for i, k in enumerate(keys)]
    fields += [T.StructField(n, T.LongType()) for n in ("_first", "_last", "changes")]
    out = T.StructType([*fields, T.StructField("_payload", kind)])
    ms = F.unix_millis(F.col(time)).alias("_ms")
    rows = stream.withWatermark(time, late).select(*keys, time, ms, F.col(payload).alias("_payload"))
    told = rows.groupBy(*keys).transformWithState(_Quiet(int(seconds * 1000), kind), out, "append", "eventTime")
    named = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    return told.select(*named, F.timestamp_millis("_first").alias("first"), F.timestamp_millis("_last").alias("last"), "changes", F.col("_payload").alias(payload))


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    """Timers need the RocksDB store; the session's own setting comes back, a query keeps what it was started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_quiet(rows: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; what waits stays in the checkpoint, for a later call."""
    with _rocks(rows.sparkSession):
        query = rows.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        started = query.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def settled_files(listings: DataFrame, seconds: float, late: str = "0 seconds") -> DataFrame:
    """(path, mtime, size, changes) of files (path, mtime, size) that didn't change for so long; the others are parked."""
    quiet = when_quiet(listings, ["path"], "mtime", "size", seconds, late)
    return quiet.select("path", F.col("last").alias("mtime"), "size", "changes")


def debounced_writes(changes: DataFrame, target: str, time: str, version: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """(target, version, changes, due): one write, of the last version, after the last of a run of changes to a target."""
    quiet = when_quiet(changes, [target], time, version, seconds, late)
    return quiet.select(target, version, "changes", (F.col("last") + F.make_dt_interval(secs=F.lit(float(seconds)))).alias("due"))
