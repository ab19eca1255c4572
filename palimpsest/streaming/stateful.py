"""Stateful streams: circuit breakers over calls, and documents that complete page by page.

Both keep their state by key in Spark's state store, take rows in event time, and act when the watermark passes: a
result does not depend on how rows fall into micro-batches, rows that come late (within ``delay``) included. State is
bounded: calls wait no longer than the delay; documents go when they are complete or have waited long enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Processors with several kinds of state need the store that keeps column families."""
    spark.conf.set(_STORE, _ROCKS)


class _Alarm:
    """One timer of a key: set to the earliest time at which there is something to do."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    def set(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != at:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)


#: A call as bytes that sort by (us, seq, failed), a missing seq first; the last byte is never 0, which numpy would strip.
_CALL = np.dtype([("us", ">u8"), ("named", "u1"), ("seq", ">u8"), ("failed", "u1")])
_KEY, _SIGN = f"S{_CALL.itemsize}", np.uint64(1 << 63)
#: Calls of a block, which is read and written at once; blocks that are sorted in memory; runs of a level before they become one.
_BLOCK, _SORTED, _RUNS = 8192, 32, 32


def _packed(calls: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(calls), _CALL)
    for name in ("us", "seq"):
        out[name] = calls[name].to_numpy("int64").view("uint64") ^ _SIGN
    out["named"], out["failed"] = calls["named"], 1 + calls["failed"].to_numpy("u1")
    return out.view(_KEY)


def _gathered(parts: Iterable[np.ndarray], least: int) -> Iterator[np.ndarray]:
    """The same calls in arrays of at least ``least``, but for the last."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


class Breaker(StatefulProcessor):
    """Failures in a row of an engine. Calls wait until the watermark says that no earlier one can come.

    Waiting calls are sorted runs of blocks in the state store; those that are due are merged from there, one block of
    each run at a time. Runs of one level become one of the next when there are many, so that memory does not grow with the calls that wait."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "failures long")
        self.blocks = handle.getMapState("blocks", "run long, block long", "calls binary")
        self.runs = handle.getMapState("runs", "run long", "level long, first long, last long, us long")
        self.alarm = _Alarm(handle)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.run.update((int(initialState["failures"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for calls in _gathered(map(_packed, rows), _BLOCK * _SORTED):
            self._keep([np.sort(calls)], 0)
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs())

    def _known(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.runs.iterator()}

    def _keep(self, parts: Iterable[np.ndarray], level: int) -> None:
        """Calls in order become a run."""
        known = self._known()
        run, n, first = max(known, default=-1) + 1, 0, None
        for calls in _gathered(parts, _BLOCK):
            first = calls[:1].view(_CALL)["us"][0] if first is None else first
            for k in range(0, len(calls), _BLOCK):
                self.blocks.updateValue((run, n), (calls[k : k + _BLOCK].tobytes(),))
                n += 1
        known[run] = (level, 0, n, int((first ^ _SIGN).astype("int64")))
        self.runs.updateValue((run,), known[run])
        same = {r: v for r, v in known.items() if v[0] == level}
        if len(same) >= _RUNS:
            self._keep(self._merged(same), level + 1)

    def _block(self, run: int, block: int) -> np.ndarray:
        return np.frombuffer(self.blocks.getValue((run, block))[0], _KEY)

    def _merged(self, runs: dict[int, tuple], limit: bytes | None = None) -> Iterator[np.ndarray]:
        """Calls of these runs in order, as far as ``limit``; what is given out goes from the state."""
        at = {r: first for r, (_, first, _, _) in runs.items()}
        heads = {r: self._block(r, k) for r, k in at.items()}
        while heads:
            # whatever is not read yet comes after the last call of its run's block
            bound = min([heads[r][-1] for r in heads if at[r] + 1 < runs[r][2]] + ([] if limit is None else [limit]), default=None)
            parts = []
            for r in list(heads):
                k = len(heads[r]) if bound is None else int(np.searchsorted(heads[r], bound, "right"))
                parts.append(heads[r][:k])
                heads[r] = heads[r][k:]
                if not len(heads[r]):
                    self.blocks.removeKey((r, at[r]))
                    at[r] += 1
                    if at[r] < runs[r][2]:
                        heads[r] = self._block(r, at[r])
                    else:
                        del heads[r]
                        self.runs.removeKey((r,))
            due = np.concatenate(parts)
            if len(due):
                yield np.sort(due, kind="stable")
            if limit is not None and all(h[0] > limit for h in heads.values()):
                break
        for r, rest in heads.items():
            self.blocks.updateValue((r, at[r]), (rest.tobytes(),))
            self.runs.updateValue((r,), (runs[r][0], at[r], runs[r][2], int((rest[:1].view(_CALL)["us"][0] ^ _SIGN).astype("int64"))))

    def _settled(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        due = {r: v for r, v in self._known().items() if v[3] // 1000 < watermark}
        if due:
            failures = self.run.get()[0] if self.run.exists() else 0
            limit = (watermark * 1000 + (1 << 63)).to_bytes(8, "big")
            for part in _gathered(self._merged(due, limit), _BLOCK):
                calls = part.view(_CALL)
                failed, k = calls["failed"] > 1, np.arange(len(calls))
                good = np.maximum.accumulate(np.where(failed, -1, k))
                n = np.where(good < 0, failures + k + 1, k - good)
                failures = int(n[-1])
                seq = pd.arrays.IntegerArray((calls["seq"].astype("uint64") ^ _SIGN).view("int64"), calls["named"] == 0)
                yield pd.DataFrame({"engine": key[0], "seq": seq, "failures": n, "is_open": n >= self.threshold})
            self.run.update((failures,))
        first = min((v[3] for v in self._known().values()), default=None)
        self.alarm.set(None if first is None else first // 1000 + 1)


def breaker(calls: DataFrame, threshold: int = 5, delay: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """(engine, seq, failures, is_open) for a stream of calls (engine, ts, seq, failed), in order of (ts, seq).

    ``initial``: (engine,
    failures) to go on from."""
    use_state_store(calls.sparkSession)
    d = calls.select("engine", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.col("seq").isNotNull().alias("named"), F.coalesce("failed", F.lit(False)).alias("failed"))
    d = d.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    start = initial.select("engine", "failures").groupBy("engine") if initial is not None else None
    return d.groupBy("engine").transformWithStateInPandas(Breaker(threshold), "engine string, seq long, failures long, is_open boolean", "append", "eventTime", start)


class Completion(StatefulProcessor):
    """A document's pages, until all are done or ``patience`` has passed since the last one's time."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "page long", "ms long")
        self.size = handle.getValueState("size", "pages long, last long, complete boolean")
        self.alarm = _Alarm(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.size.exists() and self.size.get()[1] + self.patience <= timerValues.getCurrentWatermarkInMs():
            yield from self._given_up(key)  # its time was over before these rows came
        pages, last, complete = self.size.get() if self.size.exists() else (0, 0, False)
        for r in rows:
            pages, last = max(pages, r["page_count"]), max(last, r["ms"])
            if r["is_done"] and not complete:
                self.done.updateValue((r["page"],), (r["ms"],))
        if not complete and pages:
            times = [v[0] for v in self.done.values()]
            if len(times) >= pages:
                complete = True
                self.done.clear()  # pages that are repeated later change nothing any more
                yield Row(path=key[0], pages_done=len(times), page_count=pages, complete=True)
        self.size.update((pages, last, complete))
        self.alarm.set(last + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.size.exists() and self.size.get()[1] + self.patience <= timerValues.getCurrentWatermarkInMs():
            yield from self._given_up(key)

    def _given_up(self, key) -> Iterator[Row]:
        pages, _, complete = self.size.get()
        if not complete:
            yield Row(path=key[0], pages_done=sum(1 for _ in self.done.keys()), page_count=pages, complete=False)
        self.done.clear()
        self.size.clear()


def completions(pages: DataFrame, delay: str = "10 minutes", patience_ms: int = 3_600_000) -> DataFrame:
    """(path, pages_done, page_count, complete) for a stream of pages (path, page, page_count, is_done, ts): one row a
    document, when its last page is done, or when none has come for ``patience_ms`` of event time.

    Pages may be repeated. What is kept of a document goes after ``patience_ms``; one that comes again later is new."""
    use_state_store(pages.sparkSession)
    d = pages.select("path", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("page").cast("long"), F.col("page_count").cast("long"), "is_done").withWatermark("ts", delay)
    return d.groupBy("path").transformWithState(Completion(patience_ms), "path string, pages_done long, page_count long, complete boolean", "append", "eventTime")
