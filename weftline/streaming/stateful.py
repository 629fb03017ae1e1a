"""Operators with keyed state and timers of their own: rows that expire, events in two phases, a fold by field.

State lies in RocksDB, so it may outgrow memory, and is read back when a query is started again over its
checkpoint. Times are counted in whole milliseconds, as watermarks are.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 24 * 3600 * 1000
PAGE = 256  # rows of a page of state, or those of one time
ROWS = 1 << 16  # rows of a key that are held at a time


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _millis(c: str):
    return F.unix_millis(F.col(c))


class _Retention(StatefulProcessor):
    """Ids in pages of neighbouring times, by their first time; one timer for each page, so state is asked a few times for many rows."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("pages", "first long", "at array<long>, ids array<long>")

    def _hold(self, rows: list[tuple[int, int]]) -> None:
        """Writes rows (time, id) that are in order of time as pages; rows of one time stay on one."""
        while rows:
            first = (rows[0][0],)
            page = self.held.getValue(first)
            if page is None:
                self.handle.registerTimer(first[0] + self.keep + 1)
            else:
                rows = sorted([*zip(page[0], page[1], strict=True), *rows], key=lambda r: r[0])
            end = min(PAGE, len(rows))
            while end < len(rows) and rows[end][0] == rows[end - 1][0]:
                end += 1
            self.held.updateValue(first, ([at for at, _ in rows[:end]], [i for _, i in rows[:end]]))
            rows = rows[end:]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        new: list[tuple[int, int]] = []
        for r in rows:
            if r["at"] is None or r["at"] + self.keep < now:
                continue  # gone before it came
            new.append((r["at"], r["id"]))
            if len(new) == ROWS:  # a key may have more rows than fit into memory
                self._hold(sorted(new, key=lambda r: r[0]))
                new = []
            yield Row(key=key[0], id=r["id"], at=r["at"], held=True)
        self._hold(sorted(new, key=lambda r: r[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first = expiredTimerInfo.getExpiryTimeInMs() - self.keep - 1
        page = self.held.getValue((first,))
        if page is None:
            return
        now, left = timerValues.getCurrentWatermarkInMs(), []
        self.held.removeKey((first,))
        for at, i in zip(page[0], page[1], strict=True):
            if at == first or at + self.keep < now:
                yield Row(key=key[0], id=i, at=at, held=False)
            else:
                left.append((at, i))
        self._hold(left)

    def close(self) -> None:
        pass


def retained(events: DataFrame, key: str, id: str, ts: str = "ts", days: float = 30, late: str = "0 seconds") -> DataFrame:
    """``(key, id, at, held)``: a row when an event comes (``held``) and one when its time is over, ``days`` before the watermark.

    What has come and isn't over is what a batch would keep of rows no older than ``days`` before the latest. Events
    that are over when they come give nothing, later ones than ``late`` are dropped as all streams do.
    """
    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(id).cast("long").alias("id"), _millis(ts).alias("at"), F.col(ts).alias("ts"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithState(_Retention(round(days * DAY)), f"key {kind}, id long, at long, held boolean", "append", "eventTime")


class _TwoPhase(StatefulProcessor):
    """First events and answers of a key until the time for an answer is over."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "began long", "ids array<long>")
        self.then = handle.getMapState("then", "ended long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = (r["at"],)
            if r["first"]:
                ids = list(self.first.getValue(at)[0]) if self.first.containsKey(at) else []
                self.first.updateValue(at, ([*ids, r["id"]],))
            else:
                self.then.updateValue(at, (1,))
            # An answer is held as long as a first event that it answers may still come or wait.
            self.handle.registerTimer(r["at"] + self.within + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() - self.within - 1
        if self.first.containsKey((at,)):
            answers = [e for (e,) in self.then.keys() if at <= e <= at + self.within]
            for i in self.first.getValue((at,))[0]:
                yield Row(key=key[0], id=i, began=at, ended=min(answers, default=None), answered=bool(answers))
            self.first.removeKey((at,))
        if self.then.containsKey((at,)):
            self.then.removeKey((at,))

    def close(self) -> None:
        pass


def two_phase(events: DataFrame, key: str, id: str, first, then, within_ms: int, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """``(key, id, began, ended, answered)``: every first event once, with its key's first later answer, or with none.

    ``first`` and ``then`` are conditions that tell the two kinds of events. An event is given out once the watermark has passed the time
    for its answer, so the order in which both come doesn't matter; answers to nothing, and all but the first, are let go.
    """
    rows = events.where(first | then).withWatermark(ts, late)
    rows = rows.select(F.col(key).alias("key"), F.col(id).cast("long").alias("id"), _millis(ts).alias("at"), first.alias("first"), F.col(ts).alias("ts"))
    return rows.groupBy("key").transformWithState(_TwoPhase(within_ms), f"key {dict(rows.dtypes)['key']}, id long, began long, ended long, answered boolean", "append", "eventTime")


class _Fold(StatefulProcessor):
    """The newest value of each field."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "at long, id long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict = {}
        for r in rows:
            if r["field"] is not None and (r["field"] not in newest or (r["at"], r["id"]) > newest[r["field"]][:2]):
                newest[r["field"]] = (r["at"], r["id"], r["value"])
        for field, new in newest.items():
            old = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
            if old is None or new[:2] > (old[0], old[1]):
                self.fields.updateValue((field,), new)
                yield Row(artifact_id=key[0], field=field, at=new[0], id=new[1], value=new[2])

    def close(self) -> None:
        pass


def fold_fields(events: DataFrame) -> DataFrame:
    """``(artifact_id, field, at, id, value)`` of events with these columns: each field's value whenever a newer one has come.

    Newer is later by (at, id), so the order of events within and across batches doesn't matter. A null field is ignored,
    a null value is a value.
    """
    rows = events.select("artifact_id", "field", F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), F.col("value").cast("string").alias("value"))
    return rows.groupBy("artifact_id").transformWithState(_Fold(), f"artifact_id {dict(rows.dtypes)['artifact_id']}, field string, at long, id long, value string", "update", "none")
