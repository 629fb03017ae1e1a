"""Structured Streaming forms of the event-log and telemetry operators.

Each takes a streaming DataFrame of events (event_id, ts, user_id, event_type, ...) and returns one;
``run_to_table`` drives a stream over what its source holds now and gives the result as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.staging import shared_dir, table
from weftline.streaming import stateful

LATE = "40 days"  # the test log comes in no order


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """New Parquet files of a table as a stream."""
    schema = table(spark, sf_dir, name).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    # Event times carry a zone, which watermarks ask for.
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes])


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """Calls and errors per hour and type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return w.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Events per user and session; a session ends with a gap."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return w.agg(F.count("*").alias("events"), F.max("ts").alias("last"))


def deduplicated(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Each key once within the time that late events may take."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def two_phase(first: DataFrame, then: DataFrame, key: str, within: str, late: str = LATE) -> DataFrame:
    """A first event and a later one of its key within a time, as a stream-stream join with bounded state."""
    a = first.withWatermark("ts", late).select(F.col(key), F.col("ts").alias("began"))
    b = then.withWatermark("ts", late).select(F.col(key).alias("other"), F.col("ts").alias("ended"))
    return a.join(b, (F.col(key) == F.col("other")) & (F.col("ended") >= F.col("began")) & (F.col("ended") <= F.col("began") + F.expr(f"interval {within}"))).drop("other")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, last, kind, n = state.get if state.exists else (-1, -1, "", 0)
    for pdf in batches:
        n += len(pdf)
        row = pdf.sort_values(["micros", "event_id"]).iloc[-1]
        if (int(row["micros"]), int(row["event_id"])) > (at, last):
            at, last, kind = int(row["micros"]), int(row["event_id"]), row["event_type"]
    state.update((at, last, kind, n))
    yield pd.DataFrame({"artifact_id": [key[0]], "latest_kind": [kind], "latest_id": [last], "events": [n]})


def incremental_fold(events: DataFrame) -> DataFrame:
    """The latest event of each artifact and how many it has had, carried in state across batches."""
    rows = events.select(F.col("user_id"), F.unix_micros("ts").alias("micros"), "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(_fold, "artifact_id long, latest_kind string, latest_id long, events long", "at long, last long, kind string, n long", "update", GroupStateTimeout.NoTimeout)


def _folder(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Finished tables below a folder, by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}/_SUCCESS"))
    return sorted(f.getPath().getParent().getName() for f in found or [])


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", where: str | None = None) -> DataFrame:
    """What a stream gives over all that its source holds now, as a table in the shared folder.

    Batches are tables of one folder, which is read as a whole; of a stream in complete mode the last one is the
    result. A batch that is run again replaces its own table. Started again with the same ``where``, a stream goes
    on after what it has read, and its table has what all runs gave. Nothing is gathered in the driver.
    """
    spark = stream.sparkSession
    where = where or f"{shared_dir(spark)}/streams/{name}_{uuid.uuid4().hex[:8]}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/batches/{number:09d}")
        if mode == "complete":
            for old in _folder(spark, f"{where}/batches"):
                if old != f"{number:09d}":
                    _drop(spark, f"{where}/batches/{old}")

    with stateful.rocks(spark):
        query = stream.writeStream.foreachBatch(keep).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{where}/progress").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/batches/*") if _folder(spark, f"{where}/batches") else spark.createDataFrame([], stream.schema)


COMPACT = 8  # batches after which changes are merged into the table


def _newest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*").select(*rows.columns)


def upserted(spark: SparkSession, where: str, schema, key: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """The keyed table of a folder as it stands: its newest merged state and the changes since; None if there is neither."""
    bases, changes = _folder(spark, f"{where}/base"), _folder(spark, f"{where}/changes")
    base = bases[-1] if bases else ""
    parts = [f"{where}/base/{base}"] * bool(base) + [f"{where}/changes/{c}" for c in changes if c > base]
    return _newest(spark.read.schema(schema).parquet(*parts), key, order) if parts else None


def upsert_each_batch(stream: DataFrame, key: Sequence[str], order: Sequence[str], where: str | None = None, compact: int = COMPACT) -> DataFrame:
    """A keyed table kept by foreachBatch: each batch's latest rows replace older ones of their keys.

    A batch writes its own latest rows only; every ``compact`` batches changes are merged with the table into its next state, and
    what that replaces goes one merge later. What the table is stands in ``where`` alone: a folder counts once it is
    finished, and a batch that is run again writes the same folder or is already merged, so a stream that is started again over its
    checkpoint goes on with the table that it had. Of rows of a key, the last by ``order`` holds whatever batch it came in.
    """
    spark = stream.sparkSession
    where = where or f"{shared_dir(spark)}/streams/upsert_{uuid.uuid4().hex[:8]}"

    def merge(batch: DataFrame, number: int) -> None:
        me, bases = f"{number:09d}", _folder(spark, f"{where}/base")
        if bases and me <= bases[-1]:
            return
        _newest(batch, key, order).write.mode("overwrite").parquet(f"{where}/changes/{me}")
        if (number + 1) % compact == 0:
            upserted(spark, where, batch.schema, key, order).write.mode("overwrite").parquet(f"{where}/base/{me}")
            for old in bases[:-1]:
                _drop(spark, f"{where}/base/{old}")
            for old in _folder(spark, f"{where}/changes"):
                if bases and old <= bases[-1]:
                    _drop(spark, f"{where}/changes/{old}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    found = upserted(spark, where, stream.schema, key, order)
    return spark.createDataFrame([], stream.schema) if found is None else found
