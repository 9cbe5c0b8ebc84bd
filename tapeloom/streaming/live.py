"""Structured Streaming jobs: revised bars, events to bars, and live stop tracking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tapeloom.config import Costs, Stops
from tapeloom.operators.stop_fold import EVENTS
from tapeloom.operators.stops import Bar, Holding, advance
from tapeloom.session import cut_lineage
from tapeloom.sources.upsert import upsert

MONTH = "month"
# Parts of a month.
BUCKETS = 16


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a panel, in order."""
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(home):
        return []
    names = [s.getPath() for s in fs.listStatus(home)]
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """``month, bucket, version, batch``: where the parts of a version are; one row per month and bucket."""
    return spark.read.schema("month string, bucket int, version long, batch long").parquet(f"{path}/_versions/{version}")


def _parts(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The rows of the named parts; only their folders are read."""
    data = spark.read.option("mergeSchema", True).parquet(f"{path}/data").withColumns(
        {MONTH: F.col(MONTH).cast("string"), "bucket": F.col("bucket").cast("int"), "version": F.col("version").cast("long")})
    return data.join(F.broadcast(manifest.select(MONTH, "bucket", "version")), [MONTH, "bucket", "version"], "left_semi")


def read_panel(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A whole version of a stored panel, the newest unless named; None where nothing is stored yet.

    A writer adds files and then a manifest, so a reader never sees half a batch.
    """
    versions = _manifests(spark, path)
    if not versions:
        return None
    return _parts(spark, path, _manifest(spark, path, version or versions[-1])).drop(MONTH, "bucket", "version")


def merge_batch(batch: DataFrame, path: str, keys: Sequence[str] = ("entity", "date"), batch_id: int | None = None, buckets: int = BUCKETS) -> None:
    """Upsert one batch into a panel stored by month and hash bucket of the entity.

    Only the parts that the batch touches are read; their merged rows are written as new files of the next version, each
    part by its own task, however many a month has. The version's manifest is written last and makes it visible. A batch
    whose number is in the newest manifest already was applied and is skipped. Files of a write that was cut off are
    written over by its repetition; superseded files stay for readers of earlier versions until :func:`vacuum`.
    """
    spark = batch.sparkSession
    versions = _manifests(spark, path)
    last = _manifest(spark, path, versions[-1]) if versions else None
    if last is not None and batch_id is not None and (last.agg(F.max("batch")).first()[0] or -1) >= batch_id:
        return
    version = versions[-1] + 1 if versions else 1
    placed = cut_lineage(batch.withColumns(
        {MONTH: F.date_format("date", "yyyy-MM"), "bucket": F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int")}))
    touched = placed.select(MONTH, "bucket").distinct()
    stored = None
    if last is not None:
        stored = _parts(spark, path, last.join(F.broadcast(touched), [MONTH, "bucket"], "left_semi")).drop("version")
    merged = upsert(stored, placed, keys).withColumn("version", F.lit(version))
    writer = merged.repartition(MONTH, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH, "bucket", "version").parquet(f"{path}/data")
    number = F.lit(batch_id).cast("long").alias("batch")
    new = touched.select(MONTH, "bucket", F.lit(version).cast("long").alias("version"), number)
    if last is not None:
        new = new.union(last.join(F.broadcast(touched), [MONTH, "bucket"], "left_anti"))
    new.coalesce(1).write.mode("overwrite").parquet(f"{path}/_versions/{version}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes manifests but the newest ``keep`` and the parts that only they name; returns the number of parts."""
    versions = _manifests(spark, path)
    old, new = versions[:-keep], versions[-keep:]
    if not old:
        return 0
    def named(numbers: list[int]) -> set:
        return {(r[MONTH], r["bucket"], r["version"]) for n in numbers for r in _manifest(spark, path, n).collect()}

    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    unused = named(old) - named(new)
    for n in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{n}"), True)
    for month, bucket, version in unused:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/data/{MONTH}={month}/bucket={bucket}/version={version}"), True)
    return len(unused)


def upsert_stream(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of new and revised bars to a stored panel; replaying a batch changes nothing."""
    return (
        bars.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, path, batch_id=number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def event_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily bars per user from timed values; works on a stream and on a table alike.

    On a stream, a day is emitted once the watermark has passed its end.
    """
    order = F.struct("ts", "event_id")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").cast("string").alias("entity")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).alias("num_trades"),
    ).select("entity", F.col("w.start").cast("date").alias("date"), "open", "high", "low", "close", "num_trades")


def stream_table(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """A parquet folder as a stream, a few files per batch in order of arrival."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


HOLDING = (
    "weight double, last_ord long, entry double, peak double, armed boolean, closed_by_stop boolean, "
    "stop_day long, stop_signal long"
)
FIELDS = ("day", "ord", "signal", "weight", "open", "high", "low", "close", "prev_close")
WAITING = "at long, date date, day long, signal long, weight double, open double, high double, low double, close double, prev_close double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Stops(StatefulProcessor):
    """Days of a name wait, by number, until the watermark has passed them; then they go through the state machine in order."""

    def __init__(self, stops: Stops, costs: Costs, name: str) -> None:
        self.stops, self.costs, self.name = stops, costs, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HOLDING)
        self.waiting = handle.getMapState("waiting", "ord long", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for batch in rows:
            moments = batch["ts"].astype("datetime64[ms]").astype("int64").tolist()
            for at, row in zip(moments, batch.itertuples()):
                self.waiting.updateValue((int(row.ord),), (at, row.date, int(row.day), int(row.signal), *(float(getattr(row, f)) for f in FIELDS[3:])))
                timers.add(at)
        for at in timers:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted((int(number[0]), tuple(row)) for number, row in self.waiting.iterator() if row[0] <= passed)
        if not ready:
            return
        held = Holding(*self.held.get()) if self.held.exists() else Holding()
        out = []
        for number, (_, date, day, signal, *prices) in ready:
            self.waiting.removeKey((number,))
            for kind, path, weight, ret, entry, price in advance(held, Bar(day, number, signal, *prices), self.stops, self.costs):
                ret = None if ret is None or ret != ret else ret
                out.append((self.name, key[0], date, kind, path, weight, ret, None if ret is None else weight * ret, entry, price))
        self.held.update((held.weight, held.last_ord, held.entry, held.peak, held.armed, held.closed_by_stop, held.stop_day, held.stop_signal))
        if out:
            names = [f.split()[0] for f in EVENTS.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({n: "float64" for n in names[5:]})

    def close(self) -> None:
        pass


def live_stops(days: DataFrame, stops: Stops, costs: Costs = Costs(), name: str = "live", late: str = "40 days") -> DataFrame:
    """Return and trade events from a stream of days (see ``stop_days``), with the batch state machine.

    Days may arrive in any order, and repeatedly, within ``late`` of the newest day seen. A name's days wait in the state
    store until the watermark has passed them and are then walked in order, so at most the days of that span wait, and
    the events are those of the batch. A day that arrives after the watermark has passed it is left out and counted (see
    :func:`late_rows`). Days after the last watermark wait for the next run. Needs ``STATE_STORE`` as the session's state
    store provider.
    """
    timed = days.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("entity").transformWithStateInPandas(_Stops(stops, costs, name), EVENTS, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows of a finished query that came too late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
