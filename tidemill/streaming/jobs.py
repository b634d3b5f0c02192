"""Streaming forms of the presence and screening jobs."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemill.operators import screening
from tidemill.sources.store import shared_folder
from tidemill.sources.logs import append_once
from tidemill.sources.snapshots import Snapshots


def absent_partner_stream(starts: DataFrame, ons: DataFrame, key: str, before: int, after: int, lateness: int) -> DataFrame:
    """Starts (key, ts) without an ``on`` of the key from ``before`` to ``after`` seconds around, once the watermark has passed their range.

    Unlike the batch job, which decides at ``as_of``, the stream waits for the whole range, so nothing is told twice.
    """
    s = starts.select(F.col(key), F.col("ts")).withWatermark("ts", f"{lateness} seconds")
    o = ons.select(F.col(key).alias("okey"), F.col("ts").alias("ots")).withWatermark("ots", f"{lateness} seconds")
    near = F.expr(f"okey = {key} AND ots >= ts - INTERVAL {before} SECONDS AND ots <= ts + INTERVAL {after} SECONDS")
    return s.join(o, near, "leftOuter").where("okey is null").select(key, "ts")


class Presence(StatefulProcessor):
    """Starts of a stretch of time and a share of the keys, each told once the watermark has passed its range unless an on came near it.

    ``rows`` are the group's starts and ons (key, time in microseconds), added a batch at a time and gone through as arrays. A timer is
    due with the earliest start's range, and tells whatever is due by then; rows that come later than that are dropped before they get
    here, so what is told then holds. Ons are let go of with the last start, once the watermark has passed the stretch.
    """

    def __init__(self, before: int, after: int, key: T.DataType):
        self.before, self.after, self.width = before * 1_000_000, after * 1_000_000, _width(before, after)
        self.kind = T.StructType([T.StructField("key", key), T.StructField("at", T.LongType()), T.StructField("is_start", T.BooleanType())])

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.kind)

    def due(self, at: int) -> int:
        """Milliseconds, after every event of the start's range."""
        return (at + self.after) // 1000 + 1

    def over(self, key) -> int:
        """Milliseconds, after every start of the stretch."""
        return (int(key[1]) + 1) * self.width // 1000 + 1

    def told(self, keys: list, at: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "at": np.array(at, np.int64)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            self.handle.registerTimer(self.over(key))
        for f in rows:
            f = f.drop_duplicates(["key", "at", "is_start"])
            self.rows.appendList(list(zip(f["key"].tolist(), f["at"].tolist(), f["is_start"].tolist(), strict=True)))
            starts = f.loc[f["is_start"], "at"]
            if len(starts):
                self.handle.registerTimer(self.due(int(starts.min())))
        yield self.told([], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        f = pd.DataFrame(list(self.rows.get()), columns=self.kind.names).drop_duplicates(ignore_index=True)
        at, start = f["at"].to_numpy(np.int64), f["is_start"].to_numpy(bool)
        due = start & (self.due(at) <= now)
        # key and time as one number: a stretch's times lie within its width and the range on either side
        first = int(key[1]) * self.width - self.before - self.after
        place = pd.factorize(f["key"])[0].astype(np.int64) * (4 * self.width) + (at - first)
        ons = np.append(np.sort(place[~start]), np.iinfo(np.int64).max)
        alone = due.copy()
        alone[due] = ons[np.searchsorted(ons, place[due] - self.before)] > place[due] + self.after
        left = f[~due]
        open_ = at[start & ~due]
        if len(open_):
            self.handle.registerTimer(self.due(int(open_.min())))
        elif now >= self.over(key):
            left = left[:0]
        if not len(left):
            self.rows.clear()
        elif len(left) < len(f):
            self.rows.put(list(zip(left["key"].tolist(), left["at"].tolist(), left["is_start"].tolist(), strict=True)))
        yield self.told(f.loc[alone, "key"].tolist(), at[alone].tolist())


def _width(before: int, after: int) -> int:
    return max(1, (before + after) * 1_000_000)


def presence_stream(starts: DataFrame, ons: DataFrame, key: str, before: int, after: int, lateness: int, shares: int = 32) -> DataFrame:
    """The same rows as ``absent_partner_stream``, each told as soon as the watermark has passed its own range, by a timer.

    Time is cut into stretches as wide as the range, and an on goes to each stretch that it may serve, so that a busy key is many
    groups and no state outlives its stretch by more than the range. Keys are dealt to ``shares`` by their hash, a group for each
    share and stretch: calls to the state store grow with the time covered, not with keys or rows. To be started within ``timers``.
    """
    width = _width(before, after)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    s = starts.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), micros.alias("at"), F.lit(True).alias("is_start")).withColumn("slot", F.floor(F.col("at") / width))
    o = ons.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), micros.alias("at"), F.lit(False).alias("is_start"))
    o = o.withColumn("slot", F.explode(F.sequence(F.floor((F.col("at") - after * 1_000_000) / width), F.floor((F.col("at") + before * 1_000_000) / width))))
    both = s.unionByName(o).where("key is not null and ts is not null").withWatermark("ts", f"{lateness} seconds")
    kind = T.StructType([T.StructField("key", both.schema["key"].dataType), T.StructField("at", T.LongType())])
    groups = both.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int")).groupBy("share", "slot")
    told = groups.transformWithStateInPandas(Presence(before, after, both.schema["key"].dataType), kind, "Append", "EventTime")
    return told.select(F.col("key").alias(key), F.timestamp_micros("at").alias("ts"))


@contextlib.contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within have the state store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def first_start_stream(df: DataFrame, keys: list[str], lateness: int) -> DataFrame:
    """One row a key within the watermark's delay."""
    return df.withWatermark("ts", f"{lateness} seconds").dropDuplicatesWithinWatermark(keys)


def daily_states_stream(df: DataFrame, lateness: int = 3600) -> DataFrame:
    """starts, ons and offs (state) a UTC day."""
    w = F.window("ts", "1 day")
    out = df.withWatermark("ts", f"{lateness} seconds").groupBy(w).agg(*[F.count_if(F.col("state") == s).alias(f"{s}s") for s in ("start", "on", "off")])
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "starts", "ons", "offs")


def screen_stream(df: DataFrame, cmd_col: str) -> DataFrame:
    """Commands with what each rule set says of them: rule, compiler, deploy. Stateless, so any output mode will do."""
    out = screening.screen_vcs_commands(df, cmd_col).drop("reason")
    out = screening.screen_compiler_commands(out, cmd_col).withColumnRenamed("tool", "compiler").drop("denied")
    return screening.screen_deploys(out, cmd_col).withColumnRenamed("denied", "deploy")


def audit_stream(df: DataFrame, routes: list[str], entrypoints: list[str]) -> DataFrame:
    """Calls with their problems and decision, as they come. Stateless."""
    return screening.audit_calls(df, routes, entrypoints)


def append_once_sink(df: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Start a query that appends each batch's new keys; a batch that is run again adds nothing."""
    return df.writeStream.foreachBatch(lambda batch, _: append_once(batch, path, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_sink(df: DataFrame, path: str, keys: list[str], checkpoint: str):
    """The same into a versioned table: several queries may append to it at once, and readers see whole batches."""
    return df.writeStream.foreachBatch(lambda batch, _: Snapshots(batch.sparkSession, path).append_once(batch, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    if to.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(to).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read what it has written."""
    spark, base = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    w.outputMode(mode).foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{k}")).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
