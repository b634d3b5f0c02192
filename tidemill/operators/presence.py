"""Missing events: starts without a partner nearby, daily reports, transitions, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.ordering import earlier, in_parts


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def absent_partner(starts: DataFrame, ons: DataFrame, key: str, before: int, after: int, grace: int, as_of: str, marked: DataFrame | None = None, wildcard: str | None = None) -> DataFrame:
    """Distinct (key, ts) of ``starts`` without an ``on`` of the same key from ``before`` to ``after`` seconds around.

    Starts must be strictly older than ``grace`` seconds at ``as_of``. An ``on`` whose key is ``wildcard`` counts for
    every key. ``marked`` (key, ts) are starts already reported. Bounds are inclusive; rows with a null key or time are
    ignored. Time is cut into buckets as wide as the range, so that the anti-join has an equality on key and bucket and
    one busy key spreads over many tasks.
    """
    width = max(1, (before + after) * 1_000_000)
    s = starts.select(key, "ts").where(F.col(key).isNotNull() & F.col("ts").isNotNull()).distinct()
    s = s.withColumn("at", micros("ts")).where(micros(F.lit(as_of)) - F.col("at") > grace * 1_000_000).withColumn("slot", F.floor(F.col("at") / width))
    if marked is not None:
        s = s.join(marked.select(key, "ts"), [key, "ts"], "left_anti")
    o = ons.select(F.col(key).alias("okey"), micros("ts").alias("oat")).where("okey is not null and oat is not null").distinct()
    o = o.withColumn("oslot", F.explode(F.sequence(F.floor((F.col("oat") - after * 1_000_000) / width), F.floor((F.col("oat") + before * 1_000_000) / width))))
    near = (F.col("slot") == F.col("oslot")) & F.col("oat").between(F.col("at") - before * 1_000_000, F.col("at") + after * 1_000_000)
    if wildcard is not None:
        anyone = o.where(F.col("okey") == wildcard)
        s = s.join(anyone, near, "left_anti")
        o = o.where(F.col("okey") != wildcard)
    return s.join(o, (F.col(key) == F.col("okey")) & near, "left_anti").select(key, "ts")


def evidence_union(explicit: DataFrame, inferred: DataFrame, keys: list[str]) -> DataFrame:
    """Both sets of events by their keys, each once."""
    return explicit.select(*keys).unionByName(inferred.select(*keys)).dropDuplicates(keys)


def daily_state_report(starts: DataFrame, ons: DataFrame, offs: DataFrame) -> DataFrame:
    """starts, ons and offs a day (a string), and a row 'total'. An off (key, ts of its start) counts on its start's day."""
    parts = [d.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(k).alias("kind")) for d, k in ((starts, "starts"), (ons, "ons"), (offs, "offs"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("day is not null")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("starts", "ons", "offs")]
    out = rows.rollup("day").agg(*counts, F.grouping("day").alias("g"))
    return out.select(F.when(F.col("g") == 1, "total").otherwise(F.col("day")).alias("day"), "starts", "ons", "offs")


def last_transition(events: DataFrame) -> DataFrame:
    """state, from_state, at: the latest state and the last change into it, of (ts, seq, state); ``seq`` breaks ties.

    Three aggregates and no sort: the latest key, the last key of another state, the first key after that.
    """
    key = F.struct("ts", "seq")
    latest = events.agg(F.max_by("state", key).alias("state"))
    other = events.crossJoin(F.broadcast(latest)).where(events["state"] != latest["state"]).agg(F.max(key).alias("k"), F.max_by(events["state"], key).alias("from_state"))
    both = latest.crossJoin(other)
    after = events.select("ts", "seq").crossJoin(F.broadcast(other)).where(F.col("k").isNotNull() & (F.struct("ts", "seq") > F.col("k"))).agg(F.min("ts").alias("at"))
    return both.crossJoin(after).select("state", "from_state", "at")


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; partial aggregates, no window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def first_start_per_process(starts: DataFrame, procs: DataFrame, slack: int = 5) -> DataFrame:
    """``starts`` (pid, ts, id) that are the first of their process; ``procs`` (pid, launch).

    A start belongs to the latest launch that is at most ``slack`` seconds after it; one without such a launch is kept.
    """
    s = starts.where("pid is not null").select("pid", micros("ts").alias("at"), F.lit(1).alias("is_start"), F.struct("ts", "id").alias("row"), F.lit(None).cast("long").alias("launch"))
    p = procs.where("pid is not null").select("pid", (micros("launch") - slack * 1_000_000).alias("at"), F.lit(0).alias("is_start"), F.lit(None).cast(s.schema["row"].dataType).alias("row"), micros("launch").alias("launch"))
    both = earlier(in_parts(s.unionByName(p), ["pid"], [F.col("at"), F.col("is_start")]), ["pid"], **{"before@": ("max", F.max("launch"))})
    along = W.partitionBy("pid", "part@").orderBy("at", "is_start")
    asof = both.withColumn("launch", F.coalesce(F.last("launch", ignorenulls=True).over(along), "before@")).where("is_start = 1")
    first = asof.where("launch is not null").groupBy("pid", "launch").agg(F.min("row").alias("row"))
    keep = first.select("pid", "row").unionByName(asof.where("launch is null").select("pid", "row"))
    unknown = starts.where("pid is null").select("pid", "ts", "id")
    return keep.select("pid", F.col("row.ts").alias("ts"), F.col("row.id").alias("id")).unionByName(unknown)
