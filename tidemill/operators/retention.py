"""Retention plans over file inventories, and sweeps of empty directories. Nothing is deleted: results are plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import UUID


def keep_strict_uuid(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).rlike(UUID))


def retention_plan(inventory: DataFrame, sessions: DataFrame, policy: DataFrame, as_of: Column) -> DataFrame:
    """Adds action to (category, session_id, mtime, …): DELETE, PROTECTED or KEEP.

    ``policy`` has category, days, protects. A file is due when older than ``days`` times 24 hours. A session whose
    record isn't archived (null counts as not archived) protects its files where the category says so. Files of a
    category without policy, or without time, are kept.
    """
    live = sessions.where(~F.col("is_archived").eqNullSafe(True)).select(F.col("session_id").cast("string").alias("key@")).distinct().withColumn("live@", F.lit(True))
    # one rule a category, whatever the policy repeats: the shortest term, and protection if any rule gives it
    rules = policy.groupBy("category").agg(F.min("days").alias("days"), F.max("protects").alias("protects"))
    # files without a session are no session's: they go to all tasks, under keys that none has
    spare = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in inventory.dtypes if "map<" not in kind and kind != "variant"]), F.lit(1 << 16)).cast("string"))
    out = inventory.withColumn("key@", F.coalesce(F.col("session_id").cast("string"), spare)).join(rules, "category", "left").join(live, "key@", "left")
    due = F.coalesce(F.unix_seconds(as_of) - F.unix_seconds(F.col("mtime").cast("timestamp")) > F.col("days") * 86400, F.lit(False))
    safe = F.coalesce("protects", F.lit(False)) & F.coalesce("live@", F.lit(False))
    return out.withColumn("action", F.when(due & safe, "PROTECTED").when(due, "DELETE").otherwise("KEEP")).select(*inventory.columns, "action")


def retention_summary(plan: DataFrame, policy: DataFrame) -> DataFrame:
    """Planned and protected counts for every category of the policy, zeros included."""
    n = plan.groupBy("category").agg(F.count_if(F.col("action") == "DELETE").alias("planned"), F.count_if(F.col("action") == "PROTECTED").alias("protected"))
    return policy.select("category").distinct().join(n, "category", "left").select("category", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("protected", F.lit(0)).alias("protected"))


def stale_empty_keys(inventory: DataFrame, keep: DataFrame, as_of: Column, min_age: int = 60) -> DataFrame:
    """Empty directories (name, kind, is_empty, mtime) named by a strict UUID, not kept, older than ``min_age`` minutes.

    Without anything to keep the result is empty: a missing list must not delete everything.
    """
    kept = keep.where("name is not null").select(F.lower("name").alias("kept")).distinct()
    some = kept.agg((F.count(F.lit(1)) > 0).alias("some"))
    old = F.unix_seconds(as_of) - F.unix_seconds(F.col("mtime").cast("timestamp")) > min_age * 60
    dirs = keep_strict_uuid(inventory.where((F.col("kind") == "dir") & F.col("is_empty") & old), "name")
    return dirs.join(kept, F.lower("name") == F.col("kept"), "left_anti").crossJoin(F.broadcast(some)).where("some").drop("some")


def empty_prefixes(dirs: DataFrame, surviving: DataFrame) -> DataFrame:
    """Directories (path) under which no surviving file (path) lies, at any depth."""
    parts = F.split("path", "/")
    above = surviving.where("path is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return dirs.join(above, "path", "left_anti")
