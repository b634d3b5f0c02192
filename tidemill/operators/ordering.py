"""Newest rows, byte budgets, thread references, groups by marker, gaps, pages of a feed, search."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.sources.store import written


def keep_newest_rows(df: DataFrame, by: str, order: list[str], n: int = 2000) -> DataFrame:
    """The newest n rows of each log; Spark limits each task's groups before the shuffle."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def in_parts(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df``, written, with part@: numbers that rise along (by, order) and each stand for one task's range of rows.

    A key with very many rows falls into many parts; rows that are equal in key and order stay in one.
    """
    return written(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("part@", F.spark_partition_id()), "ranged")


def earlier(parts: DataFrame, by: list[str], backward: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """Adds, for each (kind, aggregate of a part), that of the key's earlier parts: their sum, max, or last that isn't null.

    ``backward``: of its later parts, seen from the end.
    """
    kinds = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, True)}
    w = W.partitionBy(*by).orderBy(F.desc("part@") if backward else F.asc("part@")).rowsBetween(W.unboundedPreceding, -1)  # as many rows as a key has parts
    each = parts.groupBy(*by, "part@").agg(*[v.alias(k) for k, (_, v) in values.items()])
    each = each.select(*[F.col(c).alias(f"{c}@") for c in by], F.col("part@").alias("p@"), *[kinds[kind](k).over(w).alias(k) for k, (kind, _) in values.items()])
    on = F.col("part@") == F.col("p@")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}@"))
    return parts.join(each, on).drop("p@", *[f"{c}@" for c in by])


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, interpolated, by ranks over ranges of values, so that no group is one task."""
    parts = earlier(in_parts(df.select(*by, value).where(F.col(value).isNotNull()), by, [F.col(value)]), by, before=("sum", F.count(F.lit(1))))
    rank = F.coalesce("before", F.lit(0)) + F.row_number().over(W.partitionBy(*by, "part@").orderBy(value)) - 1
    ranked = parts.select(*by, value, rank.alias("rank@"))
    n = parts.groupBy(*[F.col(c).alias(f"{c}@") for c in by]).agg(F.count(F.lit(1)).alias("n@"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}@"))
    both = ranked.join(n, on)
    out = []
    for name, p in shares.items():
        at = (F.col("n@") - 1) * p
        share = F.when(F.floor(at) == F.ceil(at), 1.0).when(F.col("rank@") == F.floor(at), F.ceil(at) - at).otherwise(at - F.floor(at))
        out.append(F.sum(F.when(F.col("rank@").isin(F.floor(at), F.ceil(at)), F.col(value) * share)).alias(name))
    return both.groupBy(*by).agg(*out)


def keep_newest_bytes(df: DataFrame, by: str, order: list[str], size: str, trigger: int, keep: int) -> DataFrame:
    """Of a log over ``trigger`` bytes the newest whole rows within ``keep`` bytes; of others all rows.

    Only order and size are sorted; they tell each log's oldest row that stays. Rows that are equal in ``order`` stay or go together.
    """
    total = df.groupBy(F.col(by).alias("log")).agg(F.sum(size).alias("total"))
    narrow = df.select(by, *order, F.col(size).alias("size@")).join(total.where(F.col("total") > trigger).select("log"), F.col(by).eqNullSafe(F.col("log"))).drop("log")
    newest = [F.desc(c) for c in order]
    parts = earlier(in_parts(narrow, [by], newest), [by], before=("sum", F.sum("size@")))
    run = F.coalesce("before", F.lit(0)) + F.sum("size@").over(W.partitionBy(by, "part@").orderBy(*newest))  # with all that are equal
    oldest = parts.withColumn("run", run).where(F.col("run") <= keep).groupBy(F.col(by).alias("log2")).agg(F.min(F.struct(*order)).alias("oldest"))
    logs = total.join(oldest, F.col("log").eqNullSafe(F.col("log2")), "left").drop("log2")
    both = df.join(logs, F.col(by).eqNullSafe(F.col("log")))
    return both.where((F.coalesce("total", F.lit(0)) <= trigger) | (F.struct(*order) >= F.col("oldest"))).select(*df.columns)


def thread_refs(df: DataFrame, thread: str, pos: str, id_: str, outer: str | None = None) -> DataFrame:
    """Adds root and parent: each post replies to the one before, the first to the outer target, if there is one."""
    heads = df.groupBy(F.col(thread).alias("thread@")).agg(F.min_by(F.struct(F.col(id_).alias("id"), (F.col(outer) if outer else F.lit(None).cast("string")).alias("outer")), pos).alias("head@"))
    parts = earlier(in_parts(df, [thread], [F.col(pos)]), [thread], **{"before@": ("last", F.max_by(id_, pos))})
    own = F.lag(id_).over(W.partitionBy(thread, "part@").orderBy(pos))
    parts = parts.withColumn("before@", F.coalesce(own, "before@")).join(heads, F.col(thread).eqNullSafe(F.col("thread@")))
    return parts.select(*df.columns, F.coalesce("head@.outer", "head@.id").alias("root"), F.coalesce("before@", "head@.outer").alias("parent"))


def split_on_marker(df: DataFrame, by: str, order: list[str], marker, drop=None) -> tuple[DataFrame, DataFrame]:
    """Rows with group_no, which a marker row raises (rows before any marker are group one), and the dropped rows."""
    kept = df if drop is None else df.where(~F.coalesce(drop, F.lit(False)))
    kept = kept.withColumn("hit@", F.coalesce(marker, F.lit(False)).cast("int"))
    heads = kept.groupBy(F.col(by).alias("by@")).agg(F.min_by("hit@", F.struct(*order)).alias("head@"))
    parts = earlier(in_parts(kept, [by], [F.col(c) for c in order]), [by], **{"before@": ("sum", F.sum("hit@"))})
    run = F.sum("hit@").over(W.partitionBy(by, "part@").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumn("run@", run).join(heads, F.col(by).eqNullSafe(F.col("by@")))
    out = parts.select(*df.columns, (F.coalesce("before@", F.lit(0)) + F.col("run@") + 1 - F.col("head@")).alias("group_no"))
    return out, df.limit(0) if drop is None else df.where(F.coalesce(drop, F.lit(False)))


def stride_gaps(df: DataFrame, by: str, offset: str, stride: int = 72) -> DataFrame:
    """Rows whose distance to the row before isn't the stride, with that distance as ``gap``."""
    parts = earlier(in_parts(df, [by], [F.col(offset)]), [by], **{"before@": ("max", F.max(offset))})
    before = F.coalesce(F.lag(offset).over(W.partitionBy(by, "part@").orderBy(offset)), "before@")
    return parts.withColumn("gap", F.col(offset) - before).where(F.col("gap") != stride).drop("before@", "part@")


def feed_page(posts: DataFrame, author: str, value, ts: str, id_: str, limit: int = 20, cursor: tuple | str | None = None, keep=None) -> DataFrame:
    """A page of an author's posts, newest first; ``cursor`` is that of the page before, or (ts, id) of its last row."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    out = posts.where(F.col(author) == value)
    if keep is not None:
        out = out.where(keep)
    if cursor:
        last, key = cursor_row(cursor) if isinstance(cursor, str) else cursor
        at, key = F.lit(last).cast(posts.schema[ts].dataType), F.lit(key).cast(posts.schema[id_].dataType)
        out = out.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(id_) < key)))
    return out.orderBy(F.desc(ts), F.desc(id_)).limit(limit)


def next_cursor(page: DataFrame, ts: str, id_: str, limit: int) -> DataFrame:
    """One row: the opaque ``cursor`` with which the page after goes on; null where this page has not its full number of rows."""
    last = F.min_by(F.to_json(F.struct(F.col(ts).cast("string").alias("at"), F.col(id_).cast("string").alias("id")), {"ignoreNullFields": "false"}), F.struct(ts, id_))
    return page.agg(F.when(F.count(F.lit(1)) >= limit, F.base64(F.encode(last, "UTF-8"))).alias("cursor"))


def cursor_row(cursor: str) -> tuple[str, str]:
    """The time and id that a cursor stands for, as text."""
    try:
        row = json.loads(base64.b64decode(cursor, validate=True))
        return row["at"], row["id"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor of a feed") from e


def search_posts(posts: DataFrame, query: str, text: str, order: list[str], limit: int = 20) -> DataFrame:
    """Posts that hold every word of the query, whatever the case; newest first."""
    hit = F.lit(True)
    for word in query.lower().split():
        hit = hit & F.contains(F.lower(F.col(text)), F.lit(word))
    return posts.where(hit).orderBy(*[F.desc(c) for c in order]).limit(limit)
