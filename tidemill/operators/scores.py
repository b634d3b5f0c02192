"""Scores and costs: unpivoting, fronts, nearest peers, tiers, best candidates, catalogue differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.columns import pct_of
from tidemill.operators.ordering import earlier, in_parts

CELL = r"^\s*(~?)\s*([0-9]+(?:\.[0-9]+)?)\s*@\s*(~?)\s*\$([0-9]+(?:\.[0-9]+)?)\s*$"


def unpivot_scores(df: DataFrame, id_col: str, level_cols: list[str]) -> DataFrame:
    """A row a cell ``[~]score @ [~]$cost``: level, score, cost, approx. A dash or any other text gives nulls."""
    long = df.unpivot(id_col, level_cols, "level", "cell")
    part = lambda i: F.regexp_extract(F.coalesce("cell", F.lit("")), CELL, i)
    return long.select(id_col, "level", part(2).try_cast("double").alias("score"), part(4).try_cast("decimal(10,2)").alias("cost"), ((part(1) == "~") | (part(3) == "~")).alias("approx"))


def pareto_front(df: DataFrame, group: list[str], score: str, cost: str) -> DataFrame:
    """Rows that no other of their group dominates (score at least, cost at most, one of them strictly); ties survive.

    The best score of each cost, and the running best over lower costs, take the place of a theta anti-join. Costs go by
    ranges, so that a large group is spread over tasks.
    """
    best = df.groupBy(*group, cost).agg(F.max(score).alias("best"))
    best = earlier(in_parts(best, group, [F.col(cost)]), group, **{"before@": ("max", F.max("best"))})
    lower = W.partitionBy(*group, "part@").orderBy(cost).rowsBetween(W.unboundedPreceding, -1)
    best = best.withColumn("below", F.greatest(F.max("best").over(lower), "before@"))
    front = best.where("below is null or best > below").select(*group, cost, "best")
    return df.join(front, [*group, cost]).where(F.col(score) == F.col("best")).drop("best").select(*df.columns)


def dominated_by(df: DataFrame, group: list[str], id_col: str, score: str, cost: str) -> DataFrame:
    """Each dominated row with one dominator of the front: the cheapest, then the one with the best score, then by id.

    Any dominator at no greater cost is itself on the front or dominated by a row there, so the front is enough. On the
    front the score rises with the cost, so that the cheapest that will do is the first at or after the row's score: both
    are sorted together, and the next of the front carried back.
    """
    front = pareto_front(df, group, score, cost).groupBy(*group, score, cost).agg(F.min(id_col).alias("dominator"), F.count(F.lit(1)).alias("same"))
    marks = front.select(*group, F.col(score).alias("at"), F.lit(1).alias("side"), F.struct(F.col(cost).alias("c"), F.col(score).alias("s"), F.col("dominator").alias("d")).alias("first"))
    rows = df.where(F.col(score).isNotNull() & F.col(cost).isNotNull()).select(*group, F.col(score).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(marks.schema["first"].dataType).alias("first"), id_col, cost)
    down = [F.desc("at"), F.desc("side")]
    both = earlier(in_parts(rows.unionByName(marks, allowMissingColumns=True), group, down), group, **{"before@": ("last", F.min_by("first", F.when(F.col("side") == 1, F.col("at"))))})
    ahead = W.partitionBy(*group, "part@").orderBy(*down).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("best", F.coalesce(F.last("first", True).over(ahead), "before@")).where("side = 0")
    ok = (F.col("best.c") <= F.col(cost)) & ((F.col("best.s") > F.col("at")) | (F.col("best.c") < F.col(cost)))
    return found.where(ok).select(*group, id_col, F.col("best.d").alias("dominator"))


def nearest_peer(df: DataFrame, other: DataFrame, id_col: str, score: str, cost: str, by: list[str] | None = None) -> DataFrame:
    """Each row with the row of ``other`` nearest by score: peer, gap, pct_cost (its cost as a percentage).

    Ties: smaller gap, then lower cost, then name. Each score of either side is sorted once, and the nearest peers below and above
    are carried along, so there is no cross join; the sort goes by ranges of scores, whose last and first peers are handed on, so that
    neither a large group nor all rows (without ``by``) are one task. Whole rows are joined with their score's peers at the end.
    """
    by = by or []
    best = other.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.min(F.struct(cost, id_col)).alias("p"))
    right = best.select(*by, F.col(score).alias("at"), F.lit(0).alias("side"), F.struct(F.col(score).alias("s"), F.col(f"p.{cost}").alias("c"), F.col(f"p.{id_col}").alias("n")).alias("peer"))
    left = df.where(F.col(score).isNotNull()).select(*by, F.col(score).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.schema["peer"].dataType).alias("peer")).distinct()
    both = in_parts(left.unionByName(right), by, [F.asc("at"), F.asc("side")])
    here = F.when(F.col("side") == 0, F.col("at"))
    both = earlier(earlier(both, by, **{"before@": ("last", F.max_by("peer", here))}), by, backward=True, **{"after@": ("last", F.min_by("peer", here))})
    for name, order, far in (("lo", F.asc, "before@"), ("hi", F.desc, "after@")):
        along = W.partitionBy(*by, "part@").orderBy(order("at"), "side").rowsBetween(W.unboundedPreceding, 0)
        both = both.withColumn(name, F.coalesce(F.last("peer", True).over(along), far))
    choice = lambda p: F.struct(F.abs(F.col(f"{p}.s") - F.col("at")).alias("gap"), F.col(f"{p}.c").alias("c"), F.col(f"{p}.n").alias("n"))
    pick = F.when(F.col("lo").isNull(), choice("hi")).when(F.col("hi").isNull(), choice("lo")).otherwise(F.least(choice("lo"), choice("hi")))
    peers = both.where("side = 1").select(*[F.col(c).alias(f"{c}@") for c in by], "at", pick.alias("best"))
    on = F.col(score) == F.col("at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}@"))
    return df.join(peers, on).select(*by, id_col, F.col("best.n").alias("peer"), F.col("best.gap").alias("gap"), pct_of("best.c", cost).alias("pct_cost"))


def assign_challenger(df: DataFrame, pairs: DataFrame, available: Column) -> DataFrame:
    """``df`` (proposer, level) with challenger and escalation from ``pairs``; the fallback columns where not available."""
    out = df.join(pairs, ["proposer", "level"], "left")
    pick = lambda c: F.when(available, F.col(c)).otherwise(F.col(f"fallback_{c}"))
    return out.select(*df.columns, pick("challenger").alias("challenger"), pick("escalation").alias("escalation"))


def price_requests(usage: DataFrame, tiers: list[tuple[float, float, float]], size: str, price: str) -> DataFrame:
    """Each request's cost: above a tier's threshold the whole request takes its multiplier. ``tiers`` (lo, hi, multiplier)."""
    rate = F.lit(None).cast("double")
    for lo, hi, times in tiers:
        rate = F.when((F.col(size) > lo) & (F.col(size) <= hi), F.lit(float(times))).otherwise(rate)
    return usage.withColumn("multiplier", rate).withColumn("cost", F.col(price) * F.col("multiplier"))


def lowest_passing(measures: DataFrame, by: list[str], setting: str, ok: Column) -> DataFrame:
    """The smallest setting that passes, and a status; every setting is measured, so none need be monotone."""
    return measures.groupBy(*by).agg(F.min(F.when(ok, F.col(setting))).alias("setting")).withColumn("status", F.when(F.col("setting").isNull(), "FAIL").otherwise("PASS"))


def best_candidate(df: DataFrame, by: list[str], candidate: str, order: str, weights: dict[str, float]) -> DataFrame:
    """The candidate with the least weighted sum; the first by ``order`` wins ties."""
    total = sum(F.col(c) * w for c, w in weights.items())
    return df.groupBy(*by).agg(F.min_by(F.struct(F.col(candidate).alias("candidate"), total.alias("total")), F.struct(total, F.col(order))).alias("b")).select(*by, "b.candidate", "b.total")


def size_mix(df: DataFrame, size: str, classes: list[tuple[str, float, float]]) -> DataFrame:
    """Counts a class of a size table (name, from, to exclusive); classes without rows are kept."""
    table = df.sparkSession.createDataFrame(classes, "class string, lo double, hi double")
    name = F.lit(None).cast("string")
    for c, lo, hi in classes:
        name = F.when((F.col(size) >= lo) & (F.col(size) < hi), c).otherwise(name)
    counts = df.groupBy(name.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return table.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


def catalog_diff(old: DataFrame, new: DataFrame, id_col: str, name: str) -> DataFrame:
    """NEW, GONE, RENAMED (same id, other name) or SAME for every id of either."""
    o, n = old.select(F.col(id_col).alias("oid"), F.col(name).alias("old_name")), new.select(F.col(id_col).alias("nid"), F.col(name).alias("new_name"))
    status = F.when(F.col("oid").isNull(), "NEW").when(F.col("nid").isNull(), "GONE").when(F.col("old_name").eqNullSafe(F.col("new_name")), "SAME").otherwise("RENAMED")
    return o.join(n, F.col("oid") == F.col("nid"), "full_outer").select(F.coalesce("oid", "nid").alias(id_col), "old_name", "new_name", status.alias("status"))


def set_mismatch(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows that stand in one of two multisets more often than in the other, with the side that has them."""
    x, y = a.select(*key), b.select(*key)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))
