"""Percentiles by mergeable sketches: a small summary a group and day, added up over any range of days.

The sketches are KLL: with ``k`` of 400 a quantile's rank is off by at most about 0.7 % of the rows (two-sided, with 99 %
confidence), whatever their number, and a sketch takes a few kB. Sketching is a partial aggregate: no row is sorted or sent on.
``ordering.percentiles`` is the exact form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, RANK_ERROR = 400, 0.01


def daily_sketches(df: DataFrame, by: list[str], ts: str, value: str, k: int = K) -> DataFrame:
    """by, day, n, sketch: the values of each group and day; nulls and NaN are none."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & F.col(ts).isNotNull())
    return rows.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def over_days(sketches: DataFrame, by: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """by, n, sketch: the days from ``first`` to ``last`` (both included; None: all before, or after) as one."""
    rows = sketches
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' rows with a quantile for each name in ``shares``, in place of the sketch."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()])


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], k: int = K) -> DataFrame:
    """``ordering.percentiles`` by sketches: a value whose rank is within the error, not interpolated."""
    v = F.col(value).cast("double")
    groups = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))
    return quantiles(groups, shares)
