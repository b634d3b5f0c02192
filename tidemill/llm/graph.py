"""Classes, links and components of rows, from links between classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.store import materialise
from tidemill.operators.graphs import components, most_rows, spread


def memberships(rows: DataFrame, classes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``rows`` (with the id column ``name`` and a class key fp) with class_id, n_links, component_id and kept.

    ``classes`` has a row for each fp: its smallest id and its number n of rows. ``links`` has, any number of times, an
    fp, how many rows of other classes it is linked with there, and one class of its local group (anchor). A row whose
    fp is null or stands in no class is alone.
    """
    total = links.groupBy("fp").agg(F.sum("links").alias("links"))
    group = components(links.select(F.col("fp").alias("a"), F.col("anchor").alias("b")))
    rooted = materialise(classes.join(group.withColumnRenamed("node", "fp"), "fp").select("fp", "root", name), "rooted")
    least = rooted.groupBy("root").agg(F.min(name).alias("component_id"), F.count(F.lit(1)).alias("n@"))
    joined = spread(rooted.select("fp", "root"), least, "root", most_rows(rooted.count())).select("fp", "component_id")
    info = classes.join(total, "fp", "left").join(joined, "fp", "left").where("n > 1 or links is not null")
    info = info.select("fp", F.col(name).alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", name).alias("component_id"), F.lit(True).alias("linked"), F.col("n").alias("n@"))
    # copies of one text may be a large share of all rows
    out = spread(rows, materialise(info, "info"), "fp", most_rows(rows.count()), "left")
    mine = lambda c: F.when(F.col("linked"), F.col(c)).otherwise(F.col(name))
    out = out.withColumns({"class_id": mine("class_id"), "n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": mine("component_id")})
    return out.withColumn("kept", F.col(name).eqNullSafe(F.col("component_id"))).drop("linked")


def local_groups(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point that the given pairs join it with."""
    root = np.arange(n)
    while len(left):
        was = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        root = root[root]
        if (was == root).all():
            break
    return root


class Groups:
    """Local groups of n points from pairs that come bit by bit; pairs are let go of once there are many."""

    def __init__(self, n: int, most: int = 1 << 20):
        self.n, self.most, self.held, self.pairs = n, most, 0, []

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.pairs.append((left, right))
        self.held += len(left)
        if self.held > self.most:
            root = self.roots()
            at = np.flatnonzero(root != np.arange(self.n))
            self.pairs, self.held = [(at, root[at])], 0

    def roots(self) -> np.ndarray:
        left, right = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in self.pairs]]) for k in (0, 1))
        return local_groups(self.n, left, right)
