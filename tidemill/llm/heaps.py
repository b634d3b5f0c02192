"""Centroid clustering with heap-ordered bounds.

Vectors of whole numbers are packed into blocks, and the blocks are stored by block number in buckets. Beside them stands,
in buckets of the same kind, each round's state: for every cluster of a block a heap of its vectors by their gap, the
distance to the second centroid less that to the own, plus the drift that the cluster had gathered when the gap was
measured. A round adds to a cluster's drift how far its centroid moved and how far any other did at most, so a gap is
used up no sooner than its key is below the drift: only such vectors are popped, and compared exactly (in whole numbers)
with all centroids. Blocks and state meet bucket by bucket without a shuffle, and only states are written again.

A round hands on what moved: sums and numbers of the vectors that changed their cluster, added up by Spark; the driver
keeps the centroids' exact sums. A round in which no centroid moves is the last that has work to do.

Defined results: vectors without exactly ``DIM`` components, or with null or non-finite ones, are left out; components
beyond 2**17 count as that, so that distances fit a long; with fewer vectors than ``K`` there are as many centroids as
vectors; ids of one hash (repeated ids) are ordered by their vectors; a null id is hashed as an empty one; an inertia beyond a
long is the largest long; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.store import materialise, table
from tidemill.sources.store import shared_folder

K, ROUNDS, DIM, SCALE, WIDEST, SEED = 8, 10, 64, 1024, float(1 << 17), 3
BLOCK, BUCKET = 2048, 65_536
MOST_LONG = (1 << 63) - 1
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_numbers(df: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and x (array of int) of the vectors that are kept."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    number = lambda c: F.floor(F.least(F.greatest(c, F.lit(-WIDEST)), F.lit(WIDEST)) * SCALE).cast("int")
    return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, number).alias("x"))


def seeds(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["x"] for r in rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()], np.int64)


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of at most ``size`` vectors; the number holds the task's, so no two are the same."""
        base, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for s in range(0, b.num_rows, size):
                part = b.slice(s, size)
                x = part["x"].flatten().to_numpy().astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["vec_id"])
                yield pa.RecordBatch.from_arrays([pa.array([base + made]), ids, pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])
                made += 1

    return pack


class Buckets:
    """Tables stored in the shared folder by block, in as many buckets each, so that they join without a shuffle."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(f"tidemill_{name}_{uuid.uuid4().hex}")
        path = f"{shared_folder(self.spark)}/{self.names[-1]}"
        df.write.bucketBy(self.n, "block").sortBy("block").option("path", path).format("parquet").saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def forget(self) -> None:
        """The catalogue's entries go; the files lie in the shared folder as all intermediate tables do."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


class Round(NamedTuple):
    centroids: np.ndarray
    drift: np.ndarray  # of each cluster, since the first round


class Heaps:
    """The heaps of a block, one a cluster, of (gap and drift so far, number of the vector in the block)."""

    def __init__(self, k: int, raw: bytes | None = None):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        if raw:
            sizes = np.frombuffer(raw, "<i4", k)
            n = int(sizes.sum())
            keys, at = np.frombuffer(raw, "<f8", n, 4 * k).tolist(), np.frombuffer(raw, "<i4", n, 4 * k + 8 * n).tolist()
            cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            self.heaps = [list(zip(keys[a:b], at[a:b], strict=True)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pops the vectors whose gaps are used up: their numbers, and the clusters they were in."""
        at, was = [], []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                at.append(heapq.heappop(heap)[1])
                was.append(c)
        return np.array(at, int), np.array(was, int)

    def push(self, at: np.ndarray, cluster: np.ndarray, key: np.ndarray) -> None:
        for i, c, g in zip(at.tolist(), cluster.tolist(), key.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (g, i))

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for c, heap in enumerate(self.heaps):
            out[[i for _, i in heap]] = c
        return out

    def raw(self) -> bytes:
        both = [p for heap in self.heaps for p in heap]
        return np.array([len(h) for h in self.heaps], "<i4").tobytes() + np.array([g for g, _ in both], "<f8").tobytes() + np.array([i for _, i in both], "<i4").tobytes()


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances to all centroids, exactly."""
    x = x.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def rescan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids (ties: the smaller number) and gaps to the second, less what rounding may add."""
    d = squares(x, centroids)
    best = d.argmin(1)
    if d.shape[1] == 1:
        return best, np.full(len(d), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(float))
    return best, (two[:, 1] - two[:, 0]) - 1e-12 * (two.sum(1) + 1)


STATE = "block long, state binary, moved array<struct<cluster:int,n:long,sums:array<long>>>, popped long"


def _round(shared, dim: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Round = shared.value
        k = len(now.centroids)
        for b in batches:
            states, moves, popped = [], [], []
            for raw, state in zip(b["x"], b["state"], strict=True):
                x = np.frombuffer(raw.as_py(), "<i4").reshape(-1, dim)
                heaps = Heaps(k, state.as_py())
                at, was = (np.arange(len(x)), np.full(len(x), -1)) if state.as_py() is None else heaps.expired(now.drift)
                best, gap = rescan(x[at], now.centroids) if len(at) else (at, np.zeros(0))
                heaps.push(at, best, gap + now.drift[best])
                out, far = [], at[best != was]
                went, came = was[best != was], best[best != was]
                for c in np.unique(np.concatenate([went[went >= 0], came])).tolist():
                    plus, minus = x[far[came == c]].astype(np.int64), x[far[went == c]].astype(np.int64)
                    out.append({"cluster": c, "n": len(plus) - len(minus), "sums": (plus.sum(0) - minus.sum(0)).tolist()})
                states.append(heaps.raw())
                moves.append(out)
                popped.append(len(at))
            kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([b["block"], pa.array(states, pa.binary()), pa.array(moves, kind), pa.array(popped, pa.int64())], ["block", "state", "moved", "popped"])

    return assign


def _emit(shared, dim: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value.centroids
        for b in batches:
            for raw, state, ids in zip(b["x"], b["state"], b["ids"], strict=True):
                x = np.frombuffer(raw.as_py(), "<i4").reshape(-1, dim)
                cluster = Heaps(len(centroids), state.as_py()).clusters(len(x))
                far = ((x.astype(np.int64) - centroids[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return emit


class Sums:
    """Exact sums and numbers of the clusters' vectors, and the centroids that follow from them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.n = centroids, [0] * len(centroids)
        self.sums = [[0] * centroids.shape[1] for _ in centroids]

    def add(self, state: DataFrame) -> None:
        moved = state.select(F.explode("moved").alias("m")).select("m.cluster", "m.n", F.posexplode("m.sums").alias("at", "s"))
        total = moved.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        for r in total.collect():  # as many rows as the centroids have components
            self.sums[r["cluster"]][r["at"]] += int(r["s"])
            if r["at"] == 0:
                self.n[r["cluster"]] += r["n"]

    def next(self) -> np.ndarray:
        return np.array([[s // n for s in sums] if n else c for sums, n, c in zip(self.sums, self.n, self.centroids.tolist(), strict=True)], np.int64)


def drifted(drift: np.ndarray, was: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Drift of the clusters after centroids moved: how far the own one moved, and any other at most."""
    far = np.sqrt(((now - was) ** 2).sum(1).astype(float)) * (1 + 1e-12)
    others = np.array([np.delete(far, c).max(initial=0.0) for c in range(len(far))])
    return drift + far + others


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, block: int = BLOCK, log: list | None = None) -> DataFrame:
    """One row for each kept vector of ``df`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``log`` gets the number of vectors that each round compared.
    """
    spark = df.sparkSession
    rows = whole_numbers(df, dim)
    centroids = seeds(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    n = min(100_000, max(spark.sparkContext.defaultParallelism, rows.count() // BUCKET))
    buckets = Buckets(spark, n)
    try:
        vectors = buckets.store(rows.mapInArrow(_pack(block), "block long, ids array<long>, x binary").repartition(n, "block"), "vectors")
        sums, drift, state = Sums(centroids), np.zeros(len(centroids)), None
        for r in range(rounds + 1):
            shared = spark.sparkContext.broadcast(Round(sums.centroids, drift))
            both = vectors.select("block", "x")
            both = both.withColumn("state", F.lit(None).cast("binary")) if state is None else both.join(state.select("block", "state").hint("shuffle_hash"), "block")
            state = buckets.store(both.select("block", "x", "state").mapInArrow(_round(shared, dim), STATE), "state")
            if log is not None:
                log.append(state.agg(F.sum("popped")).first()[0])
            if r == rounds:
                break
            sums.add(state)
            now = sums.next()
            if (now == sums.centroids).all():
                break  # later rounds would find the same
            drift, sums.centroids = drifted(drift, sums.centroids, now), now
        shared = spark.sparkContext.broadcast(Round(sums.centroids, drift))
        both = vectors.join(state.select("block", "state").hint("shuffle_hash"), "block").select("x", "state", "ids")
        out = materialise(both.mapInArrow(_emit(shared, dim), "vec_id long, cluster int, distance long"), "clusters")
    finally:
        buckets.forget()
    within = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    total = min(sum(within.values()), MOST_LONG)
    known = spark.createDataFrame([(c, min(s, MOST_LONG), total, digest(sums.centroids[c])) for c, s in within.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def op12_heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out one after the other."""
    near = "SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY 1, 2"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, x AS m FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {K}))",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"s{r} AS MATERIALIZED (SELECT c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, {DIM + 1}) g(i) GROUP BY c, i)")
        parts.append(f"f{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(f{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN f{r} USING (c))")
    parts.append(f"a AS MATERIALIZED ({near.format(r=ROUNDS)})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, a.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} USING (c)"
    )


OP12_SQL = _sql()
