"""Near vectors: exact pairs by a dual traversal of cover trees.

Equal vectors form a class, and only classes are compared, by unit vectors: a cosine threshold is a distance.
The tree's first level has up to ``MOST`` centres, taken farthest first from a bounded sample; every vector goes to its
nearest centre, and a centre's covering radius is the largest distance there. A centre's vectors are dealt to blocks of
at most about ``BLOCK``, and each block's nested levels below it are built once and stored: a node's members go to as
many centres as it takes to cover them at half its radius. A node keeps the radius that it has in fact (often much
less than the level's, 0 for a vector alone), so bounds are as tight as they can be.

Two blocks meet only if their centres' distance is at most the two radii and the threshold's distance, and if the same
holds for some pair of their upper nodes, which are stored by themselves. Inside, pairs of nodes are followed down from
both trees: a pair is dropped if its distance less both radii is over the threshold's, and linked as a whole if its
distance and both radii are not over it. For nodes of one vector the distance over the ``SKETCH`` leading rotated
coordinates, in single precision with slack, is a lower bound that costs little and loses nothing. What is left is
compared in double precision. Pairs never become rows: a piece of work gives each class its number of links and one
class of its local group.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, links with nothing;
vectors of other lengths don't link; a repeated vec_id is one vector for each row; a row without vec_id is compared but
names no component while there is one with an id; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.graph import Groups, memberships
from tidemill.llm.store import materialise, table

MOST, SAMPLE, BLOCK, LEAST, LEAF, TOP, SKETCH, SLACK, ROUND = 256, 4096, 32_768, 2048, 16, 64, 16, 1e-9, 2e-5


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [None if v is None else np.array(v, "<f8").tobytes() for v in b["v"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([0 if r is None else len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dim", "vec"])


def packed(df: DataFrame) -> DataFrame:
    """vec_id, dim, vec (doubles as bytes, or null) and fp, the class key of vectors that can link."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, v).alias("v"))
    return rows.mapInArrow(_pack, "vec_id long, dim int, vec binary").withColumn("fp", F.when(F.col("vec").isNotNull(), F.unhex(F.md5("vec"))))


def centres(x: np.ndarray, most: int) -> np.ndarray:
    """Points chosen farthest first, until all are chosen or covered."""
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(most, len(x)) and far.max() > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def axes(x: np.ndarray) -> np.ndarray:
    """Orthonormal directions in which a sample spreads most."""
    return np.ascontiguousarray(np.linalg.svd(x, full_matrices=False)[2][:SKETCH].T)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def cover(x: np.ndarray, radius: float, step: int = 256) -> tuple[list[int], np.ndarray]:
    """Rows of x that cover all others within the radius, and for each row which of them does."""
    chosen, near = [], np.zeros(len(x), np.int32)
    for s in range(0, len(x), step):
        part, left = x[s : s + step], np.arange(s, min(s + step, len(x)))
        if chosen:
            dot = part @ x[chosen].T
            best = dot.argmax(1)
            fits = 2 - 2 * dot[np.arange(len(part)), best] <= radius * radius
            near[left[fits]] = best[fits]
            left = left[~fits]
        if len(left):
            square = 2 - 2 * (x[left] @ x[left].T)
            open_ = np.ones(len(left), dtype=bool)
            for i in range(len(left)):
                if open_[i]:
                    fits = open_ & (square[i] <= radius * radius)
                    fits[i] = True
                    near[left[fits]] = len(chosen)
                    chosen.append(int(left[i]))
                    open_ &= ~fits
    return chosen, near


class Tree:
    """Nested levels over unit vectors, in the order ``order``: node k covers x[lo:hi] within its radius of row ``centre``."""

    def __init__(self, x: np.ndarray, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.x, self.order, self.radius = x, order, radius
        self.lo, self.hi, self.centre, self.first, self.last = nodes.T  # first:last are the node's children
        self.nodes = nodes

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        order, nodes, radius = np.arange(len(x)), [], []

        def node(lo: int, hi: int, centre: int) -> None:
            nodes.append([lo, hi, centre, 0, 0])
            # the true distance, without the cancellation of 2 - 2 x.y, so that the radius covers what it should
            radius.append(float(np.linalg.norm(x[order[lo:hi]] - x[centre], axis=1).max()) if hi - lo > 1 else 0.0)

        node(0, len(x), 0)
        at = 0
        while at < len(nodes):
            lo, hi = nodes[at][:2]
            half = radius[at] / 2
            if hi - lo > LEAF and half > 1e-6:
                own = order[lo:hi].copy()
                chosen, near = cover(x[own], half)
                rank = np.argsort(near, kind="stable")
                order[lo:hi] = own[rank]
                cuts = lo + np.searchsorted(near[rank], np.arange(len(chosen) + 1))
                nodes[at][3] = len(nodes)
                for a, b, c in zip(cuts[:-1].tolist(), cuts[1:].tolist(), own[chosen].tolist(), strict=True):
                    node(a, b, c)
                nodes[at][4] = len(nodes)
            at += 1
        nodes = np.array(nodes, np.int32)
        nodes[:, 2] = np.argsort(order)[nodes[:, 2]]
        return cls(x[order], order, nodes, np.array(radius))

    def top(self) -> np.ndarray:
        """The upper nodes: those below the root, or the root where there are too many."""
        below = np.arange(self.first[0], self.last[0])
        return below if 0 < len(below) <= TOP else np.zeros(1, int)

    def sketch(self, turn: np.ndarray) -> None:
        """Single-precision rows whose products are squared distances: over the rotated coordinates, and over all."""
        self.part, self.whole = _squares(self.x @ turn), _squares(self.x)


def _squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm, one = (x * x).sum(1, keepdims=True), np.ones((len(x), 1))
    return np.hstack([-2 * x, norm, one]).astype(np.float32), np.hstack([x, one, norm]).astype(np.float32)


def _near_nodes(a: Tree, b: Tree, p: np.ndarray, q: np.ndarray, reach: float, single: bool, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the nodes p and q that their bound doesn't part; single: all are of one vector."""
    one, two = (a.part, b.part) if single else (a.whole, b.whole)
    two = two[1][b.centre[q]].T
    for s in range(0, len(p), step):
        some = p[s : s + step]
        square = one[0][a.centre[some]] @ two
        limit = np.float32(reach * reach + ROUND) if single else ((a.radius[some][:, None] + b.radius[q][None, :] + reach) ** 2 + ROUND).astype(np.float32)
        i, j = np.divmod(np.flatnonzero(square <= limit), len(q))
        yield some[i], q[j]


def dual(a: Tree, b: Tree, threshold: float, linked: Callable[[slice | np.ndarray, slice | np.ndarray, np.ndarray | None], None]) -> tuple[int, int]:
    """Calls linked(rows of a, rows of b, which pairs: None for all of two slices) for all pairs that reach the threshold.

    If a is b, each pair comes once, and a row with itself may come too. Returns how many pairs of nodes were compared,
    and how many of them had to be followed.
    """
    reach, same, compared, followed = float(np.sqrt(2 - 2 * threshold)), a is b, 0, 0
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        (alo, ahi), (blo, bhi) = (a.lo[p], a.hi[p]), (b.lo[q], b.hi[q])
        self_pair = same and p == q
        if (ahi - alo) * (bhi - blo) <= LEAF * LEAF * 16 or (a.first[p] == a.last[p] and b.first[q] == b.last[q]):
            for s in range(alo, ahi, 1024):
                hit = a.x[s : min(s + 1024, ahi)] @ b.x[blo:bhi].T >= threshold
                if hit.any():
                    i, j = np.nonzero(hit)
                    i, j = i + s, j + blo
                    linked(i[i < j] if self_pair else i, j[i < j] if self_pair else j, np.ones(0))
            continue
        if not self_pair:
            gap, both = float(np.linalg.norm(a.x[a.centre[p]] - b.x[b.centre[q]])), a.radius[p] + b.radius[q]
            if gap > both + reach + SLACK:
                continue
            if gap + both <= reach - SLACK:
                linked(slice(alo, ahi), slice(blo, bhi), None)
                continue
        elif 2 * a.radius[p] <= reach - SLACK:
            linked(slice(alo, ahi), slice(blo, bhi), None)
            continue
        ps = np.arange(a.first[p], a.last[p]) if a.first[p] < a.last[p] else np.array([p])
        qs = np.arange(b.first[q], b.last[q]) if b.first[q] < b.last[q] else np.array([q])
        compared += len(ps) * len(qs)
        for single_p in (True, False):
            for single_q in (True, False):
                mine, other = ps[(a.hi[ps] - a.lo[ps] == 1) == single_p], qs[(b.hi[qs] - b.lo[qs] == 1) == single_q]
                for i, j in _near_nodes(a, b, mine, other, reach, single_p and single_q) if len(mine) and len(other) else ():
                    if self_pair:  # the mirrored pair comes too
                        i, j = i[i <= j], j[i <= j]
                    followed += len(i)
                    if single_p and single_q:
                        x, y = a.lo[i], b.lo[j]
                        for s in range(0, len(x), 65_536):
                            u, v = x[s : s + 65_536], y[s : s + 65_536]
                            ok = np.einsum("ij,ij->i", a.x[u], b.x[v]) >= threshold
                            if same:
                                ok &= u != v
                            linked(u[ok], v[ok], np.ones(0))
                    else:
                        stack += zip(i.tolist(), j.tolist(), strict=True)
    return compared, followed


class Links:
    """Links and local groups of a piece's classes, added up as pairs come; ``n`` is the number of rows of each class."""

    def __init__(self, n: np.ndarray, shift: int):
        self.n, self.shift = n, shift  # rows of the second tree follow those of the first
        self.links, self.groups = np.zeros(len(n), np.int64), Groups(len(n))

    def __call__(self, i, j, which) -> None:
        n, k = self.n, self.shift
        if which is None:
            i, j = np.arange(i.start, i.stop), np.arange(j.start, j.stop) + k
            own = k == 0 and i[0] == j[0]
            self.links[i] += n[j].sum() - (n[i] if own else 0)
            if not own:
                self.links[j] += n[i].sum()
            self.groups.add(np.concatenate([i, j]), np.full(len(i) + len(j), min(i[0], j[0])))
        elif len(i):
            j = j + k
            self.links += (np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n))).astype(np.int64)
            self.groups.add(i, j)


def _assigner(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw = b["dim"].to_numpy(), b["vec"].to_pylist()
            node, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, (first, c, _) = unit([raw[i] for i in at], int(d)), shared.value[int(d)]
                for s in range(0, len(at), 4096):
                    near = distances(x[s : s + 4096], c).argmin(1)
                    node[at[s : s + 4096]] = first + near
                    far[at[s : s + 4096]] = np.linalg.norm(x[s : s + 4096] - c[near], axis=1)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in ("fp", "n", "dim", "vec")], pa.array(node), pa.array(far)], ["fp", "n", "dim", "vec", "node", "far"])

    return assign


TREE = "block long, dim int, x binary, fps binary, ns binary, nodes binary, radius binary, tops binary, top_radius binary"


def _tree(t: pa.Table) -> pa.Table:
    """A block's tree as one row."""
    dim = t["dim"][0].as_py()
    order = np.argsort(np.array(t["fp"].to_pylist(), dtype="S16"), kind="stable")  # the same tree however rows arrive
    raw, fps, n = t["vec"].to_pylist(), t["fp"].to_pylist(), t["n"].to_numpy()[order]
    tree = Tree.build(unit([raw[i] for i in order], dim))
    rows, top = order[tree.order], tree.top()
    row = [t["block"][0].as_py(), dim, tree.x.tobytes(), b"".join(fps[i] for i in rows), n[tree.order].astype("<i8").tobytes(), tree.nodes.tobytes(), tree.radius.tobytes(), tree.x[tree.centre[top]].tobytes(), tree.radius[top].tobytes()]
    return pa.table({c.split()[0]: pa.array([v], pa.int64() if "long" in c else pa.int32() if c == "dim int" else pa.binary()) for c, v in zip(TREE.split(", "), row, strict=True)})


def _meeting(reach: float):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for r in b.to_pylist():
                x, y = (np.frombuffer(r[c], "<f8").reshape(-1, r["dim"]) for c in ("tops_a", "tops_b"))
                both = np.frombuffer(r["radius_a"], "<f8")[:, None] + np.frombuffer(r["radius_b"], "<f8")[None, :]
                keep.append(r["a"] == r["b"] or bool((distances(x, y) <= both + reach + 1e-6).any()))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return meet


def _joiner(threshold: float, shared):
    def join(t: pa.Table) -> pa.Table:
        trees, fps, ns = [], b"", []
        for r in t.sort_by("block").to_pylist():
            x = np.frombuffer(r["x"], "<f8").reshape(-1, r["dim"])
            trees.append(Tree(x, np.arange(len(x)), np.frombuffer(r["nodes"], np.int32).reshape(-1, 5), np.frombuffer(r["radius"], "<f8")))
            trees[-1].sketch(shared.value[r["dim"]][2])
            fps += r["fps"]
            ns.append(np.frombuffer(r["ns"], "<i8"))
        links = Links(np.concatenate(ns), len(ns[0]) if len(ns) > 1 else 0)
        dual(trees[0], trees[-1], threshold, links)
        root, at = links.groups.roots(), np.flatnonzero(links.links)
        return pa.table({"fp": pa.array([fps[16 * i : 16 * i + 16] for i in at], pa.binary()), "links": pa.array(links.links[at]), "anchor": pa.array([fps[16 * i : 16 * i + 16] for i in root[at]], pa.binary())})

    return join


def near_vectors(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row for each of ``df`` (vec_id, embedding): vec_id, class_id, n_links, component_id, kept."""
    spark = df.sparkSession
    rows = materialise(packed(df), "vectors")
    classes = materialise(rows.where("fp is not null").groupBy("fp").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")

    first, known, all_centres = 0, {}, []
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    size = min(BLOCK, max(LEAST, -(-sum(counts.values()) // 6)))
    for dim, count in sorted(counts.items()):
        few = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("vec").collect()
        x = unit([v["vec"] for v in few], dim)
        c = centres(x, max(1, min(MOST, count // size)))
        known[dim] = (first, c, axes(x))
        all_centres += [(first + i, dim, v) for i, v in enumerate(c)]
        first += len(c)
    shared = spark.sparkContext.broadcast(known)  # at most MOST centres and SKETCH directions a length
    dealt = materialise(classes.select("fp", "n", "dim", "vec").mapInArrow(_assigner(shared), "fp binary, n long, dim int, vec binary, node int, far double"), "nodes")
    stats = {r["node"]: (r["far"], -(-r["count"] // size)) for r in dealt.groupBy("node").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("count")).collect()}

    chunks = spark.createDataFrame([(k, c) for k, (_, c) in stats.items()], "node int, chunks long")
    block = F.shiftleft(F.col("node").cast("long"), 32) + F.pmod(F.xxhash64("fp"), F.col("chunks"))
    members = dealt.drop("far").join(F.broadcast(chunks), "node").withColumn("block", block).drop("node", "chunks")
    trees = materialise(members.groupBy("block").applyInArrow(_tree, TREE), "trees", compression="uncompressed")

    # at most MOST nodes a length: their pairs are a small table, and pairs of their blocks are made by Spark
    reach = float(np.sqrt(2 - 2 * threshold))
    used = [(k, d, v) for k, d, v in all_centres if k in stats]
    meet = []
    for i, (k, d, v) in enumerate(used):
        for m, e, w in used[i:]:
            if d == e and np.linalg.norm(v - w) <= stats[k][0] + stats[m][0] + reach + SLACK:
                meet.append((k, m, stats[k][1], stats[m][1]))
    pairs = spark.createDataFrame(meet, "ka long, kb long, na long, nb long")
    each = lambda k, n: F.explode(F.sequence(F.shiftleft(k, 32), F.shiftleft(k, 32) + F.col(n) - 1))
    pairs = pairs.withColumn("a", each("ka", "na")).withColumn("b", each("kb", "nb")).where("a <= b").select("a", "b")
    tops = [trees.select(F.col("block").alias(c), *(["dim"] if c == "a" else []), F.col("tops").alias(f"tops_{c}"), F.col("top_radius").alias(f"radius_{c}")) for c in "ab"]
    pairs = pairs.join(tops[0], "a").join(tops[1], "b").mapInArrow(_meeting(reach), "a long, b long")
    pairs = materialise(pairs.withColumn("piece", F.xxhash64("a", "b")), "pieces")
    sides = pairs.select("piece", F.col("a").alias("block")).unionByName(pairs.where("a != b").select("piece", F.col("b").alias("block")))
    found = sides.join(trees.drop("tops", "top_radius"), "block").groupBy("piece").applyInArrow(_joiner(threshold, shared), "fp binary, links long, anchor binary")
    found = materialise(found, "links")
    return memberships(rows.select("vec_id", "fp"), classes.select("fp", "vec_id", "n"), found, "vec_id").drop("fp")


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept", "class_id")


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS near FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.near),
c AS (SELECT node, min(near) AS component_id FROM r GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept,
 coalesce((SELECT min(w.vec_id) FROM v w JOIN v x ON w.v = x.v WHERE x.vec_id = e.vec_id), e.vec_id) AS class_id
FROM embeddings e JOIN c ON c.node = e.vec_id
"""
