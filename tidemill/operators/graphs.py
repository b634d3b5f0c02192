"""Walks and components over edge tables, level by level, written out between rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.store import written


def first_matching_ancestor(edges: DataFrame, starts: DataFrame, match: Column, max_hops: int = 12) -> DataFrame:
    """(start, ancestor, hops): the first row of ``edges`` (id, parent_id, …) on the way up for which ``match`` holds.

    The walk starts at the start's parent and ends at a missing row, a row that is its own parent, or the root 0. A row that very
    many walks come by is dealt to several tasks. An id stands once in ``edges``.
    """
    rows = written(edges.select("id", "parent_id", F.coalesce(match, F.lit(False)).alias("match")), "edges")
    walk = starts.select(F.col("id").alias("start")).join(rows.select(F.col("id").alias("start"), F.col("parent_id").alias("at")), "start")
    walk, found = walk.where("at is not null and at != start and at != 0"), None
    for hop in range(1, max_hops + 1):
        step = written(looked_up(walk, "at", rows.withColumnRenamed("id", "at")).where("match is not null").select("start", F.col("at").alias("id"), "parent_id", "match"), "walk")
        hit = step.where("match").select("start", F.col("id").alias("ancestor"), F.lit(hop).alias("hops"))
        found = hit if found is None else found.unionByName(hit)
        walk = step.where("not match and parent_id is not null and parent_id != id and parent_id != 0").select("start", F.col("parent_id").alias("at"))
        if walk.isEmpty():
            break
    return found


def thread_view(posts: DataFrame, starts: DataFrame, depth: int = 6, parent_height: int = 80) -> DataFrame:
    """(start, uri, level) of every start's ancestors (negative levels), itself (0) and descendants, within bounds."""
    there = posts.select(F.col("uri").alias("parent_uri"), F.lit(True).alias("there"))
    rows = looked_up(posts.select("uri", "parent_uri"), "parent_uri", there)  # a parent that is no post is none
    rows = written(rows.select("uri", F.when(F.col("there"), F.col("parent_uri")).alias("parent_uri")), "posts")
    out = starts.select(F.col("uri").alias("start")).join(rows.select(F.col("uri").alias("start")), "start").select("start", F.col("start").alias("uri"), F.lit(0).alias("level"))
    seen = written(out, "thread")
    for direction, most in ((-1, parent_height), (1, depth)):
        front = out
        for k in range(1, most + 1):
            if direction < 0:
                # many walks come by one ancestor
                nxt = looked_up(front.select("start", "uri"), "uri", rows).where("parent_uri is not null").select("start", F.col("parent_uri").alias("uri"))
            else:
                nxt = front.select("start", F.col("uri").alias("parent_uri")).join(rows, "parent_uri").select("start", "uri")
            front = written(nxt.distinct().join(seen, ["start", "uri"], "left_anti").select("start", "uri", F.lit(direction * k).alias("level")), "front")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
    return seen


def spread(rows: DataFrame, unique: DataFrame, key: str, most: int, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) with ``unique``, which has one row a key and the number of ``rows`` of it as ``n@``.

    A key of more than ``most`` rows is dealt to as many tasks as that takes; such keys are at most rows / most, so
    ``most`` bounds the broadcast list of them. Rows without a key are dealt to all tasks, which are ``tasks`` if that is given.
    """
    parts = unique.withColumn("parts@", F.ceil(F.col("n@") / most)).drop("n@")
    hubs = parts.where("`parts@` > 1").select(key, "parts@")
    h = F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"])
    salt = F.when(F.col(key).isNull(), -1 - F.pmod(h, F.lit(1 << 20))).otherwise(F.pmod(h, F.coalesce("parts@", F.lit(1))))
    salted = rows.join(F.broadcast(hubs), key, "left").withColumn("salt@", salt).drop("parts@")
    copies = parts.withColumn("salt@", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts@") - 1))).drop("parts@")
    if tasks:
        salted, copies = (df.repartition(tasks, key, "salt@") for df in (salted, copies))
    return salted.join(copies, [key, "salt@"], how).drop("salt@")


#: Rows of one key in a task where counting all rows first is not worth it.
HOT = 1_000_000


def looked_up(rows: DataFrame, key: str, unique: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``unique``, one row a key, by ``spread``; how often each key is asked for is counted first."""
    asked = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n@"))
    return spread(rows, unique.join(asked, key), key, HOT, "left")


def most_rows(rows: int) -> int:
    """Rows of one key in a task: few enough that it stays small, so many that at most 100,000 keys have more."""
    return max(1024, rows // 100_000)


#: Edges that one task may hold: contracted on the way, and all that are left once they are so few.
HELD, FEW = 1 << 20, 1 << 21
#: Rows of a table that are broadcast to be looked up.
SMALL = 200_000


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n points the smallest one that the given pairs join it with: larger roots are hooked to smaller ones, and paths halved."""
    root = np.arange(n)
    while len(left):
        u, v = root[left], root[right]
        apart = u != v
        left, right, u, v = left[apart], right[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return root


def _forest(edges: pa.Table, marks: bool = False) -> pa.Table:
    """The same components as one edge from each node to the smallest of its component, with ``marks`` from the smallest to itself too."""
    both = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).combine_chunks()
    coded = both.dictionary_encode()
    nodes, code = coded.dictionary, coded.indices.to_numpy()
    order = pc.sort_indices(nodes)
    rank = np.empty(len(nodes), np.int64)
    rank[order.to_numpy()] = np.arange(len(nodes))
    nodes, code = nodes.take(order), rank[code]
    root = roots(len(nodes), code[: edges.num_rows], code[edges.num_rows :])
    far = np.arange(len(root)) if marks else np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": nodes.take(pa.array(far)), "b": nodes.take(pa.array(root[far]))})


def _contract(batches: Iterator[pa.RecordBatch], marks: bool = False) -> Iterator[pa.RecordBatch]:
    """A task's edges as forests: what it holds is contracted whenever it has grown to ``HELD``, and let go of if that doesn't make it smaller."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= HELD:
            t = _forest(pa.Table.from_batches(held), marks)
            held, n = (t.to_batches(), t.num_rows) if t.num_rows < HELD // 2 else ([], 0)
            if not held:
                yield from t.to_batches()
    if held:
        yield from _forest(pa.Table.from_batches(held), marks).to_batches()


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges, which are few, as one forest: each node once, with the smallest of its component."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _forest(pa.Table.from_batches(held), True).to_batches()


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From forests' edges, sorted: each node with its least root (itself, if it is a root anywhere), and as ``more`` the edges between roots, contracted."""

    def rows(t: pa.Table, more: bool) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"a": t["a"], "b": t["b"], "more": pa.repeat(pa.scalar(more), t.num_rows)}).to_batches()

    def done(t: pa.Table) -> tuple[pa.Table, pa.Table]:
        a, b = t["a"].combine_chunks(), t["b"].combine_chunks()
        new = np.concatenate([[True], pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        least = b.take(pa.array(first[np.cumsum(new) - 1]))
        root = pc.equal(a.take(pa.array(last)), b.take(pa.array(last)))  # a root's own mark comes last, as its roots are smaller
        node = a.take(pa.array(first))
        far = pc.and_(pc.not_equal(b, least), pc.not_equal(a, b))
        up = pc.and_(root, pc.not_equal(node, b.take(pa.array(first))))
        own = pa.table({"a": node, "b": pc.if_else(root, node, b.take(pa.array(first)))})
        between = pa.table({"a": pa.chunked_array([b.filter(far), node.filter(up)]), "b": pa.chunked_array([least.filter(far), b.take(pa.array(first)).filter(up)])})
        return own, between

    held, found, n = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
        a = t["a"].combine_chunks()
        end = int(np.flatnonzero(pc.equal(a, a[-1]).to_numpy(zero_copy_only=False))[0])  # the last node may go on
        held = t.slice(end).combine_chunks()
        if end:
            own, between = done(t.slice(0, end))
            yield from rows(own, False)
            found.append(between)
            n += between.num_rows
        if n >= HELD:
            for x in _contract((x for t in found for x in t.to_batches()), True):
                yield from rows(pa.Table.from_batches([x]), True)
            found, n = [], 0
    if held is not None:
        own, between = done(held)
        yield from rows(own, False)
        found.append(between)
    for x in _contract((x for t in found for x in t.to_batches()), True):
        yield from rows(pa.Table.from_batches([x]), True)


def contracted(edges: DataFrame, by: Callable = _contract) -> DataFrame:
    """Fewer edges (a, b) with the same components: each task's own are contracted to forests, before anything is shuffled."""
    return edges.select("a", "b").mapInArrow(by, edges.select("a", "b").schema)


def peeled(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; none null, loops are nodes), once: root is the smallest node it is joined with.

    Each task makes forests of its own edges. One shuffle brings a node's roots together (at most one of each forest, so no node is
    a hub), by ranges of nodes, as neighbours in number are often joined. Nodes that are no root anywhere then know one root and are settled; what is
    left is a graph between roots, treated alike until it has at most ``FEW`` edges (one task ends it) or doesn't get
    smaller by a quarter (stars end it). Then each settled node looks its root up, from the last round to the first.
    """
    spark, levels, was = edges.sparkSession, [], None
    now = written(contracted(edges, _marked), "edges")
    n = now.count()
    while n > FEW and (was is None or n <= 0.75 * was):
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // HELD))
        sorted_ = now.repartitionByRange(parts, "a").sortWithinPartitions("a", "b")
        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema)
        both = written(sorted_.mapInArrow(_peel, f"{kind}, more boolean"), "peeled")
        levels.append(both.where("not more").select(F.col("a").alias("node"), F.col("b").alias("root")))
        now, was = both.where("more").select("a", "b"), n
        n = now.count()
    if n <= FEW:
        found = written(contracted(now.coalesce(1), _one_forest), "forest").select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        ends = now.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
        found = written(components(now, most_rounds).unionByName(ends).groupBy("node").agg(F.min("root").alias("root")), "roots")
    size = n
    for nodes in reversed(levels):
        last = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        up = nodes.join(F.broadcast(last), "root", "left") if size <= SMALL else looked_up(nodes, "root", last)
        found, size = up.select("node", F.coalesce("end", "root").alias("root")), SMALL + 1
        if nodes is not levels[0]:
            found = written(found, "roots")
    return found


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _contract(batches, True)


def components(edges: DataFrame, most_rounds: int = 60, contract: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it is joined with.

    Each round points every neighbour at its node's least neighbour, first the larger ones, then the smaller ones
    (large star, small star), until the edges stay as they are. Neighbour lists are never gathered: a node's least
    neighbour is a partial aggregate, joined back to the edges, those of a hub in parts. With ``contract`` tasks first make
    forests of their edges, see ``peeled``. Loops,
    repeated edges and null ends are ignored; an empty table gives an empty one.
    """
    if contract:
        return peeled(edges.where("a != b"), most_rounds)
    now = written(_clean(edges), "edges")
    mark = _mark(now)
    most = most_rows(mark[0])
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _clean(_least(both, most).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = _least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), most)
        small = _clean(down.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")))
        now = written(small, "edges")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    greater, lesser = F.greatest("a", "b"), F.least("a", "b")
    return now.select(greater.alias("node"), lesser.alias("root")).unionByName(now.select(lesser.alias("node"), lesser.alias("root"))).distinct()


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _least(pairs: DataFrame, most: int) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n@"))
    return spread(pairs, least, "a", most).select("a", "b", F.least("a", "m").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_parts(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, part): part is the smallest node it is joined with; a node that is joined with itself alone is a part."""
    rows = edges.select("a", "b").where("a is not null and b is not null")
    return peeled(rows, max_rounds).select("node", F.col("root").alias("part"))


def part_sizes(parts: DataFrame) -> DataFrame:
    """Each part with its size, and whether it is the largest (ties: the smallest label)."""
    n = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    best = n.agg(F.min(F.struct((-F.col("size")).alias("s"), "part"))["part"].alias("best"))
    return n.crossJoin(F.broadcast(best)).select("part", "size", (F.col("part") == F.col("best")).alias("largest"))
