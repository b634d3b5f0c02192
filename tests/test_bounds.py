"""Top lists with an exact stop, components of contracted edges, distances by size levels: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import content, graphs, meshes


def brute_related(rows, n, ask, newer=None, threshold=0.0):
    w, date = {}, {}
    for item, term, weight, d in rows:
        if item is not None and term is not None:
            w.setdefault(item, {})[term] = max(weight, w.get(item, {}).get(term, -1e9))
            date[item] = max(d, date.get(item, d))
    out = set()
    for q in ask:
        scores = []
        for i in w:
            both = set(w[i]) & set(w.get(q, {}))
            if i != q and both and not (newer and date[i] > date[q]):
                s = sum(min(w[i][t], w[q][t]) for t in both)
                if s >= threshold:
                    scores.append((-s, i))
        out |= {(q, i, round(-s, 9), k + 1) for k, (s, i) in enumerate(sorted(scores)[:n])}
    return out


@pytest.mark.parametrize("newer", [None, "d"])
def test_related_items_with_terms_that_all_have(spark, newer):
    """One term in every item, one in a third of them; most items stop before those, some have nothing else."""
    rng = np.random.default_rng(4)
    rows = [(i, "all", 1.0, i % 3) for i in range(400)] + [(i, "third", 2.0, i % 3) for i in range(0, 400, 3)]
    rows += [(i, f"t{int(t)}", float(rng.integers(1, 30)), i % 3) for i in range(360) for t in rng.integers(0, 90, 6)]
    rows += [(None, "all", 1.0, 0), (5, None, 1.0, 0), (7, "all", 0.5, 0), (390, "minus", -3.0, 0), (391, "minus", -2.0, 0)]
    df, log = spark.createDataFrame(rows, "item long, term string, w double, d int"), []
    got = content.related_items(df, "item", "w", 3, df.where("item % 10 = 0").select("item"), newer=newer, first=40, step=4, threshold=-100.0, log=log)
    assert {(r["item"], r["related"], round(r["score"], 9), r["rank"]) for r in got.collect()} == brute_related(rows, 3, range(0, 400, 10), newer, -100.0)
    assert 0 < log[0] < 20  # of 40 that ask


def test_related_items_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "item long, term string, w double")
    assert content.related_items(df, "item", "w", 3).count() == 0
    assert content.related_items(df.limit(0), "item", "w", 3).count() == 0


def test_tasks_of_related_items_grow_with_the_pairs(spark, monkeypatch):
    """Tasks are as many as rows and pairs take, an item of very many pairs is parted, and the scores stay."""
    monkeypatch.setattr(content, "ROWS", 100)
    rng = np.random.default_rng(6)
    rows = [(i, f"t{int(t)}", float(rng.integers(1, 9)), 0) for i in range(120) for t in rng.integers(0, 40, 4)]
    df = spark.createDataFrame(rows, "item long, term string, w double, d int")
    for whole in (1 << 20, 10):
        monkeypatch.setattr(content, "WHOLE", whole)
        got = content.related_items(df, "item", "w", 3)
        assert got.rdd.getNumPartitions() > 4 or whole == 10
        assert {(r["item"], r["related"], round(r["score"], 9), r["rank"]) for r in got.collect()} == brute_related(rows, 3, range(120))


def test_related_items_asks_for_every_order(spark, sf):
    """The registered query has rows for all orders that share a part with another one, whatever their key."""
    from tidemill.plans.texts import related_items

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity").collect()
    rows = [(r["l_orderkey"], r["l_partkey"], r["l_quantity"], 0) for r in lines]
    got = {(r["l_orderkey"], r["related"], round(r["score"], 9), r["rank"]) for r in related_items(spark, sf).collect()}
    assert got == brute_related(rows, 3, {r[0] for r in rows})
    assert any(q % 20 for q, *_ in got)


@pytest.mark.parametrize("weights, ask, n", [(2, None, 1), (9, None, 3), (9, 7, 40)])
def test_related_items_leaves_out_only_pairs_that_are_not_among_the_best(spark, weights, ask, n):
    """Items of one to 300 terms, ties of weights, copies, terms that many or all have: as by brute force, of fewer pairs."""
    rng = np.random.default_rng(weights)
    rows = [(i, f"t{int(t)}", float(rng.integers(0, weights)), 0) for i in range(300) for t in rng.integers(0, 150, rng.integers(1, 7))]
    rows += [(i, "all", 1.0, 0) for i in range(0, 300, 2)] + [(i, "only", float(i % 3), 0) for i in range(300, 330)]
    rows += [(400 + k, f"t{t}", float(t % weights), 0) for k in range(3) for t in range(300)] + [(500, "alone", 5.0, 0)]
    df = spark.createDataFrame(rows, "item long, term string, w double, d int")
    asked = None if ask is None else df.where(F.col("item") % ask == 0).select("item")
    got = content.related_items(df, "item", "w", n, asked)
    assert {(r["item"], r["related"], round(r["score"], 9), r["rank"]) for r in got.collect()} == brute_related(rows, n, {r[0] for r in rows if not r[0] % (ask or 1)})
    few = df.where("item < 300 and term != 'all'").groupBy("item", "term").agg(F.max("w").alias("w"))
    few = few.join(few.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "term")
    every, some = content._shared(few, few, "item", None, 1000), content._shared_best(few, None, "item", 1, 64, 1000)
    assert some.count() < 0.6 * every.count()


def brute_components(edges):
    root = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            for x in (a, b):
                root.setdefault(x, x)
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_components_of_contracted_edges(spark, monkeypatch, few):
    """With tasks that hold 50 edges at most, and with or without an end in one task."""
    monkeypatch.setattr(graphs, "FEW", few)
    rng = np.random.default_rng(few)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(i, i + 1) for i in range(2000, 2080)] + [(5000, k) for k in range(5001, 5060)] + [(7000, 7000), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r["node"]: r["part"] for r in graphs.connected_parts(df).collect()} == brute_components(edges)
    names = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges[:100]], "a string, b string")
    assert {r["node"]: r["root"] for r in graphs.components(names.where("a != b"), contract=True).collect()} == brute_components([(f"n{a}", f"n{b}") for a, b in edges[:100] if a != b])


def test_the_task_that_ends_components_keeps_all_edges(spark):
    """Over a million edges that no forest makes fewer, whose second half joins on to the first."""
    n = 600_000
    edges = spark.range(0, 2 * n, 1, 4).select(F.col("id").alias("a"), (F.col("id") + n).alias("b"))
    got = graphs.connected_parts(edges)
    assert got.agg(F.count("node"), F.sum((F.col("part") == F.col("node") % n).cast("long"))).first() == (3 * n, 3 * n)


def test_components_by_rounds(spark, monkeypatch):
    """A tangle, a hub, a path and a loop: ended by one task, by rounds alone, and with roots looked up by joins; each node once."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 8000, (6000, 2))] + [(20_000, k) for k in range(100, 8000, 50)] + [(25_000, 25_000), (7, 7)]
    edges += [(k, k + 1) for k in rng.permutation(np.arange(30_000, 30_200)).tolist()]
    df, want = spark.createDataFrame(edges, "a long, b long").repartition(5), brute_components(edges)
    for few, small in ((1 << 21, 200_000), (0, 200_000), (300, 0)):
        monkeypatch.setattr(graphs, "FEW", few)
        monkeypatch.setattr(graphs, "SMALL", small)
        got = [(r["node"], r["part"]) for r in graphs.connected_parts(df).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_forests():
    rng = np.random.default_rng(0)
    for n, m in ((1, 0), (50, 20), (50, 200), (3000, 3000)):
        pairs = rng.integers(0, n, (m, 2))
        chain = np.stack([np.arange(n - 1), np.arange(1, n)], 1)[::2]
        every = np.concatenate([pairs, chain, pairs[:, ::-1]])
        got = graphs.roots(n, every[:, 0], every[:, 1])
        want = brute_components(every.tolist())
        assert all(got[x] == want.get(x, x) for x in range(n))


def test_tasks_let_go_of_forests_that_don_t_shrink(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(graphs, "HELD", 64)
    rng = np.random.default_rng(1)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"]) for x in (rng.integers(0, m, (40, 2)) for m in (2000, 2000, 30, 30, 30, 30, 2000))]
    out = [(r["a"], r["b"]) for b in graphs._contract(iter(batches)) for r in b.to_pylist()]
    given = [(r["a"], r["b"]) for b in batches for r in b.to_pylist()]
    want = brute_components(given)
    assert brute_components(out) == {x: r for x, r in want.items() if x in {y for e in out for y in e}}
    assert len(out) < len(given)


def to_triangle(p, a, b, c):
    """Distance of a point to a triangle: the least over a fine net of it, and over its plane."""
    u, v = np.meshgrid(np.linspace(0, 1, 60), np.linspace(0, 1, 60))
    inside = u + v <= 1 + 1e-12
    net = a + u[inside][:, None] * (b - a) + v[inside][:, None] * (c - a)
    return np.linalg.norm(net - p, axis=1).min()


def test_distances_with_triangles_of_many_sizes(spark):
    """Sizes from 0.01 to 300, points near and far, a model without triangles, coordinates that are none."""
    rng = np.random.default_rng(9)
    size = 10 ** rng.uniform(-2, 2.5, 40)
    middle = rng.uniform(-5, 5, (40, 3))
    corner = middle[:, None, :] + rng.normal(size=(40, 3, 3)) * size[:, None, None]
    corner[3] = corner[3, :1]  # a point
    t = spark.createDataFrame([("m", i, *map(float, c.ravel())) for i, c in enumerate(corner)], "model string, face_id long, " + ", ".join(f"{n}{x} double" for n in "abc" for x in "xyz"))
    points = np.concatenate([rng.uniform(-6, 6, (12, 3)), rng.uniform(-2000, 2000, (4, 3))])
    rows = [("m", i, *map(float, p)) for i, p in enumerate(points)] + [("other", 99, 0.0, 0.0, 0.0), ("m", 100, None, 0.0, 0.0), ("m", 101, float("nan"), 0.0, 0.0)]
    p = spark.createDataFrame(rows, "model string, p_id long, x double, y double, z double")
    got = {r["p_id"]: r["distance"] for r in meshes.surface_distance(p, t).collect()}
    assert set(got) == set(range(16))
    for i, x in enumerate(points):
        want = min(to_triangle(x, *c) for c in corner)
        assert got[i] <= want + 1e-9 and want - got[i] < 0.02 * max(1.0, want) + size.max() / 55
    exact = {i: min(to_triangle(points[i], *c) for c in corner[size < 1]) for i in range(3)}
    small = {r["p_id"]: r["distance"] for r in meshes.surface_distance(p.where("p_id < 3"), t.where(F.col("face_id").isin([int(k) for k in np.flatnonzero(size < 1)]))).collect()}
    assert all(abs(small[i] - exact[i]) < 0.02 for i in small)


def test_a_triangle_stands_in_one_cell(spark):
    t = spark.createDataFrame([("m", 0, *([0.0] * 3), 1e6, 0.0, 0.0, 0.0, 1e6, 0.0), ("m", 1, *([0.5] * 9)), ("m", 2, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "model string, face_id long, " + ", ".join(f"{n}{x} double" for n in "abc" for x in "xyz"))
    got = {r["face_id"]: r["level"] for r in meshes.levelled(t).collect()}
    assert got == {0: 20, 1: meshes.LEAST_LEVEL, 2: 2}


def test_defects_before_and_after(spark):
    quad = [(0, [0, 1, 2]), (1, [0, 2, 3]), (2, [0, 3, 1]), (3, [1, 3, 2])]  # closed
    df = spark.createDataFrame([("m", *f) for f in quad] + [("n", *quad[0])], "model string, face_id long, v array<long>")
    got = {(r["model"], r["defect"]): (r["before"], r["after"]) for r in meshes.defect_pairs(df, df.where("face_id != 3 and model = 'm'")).collect()}
    assert got == {("m", "nonmanifold"): (0, 3), ("m", "boundary"): (0, 3), ("n", "nonmanifold"): (3, 0), ("n", "boundary"): (3, 0)}
    d = spark.createDataFrame([("m", 0.1), ("n", 0.1)], "model string, d double")
    status = lambda pairs: {r["model"]: r["status"] for r in meshes.tolerance_check(d, ["model"], "d", 1.0, defects=pairs).collect()}
    pairs = spark.createDataFrame([("m", "a", 1, 0), ("m", "b", 0, 1), ("n", "a", 1, 1), ("n", "b", 2, 1)], "model string, defect string, before int, after int")
    assert status(pairs) == {"m": "FAIL", "n": "PASS"}
