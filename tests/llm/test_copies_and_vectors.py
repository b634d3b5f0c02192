"""Block naming, heap-bounded clustering and whitening against brute force, and on awkward rows."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import heaps, naming, whitening
from tidemill.llm.registry import QUERIES

DOCS = "doc_id long, text string, row long, name string, key int, m double"
VECS = "vec_id long, embedding array<double>, x string, block int, cluster string"


# --- exact copies


def brute_copies(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows, sorted; of equal rows any one stays."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, i, d))
    out = []
    for text, g in groups.items():
        first = min(g)
        out += [(x[4], first[4], len(g), x[3] == first[3], hashlib.sha256(text.encode()).hexdigest()) for x in g]
    return sorted(out, key=str)


def got_copies(df, **kw):
    return sorted((tuple(r) for r in naming.exact_copies(df, **kw).collect()), key=str)


def odd_texts():
    long = "".join(chr(97 + i * i % 23) + " " * (i % 3) for i in range(60_000))
    return [None, "", " \n\t\x0b\x0c\r ", "a b", "ab", "a b", "A b", long, long.replace("  ", " "), long + "x", "日本 語𝒳é", "日本語𝒳é", "ab", "one two", "onetwo", "one  two", " ", "ab" * 9, "ba" * 9, "ab" * 8, "a" * 18]


@pytest.mark.parametrize("size", [2, 7, naming.BLOCK])
def test_copies_against_brute_force(spark, size):
    texts = odd_texts()
    if size < 7:
        texts = [t for t in texts if t is None or len(t) < 1000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "ab"), (None, "null id"), (3, "a b"), (3, "a b"), (3, "another under the same id")]
    df = spark.createDataFrame([(d, t, 1, "n", 2, 0.5) for d, t in rows], DOCS)
    assert got_copies(df, size=size) == brute_copies(rows)


def test_copies_of_random_texts_over_two_letters(spark):
    """Many shared blocks and pairs, few equal texts; a block stands at many places."""
    rng = np.random.default_rng(0)
    rows = [(i, "".join(rng.choice(["a", "b", " "], int(rng.integers(0, 14))))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 3):
        assert got_copies(df, size=size) == brute_copies(rows)


def test_copies_in_large_groups(spark, monkeypatch):
    """A third of all rows is one text; groups are dealt to tasks of 50 rows."""
    monkeypatch.setattr(naming, "most_rows", lambda n: 50)
    rows = [(i, "hot text " * 5 if i % 3 == 0 else f"text {i % 700}") for i in range(3000)]
    assert got_copies(spark.createDataFrame(rows, "doc_id long, text string"), size=4) == brute_copies(rows)


def test_copies_with_keys_that_clash(spark):
    """Keys that don't tell blocks apart are noticed and replaced; keys that never do end in an error."""
    rows = [(1, "abc"), (2, "a b c"), (3, "xyz"), (4, "abd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda b, seed: F.unhex(F.lit("00")) if seed < 2 else naming.block_key(b, seed)
    ids = naming.identities(df, 2, weak).collect()
    assert {r["doc_id"] for r in ids if r["identity"] is not None} == {1, 2}
    with pytest.raises(RuntimeError):
        naming.identities(df, 2, lambda b, seed: F.unhex(F.lit("00")))


def test_copies_of_nothing(spark):
    assert naming.exact_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_copies_run_without_python(spark, sf):
    plan = naming.exact_copies(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- clustering


def brute_clusters(rows, k, rounds, dim, seed=3):
    kept = [(d, [math.floor(1024 * max(-(2.0**17), min(2.0**17, c))) for c in v]) for d, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        for c, g in groups.items():
            centroids[c] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    own = [(d, near(v), far(v, centroids[near(v)])) for d, v in kept]
    inertia = {}
    for _, c, s in own:
        inertia[c] = inertia.get(c, 0) + s
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((d, c, s, inertia[c], sum(inertia.values()), sha[c]) for d, c, s in own), key=str)


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(d, v, "x", 1, "c") for d, v in rows], VECS)
    return sorted((tuple(r) for r in heaps.cluster(df, **kw).collect()), key=str)


@pytest.mark.parametrize(("k", "rounds", "block"), [(8, 10, 2048), (5, 3, 7), (1, 2, 3), (8, 0, 5)])
def test_clusters_against_brute_force(spark, k, rounds, block):
    """Points on a small grid, so that many distances tie, repeated points, and groups of unlike size."""
    rng = np.random.default_rng(k)
    points = np.concatenate([rng.integers(-3, 4, (120, 4)) / 4, rng.normal(2, 0.3, (80, 4)), np.tile([[0.5, -0.25, 1, 0]], (60, 1))])
    rows = [(i, list(map(float, v))) for i, v in enumerate(points)]
    assert clustered(spark, rows, k=k, rounds=rounds, dim=4, block=block) == brute_clusters(rows, k, rounds, 4)


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [-1e300, 1e300]), (7, [0.0, 0.0]), (7, [-0.001, 2.0]), (9, [1.0, 2.0, 3.0])]
    assert clustered(spark, rows, k=3, rounds=4, dim=2) == brute_clusters(rows, 3, 4, 2)
    few = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert clustered(spark, few, k=8, rounds=3, dim=2) == brute_clusters(few, 8, 3, 2)
    assert clustered(spark, [], dim=2) == []
    assert clustered(spark, rows[:4], dim=2) == []


def test_only_expired_vectors_are_compared_again(spark):
    """Of well parted groups few gaps are used up after the first rounds."""
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, rng.normal(10 * (i % 8), 0.5, 8)))) for i in range(1600)]
    log = []
    got = clustered(spark, rows, k=8, rounds=10, dim=8, block=100, log=log)
    assert got == brute_clusters(rows, 8, 10, 8)
    assert log[0] == 1600 and sum(log[1:]) < 0.6 * 1600 * (len(log) - 1)


def test_heap_state_survives_its_bytes():
    h = heaps.Heaps(3)
    h.push(np.arange(6), np.array([0, 2, 2, 0, 2, 0]), np.array([5.0, 1, 3, 2, 2, np.inf]))
    again = heaps.Heaps(3, h.raw())
    assert again.heaps == h.heaps
    at, was = again.expired(np.array([2.0, 9, 2.5]))
    assert sorted(zip(at.tolist(), was.tolist(), strict=True)) == [(1, 2), (3, 0), (4, 2)]


# --- whitening


def brute_whitening(rows, most=16):
    vectors = [(d, np.array([math.floor(64 * c) + 1_000_000 for c in v], np.int64)) for d, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in vectors}), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return vectors, n, sums, v, values, axes


def check_whitening(got, rows, most=16):
    vectors, n, sums, v, values, axes = brute_whitening(rows, most)
    keep = int((values > 1e-9 * np.trace(v)).sum())
    assert len(got) == len(vectors) * keep
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, keep + 1))
    assert {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got if r["identity_error"] > 1e-6} == set()
    ids = {d: x for d, x in vectors}
    for c, out in by.items():
        assert np.allclose([r["explained"] for r in out], values[c - 1] / np.trace(v), rtol=1e-9)
        white = np.array([r["whitened"] for r in out])
        if min([abs(values[c - 1] - values[i]) for i in range(len(values)) if i != c - 1], default=1) > 1e-6 * values[0]:
            want = np.array([(ids[r["vec_id"]] - sums / n) @ axes[:, c - 1] / values[c - 1] ** 0.5 for r in out])
            assert min(np.abs(white - want).max(), np.abs(white + want).max()) < 1e-6
    for r in got:
        assert r["deviation"] == sum((n * int(x) - int(s)) ** 2 for x, s in zip(ids[r["vec_id"]], sums, strict=True))


def whitened(spark, rows, **kw):
    return whitening.whiten(spark.createDataFrame([(d, v, "x", 1, "c") for d, v in rows], VECS), **kw).collect()


def test_whitening_against_numpy(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = QUERIES["op13_whitening"](spark, sf).collect()
    check_whitening(got, [(r["vec_id"], r["embedding"]) for r in e])


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    nan = float("nan")
    good = [(i, list(map(float, rng.normal(0, [5, 5, 1, 0.5], 4)))) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, nan, 0.0, 0.0]), (103, [1.0, None, 0.0, 0.0])]
    repeated = [(200 + i, good[0][1]) for i in range(30)]  # the fit counts it once
    got = whitened(spark, good + odd + repeated)
    check_whitening(got, good + odd + repeated)
    assert {r["vec_id"] for r in got} == set(range(60)) | set(range(200, 230))
    assert len(whitened(spark, [*good, (1000, [1.0, 2.0])])) == 240  # another length
    assert {r["component"] for r in whitened(spark, good, most=2)} == {1, 2}
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    assert {r["component"] for r in whitened(spark, flat)} == {1}
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert whitened(spark, []) == [] == whitened(spark, odd)
    assert len(whitened(spark, [(None, [0.0, 1.0]), (1, [1e300, -1e300])])) == 2


@pytest.mark.parametrize("kind", ["random", "diagonal", "repeated", "near", "rank one", "zero", "wilkinson", "one"])
def test_eigenvectors(kind):
    rng, d = np.random.default_rng(7), 30
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    spread = {"repeated": [4.0] * 5 + [2.0] * 25, "near": [1 + 1e-13 * i for i in range(d)], "rank one": [3.0] + [0.0] * 29}
    if kind in spread:
        a = q @ np.diag(spread[kind]) @ q.T
    elif kind == "wilkinson":
        a = np.diag(np.abs(np.arange(d) - 15.0)) + np.eye(d, k=1) + np.eye(d, k=-1)
    else:
        a = {"random": q @ np.diag(rng.random(d)) @ q.T, "diagonal": np.diag(np.arange(d, dtype=float)), "zero": np.zeros((d, d)), "one": np.array([[2.5]])}[kind]
    a = (a + a.T) / 2
    diag, off, turn = whitening.tridiagonal(a)
    assert np.allclose(turn @ (np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)) @ turn.T, a, atol=1e-12)
    values, axes = whitening.components(a, 16)
    true = np.linalg.eigvalsh(a)[::-1][:16]
    true = true[true > len(a) * 1e-14 * max(np.trace(a), 0)]
    if kind != "rank one":
        assert np.allclose(values, true, atol=1e-12)
    assert abs(values[0] - true[0]) < 1e-12 if len(true) else not len(values)
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-10)
    assert np.allclose(a @ axes, axes * values, atol=1e-10)
    grid = np.linspace(-1, 31, 50)
    want = [(np.linalg.eigvalsh(a) < x - 1e-9).sum() for x in grid]
    assert [int(n) for n in whitening.sturm(diag, off, grid)] == want or kind in ("near", "diagonal")
