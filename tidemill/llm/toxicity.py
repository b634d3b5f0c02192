"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings, hashed to ``1 << BITS`` places; a text's features say which chosen places it
hits. The machine adds to linear weights a product of two small vectors for every pair of features, so that a pair
such as an insult and a group's mention counts for more than its two parts.

Learning takes a bounded sample (``max_rows`` labelled rows a class, by smallest hash of the id): each task reduces a
text to its set of places. A first machine is fitted by AdaGrad over all places that ``least`` texts of the sample hit,
whatever they tell by themselves. Of its places, those with the largest pair parts are tested by pairs: a pair whose
joint presence tells the classes apart far beyond chance stays, though either place alone may tell nothing (an exclusive
or). Those, and the places that tell something by themselves, are the features on whose presence the final machine is
fitted by Adam. Scoring reads every text as a whole in Arrow batches, with the fitted arrays (about 1 MB,
whatever the input's size) broadcast.

Defined results: a null text counts as empty; an empty text gets the machine's bias as score. A label that is null is
no label; repeated labels of one id count as 1 if any is 1. Without labelled rows of both classes every score is the
share of positives (0 where there is none). Rows that repeat are scored each; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.store import fold, table, texts
from tidemill.llm.words import distinct, slices, words

BITS, HEADS = 18, (4, 5)
#: What a pair must tell beyond its parts, as a squared number of standard deviations: words of one passage come together too.
BEYOND = 90.0
#: Texts that are made a matrix at once where pairs are counted.
AT_ONCE = 1024


class Machine(NamedTuple):
    """``slot`` maps a place to its feature or -1; logit = bias + x.w + half the pairwise products."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every word and word beginning."""
    w = words(data, offsets)
    doc, shift = w.doc(), np.uint64(64 - BITS)
    long = {n: w.end - w.start > n for n in HEADS}
    heads = [(w.head(n) * np.uint64(2 * n + 1) >> shift)[long[n]] for n in HEADS]
    return np.concatenate([doc, *[doc[long[n]] for n in HEADS]]), np.concatenate([w.hash >> shift, *heads]).astype(np.int64)


def place_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for _, _, data, offsets in slices(b["text"]):
            doc, place = places(data, offsets)
            key = distinct(doc << BITS | place)
            cut = np.searchsorted(key, np.arange(len(offsets)) << BITS)
            flat = (key & ((1 << BITS) - 1)).astype("<u4")
            out += [flat[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b["y"], pa.array(out, pa.binary())], ["y", "places"])


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """(y, text) of at most ``max_rows`` labelled rows a class."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    y = y.where(learn)
    few = [y.where(F.col("y") == k).orderBy(*order).limit(max_rows) for k in (0, 1)]
    return texts(docs).join(few[0].unionByName(few[1]), "doc_id")


class Sets(NamedTuple):
    """Texts' places as one array, of which text i has flat[bounds[i]:bounds[i + 1]]: no object for each text."""

    flat: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sets:
        return cls(np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)]))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.bounds[i] : self.bounds[i + 1]]

    def mapped(self, slot: np.ndarray) -> Sets:
        """The slots of the places that have one."""
        cut, out = [0], np.empty(int((slot >= 0)[self.flat].sum()), np.int32)
        for i in range(len(self)):
            f = slot[self[i]]
            f = f[f >= 0]
            out[cut[-1] : cut[-1] + len(f)] = f
            cut.append(cut[-1] + len(f))
        return Sets(out, np.array(cut))


def _hits(sets: Sets, of: np.ndarray | None = None) -> np.ndarray:
    """By place, how many texts (of those marked) have it."""
    out = np.zeros(1 << BITS)
    for i in range(len(sets)):
        if of is None or of[i]:
            out[sets[i]] += 1  # a text has a place once
    return out


def telling(y: np.ndarray, sets: Sets, hit: np.ndarray, features: int) -> np.ndarray:
    """The places whose presence alone tells the classes apart best, by the chi-squared statistic."""
    pos = _hits(sets, y > 0)
    n, p = len(y), y.sum()
    det = pos * (n - p - hit + pos) - (hit - pos) * (p - pos)
    chi = n * det**2 / np.maximum(1.0, hit * (n - hit) * 1.0 * p * (n - p))
    chi[(hit < 5) | (chi < 10.83)] = 0  # below the 0.1 % point a difference counts as chance
    best = np.argsort(-chi, kind="stable")[:features]
    return best[chi[best] > 0]


def sparse_machine(y: np.ndarray, rows: Sets, size: int, weight: np.ndarray, factors: int, epochs: int = 5, batch: int = 128, rate: float = 0.1, decay: float = 0.02, seed: int = 7) -> np.ndarray:
    """The pair vectors (size x factors) of a machine over sparse rows of features, fitted by AdaGrad on small batches."""
    rng, share, c = np.random.default_rng(seed), float((y * weight).sum() / weight.sum()), weight / weight.mean()
    b, w, v = np.log(share / (1 - share)), np.zeros(size), rng.normal(0, 0.05, (size, factors))
    gb, gw, gv = 1e-3, np.full(size, 1e-3), np.full((size, factors), 1e-3)
    for e in range(epochs):
        order, step = rng.permutation(len(y)), rate * (1 - e / epochs)
        for s in range(0, len(y), batch):
            at = order[s : s + batch]
            f, d = np.concatenate([rows[i] for i in at]), np.repeat(np.arange(len(at)), [len(rows[i]) for i in at])
            add = lambda x: np.bincount(d, x, len(at))  # noqa: B023, E731
            q = np.stack([add(v[f, j]) for j in range(factors)], axis=1)
            z = b + add(w[f]) + 0.5 * ((q**2).sum(1) - add((v[f] ** 2).sum(1)))
            g = c[at] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[at]) / len(at)
            u, inverse = np.unique(f, return_inverse=True)
            dw = np.bincount(inverse, g[d], len(u))
            dv = np.stack([np.bincount(inverse, (g[:, None] * q)[d, j], len(u)) for j in range(factors)], axis=1) - dw[:, None] * v[u]
            gb, gw[u], gv[u] = gb + g.sum() ** 2, gw[u] + dw**2, gv[u] + dv**2
            b, w[u], v[u] = b - step * g.sum() / np.sqrt(gb), w[u] - step * dw / np.sqrt(gw[u]), v[u] - step * dv / np.sqrt(gv[u])
        w, v = w * (1 - decay), v * (1 - decay)
    return v


def pairing(y: np.ndarray, sets: Sets, hit: np.ndarray, weight: np.ndarray, factors: int, least: int, candidates: int) -> np.ndarray:
    """The places of pairs whose joint presence tells the classes apart, of those to which the sparse machine gives the largest pair parts."""
    kept = np.flatnonzero(hit >= least)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    rows = sets.mapped(slot)
    v = sparse_machine(y, rows, len(kept), weight, factors)
    best = np.argsort(-(v**2).sum(1) * hit[kept], kind="stable")[:candidates]
    slot = np.full(len(kept), -1, np.int32)
    slot[best] = np.arange(len(best))
    share, rows = y.mean(), rows.mapped(slot)
    joint, apart = np.zeros((len(best), len(best)), np.float32), np.zeros((len(best), len(best)), np.float32)
    for i in range(0, len(y), AT_ONCE):
        x = _presence(rows, len(best), i, i + AT_ONCE)
        joint += x.T @ x
        apart += x.T @ (x * (y[i : i + AT_ONCE] - share).astype(np.float32)[:, None])
    # what the pair tells beyond its two parts: its difference less theirs, each by its own texts
    own = np.diag(apart) / np.maximum(1, np.diag(joint))
    beyond = apart - joint * (own[:, None] + own[None, :])
    score = beyond**2 / np.maximum(1e-9, joint * share * (1 - share))
    np.fill_diagonal(score, 0)
    score[joint < 5] = 0
    told = np.flatnonzero(score.max(1) > BEYOND)
    return kept[best[told]]


def _presence(rows: Sets, size: int, first: int, last: int) -> np.ndarray:
    """Which of the features texts first to last have, as a matrix."""
    last = min(last, len(rows))
    x = np.zeros((last - first, size), np.float32)
    for i in range(first, last):
        x[i - first, rows[i]] = 1
    return x


def fit(y: np.ndarray, sets: list[np.ndarray] | Sets, weight: np.ndarray, features: int = 1024, factors: int = 4, steps: int = 300, l2: float = 5e-4, least: int = 3, seed: int = 7) -> Machine:
    y, sets = y.astype(np.float64), sets if isinstance(sets, Sets) else Sets.of(sets)
    slot = np.full(1 << BITS, -1, np.int32)
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        share = min(max(share, 0.0), 1.0)
        return Machine(slot, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, factors)))
    hit = _hits(sets)
    best = telling(y, sets, hit, features)
    if factors:
        best = np.union1d(best, pairing(y, sets, hit, weight, factors, least, features))
    best = np.sort(best).astype(int)
    slot[best] = np.arange(len(best))
    x = _presence(sets.mapped(slot), len(best), 0, len(sets))
    del sets
    rng = np.random.default_rng(seed)
    params = [np.full(1, np.log(share / (1 - share))), np.zeros(len(best)), rng.normal(0, 0.05, (len(best), factors))]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    c = weight / weight.sum()
    for t in range(1, steps + 1):
        b, w, v = params
        q = x @ v.astype(np.float32)
        z = b[0] + x @ w.astype(np.float32) + 0.5 * ((q**2).sum(1) - x @ (v**2).sum(1).astype(np.float32))
        g = (c * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)).astype(np.float32)
        gx = x.T @ g
        grads = [np.array([g.sum()]), gx + l2 * w, x.T @ (g[:, None] * q) - gx[:, None] * v + l2 * v]
        rate = 0.1 * (1 - t / (steps + 1))
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d * d
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(slot, float(params[0][0]), params[1], params[2])


def joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of places as one array, and each text's bounds in it."""
    runs = [(data.view("<u4"), np.diff(offsets) // 4) for chunk in column.chunks for _, _, data, offsets in slices(chunk, 1 << 40)]
    flat = np.concatenate([np.zeros(0, np.uint32), *[data for data, _ in runs]])
    return flat, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[n for _, n in runs]]))])


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = 6000) -> Machine:
    """Fit on at most ``max_rows`` labelled rows a class for which ``learn`` (of doc_id) holds; classes count by their share of all labels."""
    counts = dict(labels.where(learn & F.col(label).isNotNull()).groupBy((F.col(label) == 1).cast("int").alias("y")).count().collect())
    got = sample(docs, labels, label, learn, max_rows).select("y", "text").mapInArrow(place_sets, "y int, places binary").toArrow()
    y = got["y"].to_numpy().astype(int)
    flat, bounds = joined(got["places"])
    del got
    sets = Sets(flat, bounds)
    order = sorted(range(len(y)), key=lambda i: (y[i], len(sets[i]), zlib.crc32(sets[i])))  # the same machine however rows arrive
    y, sets = y[order], Sets.of([sets[i] for i in order])
    del flat
    seen = np.bincount(y, minlength=2) if len(y) else np.ones(2)
    weight = np.array([counts.get(k, 0) / max(1, seen[k]) for k in (0, 1)])[y] if len(y) else np.zeros(0)
    return fit(y, sets, weight)


def scores(m: Machine, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    doc, place = places(data, offsets)
    f = m.slot[place]
    on = f >= 0
    k = max(1, len(m.w))
    key = distinct(doc[on] * k + f[on])
    d, f = key // k, key % k
    z = m.bias + np.bincount(d, weights=m.w[f], minlength=n)
    for j in range(m.v.shape[1]):
        u = m.v[f, j]
        z += 0.5 * (np.bincount(d, weights=u, minlength=n) ** 2 - np.bincount(d, weights=u * u, minlength=n))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(_all_scores(shared.value, b["text"]), pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_all_scores(shared.value, b["text"]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _all_scores(machine: Machine, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[scores(machine, data, offsets) for _, _, data, offsets in slices(column, 1 << 18)]])


def predict(docs: DataFrame, labels: DataFrame, learn: Callable[[], Column], threshold: float = 0.3) -> DataFrame:
    machine = train(docs, labels, "toxic", learn())
    return score(docs, machine).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = lambda: fold("doc_id", 4) != 2
    out = predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return out.select("doc_id", (~learn()).alias("held_out"), "score", "predicted")
