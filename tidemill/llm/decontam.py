"""Benchmark leaks by latent semantic retrieval.

1. Corpus statistics: in how many passages of ``WINDOW`` words each term occurs, over all texts. Terms are hashed to
   ``1 << BITS`` places, so the table has a fixed size; tasks count their texts and Spark adds the tables up by block.
2. The latent spaces: the vectors of the items (of items of more than ``WINDOW`` words, of their pieces: runs of ``STRIDE`` words,
   half overlapping, of which each lies whole in some window of a verbatim copy, and of which some piece keeps at least the share
   that the item does) are dealt to spaces of at most ``LOCAL``. Each space is a randomised singular value
   decomposition, of rank ``RANK``, of TF-IDF passages over the terms of its items: those of all passages of the corpus, and the items' own, which weigh ``BOOST`` times as much for
   each ``PASSAGES`` passages (so that the items' share of a space doesn't fall as the corpus grows). Tasks multiply their passages
   by a random sign matrix and by their own transpose, and Spark adds the products up; the driver sees a row for each of the
   space's terms, and has the axes by the Nystrom formula. So a space keeps the rare terms that tell its items, in the corpus' own directions.
3. Search: every window of every text (two cells of ``STRIDE`` words, half overlapping) is projected on each space. It is a candidate
   for an item if its latent product with it reaches ``reach`` of the most it could be for vectors of those two lengths (less where an item
   does not fit into a window whole). What the axes leave out of an item is known exactly, and a bound of what that may
   add is granted, so that no window is lost to the rank; the exact product is the first of the checks.
4. Checks on candidates: the longest common subsequence of the item's words and the window's surroundings must hold
   ``lcs`` of the item's words, and ``HEAVY`` of that share of their weight; the item may also stand there with its sentences or halves
   turned round. ``answer`` of the words of its last sentence (of as many as hold five words) must be there, in any order.
5. Items of fewer than ``least`` words are found only word for word.

Weights are the root of a term's count times its inverse passage frequency; a window's latent vector counts a repeated term in full, which
can only make it longer. The vectors of items and pieces are searched
in blocks of about ``ITEMS``, one pass over the corpus each, so that what is broadcast stays bounded however large the benchmark is.

Defined results: null and empty texts have no leaks, null and empty items are never found; a text with several items, or
an item that stands under several ids, gives a row for each pair of ids; repeated rows give one row; words are runs of
letters and digits, lower-cased; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.store import materialise, table
from tidemill.llm.store import texts as whole_texts
from tidemill.llm.words import distinct, mix, slices, words

BITS, WINDOW, STRIDE, RANK, OVER, LOCAL, ITEMS, BLOCKS = 18, 64, 32, 256, 16, 224, 1792, 64
#: Rows that are multiplied at once: so few that the products are too small for OpenBLAS to start (and wait in) threads.
TOGETHER = 8
PASSAGES, BOOST, HEAVY = 20_000, 100.0, 0.8
#: A task of the latent spaces sends an array of terms times axes, whatever it reads: it takes as many passages as this (some 50 MB), if all cores have tasks.
SHARE, SALTS = 1 << 17, 16
_PER_BLOCK = (1 << BITS) // BLOCKS
_SHIFT = np.uint64(64 - BITS)


class Item(NamedTuple):
    item_id: int | None
    words: np.ndarray  # hashes
    answer: np.ndarray  # distinct hashes of the last sentence (or sentences, to hold five words)
    turns: list[int]  # where the item may be turned round: its sentences' ends and its middle


class Space(NamedTuple):
    idf: np.ndarray  # by place
    known: np.ndarray  # places of the items' terms, sorted
    own: np.ndarray  # by known place: the hash of the one term there; 0 where several share the place
    axes: np.ndarray  # known places x rank
    items: list[Item]
    whose: np.ndarray  # vector to item
    need: np.ndarray  # by vector: the share of its squared length that a window must reach
    size: np.ndarray  # by vector: its length
    key: np.ndarray  # sorted (vector, place), and
    weight: np.ndarray  # the weight there
    latent: np.ndarray  # vectors x rank
    rest: np.ndarray  # by vector: the length of what the axes leave out of it
    short: dict[tuple[int, ...], list[int]]  # the words of short items, and which they are


def texts(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).withColumn("text", F.lower("text"))


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage, place) of each word, and the number of passages."""
    w = words(data, offsets)
    per = -(-np.diff(w.bounds) // WINDOW)
    doc = w.doc()
    return (np.cumsum(per) - per)[doc] + (np.arange(len(doc)) - w.bounds[doc]) // WINDOW, (w.hash >> _SHIFT).astype(np.int64), int(per.sum())


def add_blocks(df: DataFrame, name: str) -> dict[int, np.ndarray]:
    """The sum of zlib'd float64 arrays by block, added up in two steps so that no task gets more than a share of the tasks' arrays."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(p), "<f8") for p in t["payload"].to_pylist())
        return pa.table({"block": t["block"][:1], "salt": t["salt"][:1], "payload": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    shape = "block int, salt int, payload binary"
    some = materialise(df.groupBy("block", "salt").applyInArrow(add, shape), name)
    rows = some.withColumn("salt", F.lit(0)).groupBy("block", "salt").applyInArrow(add, shape).select("block", "payload").collect()
    return {r["block"]: np.frombuffer(zlib.decompress(r["payload"]), "<f8") for r in rows}


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    counts, n = np.zeros(1 << BITS), 0
    for b in batches:
        for _, _, data, offsets in slices(b["text"]):
            passage, place, more = passages(data, offsets)
            key = distinct(passage << BITS | place)
            counts += np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS)
            n += more
    salt = TaskContext.get().partitionId() % SALTS
    parts = [counts[k * _PER_BLOCK : (k + 1) * _PER_BLOCK] for k in range(BLOCKS)] + [np.array([float(n)])]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS + 1), pa.int32()), pa.array([salt] * (BLOCKS + 1), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["block", "salt", "payload"])


def inverse_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """By place the inverse passage frequency, and the number of passages."""
    got = add_blocks(texts(docs).select("text").mapInArrow(_counter, "block int, salt int, payload binary"), "frequencies")
    if not got:
        return np.full(1 << BITS, 1.0), 0
    return np.log((1 + got[BLOCKS][0]) / (1 + np.concatenate([got[k] for k in range(BLOCKS)]))) + 1e-3, int(got[BLOCKS][0])


def signs(place: np.ndarray, n: int) -> np.ndarray:
    """Rows of the random test matrix, made from the places alone."""
    key = (place.astype(np.uint64)[:, None] * np.uint64(n) + np.arange(n, dtype=np.uint64)[None, :]) + np.uint64(0x5851F42D4C957F2D)
    return np.where(mix(key) >> np.uint64(63), 1.0, -1.0)


def weights(place: np.ndarray, row: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, weight) of a sparse TF-IDF matrix."""
    key, count = np.unique(row << BITS | place, return_counts=True)
    place = key & ((1 << BITS) - 1)
    return key >> BITS, place, np.sqrt(count) * idf[place]


def slots(known: np.ndarray) -> np.ndarray:
    """By place its number among the known ones; -1 for others."""
    out = np.full(1 << BITS, -1, np.int32)
    out[known] = np.arange(len(known))
    return out


def _sketcher(idf, known: np.ndarray, n: int, salts: int):
    """Sums over the task's passages of their transpose times themselves times the random matrix, a row for each known place."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        omega, sums, slot = signs(known, n), None, slots(known)
        for b in batches:
            for _, _, data, offsets in slices(b["text"], 1 << 18):
                passage, place, count = passages(data, offsets)
                there = slot[place] >= 0
                passage, place = passage[there], place[there]
                if not count or not len(place):
                    continue
                row, place, x = weights(place, passage, idf.value)
                sums = np.zeros((len(known), n)) if sums is None else sums
                _add_products(sums, omega, row, slot[place], x)
        if sums is not None:
            salt, step = TaskContext.get().partitionId() % salts, max(1, -(-len(known) // BLOCKS))
            parts = [sums[k : k + step].ravel() for k in range(0, len(known), step)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["block", "salt", "payload"])

    return sketch


def _add_products(sums: np.ndarray, omega: np.ndarray, row: np.ndarray, slot: np.ndarray, x: np.ndarray) -> None:
    """Adds to ``sums`` the rows' transpose times themselves times ``omega``, for rows in ascending order.

    ``TOGETHER`` rows at a time are a small dense matrix over the terms they hold: no array of terms times axes is made.
    """
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff([*first, len(row)]))
    at, cuts = np.empty(len(sums), np.int64), [*first[::TOGETHER].tolist(), len(row)]
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        here = distinct(slot[s:e])
        at[here] = np.arange(len(here))
        some = np.zeros((of[e - 1] + 1 - k * TOGETHER, len(here)))
        some[of[s:e] - k * TOGETHER, at[slot[s:e]]] = x[s:e]
        sums[here] += some.T @ (some @ omega[here])


def latent_axes(corpus: DataFrame, tasks: int, idf, known: np.ndarray, row: np.ndarray, place: np.ndarray, v: np.ndarray, rank: int = RANK) -> np.ndarray:
    """known places x rank: the leading right singular vectors of the corpus' passages, read by so many tasks at most, and of the items' vectors (row, place, v)."""
    n = min(rank + OVER, len(known))
    got = add_blocks(corpus.coalesce(tasks).mapInArrow(_sketcher(idf, known, n, math.isqrt(tasks - 1) + 1), "block int, salt int, payload binary"), "latent")
    sums = np.concatenate([got[k] for k in sorted(got)]).reshape(-1, n) if got else np.zeros((len(known), n))
    omega = signs(known, n)
    _add_products(sums, omega, row, np.searchsorted(known, place), BOOST * v)
    core = omega.T @ sums
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value[-1], 0) * 1e-12
    if not good.any():
        return np.zeros((len(known), 1), np.float32)
    axes, strength, _ = np.linalg.svd(sums @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return np.ascontiguousarray(axes[:, :rank][:, strength[:rank] > 0], np.float32)


def read_items(bench: DataFrame) -> list[Item]:
    out = []
    for r in bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).collect():
        parts = [p for p in re.split(r"[.!?\n]+", r["text"]) if p.strip()]
        (_, _, data, offsets), *_ = slices(pa.array(["\n".join(parts), *parts]), 1 << 30)
        w = words(data, offsets)
        ends = np.cumsum(np.diff(w.bounds)[1:])
        n = int(w.bounds[1])
        turns = sorted({int(x) for x in [*ends, n // 2] if 0 < x < n})
        k = len(parts)
        while k > 1 and len(np.unique(w.hash[w.bounds[k] :])) < 5:
            k -= 1  # a last sentence of a word or two is not an answer by itself
        out.append(Item(r["item_id"], w.hash[:n], np.unique(w.hash[w.bounds[min(k, len(w.bounds) - 1)] :]), turns))
    return out


def pieces(n: int) -> list[int]:
    """Where the pieces of an item of n words begin; one that fits in a window has none."""
    return [*range(0, n - STRIDE, STRIDE // 2), n - STRIDE] if n > WINDOW else []


def project(axes: np.ndarray, slot: np.ndarray, weight: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n latent vectors: the sums of their terms' axes, for rows in ascending order."""
    out, at = np.zeros((n, axes.shape[1]), np.float32), np.empty(len(axes), np.int64)
    block = row // TOGETHER
    cuts = [*np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist(), len(row)] if len(row) else []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        here, begin = distinct(slot[s:e]), int(block[s]) * TOGETHER
        at[here] = np.arange(len(here))
        some = np.bincount((row[s:e] - begin) * len(here) + at[slot[s:e]], weight[s:e], TOGETHER * len(here)).astype(np.float32)
        out[begin : begin + TOGETHER] = (some.reshape(TOGETHER, -1) @ axes[here])[: n - begin]
    return out


def spaces(docs: DataFrame, bench: DataFrame, reach: float, lcs: float, least: int = 5) -> Iterator[list[Space]]:
    """The search's models, those of one block of items at a time."""
    bench = bench.select("item_id", F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    vectors = F.lit(2) + F.floor(F.size(F.split("text", r"[^\p{L}\p{Nd}]+")) / (STRIDE // 2))
    blocks = max(1, -(-(bench.agg(F.sum(vectors)).first()[0] or 0) // ITEMS))
    if bench.isEmpty():
        return
    spark = docs.sparkSession
    idf, total = inverse_frequencies(docs)
    shared = spark.sparkContext.broadcast(idf)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // SHARE))
    every, share = texts(docs).select("text"), max(1.0, total / PASSAGES) ** 0.5  # squares are added up
    for k in range(blocks):
        block = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items, made = [x for x in read_items(block) if len(x.words)], []
        short: dict[tuple[int, ...], list[Item]] = {}
        for x in items:
            if len(x.words) < least:
                short.setdefault(tuple(x.words.tolist()), []).append(x)
        long, held = [], 0
        for x in [x for x in items if len(x.words) >= least] + [None]:
            n = max(1, len(pieces(len(x.words)))) if x else 0
            if long and (x is None or held + n > LOCAL):
                made.append(_space(every, tasks, share, shared, idf, long, reach, lcs))
                long, held = [], 0
            if x:
                long.append(x)
                held += n
        if short:
            none = np.zeros(0)
            made.append(Space(idf, none, none, none, [x for each in short.values() for x in each], none, none, none, none, none, none, none, _numbered(short)))
        if made:
            yield made


def _numbered(short: dict[tuple[int, ...], list[Item]]) -> dict[tuple[int, ...], list[int]]:
    out, at = {}, 0
    for key, each in short.items():
        out[key] = list(range(at, at + len(each)))
        at += len(each)
    return out


def _space(corpus: DataFrame, tasks: int, share: float, shared, idf: np.ndarray, items: list[Item], reach: float, lcs: float) -> Space:
    """The latent space of some items, none of them short, whose vectors weigh ``share`` times ``BOOST``."""
    runs = [(i, x.words) for i, x in enumerate(items) if len(x.words) <= WINDOW]
    need = [reach * min(1.0, (WINDOW - STRIDE // 2) / len(x)) for _, x in runs]
    cut = [(i, x.words[p : p + STRIDE]) for i, x in enumerate(items) for p in pieces(len(x.words))]
    runs, need = runs + cut, np.array(need + [reach * lcs] * len(cut))
    terms = np.unique(np.concatenate([x.words for x in items]))
    at = (terms >> _SHIFT).astype(np.int64)
    known = np.unique(at)
    own = np.zeros(len(known), np.uint64)
    slot = np.searchsorted(known, at)
    own[slot] = terms
    own[np.bincount(slot, minlength=len(known)) > 1] = 0
    row, place, v = weights(np.concatenate([(x >> _SHIFT).astype(np.int64) for _, x in runs]), np.repeat(np.arange(len(runs)), [len(x) for _, x in runs]), idf)
    axes = latent_axes(corpus, tasks, shared, known, row, place, share * v)
    latent = project(axes, np.searchsorted(known, place), v, row, len(runs))
    size = np.sqrt(np.bincount(row, v**2, len(runs)))
    rest = np.sqrt(np.maximum(0, size**2 - (latent.astype(float) ** 2).sum(1)))
    return Space(idf, known, own, axes, items, np.array([i for i, _ in runs], int), need, size, row << BITS | place, v, latent, rest.astype(np.float32), {})


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, with a row of the table in the bits of one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def heaviest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """The largest weight (of a's words) of a common subsequence."""
    best = np.zeros(len(b) + 1)
    for x, w in zip(a.tolist(), weight.tolist(), strict=True):
        best[1:] = np.maximum(best[1:], np.where(b == x, best[:-1] + w, 0))
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def _exact(s: Space, w, found: dict) -> None:
    """Short items, word for word."""
    for n in {len(x) for x in s.short}:
        first = np.array([x[0] for x in s.short if len(x) == n], np.uint64)
        for i in np.flatnonzero(np.isin(w.hash, first)).tolist():
            d = int(np.searchsorted(w.bounds, i, side="right")) - 1
            if i + n <= w.bounds[d + 1]:
                for j in s.short.get(tuple(w.hash[i : i + n].tolist()), ()):
                    found[d, j] = (1.0, 1.0, 1.0)


def leaks(each: list[Space], data: np.ndarray, offsets: np.ndarray, lcs: float, answer: float) -> list[tuple[int, int | None, float, float, float]]:
    """(text, item_id, cosine, share of the item in order, share of its answer) of each leak."""
    w = words(data, offsets)
    if not len(w.hash):
        return []
    n_words = np.diff(w.bounds)
    place = (w.hash >> _SHIFT).astype(np.int64)
    weight = each[0].idf[place]
    # a window is two cells of STRIDE words, or as many as its text has
    cells = -(-n_words // STRIDE)
    first = np.cumsum(cells) - cells
    token_doc = w.doc()
    cell = first[token_doc] + (np.arange(len(token_doc)) - w.bounds[token_doc]) // STRIDE
    n_cells = int(cells.sum())
    mass = np.bincount(cell, weight**2, n_cells)
    per = np.where(n_words > WINDOW, 1 + -(-(n_words - WINDOW) // STRIDE), (n_words > 0).astype(int))
    doc = np.repeat(np.arange(len(per)), per)
    step = np.arange(len(doc)) - (np.cumsum(per) - per)[doc]
    begin = w.bounds[doc] + step * STRIDE
    end = np.minimum(begin + WINDOW, w.bounds[doc + 1])
    one, two = first[doc] + step, np.minimum(first[doc] + step + 1, first[doc] + cells[doc] - 1)
    twice = (two > one)[:, None]
    norm = np.sqrt(mass[one] + np.where(twice[:, 0], mass[two], 0)).astype(np.float32)
    out = []
    for s in each:
        found: dict[tuple[int, int], tuple] = {}
        if s.short:
            _exact(s, w, found)
        else:
            slot = slots(s.known)[place]
            known = (slot >= 0) & ((s.own[slot] == w.hash) | (s.own[slot] == 0))
            at = np.flatnonzero(known)
            latent_cells = project(s.axes, slot[at], weight[at], cell[at], n_cells)
            full, size = (s.need * s.size**2).astype(np.float32), (s.need * s.size).astype(np.float32)
            length = np.array([len(x.words) for x in s.items])
            # a term may stand WINDOW times in a window, which makes its vector at most that root longer than its length here
            rest = s.rest * WINDOW**0.5
            for i in range(0, len(doc), 1024):
                x, y, z = one[i : i + 1024], two[i : i + 1024], twice[i : i + 1024]
                near, here = (latent_cells[x] + latent_cells[y] * z) @ s.latent.T, norm[i : i + 1024, None]
                k, j = np.nonzero(near + here * rest >= np.minimum(full[None, :], here * size[None, :]) * (1 - 1e-3))
                for c in range(0, len(k), 4096):
                    _check(s, w, i + k[c : c + 4096], j[c : c + 4096], near[k[c : c + 4096], j[c : c + 4096]], begin, end, norm, place, known, length, lcs, answer, found, doc)
        out += [(d, s.items[i].item_id, *v) for (d, i), v in found.items()]
    return out


def _check(s: Space, w, q, j, near, begin, end, norm, place, known, length, lcs, answer, out, doc) -> None:
    """The checks on windows q as candidates for vectors j."""
    # the exact products of their weights: words of the window that the vector has
    n = end[q] - begin[q]
    pair = np.repeat(np.arange(len(q)), n)
    token = np.repeat(begin[q], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    keep = known[token]
    pair, token = pair[keep], token[keep]
    key, count = np.unique(pair << BITS | place[token], return_counts=True)
    pair, term = key >> BITS, key & ((1 << BITS) - 1)
    at = np.minimum(np.searchsorted(s.key, j[pair] << BITS | term), len(s.key) - 1)
    hit = s.key[at] == j[pair] << BITS | term
    dot = np.bincount(pair[hit], s.weight[at[hit]] * np.sqrt(count[hit]) * s.idf[term[hit]], len(q))
    ok = dot >= s.need[j] * np.minimum(s.size[j] ** 2, norm[q] * s.size[j]) * (1 - 1e-6)
    q, item, cosine = q[ok], s.whose[j[ok]], np.minimum(1.0, near / np.maximum(norm[q] * s.size[j], 1e-9))[ok]
    d = doc[q]
    x0, x1 = np.maximum(w.bounds[d], begin[q] - length[item] // 2), np.minimum(w.bounds[d + 1], end[q] + length[item] // 2)
    fits = x1 - x0 >= lcs * length[item]
    seen = set()
    for d, i, x0, x1, cosine in zip(*(x[fits].tolist() for x in (d, item, x0, x1, cosine)), strict=True):
        if (d, i, x0, x1) in seen:
            continue
        seen.add((d, i, x0, x1))
        x, near = s.items[i], w.hash[x0:x1]
        # no more words can stand in order than are there at all
        around = set(near.tolist())
        there = np.array([v in around for v in x.words.tolist()])
        if there.mean() < lcs:
            continue
        got = sum(v in around for v in x.answer.tolist()) / len(x.answer) if len(x.answer) else 1.0
        if got < answer:
            continue
        weight = s.idf[(x.words >> _SHIFT).astype(np.int64)]
        if weight[there].sum() < HEAVY * lcs * weight.sum():
            continue
        best = 0.0
        for turn in (0, *x.turns):
            order = np.roll(np.arange(len(x.words)), -turn)
            share = subsequence(x.words[order], near) / len(x.words)
            if share >= lcs and share > best and heaviest(x.words[order], near, weight[order]) >= HEAVY * lcs * weight.sum():
                best = share
            if best and not turn:
                break
        if best:
            found = (float(cosine), best, float(got))
            out[d, i] = max(found, out.get((d, i), found))


REACH, LCS, ANSWER = 0.4, 0.45, 0.3


def find_leaks(docs: DataFrame, bench: DataFrame, reach: float = REACH, lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer of every leak."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, cosine double, lcs double, answer double"
    out = spark.createDataFrame([], schema)
    for some in spaces(docs, bench, reach, lcs):
        shared = spark.sparkContext.broadcast(some)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, rows = b["doc_id"].to_pylist(), []
                for i, _, data, offsets in slices(b["text"]):
                    rows += [(ids[i + d], *rest) for d, *rest in leaks(shared.value, data, offsets, lcs, answer)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.float64()) for k in range(5)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        out = out.unionByName(texts(docs).mapInArrow(search, schema))
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs", "answer")])


def without_leaks(docs: DataFrame, bench: DataFrame, reach: float = REACH, lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found."""
    for some in spaces(docs, bench, reach, lcs):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mask = np.ones(b.num_rows, dtype=bool)
                for i, _, data, offsets in slices(b["lowered@"]):
                    for d, *_ in leaks(shared.value, data, offsets, lcs, answer):
                        mask[i + d] = False
                yield b.select(b.schema.names[:-1]).filter(pa.array(mask))

        docs = docs.withColumn("lowered@", F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).mapInArrow(keep, docs.schema)
    return docs


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
