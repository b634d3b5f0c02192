"""Near copies: an n-gram Jaccard join whose candidates are pruned by Bayesian inference on MinHash values.

A text is the set of its runs of five words (lower-cased A-Z, split at white space; a shorter text is one run). Texts
with the same words in the same order (by a digest of 128 bits) form a class, and only classes are compared. ``HASHES`` MinHash values a class,
cut into bands, bring classes into buckets. Within a bucket two classes' values are compared a few at a time: with a
uniform prior, m agreements in n make the chance that their similarity reaches the threshold P(Bin(n + 1, t) <= m),
and the pair is dropped when that falls below the tolerance. What is left is verified on the whole texts' sets.

Large buckets are cut into blocks and every pair of blocks is a piece of work of its own, so that no group meets in one
task. A pair belongs to the first band it shares. Pieces hand on, for each class, which of the piece's other classes
are still candidates, and after verification only each class's number of links and one link to its local group: pairs
never become rows.

Defined results: a null text is an empty one; a text without words links with nothing; equal texts of a few words link;
a repeated doc_id is one document for each row. A row without doc_id is compared too, but names no class or component
while there is a row with one. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.graph import local_groups, memberships
from tidemill.llm.store import materialise, table, texts
from tidemill.llm.words import NOT_SPACE, distinct, grams, mix, slices, words

BANDS, ROWS, STEP, BLOCK = 24, 4, 16, 256
FEW = 200_000  # rows of some 50 bytes that may be broadcast
HASHES = BANDS * ROWS
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, n: int, most: int = (1 << 19) - 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of runs of texts: shingle hashes and bounds."""
    for _, _, data, offsets in slices(column, most):
        w = words(data, offsets, NOT_SPACE)
        yield grams(w.hash, w.bounds, n)


def fingerprints(column: pa.Array) -> list[bytes]:
    """A cryptographic digest of each text's words, lower-cased A-Z, in their order."""
    return [blake2b(b" ".join(t.as_py().encode().lower().split()), digest_size=16).digest() for t in column]


def signatures(g: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """HASHES 16-bit digests of the texts' MinHash values; None for a text without words."""
    there = np.flatnonzero(np.diff(bounds))
    sig = np.zeros((len(bounds) - 1, HASHES), "<u2")
    if len(there):
        for k in range(HASHES):
            least = np.minimum.reduceat((g ^ _XOR[k]) * _MUL[k], bounds[:-1][there])
            sig[there, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    full = set(there.tolist())
    return [sig[i].tobytes() if i in full else None for i in range(len(sig))]


def _signer(n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sigs = fingerprints(b["text"]), []
            for g, gb in shingles(b["text"], n):
                sigs += signatures(g, gb)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "row", "fp", "sig"])

    return sign


def needed(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, a multiple of STEP: the fewest agreements that keep a pair."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of equal keys, several at a time, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if held and (cut or held[-1][key][-1].as_py() != k[0]):
            if cut == 0:
                yield pa.Table.from_batches(held)
                held = [b]
                continue
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _pruner(need: list[int], most: int = 16_384):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "piece"):
            t = t.combine_chunks()
            piece, side, band = (t[c].to_numpy() for c in ("piece", "side", "band"))
            n = len(piece)
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(n, HASHES)
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            start = np.repeat(first, np.diff([*first, n]))
            end = np.repeat([*first[1:], n], np.diff([*first, n]))
            right = np.add.reduceat(side == 1, first).repeat(np.diff([*first, n]))  # rows of the second side, last in their run
            whole = np.repeat(t["whole"].to_numpy()[first], np.diff([*first, n]))
            lo = np.where(whole, np.arange(n) + 1, np.where(side == 0, end - right, end))
            count = end - lo
            ends = np.cumsum(count)
            kept_l, kept_r, i = [], [], 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
                c = count[i:j]
                left = np.repeat(np.arange(i, j), c)
                other = np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[i:j], c)
                same = np.zeros(len(left), np.int64)
                for k, least in enumerate(need):
                    s = slice(k * STEP, (k + 1) * STEP)
                    same += (sig[left, s] == sig[other, s]).sum(1)
                    ok = same >= least
                    left, other, same = left[ok], other[ok], same[ok]
                if len(left):
                    eq = (sig[left] == sig[other]).reshape(-1, BANDS, ROWS).all(2)
                    ok = eq.argmax(1) == band[left]
                    kept_l.append(left[ok])
                    kept_r.append(other[ok])
                i = j
            left, other = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (kept_l, kept_r))
            if not len(left):
                continue
            used = np.unique(np.concatenate([left, other]))
            cut = np.searchsorted(left, used), np.searchsorted(left, used, side="right")
            rel = (other - start[other]).astype("<u4")
            out = t.take(pa.array(used)).select(["piece", "fp", "n"])
            out = out.append_column("place", pa.array(used - start[used], pa.int32())).append_column("others", pa.array([rel[a:b].tobytes() for a, b in zip(*cut, strict=True)], pa.binary()))
            yield from out.combine_chunks().to_batches()

    return prune


def _verifier(n: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "piece"):
            piece, place = t["piece"].to_numpy(), t["place"].to_numpy()
            fps, counts, others = t["fp"].to_pylist(), t["n"].to_numpy(), t["others"].to_pylist()
            sets: list[np.ndarray] = []
            for g, gb in shingles(t["text"].combine_chunks(), n):
                sets += [distinct(g[a:b]) for a, b in zip(gb[:-1], gb[1:], strict=True)]
            cuts = [*np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])), len(piece)]
            out: dict[str, list] = {"fp": [], "links": [], "anchor": []}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = {int(place[i]): i for i in range(a, b)}
                rows = sorted(at.values(), key=lambda i: place[i])
                index = {i: k for k, i in enumerate(rows)}
                pairs = [(index[i], index[at[int(p)]]) for i in rows for p in np.frombuffer(others[i], "<u4") if int(p) in at]
                if not pairs:
                    continue
                shared = common([sets[i] for i in rows], np.array(pairs))
                size = np.array([len(sets[i]) for i in rows])
                left, right = np.array(pairs).T
                ok = shared >= threshold * (size[left] + size[right] - shared) - 1e-9
                left, right = left[ok], right[ok]
                cls = counts[rows]
                links = np.bincount(left, cls[right], len(rows)) + np.bincount(right, cls[left], len(rows))
                root = local_groups(len(rows), left, right)
                for k in np.flatnonzero(links):
                    out["fp"].append(fps[rows[k]])
                    out["links"].append(int(links[k]))
                    out["anchor"].append(fps[rows[root[k]]])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("fp", pa.binary()), ("links", pa.int64()), ("anchor", pa.binary())]))

    return verify


def common(sets: list[np.ndarray], pairs: np.ndarray, wide: int = 2048) -> np.ndarray:
    """The number of elements that the two sets of each pair share."""
    if len(pairs) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(times > 1) - 1  # only what two sets hold can be shared
    on = times[where] > 1
    owner, where = owner[on], column[where[on]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int((times > 1).sum()), wide):
        a, b = np.searchsorted(where, [c, c + wide])
        hit = np.zeros((len(sets), wide), np.float32)
        hit[owner[a:b], where[a:b] - c] = 1
        total += hit @ hit.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row for each of ``docs``: doc_id, row (a hash of its text), class_id, n_links, component_id, kept."""
    base = texts(docs).withColumn("row", F.xxhash64("text"))
    signed = materialise(base.mapInArrow(_signer(n), "doc_id long, row long, fp binary, sig binary"), "signatures")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))  # the row whose text stands for the class
    classes = signed.where("sig is not null").groupBy("fp").agg(one.alias("one"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
    classes = materialise(classes.select("fp", "one.doc_id", "one.row", "n", "sig"), "classes")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.expr("sig").substr(b * 2 * ROWS + 1, F.lit(2 * ROWS))))
    banded = classes.select("fp", F.posexplode(band).alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = banded.join(full, "bucket").join(classes, "fp")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    member = member.withColumn("mine", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    member = member.select(
        F.xxhash64("bucket", "band", F.least("mine", "with"), F.greatest("mine", "with")).alias("piece"),
        (F.col("mine") > F.col("with")).cast("int").alias("side"),
        (F.col("mine") == F.col("with")).alias("whole"),
        "band", "fp", "n", "sig",
    )
    pieces = member.repartition("piece").sortWithinPartitions("piece", "side", "fp")
    pruned = pieces.mapInArrow(_pruner(needed(threshold, tolerance)), "piece long, fp binary, n long, place int, others binary")
    pruned = materialise(pruned, "candidates")

    # one text for each class that has a candidate: its row's, found by id and text
    wanted = materialise(pruned.select("fp").distinct().join(classes, "fp").select("fp", F.col("doc_id").alias("id"), F.col("row").alias("text_row")), "wanted")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    whole = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("text_row"))).select("fp", "text").dropDuplicates(["fp"])
    work = pruned.join(materialise(whole, "texts"), "fp")
    work = work.select("piece", "place", "fp", "n", "others", "text").repartition("piece").sortWithinPartitions("piece", "place")
    verified = materialise(work.mapInArrow(_verifier(n, threshold), "fp binary, links long, anchor binary"), "links")

    out = memberships(signed.drop("sig"), classes.select("fp", "doc_id", "n"), verified, "doc_id")
    return out.select("doc_id", "row", "class_id", "n_links", "component_id", "kept")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group of near copies."""
    found = materialise(near_copies(docs), "near")
    key = ["doc_id", "row"]
    again = found.where("kept").groupBy(*key).count().where("count > 1").select(*key)  # repeated rows: one stays
    drop = found.where("not kept").select(*key).distinct()
    marked = docs.withColumns({"row@": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), "id@": F.col("doc_id").cast("long")})
    on = lambda d: [F.col("row@") == d["row"], F.col("id@").eqNullSafe(d["doc_id"])]
    drop, again = (d.toDF("doc_id", "row") for d in (drop, again))
    once = marked.join(again, on(again), "left_semi").dropDuplicates(["id@", "text"])
    both = drop.unionByName(again)
    return marked.join(both, on(both), "left_anti").unionByName(once).drop("row@", "id@")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).drop("row")


OP8_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i >= 0.8 * (x.n + y.n - i) - 1e-9),
r AS (SELECT doc_id AS node, doc_id AS near FROM t UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.near),
c AS (SELECT node, min(near) AS component_id FROM r GROUP BY 1)
SELECT t.doc_id, CASE WHEN len(w) = 0 THEN t.doc_id ELSE min(t.doc_id) OVER (PARTITION BY w) END AS class_id, (SELECT count(*) FROM l WHERE a = t.doc_id) AS n_links, component_id, t.doc_id = component_id AS kept
FROM t JOIN c ON c.node = t.doc_id
"""
