"""Language-model scores by deleted interpolation of bigrams.

    p(w | h) = a[b] c(h, w) / c(h)  +  u[b] c(w) / N  +  z[b] / (V + 1)

b is the bucket of c(h) by powers of two; each bucket's three weights are learned by expectation-maximisation on
held-out counts: one fold of the training texts is left out of the counts (deleted) and explained by the rest. Scores
then use the counts of all training texts. Words are lower-cased A-Z, split at white space; every text ends in an end
token and starts from a start context.

How it runs: texts are packed into blocks of some megabytes. A block asks for its distinct words and bigrams, sorted by
hash and cut by hash range; a range's group adds up all blocks' counts and answers each block in the order asked. So a
word costs a few bytes for each block that has it, not for each time it occurs, and a word however frequent is one entry
a block. More than ``FAN`` blocks ask in two steps: teams of some ``FAN`` blocks merge their questions for each of ``FAN`` parts of
the hashes, and ask in turn by finer parts, so that neither the rows exchanged nor a group's size grow with the square of the corpus. Blocks and answers meet by block to learn the weights (fold blocks only) and to score. For the weights, tasks
count the fold's tokens by bucket and by both probabilities, rounded to an eighth of an octave; expectation-maximisation
runs on those counts, in a task for each bucket. Scores use unrounded probabilities. Words are told apart by
64-bit hashes; bigrams by as many bits as the corpus' size calls for, so that about one in 2**14 shares a count by chance.

Defined results: a null text is an empty one and is scored as its end token alone; a null id counts as an empty text in
the fold; repeated rows count and are scored each; without training texts N = V = 0 and every token has probability 1;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.store import fold, materialise, table, texts
from tidemill.llm.words import NOT_SPACE, mix, slices, words

PACK, TEXTS, FAN = 24 << 20, 1 << 17, 1024
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
BINS, BUCKETS = 8, 40
BLOCK = "block long, deleted boolean, ids array<long>, train array<boolean>, sizes array<long>, payload binary"


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made, kinds = TaskContext.get().partitionId(), 0, [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
    held: dict[bool, list] = {False: [[], [], [], []], True: [[], [], [], []]}
    size = {False: 0, True: 0}

    def flush(deleted: bool) -> pa.RecordBatch:
        nonlocal made
        ids, train, sizes, parts = held[deleted]
        held[deleted] = [[], [], [], []]
        row = [part << 32 | made, deleted, ids, train, sizes, zstandard.ZstdCompressor(level=3).compress(b"".join(parts))]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["block", "deleted", "ids", "train", "sizes", "payload"])

    for b in batches:
        for d, t, tr, de in zip(*[b[c].to_pylist() for c in ("doc_id", "text", "train", "deleted")], strict=True):
            raw = t.encode()
            for box, v in zip(held[de], (d, tr, len(raw), raw), strict=True):
                box.append(v)
            size[de] += len(raw)
            if size[de] >= PACK or len(held[de][0]) >= TEXTS:
                size[de] = 0
                yield flush(de)
    for de in (False, True):
        if held[de][0]:
            yield flush(de)


class Tokens(NamedTuple):
    word: np.ndarray  # hash of every token, end tokens included
    before: np.ndarray  # the hash before it
    bounds: np.ndarray  # of texts


def tokens(payload: bytes, sizes: list[int]) -> Tokens:
    raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, sum(sizes)))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    word, counts = [], []
    for _, _, data, cut in slices(column):
        w = words(data, cut, NOT_SPACE)
        word.append(np.insert(w.hash, w.bounds[1:], END))
        counts.append(np.diff(w.bounds) + 1)
    word, bounds = np.concatenate(word), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[bounds[:-1]] = START
    return Tokens(word, before, bounds)


def bigram(t: Tokens, bits: int) -> np.ndarray:
    return mix(t.before * np.uint64(0x9E3779B97F4A7C15) ^ t.word) >> np.uint64(64 - bits)


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes: how many, how many planes, then a zstandard frame of them."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(6, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:6], "little"), raw[6]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[7:]), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def sorted_keys(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def _asker(bits: int, ranges: int):
    kinds = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("deleted", pa.bool_()), *[(c, pa.binary()) for c in ("words", "word_n", "pairs", "pair_n")]])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = tokens(r["payload"], r["sizes"])
                counted = np.repeat(np.array(r["train"]), np.diff(t.bounds))
                columns: list[list] = [[], [], [], []]
                for at, (key, width) in enumerate(((t.word, 64), (bigram(t, bits), bits))):
                    u, inverse = np.unique(key, return_inverse=True)
                    n = np.bincount(inverse[counted], minlength=len(u))
                    cuts = np.searchsorted(u, np.array([(k << width) // ranges for k in range(1, ranges)], np.uint64))
                    for x, y in zip([0, *cuts], [*cuts, len(u)], strict=True):
                        columns[2 * at].append(sorted_keys(u[x:y]))
                        columns[2 * at + 1].append(squeeze(n[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([r["block"]] * ranges), pa.array([r["deleted"]] * ranges), *[pa.array(c, pa.binary()) for c in columns]], schema=kinds)

    return ask


ANSWER = "part int, block long, word_all binary, pair_all binary, word_kept binary, pair_kept binary, n long, n_kept long, v long"


def answer(t: pa.Table) -> pa.Table:
    """All counts, and for blocks of deleted texts those of the other training texts, in the order that each block asked."""
    blocks, deleted = t["block"].to_pylist(), np.array(t["deleted"].to_pylist())
    out: dict[str, list] = {"part": t["part"].to_pylist(), "block": blocks}
    sums = {}
    for what in ("word", "pair"):
        keys = [np.cumsum(expand(x), dtype=np.uint64) for x in t[f"{what}s"].to_pylist()]
        n = [expand(x).astype(np.int64) for x in t[f"{what}_n"].to_pylist()]
        size = np.array([len(k) for k in keys])
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        every, gone = np.concatenate(n), np.repeat(deleted, size)
        total = np.bincount(inverse, every, len(u)).astype(np.int64)
        kept = total - np.bincount(inverse[gone], every[gone], len(u)).astype(np.int64)
        sums[what] = int(total.sum()), int(kept.sum()), int((total > 0).sum())
        ends = np.cumsum(size)
        out[f"{what}_all"] = [squeeze(total[inverse[e - s : e]]) for s, e in zip(size, ends, strict=True)]
        out[f"{what}_kept"] = [squeeze(kept[inverse[e - s : e]]) if d else None for s, e, d in zip(size, ends, deleted, strict=True)]
    first = [i == 0 for i in range(len(blocks))]
    for k, name in enumerate(("n", "n_kept", "v")):
        out[name] = [sums["word"][k] if f else 0 for f in first]
    return pa.table({c: pa.array(out[c], pa.binary() if "_all" in c or "_kept" in c and c != "n_kept" else pa.int32() if c == "part" else pa.int64()) for c in [x.split()[0] for x in ANSWER.split(", ")]})


MERGED = "kind int, team long, part int, fine long, block long, deleted boolean, word_key binary, word_all binary, word_gone binary, pair_key binary, pair_all binary, pair_gone binary"
TOTAL = "team long, part int, fine long, word_all binary, pair_all binary, word_kept binary, pair_kept binary, n long, n_kept long, v long"


def _table(rows: list[dict], shape: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.table({c: pa.array([r.get(c) for r in rows], kinds[t]) for c, t in (x.split() for x in shape.split(", "))})


def _merger(bits: int, parts: int, fine: int):
    """For a team of blocks and a part of the keys: each block's places among the team's keys (kind 0), and the team's own questions by finer parts (kind 1)."""

    def merge(t: pa.Table) -> pa.Table:
        blocks, deleted = t["block"].to_pylist(), np.array(t["deleted"].to_pylist())
        team, part = t["team"][0].as_py(), t["part"][0].as_py()
        routes = [{"kind": 0, "team": team, "part": part, "block": b, "deleted": bool(d)} for b, d in zip(blocks, deleted, strict=True)]
        asks = [{"kind": 1, "team": team, "part": part, "fine": part * fine + j} for j in range(fine)]
        for what, width in (("word", 64), ("pair", bits)):
            keys = [np.cumsum(expand(x), dtype=np.uint64) for x in t[f"{what}s"].to_pylist()]
            n = np.concatenate([expand(x).astype(np.int64) for x in t[f"{what}_n"].to_pylist()])
            size = np.array([len(k) for k in keys])
            u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            gone = np.repeat(deleted, size)
            every, less = np.bincount(inverse, n, len(u)).astype(np.int64), np.bincount(inverse[gone], n[gone], len(u)).astype(np.int64)
            for r, e, z in zip(routes, np.cumsum(size), size, strict=True):
                r[f"{what}_key"] = sorted_keys(inverse[e - z : e].astype(np.uint64))
            cuts = np.searchsorted(u, np.array([((part * fine + j) << width) // (parts * fine) for j in range(1, fine)], np.uint64))
            for r, x, y in zip(asks, [0, *cuts], [*cuts, len(u)], strict=True):
                r |= {f"{what}_key": sorted_keys(u[x:y]), f"{what}_all": squeeze(every[x:y]), f"{what}_gone": squeeze(less[x:y])}
        return _table(routes + asks, MERGED)

    return merge


def total(t: pa.Table) -> pa.Table:
    """The teams' questions of one finer part, added up and answered in the order asked."""
    out = [{"team": a, "part": p, "fine": f, "n": 0, "n_kept": 0, "v": 0} for a, p, f in zip(*[t[c].to_pylist() for c in ("team", "part", "fine")], strict=True)]
    for what in ("word", "pair"):
        keys = [np.cumsum(expand(x), dtype=np.uint64) for x in t[f"{what}_key"].to_pylist()]
        size = np.array([len(k) for k in keys])
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        every, less = (np.bincount(inverse, np.concatenate([expand(x).astype(np.int64) for x in t[f"{what}_{c}"].to_pylist()]), len(u)).astype(np.int64) for c in ("all", "gone"))
        if what == "word":
            out[0] |= {"n": int(every.sum()), "n_kept": int((every - less).sum()), "v": int((every > 0).sum())}
        for r, e, z in zip(out, np.cumsum(size), size, strict=True):
            at = inverse[e - z : e]
            r |= {f"{what}_all": squeeze(every[at]), f"{what}_kept": squeeze((every - less)[at])}
    return _table(out, TOTAL)


def hand_back(routes: pa.Table, totals: pa.Table) -> pa.Table:
    """A team's answers, dealt to its blocks by their places."""
    if not routes.num_rows:
        return _table([], ANSWER)
    totals = totals.sort_by("fine")
    out = [{"part": p, "block": b, "n": 0, "n_kept": 0, "v": 0} for p, b in zip(routes["part"].to_pylist(), routes["block"].to_pylist(), strict=True)]
    for what in ("word", "pair"):
        for which in ("all", "kept"):
            known = np.concatenate([expand(x) for x in totals[f"{what}_{which}"].to_pylist()])
            for r, at, deleted in zip(out, routes[f"{what}_key"].to_pylist(), routes["deleted"].to_pylist(), strict=True):
                if which == "all" or deleted:
                    r[f"{what}_{which}"] = squeeze(known[np.cumsum(expand(at), dtype=np.uint64).astype(np.int64)])
    return _table(out, ANSWER)


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by powers of two."""
    return np.minimum(np.frexp(c.astype(float))[1] * (c > 0), BUCKETS - 1)


def counts_of(block: dict, answers: pa.Table, bits: int, which: str) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """The block's tokens, and of each: c(h), c(h, w), c(w)."""
    t = tokens(block["payload"], block["sizes"])
    order = np.argsort(answers["part"].to_numpy())
    got = {}
    for what, key in (("word", t.word), ("pair", bigram(t, bits))):
        column = answers[f"{what}_{which}"]
        n = np.concatenate([expand(column[int(i)].as_py()) for i in order]).astype(np.int64)
        got[what] = n[np.unique(key, return_inverse=True)[1]]
    c_before = np.empty_like(got["word"])
    c_before[1:] = got["word"][:-1]
    ends = got["word"][t.bounds[1:] - 1]  # every text has one end and one start
    c_before[t.bounds[:-1]] = ends
    return t, c_before, got["pair"], got["word"]


def _log_bins(p: np.ndarray) -> np.ndarray:
    out = np.full(len(p), 1, np.int64)  # 1: none; others are at most 0
    out[p > 0] = np.round(BINS * np.log2(p[p > 0])).astype(np.int64)
    return out


def _held_out(bits: int, n_kept: int):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"b": [], "i": [], "j": [], "n": []}
        for r in packs.to_pylist():
            t, ch, chw, cw = counts_of(r, answers, bits, "kept")
            code = np.stack([bucket(ch), _log_bins(chw / np.maximum(ch, 1)), _log_bins(cw / max(n_kept, 1))], axis=1)
            rows, n = np.unique(code, axis=0, return_counts=True)
            for k, c in enumerate("bij"):
                out[c] += rows[:, k].tolist()
            out["n"] += n.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def learn_weights(hist: np.ndarray, v: int, rounds: int = 200, least: float = 1e-4) -> np.ndarray:
    """Weights (bucket x 3) by expectation-maximisation on a histogram of (bucket, bigram bin, word bin, count)."""
    prior = np.array([0.3, 0.6, 0.1])
    out = np.tile(prior, (BUCKETS, 1))
    p = lambda x: np.where(x == 1, 0.0, 2.0 ** (np.minimum(x, 0) / BINS))
    for b in range(BUCKETS):
        h = hist[hist[:, 0] == b] if len(hist) else hist
        w = prior.copy()
        if len(h):
            q, n = np.stack([p(h[:, 1]), p(h[:, 2]), np.full(len(h), 1 / (v + 1))], axis=1), h[:, 3].astype(float)
            for _ in range(rounds):
                part = w * q
                new = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
                done = abs(new - w).max() < 1e-7
                w = new
                if done:
                    break
        w = np.maximum(w, least)
        if b == 0:
            w[0] = 0.0  # an unseen context says nothing
        out[b] = w / w.sum()
    return out


def _learner(v: int):
    def learn(t: pa.Table) -> pa.Table:
        hist = np.stack([t[c].to_numpy() for c in "bijn"], axis=1)
        hist = hist[np.lexsort(hist.T[:3])]
        b = int(hist[0, 0])
        return pa.table({"b": pa.array([b] * 3, pa.int64()), "k": pa.array(range(3), pa.int64()), "w": learn_weights(hist, v)[b]})

    return learn


SCORE = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scorer(bits: int, n: int, v: int, weights: np.ndarray):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for r in packs.to_pylist():
            t, ch, chw, cw = counts_of(r, answers, bits, "all")
            w = weights[bucket(ch)]
            p = w[:, 0] * chw / np.maximum(ch, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] / (v + 1)
            add = lambda x: np.add.reduceat(x, t.bounds[:-1])  # noqa: B023, E731
            columns = [np.diff(t.bounds), add((cw > 0).astype(np.int64)), add(np.log10((cw + 1) / (n + v + 1))), add(np.log10(p))]
            out.append(pa.table([pa.array(r["ids"], pa.int64()), *[pa.array(c) for c in columns]], [x.split()[0] for x in SCORE.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({x.split()[0]: pa.array([], pa.float64() if "double" in x else pa.int64()) for x in SCORE.split(", ")})

    return run


def language_scores(docs: DataFrame, train: Column, deleted: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score; ``train`` and ``deleted`` tell rows by doc_id."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = texts(docs).withColumns({"train": yes(train), "deleted": yes(train & deleted)})
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(62, 14 + max(16, int(size).bit_length()))
    ranges = max(8, -(-size // (PACK // 2)))
    packs = materialise(rows.mapInArrow(_packer, BLOCK), "packs", compression="uncompressed")
    by = lambda df, *key: df.repartition(tasks, *key)
    # as many tasks as ranges or blocks call for, so that a task's share stays the same however large the corpus is
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 4)
    asking = "part int, block long, deleted boolean, words binary, word_n binary, pairs binary, pair_n binary"
    count = packs.count()
    if count <= FAN:
        asked = packs.mapInArrow(_asker(bits, ranges), asking)
        answers = materialise(by(asked, "part").groupBy("part").applyInArrow(answer, ANSWER), "counts", compression="uncompressed")
        sums = answers
    else:
        # in two steps: blocks ask in teams, and teams ask by finer parts
        parts = min(FAN, ranges)
        asked = packs.mapInArrow(_asker(bits, parts), asking).withColumn("team", F.pmod(F.xxhash64("block"), F.lit(-(-count // FAN))))
        merged = materialise(by(asked, "team", "part").groupBy("team", "part").applyInArrow(_merger(bits, parts, -(-ranges // parts)), MERGED), "merged", compression="uncompressed")
        sums = materialise(by(merged.where("kind = 1"), "fine").groupBy("fine").applyInArrow(total, TOTAL), "totals", compression="uncompressed")
        answers = by(merged.where("kind = 0"), "team", "part").groupBy("team", "part").cogroup(by(sums, "team", "part").groupBy("team", "part")).applyInArrow(hand_back, ANSWER)
        answers = materialise(answers, "counts", compression="uncompressed")
    n, n_kept, v = (x or 0 for x in sums.agg(F.sum("n"), F.sum("n_kept"), F.sum("v")).first())

    kept = answers.where("word_kept is not null").select("part", "block", "word_kept", "pair_kept")
    hist = by(packs.where("deleted"), "block").groupBy("block").cogroup(by(kept, "block").groupBy("block")).applyInArrow(_held_out(bits, n_kept), "b long, i long, j long, n long")
    learned = hist.groupBy("b", "i", "j").agg(F.sum("n").alias("n")).groupBy("b").applyInArrow(_learner(v), "b long, k long, w double").collect()  # three numbers a bucket
    weights = learn_weights(np.zeros((0, 4)), v)
    for r in learned:
        weights[r["b"], r["k"]] = r["w"]

    every = answers.select("part", "block", "word_all", "pair_all")
    out = by(packs, "block").groupBy("block").cogroup(by(every, "block").groupBy("block")).applyInArrow(_scorer(bits, n, v, weights), SCORE)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    out = language_scores(table(spark, sf_dir, "documents"), ~held_out, fold("doc_id", 7) == 3)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
