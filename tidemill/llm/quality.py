"""Quality by compression: two zstandard dictionaries, built from good and from bad labelled texts.

A text is compressed in pieces of ``PIECE`` bytes with either dictionary. The difference of the two sizes, divided by
the text's length, says which class's material it resembles; a rising curve, fitted on other labelled texts by isotonic
regression, makes it a probability.

Learning takes a bounded sample: ``max_rows`` labelled rows a class (by smallest hash of the id), half of them for the
dictionaries, half for the curve. Scoring reads every text as a whole in Arrow batches; the dictionaries (``SIZE`` bytes
each) are broadcast.

Defined results: a null text is an empty one; an empty text has difference 0 and gets the curve's value there. Repeated
labels of an id count as 1 if any is 1. With labels of one class or none, every score is the share of 1 (0 if none).
Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.store import fold, table, texts
from tidemill.llm.toxicity import sample

PIECE, SIZE, LEVEL = 2048, 112_640, 3


class Classifier(NamedTuple):
    good: bytes
    bad: bytes
    x: np.ndarray  # rising differences, and the probability at each; between them it is interpolated
    p: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.p)


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def spaced(text: bytes, each: int = 4) -> list[bytes]:
    """Up to ``each`` evenly spaced pieces, so that long texts don't fill a dictionary."""
    p = pieces(text)
    return [p[i * len(p) // each] for i in range(each)] if len(p) > each else p


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["y"], pa.array([spaced(t.encode()) for t in b["text"].to_pylist()], pa.list_(pa.binary()))], ["y", "pieces"])


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on pieces of texts; of samples too small to train on, the bytes."""
    try:
        return zstandard.train_dictionary(SIZE, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-SIZE:]


def compressor(dictionary_: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary_)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def differences(column: pa.Array, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """By how many bytes a byte of text the bad dictionary serves worse than the good one."""
    out = np.zeros(len(column))
    for i, x in enumerate(column):
        text = x.as_py().encode()
        out[i] = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text)) / max(1, len(text))
    return out


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: pools of sorted points whose weighted means rise, at their weighted centres."""
    pools: list[list[float]] = []  # weight, weight * y, weight * x
    for i in np.argsort(x, kind="stable"):
        pools.append([weight[i], weight[i] * y[i], weight[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    w, wy, wx = np.array(pools).T
    return wx / w, np.clip(wy / w, 1e-3, 1 - 1e-3)


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int = 3000) -> Classifier:
    known = labels.where(learn & F.col(label).isNotNull())
    counts = dict(known.groupBy((F.col(label) == 1).cast("int").alias("y")).count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = sample(docs, labels, label, learn, max_rows).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    flat = Classifier(b"", b"", np.zeros(1), np.array([share]))
    base = {0: [], 1: []}
    # four pieces a row at most come to the driver
    for r in rows.where("half = 0").select("y", "text").mapInArrow(_cut, "y int, pieces array<binary>").collect():
        base[r["y"]].append([bytes(p) for p in r["pieces"]])
    good, bad = (dictionary([p for parts in sorted(base[k]) for p in parts]) for k in (1, 0))
    if not base[0] or not base[1]:
        return flat
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = [compressor(d) for d in shared.value]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(differences(b["text"], *two))], ["y", "x"])

    got = rows.where("half = 1").select("y", "text").mapInArrow(measure, "y int, x double").orderBy("x", "y").toArrow()
    y, x = got["y"].to_numpy().astype(float), got["x"].to_numpy()
    if not len(y) or y.min() == y.max():
        return flat
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    return Classifier(good, bad, *curve(x, y, weight))


def score(docs: DataFrame, c: Classifier) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        two = [compressor(d) for d in (m.good, m.bad)] if m.good else None
        for b in batches:
            x = differences(b["text"], *two) if two else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(m.probability(x))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    c = train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    return score(docs, c).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
