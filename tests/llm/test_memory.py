"""What a task holds at once, and what it sends whatever it reads."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemill.llm import decontam, jaccard, store


def test_python_gets_small_batches(spark):
    docs = store.table(spark, "/root/testdata/sf0.1", "documents").select("text").coalesce(1)

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    got = docs.mapInArrow(measure, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == docs.count() > 2 * max(r["rows"] for r in got)
    assert max(r["bytes"] for r in got) < 6 << 20


def test_a_block_of_near_copies_takes_little_memory():
    """All pairs of a full bucket stay candidates, a few at a time."""
    n, rng = 2 * jaccard.BLOCK, np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, jaccard.HASHES).astype("<u2").tobytes()
    t = pa.RecordBatch.from_pydict({"piece": [1] * n, "side": [0] * n, "whole": [True] * n, "band": pa.array([0] * n, pa.int32()), "fp": [b"%d" % i for i in range(n)], "n": [1] * n, "sig": [sig] * n})
    prune = jaccard._pruner(jaccard.needed(0.8, 1e-6))
    tracemalloc.start()
    out = list(prune(iter([t])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for b in out for x in b["others"].to_pylist()) == 4 * n * (n - 1) // 2
    assert peak < 20e6


def test_sums_of_a_space_do_not_grow_with_the_files(spark, sf, monkeypatch):
    """A text or two a task: the arrays of terms times axes are as many as the tasks that the passages and cores call for."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, whole = {}, decontam.materialise

    def counted(df, name):
        out = whole(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(decontam, "materialise", counted)
    list(decontam.spaces(docs.repartition(40), bench.limit(3), decontam.REACH, decontam.LCS))
    assert 0 < rows["latent"] <= 2 * spark.sparkContext.defaultParallelism * decontam.BLOCKS / 2
