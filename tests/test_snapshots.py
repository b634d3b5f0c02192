"""Versioned tables: jobs stopped between any two steps, writers at once, versions, and files that the index spares."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.sources import snapshots
from tidemill.sources.snapshots import Snapshots


class Stopped(Exception):
    pass


def stop_at(step):
    def at(now):
        if now == step:
            raise Stopped(step)

    return at


def ids(df):
    return sorted(r["id"] for r in df.collect())


def batch(spark, lo, hi, v=0):
    return spark.range(lo, hi).withColumn("v", F.lit(v))


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/table"


STEPS = ["index asked", "before commit"]


@pytest.mark.parametrize("step", ["data written", "before commit", "committed"])
def test_a_job_that_is_stopped_leaves_whole_versions(spark, folder, step):
    Snapshots(spark, folder).append_once(batch(spark, 0, 10), ["id"])
    with pytest.raises(Stopped):
        Snapshots(spark, folder, stop_at(step)).append_once(batch(spark, 5, 15, 1), ["id"])
    whole = 15 if step == "committed" else 10
    assert ids(Snapshots(spark, folder).read()) == list(range(whole))
    assert Snapshots(spark, folder).append_once(batch(spark, 5, 15, 2), ["id"]).rows == 15 - whole
    assert ids(Snapshots(spark, folder).read()) == list(range(15))
    if step in ("data written", "committed"):
        with pytest.raises(Stopped):
            Snapshots(spark, folder, stop_at(step)).rewrite(F.col("id") >= 8)
        assert ids(Snapshots(spark, folder).read()) == list(range(8 if step == "committed" else 0, 15))


@pytest.mark.parametrize("step", STEPS)
def test_another_writer_comes_between(spark, folder, step):
    """Whatever the step at which another append or rewrite is committed, every key stands once."""
    Snapshots(spark, folder).append_once(batch(spark, 0, 10), ["id"])
    done = []

    def meanwhile(now):
        if now == step and not done:
            done.append(1)
            Snapshots(spark, folder).append_once(batch(spark, 8, 14, 1).unionByName(batch(spark, 30, 32, 1)), ["id"])

    Snapshots(spark, folder, meanwhile).append_once(batch(spark, 5, 20, 2), ["id"])
    out = Snapshots(spark, folder).read()
    assert ids(out) == [*range(20), 30, 31]
    assert ids(out.where("v = 1")) == [*range(10, 14), 30, 31]
    done.clear()

    def trimmed(now):
        if now == step and not done:
            done.append(1)
            Snapshots(spark, folder).rewrite(F.col("id") < 7)

    Snapshots(spark, folder, trimmed).append_once(batch(spark, 5, 9, 3).unionByName(batch(spark, 40, 41)), ["id"])
    assert ids(Snapshots(spark, folder).read()) == [*range(9), 40]


def test_rows_added_during_a_rewrite_are_asked_too(spark, folder):
    Snapshots(spark, folder).append_once(batch(spark, 0, 10), ["id"])
    done = []

    def meanwhile(now):
        if now == "before commit" and not done:
            done.append(1)
            Snapshots(spark, folder).append_once(batch(spark, 10, 20), ["id"])

    report = Snapshots(spark, folder, meanwhile).rewrite(F.col("id") % 2 == 0)
    assert (report.version, report.rows) == (3, 10)
    assert ids(Snapshots(spark, folder).read()) == list(range(0, 20, 2))


def test_writers_at_once(spark, folder):
    errors = []

    def write(k):
        try:
            Snapshots(spark, folder).append_once(batch(spark, k * 5, k * 5 + 10, k), ["id"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert ids(Snapshots(spark, folder).read()) == list(range(25))
    assert len(Snapshots(spark, folder).versions()) <= 4


def test_a_version_is_made_once(spark, folder):
    store = snapshots.Store(spark, folder)
    assert store.create("a/x.json", "one") and not store.create("a/x.json", "two")
    assert store.text("a/x.json") == "one"
    assert set(store.names("a")) == {"x.json"}


def test_versions_and_readers(spark, folder):
    t = Snapshots(spark, folder)
    with pytest.raises(ValueError):
        t.read()
    assert t.append_once(batch(spark, 0, 0), ["id"]) == (0, 0, 0, 0)
    t.append_once(batch(spark, 0, 4), ["id"])
    open_ = t.read()
    t.append_once(batch(spark, 2, 6), ["id"])
    t.rewrite(F.col("id") > 4)
    assert (ids(open_), ids(t.read(1)), ids(t.read(2)), ids(t.read())) == ([0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, 3, 4, 5], [5])
    with pytest.raises(ValueError):
        t.append_once(batch(spark, 0, 4), ["v"])
    assert t.vacuum(versions=1, older_than=3600) == []
    t.append_once(batch(spark, 7, 8), ["id"])
    assert t.vacuum(versions=1, older_than=0)
    assert ids(t.read()) == [5, 7] and t.versions() == [4]
    t.rewrite(F.lit(False))
    assert ids(t.read()) == [] and t.append_once(batch(spark, 7, 9), ["id"]).rows == 2


def test_null_and_compound_keys(spark, folder):
    rows = [(1, "a"), (1, None), (None, None), (None, "a"), (1, "a"), (None, None)]
    df = spark.createDataFrame(rows, "k long, s string").withColumn("more", F.lit(1.5))
    t = Snapshots(spark, folder)
    assert t.append_once(df, ["k", "s"]).rows == 4
    assert t.append_once(df.unionByName(spark.createDataFrame([(None, "b", 0.5)], df.schema)), ["k", "s"]).rows == 1
    assert t.read().count() == 5


def test_files_without_the_keys_are_not_read(spark, folder):
    """Parts of keys that rise, then a batch between them: few files are read, and the rows equal the full anti-join."""
    t = Snapshots(spark, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for k in range(3):
            t.append_once(spark.range(0, 40_000).select((F.col("id") * 10 + k * 1_000_000).alias("id"), F.lit(k).alias("v")), ["id"])
        assert sum(t.version().files.values()) == 12
        fresh = spark.range(0, 300).select((F.col("id") * 10 + 1_000_005).alias("id"), F.lit(9).alias("v"))
        assert t.append_once(fresh, ["id"])[1:] == (300, 12, 0)  # in the second part's range, in no filter
        known = t.read().select("id")
        some = spark.createDataFrame([(0, 9), (1_000_000, 9), (77, 9), (5_000_000, 9)], "id long, v int")
        want = some.join(known, "id", "left_anti").count()
        report = t.append_once(some, ["id"])
        assert report.rows == want == 2 and report.files_read <= 4 < report.files
        assert t.append_once(spark.range(3).select((F.col("id") + 9_000_000).alias("id"), F.lit(0).alias("v")), ["id"]).files_read == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_batches_go_by_ranges(spark, folder, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_HASHES", 10)
    t = Snapshots(spark, folder)
    t.append_once(batch(spark, 0, 100), ["id"])
    report = t.append_once(batch(spark, 50, 150), ["id"])
    assert report.rows == 50 and report.files_read > 0


def test_filters_never_miss():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    bits = (len(h) * snapshots.BITS_A_KEY).bit_length()
    held = np.zeros(1 << bits, bool)
    held[snapshots.positions(h, bits).ravel()] = True
    raw, lo, hi = np.packbits(held).tobytes(), int(h.min()), int(h.max())
    assert all(snapshots.may_hold(np.array([x]), lo, hi, bits, raw) for x in h[:500])
    other = rng.integers(lo, hi, 3000, dtype=np.int64)
    assert sum(snapshots.may_hold(np.array([x]), lo, hi, bits, raw) for x in other) < 30
