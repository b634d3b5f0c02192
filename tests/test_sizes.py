"""What must not grow with the tables: broadcasts, tasks a file, groups a key, rows a shuffle."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemill.operators import meshes
from tidemill.sources import logs, ranges
from tidemill.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def squares(spark):
    at = spark.range(50).select(F.lit(0).alias("model"), F.col("id").alias("k"), (F.col("id") * 3.0).alias("ox"))
    v = at.select("model", F.explode(F.array(*[F.struct((F.col("k") * 4 + i).alias("v_id"), (F.col("ox") + i % 2).alias("x"), F.lit(float(i // 2)).alias("y"), F.lit(0.0).alias("z")) for i in range(4)])).alias("p")).select("model", "p.*")
    faces = at.select("model", F.col("k").alias("face_id"), F.array(*[F.col("k") * 4 + i for i in (0, 1, 3)]).alias("v"))
    return faces, v


def test_no_mesh_is_broadcast(spark, squares, monkeypatch):
    faces, v = squares
    plans, write = [], meshes.written
    monkeypatch.setattr(meshes, "written", lambda df, name: plans.append(plan(df)) or write(df, name))
    got = meshes.surface_deviation(faces, v, faces, v.withColumn("z", F.lit(0.5)), 2.0)
    assert {r["distance"] for r in got.where("p_id % 4 < 2").select(F.round("distance", 9).alias("distance")).collect()} == {0.5}
    joins = [line for p in plans for line in p.splitlines() if "Join" in line and "LeftSemi" not in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_points_go_to_few_cells(spark, squares, monkeypatch):
    """A point stands in at most two cells along each axis, not three."""
    faces, v = squares
    rows, write = [], meshes.written
    explode = F.explode
    monkeypatch.setattr(meshes, "written", lambda df, name: write(df, name))

    class Counted:
        def __getattr__(self, name):
            return getattr(F, name)

        def explode(self, x):
            text = str(x)
            if "sequence" in text:
                rows.append(x)
            return explode(x)

    monkeypatch.setattr(meshes, "F", Counted())
    meshes.surface_distance(v.withColumnRenamed("v_id", "p_id"), meshes.corners(faces, v), 2.0)
    assert rows
    most = v.withColumn("level", F.lit(2)).select(*[F.max(F.size(x)).alias(f"n{i}") for i, x in enumerate(rows)]).first()
    assert max(most) <= 2


class Calls:
    """A state store that counts what it is asked."""

    def __init__(self):
        self.n, self.held, self.at = 0, [], []

    def getListState(self, name, kind):
        return self

    getMapState = getValueState = lambda self, *a: self

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            if name in ("put", "clear"):
                self.held = list(args[0]) if args else []
            elif name == "appendList":
                self.held += args[0]
            elif name == "registerTimer":
                self.at.append(args[0])
            return {"exists": bool(self.held), "get": iter(self.held)}.get(name)

        return call

    def getCurrentWatermarkInMs(self):
        return max(self.at)


def test_presence_asks_the_state_store_by_groups_not_rows():
    p, calls = jobs.Presence(1, 9, LongType()), Calls()
    p.init(calls)
    rows = pd.DataFrame({"key": np.arange(1000) % 500, "at": 20_000_000 + np.arange(1000), "is_start": np.arange(1000) < 700})
    told = pd.concat([*p.handleInputRows((0, 2), iter([rows]), calls), *p.handleExpiredTimer((0, 2), calls, None)])
    assert set(told["key"]) == set(range(200))
    assert len(told) == 400 and calls.n < 12 and calls.held == []


def test_small_files_are_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k:03}.stl").write_bytes(b"\0" * 80 + (200).to_bytes(4, "little") + bytes(50 * 200))
    got = ranges.read_facets(spark, str(tmp_path), "model string, face_id long", split=1 << 10)
    assert got.count() == 300 * 200 == got.distinct().count()
    assert got.rdd.getNumPartitions() <= 2 * 2 * spark.sparkContext.defaultParallelism


def test_a_large_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.stl").write_bytes(b"\0" * 80 + (9_000_000).to_bytes(4, "little") + bytes(50 * 9_000_000))
    got = ranges.read_facets(spark, str(tmp_path), "face_id long")
    assert got.rdd.getNumPartitions() >= 7 and got.agg(F.count_distinct("face_id")).first()[0] == 9_000_000


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Folders far more than a listing job's threshold: neither listing nor reading goes through Spark's file index."""
    for k in range(120):
        (tmp_path / f"a{k % 3}" / f"b{k}").mkdir(parents=True)
        (tmp_path / f"a{k % 3}" / f"b{k}" / "r.txt").write_text("{oops" if k % 7 == 3 else f'{{"key":\n {k}}}')
    (tmp_path / "top.txt").write_text('{"key": -1}')
    (tmp_path / "_hidden.txt").write_text('{"key": -2}')
    (tmp_path / "a0" / "other.md").write_text("x")
    plans, write = [], logs.written
    monkeypatch.setattr(logs, "written", lambda df, name: plans.append(plan(df)) or write(df, name))
    got = logs.read_json_records(spark, str(tmp_path), "key long", "*.txt")
    assert sorted(r["key"] for r in got.collect()) == [-1, *[k for k in range(120) if k % 7 != 3]]
    inventory = logs.read_file_inventory(spark, str(tmp_path), "*.txt").collect()
    assert sorted({r["depth"] for r in inventory}) == [1, 3] and len(inventory) == 121
    one = next(r for r in inventory if r["depth"] == 1)
    seen = spark.read.format("binaryFile").load(f"{tmp_path}/top.txt").select("path", "modificationTime", "length").first()
    assert (one["path"], one["mtime"], one["length"]) == tuple(seen)
    assert len(plans) == 6 and all("MapInArrow" in p and "binaryFile" not in p for p in plans)
    assert logs.read_file_inventory(spark, f"{tmp_path}/top.txt").select("name").first()[0] == "top.txt"
