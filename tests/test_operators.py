"""Golden rows and second formulations of the operators."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import columns as c
from tidemill.operators import content, graphs, meshes, ordering, posts, presence, retention, scores, screening
from tidemill.sources import binary, logs


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("command", "rule"),
    [
        ("git checkout -- a", "checkout"), ("git checkout main", None), ("git checkout x;y -- f", None), ("git checkout main | tee -- out", None),
        ("git -C /r -c a=b --git-dir /x checkout HEAD -- f", "checkout"), ("git -C checkout -- f", None), ("digit checkout -- f", "checkout"),
        ("git --weird checkout -- f", None), ("git restore f", "restore"), ("git restore --staged f", None), ("git restore --staged -W f", "restore"),
        ("git restored", None), ("git restore-x", "restore"), ("git restoreé f", None), ("git　restore f", "restore"), ("git﻿restore f", None),
        ("git reset --hard", "reset"), ("git reset --hardly", None), ("git reset x--hard", "reset"), ("ls\ngit reset --hard\n\n", "reset"),
        ("git clean -fd", "clean"), ("git clean -nfd", None), ("git clean --dry-run --force", None), ("git clean -d", None), ("", None), (None, None), ("gi\0t clean -f", "clean"),
    ],
)
def test_vcs_rules(spark, command, rule):
    assert screening.screen_vcs_commands(spark.createDataFrame([(command,)], "c string"), "c").first()["rule"] == rule


@pytest.mark.parametrize(
    ("command", "tool"),
    [("tsc a.ts", "tsc"), ("tsc -p a.ts", None), ("npx tsc --noEmit", None), ("tsc a.ts && tsrs b.tsx", "tsrs"), ("echo tsc; ls a.ts", None), ("tsrs-lint a.ts", None), ("cat a.ts\ntsc", "tsc"), (None, None)],
)
def test_compiler_rules(spark, command, tool):
    assert screening.screen_compiler_commands(spark.createDataFrame([(command,)], "c string"), "c").first()["tool"] == tool


def test_long_command_is_linear():
    import time

    line = "git -C " * 150_000
    begun = time.perf_counter()
    assert screening.subcommands(line) == set()
    assert time.perf_counter() - begun < 5


def test_columns(spark):
    assert one(spark, c.elapsed_seconds("v"), v="1-02:03:04") == 93784
    assert one(spark, c.elapsed_seconds("v"), v="junk") is None
    assert str(one(spark, c.parse_instant("v"), v="2024-02-29T01:02:03.5Z")) == "2024-02-29 01:02:03.500000"
    assert one(spark, c.parse_instant("v"), v="2024-13-01T00:00:00Z") is None
    assert one(spark, c.payload_code("v"), v='{"b": 1, "a": [2, {"d": 1, "c": null}]}') == one(spark, c.payload_code("v"), v='{"a":[2,{"c":null,"d":1}],"b":1}')
    assert one(spark, c.graphemes("v"), v="a\U0001f468‍\U0001f469‍\U0001f467é") == 3
    assert one(spark, c.slug("v"), v="Hello, World Wide!") == "hello-world-wide"
    assert one(spark, c.page_path("v"), v="content/blog/post.md") == "/blog/post/"
    assert one(spark, c.stored_path("v"), v="/about") == "/about/index.html"
    assert one(spark, c.clean_token("v"), v="a b\n\tc") == "a_b_c"
    uri = one(spark, c.post_uri("v"), v="https://bsky.app/profile/a.b/post/k1")
    assert uri == "at://a.b/app.bsky.feed.post/k1"
    assert one(spark, c.post_url("v"), v=uri) == "https://bsky.app/profile/a.b/post/k1"
    spans = one(spark, c.facet_spans("v"), v="hé @bob.x see https://a.b/c")
    assert [(s["start"], s["end"], s["kind"], s["value"]) for s in spans] == [(4, 10, "mention", "@bob.x"), (15, 28, "link", "https://a.b/c")]


def test_absent_partner_edges(spark):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    starts = spark.createDataFrame([("a", at(600)), ("b", at(600)), ("c", at(600)), ("d", at(600)), ("n", None), (None, at(600))], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    ons = spark.createDataFrame([("a", at(570)), ("b", at(900)), ("c", at(569)), ("c", at(901)), ("z", at(600))], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = lambda **a: sorted(r["k"] for r in presence.absent_partner(starts, ons, "k", 30, 300, 120, **a).collect())
    assert got(as_of=at(721)) == ["c", "d"]
    assert got(as_of=at(720)) == []  # not yet older than the grace
    assert got(as_of=at(721), wildcard="z") == []
    assert got(as_of=at(721), marked=starts.where("k = 'd'")) == ["c"]


def test_state_log(spark):
    lines = ["2024-01-01T00:00:00Z session=a x=1 x=2 start", "2024-01-01T00:00:00Z session= start", "2024-13-01T00:00:00Z session=a on", "2024-01-01T00:00:00.25Z session=b for_start=2024-01-01T00:00:00Z inferred off", "2024-01-01T00:00:00Z session=b off", "start", "", "2024-01-01T00:00:00Z session=a done"]
    entries, rejects = logs.parse_state_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r["session"], r["state"], r["kv"].get("x")) for r in entries.collect()) == [("a", "start", "2"), ("b", "off", None)]
    assert rejects.count() == 6


def test_json_inventory_and_tables(spark, tmp_path):
    for name, body in (("a.json", '{\n "cliSessionId": "x",\n "isArchived": true}'), ("b.json", "{oops"), ("c.json", '{"cliSessionId": "y"}')):
        (tmp_path / name).write_text(body)
    got = logs.read_json_records(spark, str(tmp_path), "cliSessionId string, isArchived boolean")
    assert sorted(r["cliSessionId"] for r in got.collect()) == ["x", "y"]
    inv = {r["session_id"]: r["length"] for r in logs.read_file_inventory(spark, str(tmp_path)).collect()}
    assert inv["b"] == 5
    table = f"file://{tmp_path}/t"
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    assert logs.append_once(df, table, ["id"]).count() == 5
    assert logs.append_once(spark.range(7).withColumn("v", F.lit(0).cast("long")), table, ["id"]).count() == 7
    assert sorted(r["id"] for r in logs.rewrite_trimmed(spark, table, F.col("id") > 3).collect()) == [4, 5, 6]


def test_retention_nulls_and_guard(spark):
    inv = spark.createDataFrame([("s1", "p", "2024-01-01"), ("s2", "p", "2024-01-01"), ("s3", "p", "2024-01-01"), ("s1", "q", "2024-01-01"), ("s1", "p", "2024-01-09"), ("s1", "other", "2024-01-01"), (None, "p", "2024-01-01")], "session_id string, category string, t string").withColumn("mtime", F.col("t").cast("timestamp"))
    ses = spark.createDataFrame([("s1", None), ("s2", True), ("s3", False)], "session_id string, is_archived boolean")
    pol = spark.createDataFrame([("p", 3, True), ("q", 3, False)], "category string, days int, protects boolean")
    got = [(r["session_id"], r["category"], r["action"]) for r in retention.retention_plan(inv, ses, pol, F.lit("2024-01-10").cast("timestamp")).collect()]
    assert sorted(got, key=str) == sorted([("s1", "p", "PROTECTED"), ("s2", "p", "DELETE"), ("s3", "p", "PROTECTED"), ("s1", "q", "DELETE"), ("s1", "p", "KEEP"), ("s1", "other", "KEEP"), (None, "p", "DELETE")], key=str)
    u = "0a1b2c3d-0000-1111-2222-333344445555"
    dirs = spark.createDataFrame([(u, "dir", True), (u + "\n", "dir", True), ("x", "dir", True)], "name string, kind string, is_empty boolean").withColumn("mtime", F.lit("2024-01-01").cast("timestamp"))
    now = F.lit("2024-01-02").cast("timestamp")
    assert retention.stale_empty_keys(dirs, spark.createDataFrame([], "name string"), now).count() == 0
    assert [r["name"] for r in retention.stale_empty_keys(dirs, spark.createDataFrame([("k",)], "name string"), now).collect()] == [u]
    assert retention.stale_empty_keys(dirs, spark.createDataFrame([(u.upper(),)], "name string"), now).count() == 0


def test_pareto_equals_theta(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    o = part.select(*[F.col(x).alias("o" + x) for x in part.columns])
    theta = part.join(o, (F.col("p_brand") == F.col("op_brand")) & (F.col("op_size") >= F.col("p_size")) & (F.col("op_retailprice") <= F.col("p_retailprice")) & ((F.col("op_size") > F.col("p_size")) | (F.col("op_retailprice") < F.col("p_retailprice"))), "left_anti")
    fast = scores.pareto_front(part, ["p_brand"], "p_size", "p_retailprice")
    assert {r["p_partkey"] for r in theta.collect()} == {r["p_partkey"] for r in fast.collect()}


def test_cells(spark):
    df = spark.createDataFrame([("m", "54 @ $3.10", "~7 @ ~$1", "—")], "model string, low string, mid string, high string")
    got = {r["level"]: (r["score"], r["cost"] and float(r["cost"]), r["approx"]) for r in scores.unpivot_scores(df, "model", ["low", "mid", "high"]).collect()}
    assert got == {"low": (54.0, 3.1, False), "mid": (7.0, 1.0, True), "high": (None, None, False)}


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 3, 10), ("b", 1, 5)], "k string, t int, size int")
    assert sorted((r["k"], r["t"]) for r in ordering.keep_newest_bytes(df, "k", ["t"], "size", 20, 20).collect()) == [("a", 2), ("a", 3), ("b", 1)]
    kept, dropped = ordering.split_on_marker(df, "k", ["t"], F.col("t") == 2, F.col("t") == 3)
    assert sorted((r["k"], r["t"], r["group_no"]) for r in kept.collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]
    assert dropped.count() == 1
    with pytest.raises(ValueError):
        ordering.feed_page(df, "k", "a", "t", "size", 101)


def test_front_matter_lists(spark):
    text = "---\ntitle: 'A b'\ntags:\n  - x\n  - \"y z\"\ndraft: true\ntitle: C\n---\nrest"
    r = content.extract_front_matter(spark.createDataFrame([(text,), ("plain",), (None,)], "t string"), "t").collect()
    assert (r[0]["fields"]["title"], r[0]["tags"], r[0]["body"]) == ("C", ["x", "y z"], "rest")
    assert (r[1]["fields"], r[1]["body"], r[2]["body"]) == (None, "plain", None)


def test_posts(spark):
    rows = [("t", "x" * 301, None), ("t", "", []), ("t", "ok", [("p", " ", None)]), ("t", "ok", [("p", "a", bytearray(b"\x89PNG\r\n\x1a\n0000"))]), ("t", "ok", [("p", "a", bytearray(b"GIF89a"))])]
    got = [r["violations"] for r in posts.validate_posts(spark.createDataFrame(rows, "thread string, text string, images array<struct<path:string,alt:string,data:binary>>"), "thread").collect()]
    assert got == [["text has more than 300 characters"], ["neither text nor image"], ["image without path or alt text"], [], ["unknown image type"]]


def test_walks(spark):
    edges = spark.createDataFrame([(1, 0, "root"), (2, 1, "x"), (3, 2, "y"), (4, 3, "z"), (8, 8, "self"), (9, 10, "x"), (10, 9, "y")], "id long, parent_id long, label string")
    got = graphs.first_matching_ancestor(edges, edges.select("id"), F.col("label") == "x")
    assert sorted((r["start"], r["ancestor"], r["hops"]) for r in got.collect()) == [(3, 2, 1), (4, 2, 2), (9, 9, 2), (10, 9, 1)]
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    parts = {r["node"]: r["part"] for r in graphs.connected_parts(e).collect()}
    assert set(parts[i] for i in range(1, 41)) == {1}
    assert parts[101] == 100
    assert {(r["part"], r["size"], r["largest"]) for r in graphs.part_sizes(spark.createDataFrame(list(parts.items()), "node long, part long")).collect()} == {(1, 40, True), (100, 2, False)}


def cube():
    v = [(x, y, z) for x in (0.0, 2.0) for y in (0.0, 2.0) for z in (0.0, 2.0)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return v, [t for a, b, c_, d in quads for t in ((a, b, c_), (a, c_, d))]


def test_meshes(spark, tmp_path):
    v, f = cube()
    body = b"".join(struct.pack("<12fH", 0, 0, 0, *[x for i in t for x in v[i]], 0) for t in f)
    (tmp_path / "cube.stl").write_bytes(b"\0" * 80 + struct.pack("<I", len(f)) + body)
    assert [(r["faces"], r["large"]) for r in binary.mesh_triage(spark, str(tmp_path)).collect()] == [(12, False)]
    faces, points = binary.indexed_mesh(binary.read_mesh_faces(spark, str(tmp_path)))
    assert points.count() == 8
    q = meshes.mesh_quality(faces, points, 1e-4).first()
    assert (q["small_faces"], q["short_edges"], q["bad_edges"], q["not_triangles"]) == (0, 0, 0, 0)
    m = meshes.mesh_measures(faces, points).first()
    assert abs(abs(m["volume"]) - 8) < 1e-9
    assert abs(m["area"] - 24) < 1e-9
    assert (m["size_x"], m["off_x"], m["off_z"]) == (2.0, 1.0, 0.0)
    assert meshes.mesh_quality(faces.where("face_id != 0"), points, 1e-4).first()["bad_edges"] == 3
    twice = faces.unionByName(faces.where("face_id = 3").withColumn("face_id", F.lit(50).cast("long")))
    assert [r["face_id"] for r in meshes.duplicate_faces(twice).collect()] == [50]
    pts = spark.createDataFrame([("m", i, float(i), 0.0, 0.0) for i in range(10)], "model string, p_id int, x double, y double, z double")
    near, least, r = meshes.halo(pts, pts.where("p_id in (0, 5)").withColumn("strength", F.col("x")), "strength", 1.0, 2.0, 0.9)
    assert (sorted(x["p_id"] for x in near.collect()), least, r) == ([3, 4, 5, 6, 7], 1.0, 2.0)


def test_fixed_records(spark, tmp_path):
    rec = lambda i: b"MAGC" + struct.pack("<I3f", i, 1.0 * i, 2.0, 3.0) + b"\0" * 52
    (tmp_path / "p.bin").write_bytes(b"junkMAGCx" + b"\0" * 100 + rec(1) + rec(2) + rec(3) + b"tail")
    got = binary.read_fixed_records(spark, str(tmp_path / "p.bin"), b"MAGC", [("magic", "S4"), ("type", "<u4"), ("start", ("<f4", 3)), ("rest", "S52")]).orderBy("rec_no").collect()
    assert [(r["rec_no"], r["type"], list(r["start"])) for r in got] == [(i, i + 1, [i + 1.0, 2.0, 3.0]) for i in range(3)]
    assert np.diff([r["offset"] for r in got]).tolist() == [72, 72]


def test_surface_deviation(spark):
    v, f = cube()
    verts = lambda k: spark.createDataFrame([("m", i, *(k * x for x in p)) for i, p in enumerate(v)], "model string, v_id long, x double, y double, z double")
    faces = spark.createDataFrame([("m", i, list(t)) for i, t in enumerate(f)], "model string, face_id long, v array<long>")
    got = meshes.surface_deviation(faces, verts(1.0), faces, verts(1.5), 0.3).toPandas()
    back = sorted(got[got.direction == "b to a"].distance.round(6))
    # corners of the larger cube: its origin corner touches, those along one axis stand 1 off, and so on
    assert back == sorted([0.0] + [1.0] * 3 + [round(2**0.5, 6)] * 3 + [round(3**0.5, 6)])
    forth = got[got.direction == "a to b"].distance.round(6)
    assert sorted(forth) == [0.0] * 7 + [1.0]
    rng = np.random.default_rng(5)
    points = rng.normal(size=(40, 3)) * 2
    p = spark.createDataFrame([("m", i, *map(float, x)) for i, x in enumerate(points)], "model string, p_id long, x double, y double, z double")
    fast = {r["p_id"]: r["distance"] for r in meshes.surface_distance(p, meshes.corners(faces, verts(1.0)), 0.5).collect()}
    for i, x in enumerate(points):
        outside = np.maximum(0, np.maximum(-x, x - 2.0))
        want = np.linalg.norm(outside) if outside.any() else min(min(x), min(2 - x))
        assert abs(fast[i] - want) < 1e-9


def test_streams(spark, tmp_path):
    from tidemill.streaming import jobs

    rows = [(1, "git reset --hard"), (2, "tsc a.ts"), (3, "sls deploy"), (4, "ls"), (1, "git reset --hard")]
    spark.createDataFrame(rows, "id long, command string").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds every key there
        s = spark.readStream.schema("id long, command string").parquet(f"{tmp_path}/in")
        jobs.append_once_sink(jobs.screen_stream(s, "command"), f"{tmp_path}/out", ["id"], f"{tmp_path}/check{_}").awaitTermination()
    got = sorted((r["id"], r["rule"], r["compiler"], r["deploy"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "reset", None, False), (2, None, "tsc", False), (3, None, None, True), (4, None, None, False)]
