"""Lookups of very frequent keys, dealt to several tasks: the same rows as a plain join."""

from pyspark.sql import functions as F

from tidemill.operators import graphs, posts, retention


def test_lookups_of_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 10)
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    unique = rows.select("k").where("k is not null and k != '9'").distinct().withColumn("v", F.length("k"))
    got = graphs.looked_up(rows, "k", unique).select("id", "k", "v")
    want = rows.join(unique, "k", "left").select("id", "k", "v")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert graphs.looked_up(rows.limit(0), "k", unique).count() == 0


def test_walks_by_one_ancestor(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 10)
    edges = spark.createDataFrame([(1, 0, "x"), (2, 1, "y")] + [(i, 2, "z") for i in range(3, 90)], "id long, parent_id long, label string")
    got = graphs.first_matching_ancestor(edges, edges.select("id"), F.col("label") == "x")
    assert sorted((r["start"], r["ancestor"], r["hops"]) for r in got.collect()) == [(2, 1, 1)] + [(i, 1, 2) for i in range(3, 90)]


def test_frequent_handles_and_files_without_session(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 10)
    handles = spark.createDataFrame([("Al.x", "did:1"), ("bo.x", "did:2"), (None, "did:3")], "handle string, did string")
    df = spark.createDataFrame([(i, "@al.x and @bo.x" if i % 2 else "hi @al.x @no.x") for i in range(60)], "id long, t string")
    assert posts.distinct_mentions(df, "id", "t", handles).count() == 90
    refs = spark.createDataFrame([(i, "at://AL.x/app.bsky.feed.post/k" if i < 50 else "at://no.x/app.bsky.feed.post/k" if i < 55 else None) for i in range(60)], "id long, r string")
    out = {(r["uri"], r["error"]): r["n"] for r in posts.resolve_refs(refs, "r", handles).groupBy("uri", "error").agg(F.count("id").alias("n")).collect()}
    assert out == {("at://did:1/app.bsky.feed.post/k", None): 50, (None, "unknown handle"): 5, (None, "not a post reference"): 5}
    inv = spark.range(80).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), "id")).alias("session_id"), F.lit("p").alias("category"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), "id")
    ses = spark.createDataFrame([("s4", False), (None, False)], "session_id string, is_archived boolean")
    plan = retention.retention_plan(inv, ses, spark.createDataFrame([("p", 3, True)], "category string, days int, protects boolean"), F.lit("2024-02-01").cast("timestamp"))
    assert plan.columns == [*inv.columns, "action"]
    assert {(r["id"]) for r in plan.where("action = 'PROTECTED'").collect()} == {4} and plan.where("action = 'DELETE'").count() == 79


def test_threads_by_one_ancestor(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 10)
    posts_ = spark.createDataFrame([("r", None), ("a", "r"), ("lost", "gone")] + [(f"c{i}", "a") for i in range(40)], "uri string, parent_uri string")
    got = {(r["start"], r["uri"], r["level"]) for r in graphs.thread_view(posts_, posts_, depth=1).collect()}
    want = {(u, u, 0) for u in ["r", "a", "lost"] + [f"c{i}" for i in range(40)]} | {("a", "r", -1), ("r", "a", 1)}
    want |= {x for i in range(40) for x in ((f"c{i}", "a", -1), (f"c{i}", "r", -2), ("a", f"c{i}", 1))}
    assert got == want
