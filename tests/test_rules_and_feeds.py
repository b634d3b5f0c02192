"""The native option scan against the scan in Python, sketches against exact ranks, cursors, link cards and quotes."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import meshes, ordering, posts, screening, sketches

WORDS = ["git", "digit", "git", "-C", "-c", "a=b", "-C/x", "--git-dir", "--git-dir=/x", "--git-dir=", "--bare", "-p", "--exec-path", "--exec-path=", "--exec-path=/y", "--work-tree", "checkout", "checkout", "restore", "restore-x", "restoré", "reset", "resets", "reset_", "clean", "clean;", "cleanŽ", "--", "--", "x", "a|b", ";", "&&", "\n", "\n", " ", "\t", "　", "﻿", "_", "--super-prefix=q", "--config-env=", "é"]


def test_native_scan_equals_the_scan_in_python(spark):
    rng = np.random.default_rng(11)
    lines = ["".join(WORDS[i] + (" " if rng.random() < 0.93 else "") for i in rng.integers(0, len(WORDS), int(rng.integers(1, 14)))) for _ in range(4000)]
    lines += ["git " + " ".join(WORDS[i] for i in rng.integers(3, 28, 6)) for _ in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, c string")
    got = {r["i"]: r["s"] for r in df.select("i", screening.scanned(F.col("c")).alias("s")).collect()}
    hits = 0
    for i, x in enumerate(lines):
        want = set().union(*(screening.subcommands(part) for part in x.split("\n")))
        assert {n for n in ("checkout", "restore", "reset", "clean") if got[i][n]} == want, repr(x)
        hits += len(want)
    assert hits > 800


def test_screening_runs_without_python_and_in_linear_time(spark):
    df = spark.createDataFrame([("git " + "-C x " * n + "reset --hard",) for n in (40_000, 200_000)], "c string")
    out = screening.screen_vcs_commands(df, "c")
    assert "Python" not in out._jdf.queryExecution().toString()
    took = []
    for n in (100_000, 900_000):
        begun = time.perf_counter()
        assert [r["rule"] for r in out.where((F.length("c") > n) & (F.length("c") < 10 * n)).select("rule").collect()] == ["reset"]
        took.append(time.perf_counter() - begun)
    assert took[1] < 30 and took[1] < 12 * took[0] + 3


def test_sketches_keep_to_their_rank_error(spark, sf):
    items = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_extendedprice")
    days = sketches.daily_sketches(items, ["l_returnflag"], "l_shipdate", "l_extendedprice")
    shares = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p999": 0.999}
    two = sketches.over_days(days, ["l_returnflag"], last="1997-06-30")
    pdf = items.where("l_shipdate <= '1997-06-30'").toPandas()
    for r in sketches.quantiles(two, shares).collect():
        x = np.sort(pdf[pdf.l_returnflag == r["l_returnflag"]].l_extendedprice.to_numpy(float))
        assert r["n"] == len(x)
        for name, p in shares.items():
            assert abs(np.searchsorted(x, r[name], "right") / len(x) - p) <= sketches.RANK_ERROR
    plan = sketches.percentiles(items, ["l_returnflag"], "l_extendedprice", shares)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.replace("SortAggregate", "").replace("ObjectHash", "") or "Sort [l_extendedprice" not in plan
    checked = {r["l_returnflag"]: r for r in meshes.tolerance_check(items, ["l_returnflag"], "l_extendedprice", 1e5, ranks=sketches.percentiles).collect()}
    exact = {r["l_returnflag"]: r for r in meshes.tolerance_check(items, ["l_returnflag"], "l_extendedprice", 1e5).collect()}
    assert {k: v["status"] for k, v in checked.items()} == {k: v["status"] for k, v in exact.items()}


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("b", float("nan"), "2024-01-01"), ("c", 2.0, "2024-01-01"), (None, 3.0, "2024-01-02")], "k string, v double, d string").withColumn("d", F.col("d").cast("date"))
    got = sketches.quantiles(sketches.over_days(sketches.daily_sketches(df, ["k"], "d", "v"), ["k"]), {"p50": 0.5}).collect()
    assert sorted((r["k"] or "", r["n"], r["p50"]) for r in got) == [("", 1, 3.0), ("c", 1, 2.0)]
    assert sketches.over_days(sketches.daily_sketches(df.limit(0), ["k"], "d", "v"), ["k"]).count() == 0


def test_pages_of_a_feed_by_their_cursors(spark):
    """Ties in time, ids that are texts, and an end that falls on a page's end."""
    rows = [("a", f"2024-01-0{1 + i // 3} 00:00:00.000001", f"p{i:02d}") for i in range(12)] + [("b", "2024-01-09 00:00:00", "q")]
    df = spark.createDataFrame(rows, "who string, at string, id string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    seen, cursor, pages = [], None, 0
    while pages < 9:
        page = ordering.feed_page(df, "who", "a", "at", "id", 4, cursor)
        seen += [r["id"] for r in page.collect()]
        cursor, pages = ordering.next_cursor(page, "at", "id", 4).first()["cursor"], pages + 1
        if cursor is None:
            break
    assert (seen, pages) == ([f"p{i:02d}" for i in reversed(range(12))], 4)
    for bad in ("x", "bm8=", "eyJhIjoxfQ=="):
        with pytest.raises(ValueError):
            ordering.feed_page(df, "who", "a", "at", "id", 4, bad)


def test_cards_and_quotes_wherever_they_stand(spark):
    card = lambda k: {"$type": "app.bsky.embed.external#view", "external": {"uri": f"https://{k}", "title": k, "description": "d"}}
    quoted = {"uri": "at://q", "author": {"did": "did:q", "handle": "q.x"}, "value": {"text": "said"}, "embeds": [card("in quote"), {"media": card("in quoted media")}]}
    views = [
        {"uri": "1", "embed": card("own")}, {"uri": "2", "embed": {"record": quoted}}, {"uri": "3", "embed": {"record": {"record": quoted}, "media": card("media")}},
        {"uri": "4", "embed": {"external": {"title": "no address"}}}, {"uri": "5"}, {"uri": "6", "embed": {"record": {"uri": "at://gone", "notFound": True}}},
    ]
    flat = posts.flatten_posts(spark.createDataFrame([(json.dumps(v),) for v in views] + [("{broken",), (None,)], "j string"), "j")
    assert sorted((r["uri"], r["pos"], r["title"]) for r in flat["links"].collect()) == [("1", 0, "own"), ("2", 0, "in quote"), ("2", 1, "in quoted media"), ("3", 0, "media"), ("3", 1, "in quote"), ("3", 2, "in quoted media")]
    assert sorted(tuple(r) for r in flat["quotes"].where("uri < '4'").collect()) == [("2", "at://q", "did:q", "q.x", "said"), ("3", "at://q", "did:q", "q.x", "said")]
    assert [tuple(r) for r in flat["quotes"].where("uri = '6'").collect()] == [("6", "at://gone", None, None, None)]
