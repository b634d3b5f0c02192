"""The index against the scan: contained words, phrases, blocks and buckets that are left alone."""

import re

import numpy as np
import pytest

from tidemill.operators import ordering, search

VOCABULARY = ["the", "The", "other", "with", "within", "that", "a", "of", "é", "Été", "x y", "rare", "#tag", "don't"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    p = np.array([9, 3, 3, 5, 2, 5, 9, 9, 2, 1, 1, 0.02, 1, 1])
    out = [(i, None if i % 97 == 5 else "".join(w + [" ", "\n", "  ", "\t"][int(rng.integers(4))] for w in rng.choice(VOCABULARY, int(rng.integers(0, 12)), p=p / p.sum()))) for i in range(900)]
    return [*out, (900, ""), (901, "rare rare of the"), (902, "of  the"), (903, "of x the")]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    search.BLOCK, search.FIRST, search.STEP, was = 32, 2, 2, (search.BLOCK, search.FIRST, search.STEP)
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    posts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    search.build_index(posts, "text", ["id"], path, 5)
    yield posts, path
    search.BLOCK, search.FIRST, search.STEP = was


@pytest.mark.parametrize("query", ["the", "THE with that", "rare", "ith he", "été", "x y", "x y", "nothing", "the nothing", "", "a a a", "#ta n't"])
def test_search_equals_the_scan(spark, index, query):
    posts, path = index
    for limit in (3, 50):
        want = [(r["id"], r["text"]) for r in ordering.search_posts(posts, query, "text", ["id"], limit).collect()]
        assert [(r["id"], r["text"]) for r in search.Index(spark, path).search(query, limit).collect()] == want


@pytest.mark.parametrize("query", ["of the", "the of the", "rare rare", "é é"])
def test_phrases(spark, index, rows, query):
    _, path = index
    pattern = re.compile(r"(?<![^ \t-\r])" + r"[ \t-\r]+".join(map(re.escape, query.split())) + r"(?![^ \t-\r])")
    want = [i for i, t in sorted(rows, reverse=True) if t and pattern.search(t.lower())][:7]
    assert [r["id"] for r in search.Index(spark, path).search(query, 7, phrase=True).collect()] == want


def test_only_what_is_needed_is_read(spark, index):
    """A frequent word's newest blocks are enough; a word's buckets are the only ones opened."""
    _, path = index
    log = []
    i = search.Index(spark, path, log)
    assert i.search("the", 5).count() == 5
    assert len(log) == 1 and log[0] <= 4 * 2  # tokens that hold it, in two blocks
    total = i.postings.count()
    log.clear()
    i.search("rare", 500).collect()
    assert sum(log) < 0.15 * total
    plan = i.postings.where("bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_posts_are_shuffled_once_and_words_by_the_post(spark, rows, tmp_path, monkeypatch):
    """The index's jobs exchange whole posts once, and no row for each time a word stands; a task that makes few words at once gives the same lists."""
    monkeypatch.setattr(search, "WORDS", 50)
    posts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    ranged = search.ranged(posts, ["id"])
    assert ranged._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning") == 1
    search.build_index(posts, "text", ["id"], f"file://{tmp_path}/i")
    index = search.Index(spark, f"file://{tmp_path}/i")
    numbered = {r["number"]: r["id"] for r in index.posts.select(search.number(index.first).alias("number"), "id").collect()}
    assert [numbered[n] for n in range(len(rows))] == sorted((i for i, _ in rows), reverse=True)
    got = {(r["token"], numbered[n]): p for r in index.postings.collect() for n, p in zip(r["numbers"], r["places"], strict=True)}
    want = {}
    for i, t in rows:
        for at, w in enumerate(x for x in re.split(r"[ \t-\r]+", (t or "").lower()) if x):
            want.setdefault((w, i), []).append(at)
    assert got == want
    assert [r["id"] for r in index.search("the", 3).collect()] == [i for i, t in sorted(rows, reverse=True) if t and "the" in t.lower()][:3]
