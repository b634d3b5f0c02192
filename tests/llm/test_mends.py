"""Rows that differ in maps alone, elements that HTML ends without a tag, and names of classes inside articles."""

import time
import tracemalloc

import numpy as np
import pytest

from tidemill.llm import decontam, mixing, pages, toxicity


def text(html):
    found = pages.page_lines(html)
    return " ".join(found[i][0] for i in pages._own(found)[0])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>One<p class='promo'>Buy now<p>Two real<p>Three</article>", "One Two real Three"),
        ("<article><ul><li>a<li class=share>b<li>c<ul><li>d<li class=ad>e</ul>f</ul></article>", "a c d f"),
        ("<article><dl><dt>a<dd class=ad>b<dt>c<dd>d</dl></article>", "a c d"),
        ("<article><table><tr><td>a<td class=ad>b<td>c<tr class=promo><td>d<tr><td>e</table>f</article>", "a c e f"),
        ("<article><p class=ad>x<div>y</div>z</article>", "y z"),
        ("<article><p>a<table><tr><td><p class=ad>b<td>c</table>d</p>e</article>", "a c d e"),
        ("<article><p>a<span class=ad>b<b>c</span>d</article>", "a d"),
        ("<article></b></p>a</div></article>", "a"),
        ("<article><section class='related-work'>a</section><p class='share-price'>b</p><div id='search-results-analysis'>c</div></article>", "a b c"),
        ("<article>a<div class='comment-list'>b</div><div class='share-buttons x'>c</div><ul id=related-posts><li>d</ul><p class='text promo'>e</p></article>", "a"),
        ("<div class='related-work'>a</div>b", "b"),
    ],
)
def test_elements_end_as_in_html(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html", ["<p>" * 100_000 + "</b>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000 + "</div>" * 100_000, "<p><table><tr><td>" + "<div>" * 100_000, "<li>" * 50_000 + "<ul><li>x" * 50_000, "<b>x" * 100_000 + "</i>y" * 100_000])
def test_unclosed_elements_take_linear_time(html):
    pages.page_lines("<p>warm")
    begun = time.perf_counter()
    pages.page_lines("<article>" + html)
    assert time.perf_counter() - begun < 6


def test_mixed_rows_that_differ_in_a_map_alone(spark):
    rows = [(1, "a b c", "s", {"k": 1}, [{"x": 1}]), (1, "a b c", "s", {"k": 2}, [{"x": 1}]), (1, "a b c", "s", {"k": 2}, [{"x": 2}]), (1, "a b c", "s", None, None), (1, "a b c", "s", None, None), (2, "d e", "t", {}, [])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>, n array<map<string,int>>")
    df = df.selectExpr("*", "struct(m as inner) as s", "parse_json(to_json(m)) as v")
    got = [(r["doc_id"], str(r["m"]), str(r["n"])) for r in mixing.mix(df, entropy=0, repeats=10.0, marks=False).select("doc_id", "m", "n").collect()]
    assert sorted(got) == sorted((r[0], str(r[3]), str(r[4])) for r in rows)


@pytest.mark.parametrize("rank", [1, 12])
def test_what_the_rank_leaves_out_loses_no_leak(spark, monkeypatch, rank):
    """With spaces of few axes the bound of the rest lets the same leaks through as the full rank; with many spaces too."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = lambda: {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    full = found()
    assert full
    whole = decontam.latent_axes
    monkeypatch.setattr(decontam, "latent_axes", lambda *a: whole(*a, rank=rank))
    monkeypatch.setattr(decontam, "LOCAL", 30)
    assert found() == full


def test_a_space_holds_its_items(spark):
    """At full rank next to nothing of an item lies outside its space, though the corpus' own directions are in it too."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    (some,) = decontam.spaces(docs, bench, decontam.REACH, decontam.LCS)
    for s in some:
        assert (s.rest <= 0.02 * s.size).all()
        assert abs(s.axes.T @ s.axes - np.eye(s.axes.shape[1])).max() < 1e-3


def test_training_holds_no_matrix_of_all_texts_and_candidates():
    """The driver's Python counts pairs by blocks of texts; 6,000 texts and 1,024 candidates were two matrices of 25 MB."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 3000, 40)).astype("<u4") for _ in range(6000)]
    y = rng.integers(0, 2, 6000)
    tracemalloc.start()
    machine = toxicity.fit(y, sets, np.ones(6000), steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(machine.w) < 500 and peak < 45e6


def test_axes_come_from_all_passages(spark, sf, monkeypatch):
    """The axes are fitted on every text of the table, not on some."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    seen, whole = [], decontam.latent_axes
    monkeypatch.setattr(decontam, "PASSAGES", 100)
    monkeypatch.setattr(decontam, "latent_axes", lambda corpus, *a: seen.append(corpus.count()) or whole(corpus, *a))
    list(decontam.spaces(docs, bench, decontam.REACH, decontam.LCS))
    assert seen and set(seen) == {docs.count()}


def test_products_of_passages_take_no_arrays_of_terms_times_axes():
    """The same sums as by whole dense matrices, and little memory beside them however many rows there are."""
    rng = np.random.default_rng(8)
    n, terms, axes = 20_000, 400, 272
    key = np.unique(rng.integers(0, n, 200_000) * terms + (rng.random(200_000) ** 3 * terms).astype(int))
    row, slot, x = key // terms, key % terms, rng.random(len(key))
    omega, sums = decontam.signs(np.arange(terms), axes), np.zeros((terms, axes))
    tracemalloc.start()
    decontam._add_products(sums, omega, row, slot, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dense = np.zeros((n, terms))
    dense[row, slot] = x
    assert np.allclose(sums, dense.T @ (dense @ omega))
    assert peak < 32 << 20  # the terms' axes take 8 * len(key) * axes, over 300 MB
    some = np.sort(rng.integers(0, len(key), 5000))
    latent = decontam.project(omega.astype(np.float32), slot[some], x[some], row[some], n)
    want = np.zeros((n, axes))
    np.add.at(want, row[some], omega[slot[some]] * x[some][:, None])
    assert latent.shape == want.shape and np.allclose(latent, want, atol=1e-4)
    assert not decontam.project(omega.astype(np.float32), slot[:0], x[:0], row[:0], 3).any()
