"""Audits of pages and documents: front matter, terms, style, links, sections, sync, related items."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.columns import slug
from tidemill.operators.graphs import spread
from tidemill.operators.ordering import percentiles
from tidemill.sources.store import written

FRONT = r"\A---[ \t]*\r?\n([\s\S]*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)"
ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
#: Patterns of a style guide, by rule. Another table of rules can be given instead.
STYLE = {
    "hashtag": r"(?:^|\s)#\p{L}\w*", "em_dash": "—", "numbering": r"(?:^|\s)\d+/(?:\d+)?(?:\s|$)", "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "shouting": r"(?:^|\s)[A-Z]{4,}!!", "filler": r"(?i)\b(?:in order to|it is worth noting|at the end of the day)\b",
    "stock_opener": r"(?i)(?:^|[.!?]\s+)(?:great question|it'?s worth noting|here'?s the thing|this is fascinating)\b",
    "hedge_stack": r"(?i)\b(?:might|may|could|perhaps|maybe)\s+(?:possibly|perhaps|potentially|conceivably|arguably)\b",
    "inflation": r"(?i)\b(?:game-?changer|incredible|huge)\b",
    "launch_voice": r"(?i)\b(?:excited|thrilled|proud) to (?:share|announce)\b",
    "reveal": r"(?i)\bthe (?:result|best part|catch)\?\s",
}


def extract_front_matter(df: DataFrame, text: str) -> DataFrame:
    """Adds fields (map of strings, last of a repeated key wins), tags (array) and body. Without a block: null, null, the text."""
    block = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), FRONT, 1)
    has = F.coalesce(F.col(text).rlike(FRONT), F.lit(False))
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.-]*\s*:"))
    unquote = lambda c: F.regexp_replace(F.trim(c), r"^([\"'])(.*)\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), unquote(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    fields = F.when(has, F.map_from_entries(last))
    inline = F.regexp_extract(F.coalesce(F.element_at("fields", "tags"), F.lit("")), r"^\[(.*)\]$", 1)
    listed = F.regexp_extract_all(F.regexp_extract(block, r"(?:^|\n)tags:[ \t]*\r?\n((?:[ \t]*-[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*([^\r\n]+)"), F.lit(1))
    tags = F.when(has, F.transform(F.filter(F.concat(F.split(inline, ","), listed), lambda x: F.trim(x) != ""), unquote))
    return df.withColumn("fields", fields).withColumn("tags", tags).withColumn("body", F.when(has, F.regexp_replace(F.col(text), FRONT, "")).otherwise(F.col(text)))


def audit_front_matter(df: DataFrame, required: list[str], rules: list[tuple[str, str, list[str], list[str]]] = ()) -> DataFrame:
    """Adds problems. A rule (key, value, needs, forbids) holds for rows whose field has that value."""
    has = lambda k: F.coalesce(F.element_at("fields", k), F.lit("")) != ""
    found = [F.when(~has(k), f"missing {k}") for k in required]
    found.append(F.when(has("date") & ~F.element_at("fields", "date").rlike(ZONED), "date without zone"))
    for key, value, needs, forbids in rules:
        on = F.coalesce(F.element_at("fields", key) == value, F.lit(False))
        found += [F.when(on & ~has(k), f"{value} needs {k}") for k in needs] + [F.when(on & has(k), f"{value} forbids {k}") for k in forbids]
    return df.withColumn("problems", F.array_compact(F.array(*found)))


def publishable(df: DataFrame, as_of: Column, drafts: bool = False, future: bool = False) -> DataFrame:
    """Rows (draft, date, expires) that a build at ``as_of`` shows; the two switches are independent."""
    out = df.where(F.col("expires").isNull() | (F.col("expires") > as_of))
    if not drafts:
        out = out.where(~F.col("draft").eqNullSafe(True))
    return out if future else out.where(F.col("date").isNull() | (F.col("date") <= as_of))


def publish_states(df: DataFrame, as_of: Column) -> DataFrame:
    state = F.when(F.col("draft").eqNullSafe(True), "draft").when(F.col("expires") <= as_of, "expired").when(F.col("date") > as_of, "future").otherwise("live")
    return df.withColumn("state", state)


def style_flags(df: DataFrame, text: str, rules: dict[str, str] = STYLE) -> DataFrame:
    """Adds flags: how often each rule's pattern occurs, a column a rule."""
    return df.withColumns({name: F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(p)) for name, p in rules.items()})


def raw_image_refs(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("images", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(IMAGE), F.lit(0))).withColumn("n_images", F.size("images"))


def register_profile(posts: DataFrame, by: list[str], text: str, reply: Column, quote: Column, ranks: Callable = percentiles) -> DataFrame:
    """Shares and lengths of a group's posts; percentiles are exact, or ``sketches.percentiles`` as ``ranks``."""
    size = F.char_length(text)
    has = lambda p: F.avg(F.col(text).rlike(p).cast("int"))
    rates = {"hashtag": STYLE["hashtag"], "mention": r"(?:^|\s)@\w", "emoji": STYLE["emoji"], "link": "https?://", "line_break": "\n", "em_dash": "—", "hyphen": " - "}
    top = F.avg(F.when(~reply, quote.cast("int")))
    out = posts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(reply.cast("int")).alias("reply_share"), top.alias("quote_share"),
        *[has(p).alias(f"{k}_rate") for k, p in rates.items()],
    )
    lengths = ranks(posts.select(*by, size.alias("size@")), by, "size@", {"p25": 0.25, "p50": 0.5, "p90": 0.9})
    lengths = lengths.select(*[F.col(c).alias(f"{c}@") for c in by], "p25", "p50", "p90")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}@"))
    return out.join(lengths, on, "left").drop(*[f"{c}@" for c in by])


def term_counts(items: DataFrame, item: str, terms: Column) -> DataFrame:
    """How many items have each term; a term that an item repeats counts once."""
    return items.select(item, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("items"))


def term_variants(terms: DataFrame) -> DataFrame:
    """Groups of terms with the same slug."""
    out = terms.select("term", slug("term").alias("slug")).distinct().groupBy("slug").agg(F.array_sort(F.collect_set("term")).alias("variants"))
    return out.where(F.size("variants") > 1)


def section_rollup(pages: DataFrame, path: str, depth: int = 2) -> DataFrame:
    """Pages at every level of their path."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    levels = [F.get(parts, i).alias(f"level{i + 1}") for i in range(depth)]
    return pages.select(*levels).rollup(*[f"level{i + 1}" for i in range(depth)]).agg(F.count(F.lit(1)).alias("pages"), F.grouping_id().alias("g"))


def sections_without_index(pages: DataFrame, path: str) -> DataFrame:
    """Parents of pages that are not pages themselves."""
    clean = F.regexp_replace(F.col(path), "/+$", "")
    parents = pages.select(F.regexp_replace(clean, "/[^/]*$", "").alias("section")).where("section != ''").distinct()
    return parents.join(pages.select(clean.alias("section")).distinct(), "section", "left_anti")


def broken_links(pages: DataFrame, id_col: str, html: str, known: DataFrame) -> DataFrame:
    """(page, target) of internal links whose path is no known page (column path)."""
    links = F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"<a\s[^>]*?href=[\"'](/[^\"'#?]*)"), F.lit(1)), lambda x: F.when(x == "/", x).otherwise(F.regexp_replace(x, "/+$", "")))
    found = pages.select(id_col, F.explode(F.array_distinct(links)).alias("target"))
    return found.join(known.select(F.col("path").alias("target")).distinct(), "target", "left_anti").select(id_col, "target")


def sync_diff(source: DataFrame, target: DataFrame, key: str, digest: str, delete_removed: bool = True) -> DataFrame:
    """UPLOAD, DELETE or UNCHANGED for each key of either side (KEEP for extra ones where nothing is to be deleted)."""
    s, t = source.select(F.col(key).alias("k"), F.col(digest).alias("sd"), F.lit(True).alias("here")), target.select(F.col(key).alias("k2"), F.col(digest).alias("td"), F.lit(True).alias("there"))
    gone = F.lit("DELETE" if delete_removed else "KEEP")
    action = F.when(F.col("here").isNull(), gone).when(F.col("there").isNotNull() & F.col("sd").eqNullSafe(F.col("td")), "UNCHANGED").otherwise("UPLOAD")
    return s.join(t, F.col("k") == F.col("k2"), "full_outer").select(F.coalesce("k", "k2").alias(key), action.alias("action"))


#: Rows or pairs of a task of ``related_items``, and the pairs of one item that a task may get whole.
ROWS, WHOLE = 1 << 19, 1 << 20
#: Words of 64 bits in the mark of an item's terms.
WORDS = 4


def _tasks(df: DataFrame, rows: int) -> int:
    """As many tasks as keep each at about ``ROWS`` rows, at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _shared(asking: DataFrame, there: DataFrame, item: str, newer: str | None, rows: int) -> DataFrame:
    """(item, related, score): the weight that items of ``asking`` share with others in its terms, which hold their number ``df`` of items.

    A term's items are dealt to parts of some thousand, each of which meets the items that ask for the term. Tasks are as many as the
    ``rows`` of ``there`` and the pairs take, which are counted before; an item's pairs go to one task, unless they are too many.
    """
    n, widest = asking.groupBy(item).agg(F.sum("df").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = _tasks(asking, rows + n)
    parts = asking.select("term", F.ceil(F.col("df") / 4096).alias("parts")).distinct()
    has = there.repartition(tasks, "term").join(parts, "term").withColumn("part", F.pmod(F.xxhash64(item), F.col("parts"))).select("term", "part", F.col(item).alias("related"), F.col("w").alias("w2"), *([F.col(newer).alias("date2")] if newer else []))
    asks = asking.join(parts, "term").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    pairs = asks.repartition(tasks, "term", "part").join(has.repartition(tasks, "term", "part"), ["term", "part"]).where(F.col(item) != F.col("related"))
    if newer:
        pairs = pairs.where(F.col("date2") <= F.col(newer))
    pairs = pairs.select(item, "related", F.least("w", "w2").alias("score")).repartition(tasks, *([item] if widest <= WHOLE else [item, "related"]))
    return pairs.groupBy(item, "related").agg(F.sum("score").alias("score"))


def _shared_best(shared: DataFrame, asked: DataFrame | None, item: str, n: int, most: int, rows: int) -> DataFrame:
    """As ``_shared`` in the terms of up to ``most`` items, without pairs that can't be among an item's n best; weights are not negative.

    A pair with one term alone in common scores there what it scores at all, so it needs to be among the term's n best for the item.
    Pairs with more in common are told before any is moved: an item's row has a bit for each of its other terms, and two rows
    of a term without a common bit have no other term in common (by chance they may have such a bit, and are kept).
    """
    each = shared if asked is None else shared.join(asked, item, "left_semi")
    each = each.repartition(_tasks(shared, rows), item).groupBy(item).agg(F.sum(F.when(F.col("df") <= most, F.col("df")).otherwise(0)).alias("n"), F.count(F.lit(1)).alias("k"))
    pairs, widest, k, k2 = each.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.max("n"), F.sum("k"), F.sum(F.col("k") * F.col("k")))]).first()
    chance = min(1.0, (k2 / max(k, 1)) ** 2 / (64 * WORDS))
    tasks, then = _tasks(shared, 2 * rows), _tasks(shared, min(pairs, rows * n + int(chance * pairs)))
    marks = shared.repartition(tasks, item).withColumn("bit", F.pmod(F.xxhash64("term"), F.lit(64 * WORDS))).withColumn("again", F.count(F.lit(1)).over(W.partitionBy(item, "bit")) > 1)
    for k in range(WORDS):
        own = F.expr(f"if(bit div 64 = {k}, shiftleft(1L, cast(bit % 64 as int)), 0L)")
        every = F.bit_or(own).over(W.partitionBy(item))
        marks = marks.withColumn(f"m{k}", F.when(F.col("again"), every).otherwise(every.bitwiseAND(F.bitwise_not(own))))
    own = [f"m{k}" for k in range(WORDS)]
    rare = marks.where(F.col("df") <= most).select("term", item, "w", *own).repartition(tasks, "term")
    down = W.partitionBy("term").orderBy(F.desc("w"))
    has = rare.withColumn("place", F.row_number().over(W.partitionBy("term").orderBy(F.desc("w"), item))).select("term", F.col(item).alias("related"), F.col("w").alias("w2"), "place", *[F.col(m).alias(f"o{m}") for m in own])
    asks = rare.withColumn("nth", F.get(F.sort_array(F.collect_list(item).over(down)), F.lit(n)))  # of the items that weigh as much or more, in order
    if asked is not None:
        asks = asks.join(asked, item, "left_semi").repartition(tasks, "term")
    more = functools.reduce(operator.or_, (F.col(m).bitwiseAND(F.col(f"o{m}")) != 0 for m in own))
    best = F.when(F.col("nth").isNull(), F.col("place") <= n + 1).otherwise((F.col("w2") >= F.col("w")) & (F.col("related") <= F.col("nth")))
    pairs = asks.join(has.hint("merge"), "term").where((F.col(item) != F.col("related")) & (more | best))
    pairs = pairs.select(item, "related", F.least("w", "w2").alias("score")).repartition(then, *([item] if widest <= WHOLE else [item, "related"]))
    return pairs.groupBy(item, "related").agg(F.sum("score").alias("score"))


def related_items(item_terms: DataFrame, item: str, weight: str, n: int, queries: DataFrame | None = None, threshold: float = 0.0, newer: str | None = None, first: int = 64, step: int = 8, log: list | None = None) -> DataFrame:
    """The n items that share most weight in terms with each item of ``queries`` (all items where it is None).

    A pair's score is the sum over all shared terms, however frequent, of the lesser of the two weights; pairs under
    ``threshold`` are left out. Where ``newer`` names a column of dates, items newer than the item itself are too. Repeated
    (item, term) rows count once, by their greatest weight; null items and terms relate to nothing.

    Rare terms come first: those of up to ``first`` items, then of ``step`` times as many, and so on. What an item's terms that are
    still to come can add is bounded by the greatest weight of each; once that is less than its n-th best score, no other item can
    be among its best, so only the scores of those found are completed, item by item, and the items of its frequent terms
    are never gone through. Items with too little in common by then take the next terms. ``log`` gets how many items each step left.
    Where no weight is negative or missing and no dates are asked for, the first step leaves out pairs that have one term in common
    and are not among its best (``_shared_best``).
    """
    keep = [newer] if newer else []
    rows = item_terms.where(F.col(item).isNotNull() & F.col("term").isNotNull())
    t = written(rows.repartition(_tasks(rows, rows.count()), item, "term").groupBy(item, "term").agg(F.max(weight).alias("w"), *[F.max(c).alias(c) for c in keep]), "terms")
    df = written(t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("most"), F.min("w").alias("least")).where("df > 1"), "df")
    adds = F.coalesce((F.col("w") >= 0) & ~F.isnan(F.col("w").cast("double")), F.lit(False))
    n_rows, all_add = t.agg(F.count(F.lit(1)), F.bool_and(adds)).first()
    t = asking = written(spread(t, df.withColumn("n@", F.col("df")), "term", ROWS, tasks=_tasks(t, n_rows)), "shared")
    asked = None if queries is None else queries.select(item).distinct()
    if asked is not None:
        asking = written(t.repartition(_tasks(t, n_rows), item).join(asked, item, "left_semi"), "asking")
    top = asking.agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]
    scores, out, done = None, [], 0
    while asking is not None:
        last, bound = first >= top, first
        if all_add and not newer and not done:
            pairs = _shared_best(t, asked, item, n, bound, n_rows)
        else:
            pairs = _shared(asking.where((F.col("df") > done) & (F.col("df") <= bound)), t, item, newer, n_rows)
        if scores is not None:
            pairs = scores.unionByName(pairs).groupBy(item, "related").agg(F.sum("score").alias("score"))
        if last:
            out.append(pairs)
            break
        pairs = written(pairs, "scores")
        to_come = asking.where(F.col("df") > bound)
        bounds = to_come.groupBy(item).agg(F.sum(F.greatest(F.least("w", "most"), F.lit(0))).alias("up"), F.sum(F.least(F.least("w", "least"), F.lit(0))).alias("down"))
        ranked = pairs.withColumn("at", F.row_number().over(W.partitionBy(item).orderBy(F.desc("score"), "related"))).where(F.col("at") == n).select(item, F.col("score").alias("nth"))
        state = asking.select(item).distinct().join(bounds, item, "left").join(ranked, item, "left")
        slack = (F.abs("up") + F.abs("nth")) * 1e-9
        sure = F.col("up").isNull() | F.coalesce(F.col("nth") + F.col("down") > F.col("up") + slack, F.lit(False))
        state = written(state.select(item, "nth", "up", "down", sure.alias("sure"), slack.alias("slack")), "state")
        ended = state.where("sure").drop("sure")
        able = F.col("up").isNull() | (F.col("score") + F.col("up") >= F.col("nth") + F.col("down") - F.col("slack"))
        found = written(pairs.join(ended, item).where(able).select(item, "related", "score"), "found")
        more = found.join(to_come.select(item, "term", "w"), item).join(t.select(F.col(item).alias("related"), "term", F.col("w").alias("w2")), ["related", "term"])
        out.append(found.unionByName(more.select(item, "related", F.least("w", "w2").alias("score"))).groupBy(item, "related").agg(F.sum("score").alias("score")))
        open_ = state.where("not sure").select(item)
        left = open_.count()
        if log is not None:
            log.append(left)
        asking = written(asking.join(open_, item, "left_semi"), "asking") if left else None
        scores = pairs.join(open_, item, "left_semi")
        done, first = bound, first * step
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(W.partitionBy(item).orderBy(F.desc("score"), "related"))).where(F.col("rank") <= n)


def layered_params(base: DataFrame, override: DataFrame) -> DataFrame:
    """value and origin a key: the override's, null included, where it has the key."""
    o = override.select(F.col("key").alias("okey"), F.col("value").alias("ovalue"))
    has = F.col("okey").isNotNull()
    out = base.join(o, F.col("key") == F.col("okey"), "full_outer")
    return out.select(F.coalesce("okey", "key").alias("key"), F.when(has, F.col("ovalue")).otherwise(F.col("value")).alias("value"), F.when(has, "override").otherwise("base").alias("origin"))


def health_status(df: DataFrame, body: str) -> DataFrame:
    """From health reports in JSON: ok (identity), quota (the busiest, in percent), advice."""
    kind = "status string, version string, uptime double, quotas array<struct<name: string, used_percent: double>>, auth struct<state: string>, catalog struct<state: string>"
    h = F.from_json(body, kind)
    ok = F.coalesce((h["status"] == "ok") & (F.coalesce(h["version"], F.lit("")) != "") & h["uptime"].isNotNull(), F.lit(False))
    quota = F.array_max(F.transform(h["quotas"], lambda q: q["used_percent"]))
    state = lambda s: F.coalesce(h[s]["state"], F.lit("unknown"))
    advice = F.array_compact(F.array(F.when(state("auth") != "ok", F.concat(F.lit("check sign-in: "), state("auth"))), F.when(state("catalog") != "ok", F.concat(F.lit("refresh catalog: "), state("catalog")))))
    return df.withColumn("ok", ok).withColumn("quota", quota).withColumn("advice", advice)
