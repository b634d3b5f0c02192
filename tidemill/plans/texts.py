"""Queries over documents, pages, conversations and the star schema: content audits and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import columns as c
from tidemill.operators import content, graphs
from tidemill.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a front matter made of their own columns."""
    date = F.when(F.col("doc_id") % 4 == 0, "2024-01-05").when(F.col("doc_id") % 4 != 1, F.concat(F.lit("2024-01-05T10:00:00"), F.when(F.col("doc_id") % 2 == 0, "Z").otherwise("+01:00")))
    lines = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: doc "), F.col("doc_id").cast("string")), F.concat(F.lit("date: "), date), F.concat(F.lit("kind: "), F.col("lang")), F.when(F.col("doc_id") % 3 == 0, "effort: high"), F.when(F.col("doc_id") % 5 == 0, "model: m"), F.concat(F.lit("tags: [\""), F.col("source"), F.lit("\", "), F.col("lang"), F.lit("]")), F.lit("---"), F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 7 == 0, "no block").otherwise(lines).alias("md"))


def extract_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = content.extract_front_matter(_fronted(spark, sf_dir), "md")
    return out.select("doc_id", F.element_at("fields", "title").alias("title"), F.size("fields").alias("n_fields"), F.array_join("tags", "|").alias("tags"), "body")


def audit_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = content.audit_front_matter(content.extract_front_matter(_fronted(spark, sf_dir), "md").where("fields is not null"), ["title", "date"], [("kind", "fr", ["model"], ["effort"]), ("kind", "en", ["model", "effort"], [])])
    return out.select("doc_id", F.array_join("problems", "; ").alias("problems"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("draft"), F.col("ts").alias("date"), F.when(F.col("event_id") % 6 == 0, F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("expires"))


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.publishable(_dated(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz"), future=False, drafts=False).select("event_id")


def publish_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.publish_states(_dated(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def style_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.style_flags(_docs(spark, sf_dir), "text").select("doc_id", *content.STYLE)


def raw_image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("![a](x.png) ![]("), F.col("source"), F.lit(")"))).otherwise(""))
    return content.raw_image_refs(_docs(spark, sf_dir).select("doc_id", md.alias("md")), "md").select("doc_id", "n_images", F.array_join("images", "|").alias("images"))


def register_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = content.register_profile(_docs(spark, sf_dir), ["source"], "text", F.col("doc_id") % 3 == 0, F.col("doc_id") % 4 == 0)
    return out.select("source", "n", "p25", "p50", "p90", F.round("reply_share", 9).alias("reply_share"), F.round("quote_share", 9).alias("quote_share"), *[F.round(f"{c}_rate", 9).alias(f"{c}_rate") for c in ("hashtag", "mention", "emoji", "link", "line_break", "em_dash", "hyphen")])


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.split("text", r"[ \n]+").alias("terms"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.term_counts(_terms(spark, sf_dir), "doc_id", F.filter("terms", lambda x: x != ""))


def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, sf_dir).select(F.explode("terms").alias("term")).where("term != ''")
    return content.term_variants(terms).select("slug", F.array_join("variants", "|").alias("variants"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))


def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.section_rollup(_paths(spark, sf_dir), "path", 2)


def sections_without_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.sections_without_index(_paths(spark, sf_dir), "path")


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known pages: those whose path some page has, and single words that begin some document."""
    known = _docs(spark, sf_dir).select(F.concat(F.lit("/"), F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("path"))
    return content.broken_links(_paths(spark, sf_dir), "page_id", "html", known)


def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against the same texts a release earlier: some changed, some gone, some new."""
    now = _docs(spark, sf_dir).where("doc_id % 10 != 1").select("doc_id", c.integrity("text").alias("digest"))
    old = _docs(spark, sf_dir).where("doc_id % 10 != 2").select("doc_id", c.integrity(F.when(F.col("doc_id") % 10 == 3, F.upper("text")).otherwise(F.col("text"))).alias("digest"))
    return content.sync_diff(now, old, "doc_id", "digest")


def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three orders that share most parts with each order, by the smaller of the two quantities."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("term"), F.col("l_quantity").alias("w"))
    return content.related_items(items, "l_orderkey", "w", 3)


def layered_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    over = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 50).alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("value"))
    return content.layered_params(base, over)


def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    auth = F.when(F.col("event_id") % 3 == 0, '"ok"').when(F.col("event_id") % 3 == 1, '"expired"').otherwise("null")
    body = F.concat(F.lit('{"status":"'), F.when(F.col("event_type") == "error", "bad").otherwise("ok"), F.lit('","version":"1","uptime":'), F.col("event_id").cast("string"), F.lit(',"quotas":[{"name":"a","used_percent":'), (F.col("event_id") % 100).cast("string"), F.lit('},{"name":"b","used_percent":'), (F.col("user_id") % 100).cast("string"), F.lit('}],"auth":{"state":'), auth, F.lit("}}"))
    out = content.health_status(e.select("event_id", F.when(F.col("event_id") % 50 == 0, "oops").otherwise(body).alias("body")), "body")
    return out.select("event_id", "ok", "quota", F.array_join("advice", "; ").alias("advice"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a binary heap over their row numbers: parent of n is n div 2."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 2).cast("long").alias("parent_id"), "c_nationkey")


def first_matching_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return graphs.first_matching_ancestor(tree, tree.select("id"), F.col("c_nationkey") == 3, 12)


def thread_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("uri"), F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("parent_uri"), "turn")
    return graphs.thread_view(turns, turns)


def connected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts of all line items as a graph."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return graphs.connected_parts(e)


QUERIES = {f.__name__: f for f in (extract_front_matter, audit_front_matter, publishable, publish_states, style_flags, raw_image_refs, register_profile, term_counts, term_variants, section_rollup, sections_without_index, broken_links, sync_diff, related_items, layered_params, health_status, first_matching_ancestor, thread_view, connected_parts)}

_DATED = "SELECT event_id, event_type = 'error' AS draft, ts AS date, CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 2 DAY END AS expires FROM events"
_PATHS = r"SELECT page_id, html, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages"
ORACLE_SQL = {
    "extract_front_matter": """
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'doc ' || doc_id END AS title,
 CASE WHEN doc_id % 7 <> 0 THEN 3 + (doc_id % 4 <> 1)::INT + (doc_id % 3 = 0)::INT + (doc_id % 5 = 0)::INT END AS n_fields,
 CASE WHEN doc_id % 7 <> 0 THEN source || '|' || lang END AS tags, CASE WHEN doc_id % 7 = 0 THEN 'no block' ELSE coalesce(text, '') END AS body FROM documents""",
    "audit_front_matter": """
SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 4 = 1 THEN 'missing date' END, CASE WHEN doc_id % 4 = 0 THEN 'date without zone' END,
 CASE WHEN lang = 'fr' AND doc_id % 5 <> 0 THEN 'fr needs model' END, CASE WHEN lang = 'fr' AND doc_id % 3 = 0 THEN 'fr forbids effort' END,
 CASE WHEN lang = 'en' AND doc_id % 5 <> 0 THEN 'en needs model' END, CASE WHEN lang = 'en' AND doc_id % 3 <> 0 THEN 'en needs effort' END) AS problems
FROM documents WHERE doc_id % 7 <> 0""",
    "publishable": f"SELECT event_id FROM ({_DATED}) WHERE NOT draft AND date <= TIMESTAMP '2024-01-15' AND (expires IS NULL OR expires > TIMESTAMP '2024-01-15')",
    "publish_states": f"SELECT CASE WHEN draft THEN 'draft' WHEN expires <= TIMESTAMP '2024-01-15' THEN 'expired' WHEN date > TIMESTAMP '2024-01-15' THEN 'future' ELSE 'live' END AS state, count(*) AS n FROM ({_DATED}) GROUP BY 1",
    "style_flags": r"""SELECT doc_id, """ + ", ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))::INT AS {k}" for k, p in content.STYLE.items()) + " FROM documents",
    "raw_image_refs": r"""
WITH m AS (SELECT doc_id, regexp_extract_all(text || CASE WHEN doc_id % 3 = 0 THEN '![a](x.png) ![](' || source || ')' ELSE '' END, '!\[[^\]]*\]\([^)]*\)') AS l FROM documents)
SELECT doc_id, len(l)::INT AS n_images, array_to_string(l, '|') AS images FROM m""",
    "register_profile": r"""
SELECT source, count(*) AS n, quantile_cont(length(text), 0.25) AS p25, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.9) AS p90,
 round(avg((doc_id % 3 = 0)::INT), 9) AS reply_share, round(avg((doc_id % 4 = 0)::INT) FILTER (doc_id % 3 <> 0), 9) AS quote_share,
 round(avg(regexp_matches(text, '(?:^|\s)#\p{L}')::INT), 9) AS hashtag_rate, round(avg(regexp_matches(text, '(?:^|\s)@\w')::INT), 9) AS mention_rate,
 round(avg(regexp_matches(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]')::INT), 9) AS emoji_rate, round(avg(regexp_matches(text, 'https?://')::INT), 9) AS link_rate,
 round(avg(contains(text, '—')::INT), 9) AS em_dash_rate, round(avg(contains(text, chr(10))::INT), 9) AS line_break_rate, round(avg(contains(text, ' - ')::INT), 9) AS hyphen_rate FROM documents GROUP BY 1""",
    "term_counts": r"SELECT term, count(DISTINCT doc_id) AS items FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1",
    "term_variants": r"""
WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]+')) AS term FROM documents),
s AS (SELECT term, regexp_replace(regexp_replace(lower(term), '[^A-Za-z0-9_\s-]', '', 'g'), '\s+', '-', 'g') AS slug FROM t WHERE term <> '')
SELECT slug, string_agg(term, '|' ORDER BY term) AS variants FROM s GROUP BY 1 HAVING count(*) > 1""",
    "section_rollup": f"""
WITH p AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS l FROM ({_PATHS}))
SELECT l[1] AS level1, l[2] AS level2, count(*) AS pages, grouping(l[1], l[2]) AS g FROM p GROUP BY ROLLUP (l[1], l[2])""",
    "sections_without_index": f"""
WITH p AS (SELECT regexp_replace(path, '/+$', '') AS q FROM ({_PATHS}))
SELECT DISTINCT regexp_replace(q, '/[^/]*$', '') AS section FROM p WHERE regexp_replace(q, '/[^/]*$', '') <> '' AND regexp_replace(q, '/[^/]*$', '') NOT IN (SELECT q FROM p)""",
    "broken_links": r"""
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="(/[^"#?]*)', 1)) AS target FROM pages)
SELECT page_id, target FROM l WHERE target NOT IN (SELECT '/' || regexp_extract(text, '^([A-Za-z]+)', 1) FROM documents)""",
    "sync_diff": """
SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'DELETE' WHEN doc_id % 10 = 2 OR (doc_id % 10 = 3 AND upper(text) <> text) THEN 'UPLOAD' ELSE 'UNCHANGED' END AS action FROM documents""",
    "related_items": """
WITH t AS (SELECT l_orderkey, l_partkey AS term, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
s AS (SELECT a.l_orderkey, b.l_orderkey AS related, sum(least(a.w, b.w)) AS score FROM t a JOIN t b ON a.term = b.term AND a.l_orderkey <> b.l_orderkey GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, related)::INT AS rank FROM s QUALIFY rank <= 3""",
    "layered_params": """
WITH o AS (SELECT c_custkey + 50 AS key, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS value FROM customer)
SELECT coalesce(o.key, s_suppkey) AS key, CASE WHEN o.key IS NOT NULL THEN o.value ELSE s_acctbal END AS value, CASE WHEN o.key IS NOT NULL THEN 'override' ELSE 'base' END AS origin
FROM supplier FULL JOIN o ON o.key = s_suppkey""",
    "health_status": """
SELECT event_id, event_id % 50 <> 0 AND event_type <> 'error' AS ok, CASE WHEN event_id % 50 <> 0 THEN greatest(event_id % 100, user_id % 100)::DOUBLE END AS quota,
 concat_ws('; ', CASE WHEN event_id % 50 = 0 OR event_id % 3 = 2 THEN 'check sign-in: unknown' WHEN event_id % 3 = 1 THEN 'check sign-in: expired' END, 'refresh catalog: unknown') AS advice FROM events""",
    "first_matching_ancestor": """
WITH RECURSIVE w AS (SELECT c_custkey AS start, c_custkey // 2 AS "at", 1 AS hops FROM customer WHERE c_custkey // 2 <> 0 AND c_custkey // 2 <> c_custkey
 UNION ALL SELECT start, w."at" // 2, hops + 1 FROM w JOIN customer ON c_custkey = w."at" WHERE c_nationkey <> 3 AND w."at" // 2 <> 0 AND w."at" // 2 <> w."at" AND hops < 12)
SELECT start, w."at" AS ancestor, hops FROM w JOIN customer ON c_custkey = w."at" WHERE c_nationkey = 3""",
    "connected_parts": """
WITH RECURSIVE x AS (SELECT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem), e AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
r(node, part) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM e GROUP BY a
 UNION (SELECT e.a, min(r.part) FROM r JOIN e ON e.b = r.node JOIN recurring.r AS old ON old.node = e.a WHERE r.part < old.part GROUP BY e.a))
SELECT node, part FROM r""",
    "thread_view": """
SELECT s.conv_id || '/' || s.turn AS start, t.conv_id || '/' || t.turn AS uri, (t.turn - s.turn)::INT AS level
FROM conversations s JOIN conversations t ON s.conv_id = t.conv_id AND t.turn BETWEEN s.turn - 80 AND s.turn + 6
WHERE NOT EXISTS (SELECT 1 FROM range(least(s.turn, t.turn), greatest(s.turn, t.turn)) g(k) WHERE NOT EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = s.conv_id AND u.turn = g.k))""",
}
