"""Queries over events, documents and conversations: presence, windows, paging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import ordering, presence, search, sketches
from tidemill.sources.store import shared_folder
from tidemill.sources.tables import table

AS_OF, BEFORE, AFTER, GRACE = "2024-02-01 00:00:00", 30, 21600, 120


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


def absent_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.absent_partner(_kind(spark, sf_dir, "view"), _kind(spark, sf_dir, "click"), "user_id", BEFORE, AFTER, GRACE, AS_OF)


def absent_partner_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User 0 stands for everyone."""
    who = F.when(F.col("user_id") == 0, "?").otherwise(F.col("user_id").cast("string")).alias("who")
    starts, ons = (_kind(spark, sf_dir, k).select(who, "ts") for k in ("view", "click"))
    return presence.absent_partner(starts, ons, "who", 30, 900, GRACE, AS_OF, wildcard="?")


def _offs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _kind(spark, sf_dir, "view")
    marked = starts.where("event_id % 10 = 0").select("user_id", "ts")
    due = presence.absent_partner(starts, _kind(spark, sf_dir, "click"), "user_id", BEFORE, AFTER, GRACE, AS_OF, marked=marked)
    return presence.evidence_union(marked, due, ["user_id", "ts"])


def daily_state_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.daily_state_report(_kind(spark, sf_dir, "view"), _kind(spark, sf_dir, "click"), _offs(spark, sf_dir))


def last_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.last_transition(table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.first_occurrence(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


def first_start_per_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _kind(spark, sf_dir, "view").select(F.col("user_id").alias("pid"), "ts", F.col("event_id").alias("id"))
    return presence.first_start_per_process(starts, _kind(spark, sf_dir, "signup").select(F.col("user_id").alias("pid"), F.col("ts").alias("launch")))


def keep_newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.keep_newest_rows(table(spark, sf_dir, "events").select("event_type", "ts", "event_id"), "event_type", ["ts", "event_id"], 100)


def keep_newest_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return ordering.keep_newest_bytes(docs, "source", ["doc_id"], "bytes", 100_000, 50_000)


def thread_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("id"))
    return ordering.thread_refs(turns, "conv_id", "turn", "id")


def split_on_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = ordering.split_on_marker(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error")
    return kept


def stride_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.stride_gaps(table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").count().select("l_suppkey", "l_orderkey"), "l_suppkey", "l_orderkey", 100)


def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ordering.feed_page(posts, "user_id", 7, "ts", "event_id", 20, ("2024-01-20 00:00:00", 1 << 40), F.col("event_type") != "error")


def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of a user's feed, each from the cursor that the one before returned."""
    events, out, cursor = table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), None, None
    for k in range(3):
        page = ordering.feed_page(events, "user_id", 7, "ts", "event_id", 10, cursor)
        numbered = page.withColumn("page", F.lit(k))
        out = numbered if out is None else out.unionByName(numbered)
        cursor = ordering.next_cursor(page, "ts", "event_id", 10).first()["cursor"]
        if cursor is None:
            break
    return out


def day_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values' quantiles over two weeks from daily sketches: how many values, and whether each quantile's true rank is near enough."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    two = sketches.over_days(sketches.daily_sketches(e, ["event_type"], "ts", "value"), ["event_type"], "2024-01-05", "2024-01-18")
    q = sketches.quantiles(two, {"p50": 0.5, "p99": 0.99}).withColumnRenamed("event_type", "kind")
    rows = e.where("value is not null and ts >= '2024-01-05' and ts < '2024-01-19'").join(q, F.col("event_type") == F.col("kind"))
    share = lambda c: (F.avg((F.col("value") < F.col(c)).cast("int")), F.avg((F.col("value") <= F.col(c)).cast("int")))
    near = [((share(c)[0] <= p + sketches.RANK_ERROR) & (share(c)[1] >= p - sketches.RANK_ERROR)).alias(f"{c}_near") for c, p in (("p50", 0.5), ("p99", 0.99))]
    return rows.groupBy("event_type").agg(F.max("n").alias("n"), *near)


def search_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.search_posts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "the with that", "text", ["doc_id"]).select("doc_id", "source")


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "text", ["doc_id"], path, 8)
    return search.Index(spark, path)


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by an index of the documents."""
    return _index(spark, sf_dir).search("The with that").select("doc_id", "source")


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents in which two words stand one after the other."""
    return _index(spark, sf_dir).search("of the", 50, phrase=True).select("doc_id")


QUERIES = {f.__name__: f for f in (absent_partner, absent_partner_wildcard, daily_state_report, last_transition, first_occurrence, first_start_per_process, keep_newest_rows, keep_newest_bytes, thread_refs, split_on_marker, stride_gaps, feed_page, feed_pages, day_quantiles, search_posts, search_index, search_phrase)}

_NEAR = f"o.ts BETWEEN s.ts - INTERVAL {BEFORE} SECOND AND s.ts + INTERVAL {AFTER} SECOND"
_DUE = f"""SELECT DISTINCT s.user_id, s.ts FROM events s
WHERE s.event_type = 'view' AND s.user_id IS NOT NULL AND s.ts < TIMESTAMP '{AS_OF}' - INTERVAL {GRACE} SECOND
AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'click' AND o.user_id = s.user_id AND {_NEAR})"""

ORACLE_SQL = {
    "absent_partner": _DUE,
    "absent_partner_wildcard": f"""
WITH e AS (SELECT CASE WHEN user_id = 0 THEN '?' ELSE user_id::VARCHAR END AS who, ts, event_type FROM events)
SELECT DISTINCT s.who, s.ts FROM e s WHERE s.event_type = 'view' AND s.ts < TIMESTAMP '{AS_OF}' - INTERVAL {GRACE} SECOND
AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'click' AND o.who = s.who AND o.ts BETWEEN s.ts - INTERVAL 30 SECOND AND s.ts + INTERVAL 900 SECOND)
AND NOT EXISTS (SELECT 1 FROM e o WHERE o.event_type = 'click' AND o.who = '?' AND o.ts BETWEEN s.ts - INTERVAL 30 SECOND AND s.ts + INTERVAL 900 SECOND)""",
    "daily_state_report": f"""
WITH marked AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view' AND event_id % 10 = 0),
due AS ({_DUE}), offs AS (SELECT * FROM marked UNION SELECT * FROM due),
r AS (SELECT ts, 'starts' AS k FROM events WHERE event_type = 'view' UNION ALL SELECT ts, 'ons' FROM events WHERE event_type = 'click' UNION ALL SELECT ts, 'offs' FROM offs)
SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'total') AS day, count(*) FILTER (k = 'starts') AS starts, count(*) FILTER (k = 'ons') AS ons, count(*) FILTER (k = 'offs') AS offs
FROM r GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'))""",
    "last_transition": """
WITH e AS (SELECT ts, event_id, event_type AS state, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events),
last AS (SELECT state FROM e ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT last.state, t.before AS from_state, t.ts AS at FROM last LEFT JOIN (SELECT * FROM e WHERE before IS NOT NULL AND before <> state ORDER BY ts DESC, event_id DESC LIMIT 1) t ON true""",
    "first_occurrence": "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "first_start_per_process": """
WITH s AS (SELECT user_id AS pid, ts, event_id AS id, (SELECT max(p.ts) FROM events p WHERE p.event_type = 'signup' AND p.user_id = e.user_id AND p.ts - INTERVAL 5 SECOND <= e.ts) AS launch
FROM events e WHERE event_type = 'view')
SELECT pid, ts, id FROM s QUALIFY launch IS NULL OR row_number() OVER (PARTITION BY pid, launch ORDER BY ts, id) = 1""",
    "keep_newest_rows": "SELECT event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100",
    "keep_newest_bytes": """
WITH d AS (SELECT source, doc_id, strlen(text)::BIGINT AS bytes FROM documents),
w AS (SELECT *, sum(bytes) OVER (PARTITION BY source) AS total, sum(bytes) OVER (PARTITION BY source ORDER BY doc_id DESC) AS run FROM d)
SELECT source, doc_id, bytes FROM w WHERE total <= 100000 OR run <= 50000""",
    "thread_refs": """
WITH t AS (SELECT conv_id, turn, conv_id || '/' || turn AS id FROM conversations)
SELECT conv_id, turn, id, first(id) OVER w AS root, lag(id) OVER w AS parent FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "split_on_marker": """
WITH e AS (SELECT user_id, ts, event_id, event_type, (event_type = 'signup')::INT AS m FROM events WHERE event_type <> 'error')
SELECT user_id, ts, event_id, event_type, (sum(m) OVER w + 1 - first(m) OVER w)::BIGINT AS group_no FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "stride_gaps": """
WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), g AS (SELECT *, l_orderkey - lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS gap FROM d)
SELECT * FROM g WHERE gap <> 100""",
    "feed_page": "SELECT user_id, ts, event_id, event_type FROM events WHERE user_id = 7 AND event_type <> 'error' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "feed_pages": """
WITH r AS (SELECT user_id, ts, event_id, (row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1) // 10 AS page FROM events WHERE user_id = 7) SELECT user_id, ts, event_id, page::INTEGER AS page FROM r WHERE page < 3""",
    "day_quantiles": "SELECT event_type, count(value) AS n, true AS p50_near, true AS p99_near FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-19' GROUP BY 1",
    "search_index": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'with') AND contains(lower(text), 'that') ORDER BY doc_id DESC LIMIT 20",
    "search_phrase": r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[\x20\x09-\x0D])of[\x20\x09-\x0D]+the($|[\x20\x09-\x0D])') ORDER BY doc_id DESC LIMIT 50",
    "search_posts": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'with') AND contains(lower(text), 'that') ORDER BY doc_id DESC LIMIT 20",
}
