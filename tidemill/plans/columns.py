"""Queries that put the shared column expressions to work over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import columns as c
from tidemill.operators import presence
from tidemill.sources.tables import table


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and days of views and of clicks, each once."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return presence.evidence_union(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id", "day"])


def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files, by how long each may be cached."""
    ending = F.element_at(F.array(*[F.lit(x) for x in ("", "/", ".css", ".PNG", ".json", ".html")]), (F.col("page_id") % 6 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select(c.stored_path(F.concat(F.lit("/p"), F.col("page_id").cast("string"), ending)).alias("file"))
    return files.groupBy(c.cache_policy("file").alias("policy"), F.col("file").endswith("index.html").alias("is_index")).agg(F.count(F.lit(1)).alias("files"))


def payload_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", c.payload_code("props").alias("code"))


def effective_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    suffix, body = F.when(F.col("event_id") % 3 == 0, "medium").when(F.col("event_id") % 3 == 1, ""), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, "low")
    level, origin = c.effective_level(suffix, body, "high", ["low", "high", "max"], {"medium": "high"})
    return e.select("event_id", level.alias("level"), origin.alias("origin"))


def elapsed_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers as elapsed times in several forms, read back; every ninth is malformed."""
    n = F.col("event_id") * 37
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day, hour, rest = F.floor(n / 86400), F.floor(n % 86400 / 3600), F.concat(two(F.floor(n % 3600 / 60)), F.lit(":"), two(n % 60))
    text = F.when(F.col("event_id") % 9 == 0, "1:2:3:4").when(n >= 86400, F.concat(day.cast("string"), F.lit("-"), two(hour), F.lit(":"), rest)).when(n >= 3600, F.concat(two(hour), F.lit(":"), rest)).otherwise(rest)
    return table(spark, sf_dir, "events").select("event_id", c.elapsed_seconds(text).alias("seconds"))


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.clean_token("text").alias("token"))


QUERIES = {f.__name__: f for f in (evidence_union, cache_report, payload_codes, effective_levels, elapsed_seconds, clean_tokens)}
ORACLE_SQL = {
    "evidence_union": "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type IN ('view', 'click')",
    "cache_report": """
SELECT CASE page_id % 6 WHEN 2 THEN 'public, max-age=31536000, immutable' WHEN 3 THEN 'public, max-age=86400' WHEN 4 THEN 'public, max-age=3600' ELSE 'no-cache' END AS policy,
 page_id % 6 IN (0, 1) AS is_index, count(*) AS files FROM pages GROUP BY ALL""",
    "payload_codes": """SELECT event_id, substr(sha256('{"k":' || json_extract_string(props, '$.k') || '}'), 1, 16) AS code FROM events""",
    "effective_levels": """
WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN '' END AS s, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'low' END AS b FROM events),
l AS (SELECT *, coalesce(nullif(s, ''), nullif(b, ''), 'high') AS l FROM e)
SELECT event_id, CASE WHEN l IN ('low', 'high', 'max') THEN l ELSE 'max' END AS level, CASE WHEN nullif(s, '') IS NOT NULL THEN 'suffix' WHEN b IS NOT NULL THEN 'body' ELSE 'default' END AS origin FROM l""",
    "elapsed_seconds": "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id * 37 END AS seconds FROM events",
    "clean_tokens": r"SELECT conv_id, turn, regexp_replace(text, '[\s\x{0085}\p{Z}\x00-\x1f\x7f]+', '_', 'g') AS token FROM conversations",
}
