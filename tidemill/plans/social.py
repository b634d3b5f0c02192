"""Queries over conversations, embeddings and events as posts, meshes and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators import meshes, posts
from tidemill.sources import logs
from tidemill.sources.snapshots import Snapshots
from tidemill.sources.store import shared_folder, written
from tidemill.sources.tables import table
from tidemill.streaming import jobs


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested post views in JSON."""
    c = table(spark, sf_dir, "conversations").withColumn("uri", F.concat_ws("/", "conv_id", "turn"))
    image = lambda alt: F.struct(alt.alias("alt"), F.concat(F.lit("f/"), "uri").alias("fullsize"), F.lit("t").alias("thumb"))
    images = F.when(F.col("turn") % 3 == 0, F.array(image(F.col("role")), image(F.lit(None).cast("string"))))
    card = lambda turn, host: F.when(F.col("turn") == turn, F.struct(F.concat(F.lit(f"https://{host}.x/"), "uri").alias("uri"), F.col("role").alias("title"), F.lit("d").alias("description")))
    media = F.when(F.col("turn") % 3 == 1, F.struct(F.array(image(F.lit("m"))).alias("images"), card(7, "m").alias("external")))
    inner = F.array(F.struct(F.lit("app.bsky.embed.external#view").alias("$type"), F.lit(None).cast("array<struct<alt:string,fullsize:string,thumb:string>>").alias("images"), card(2, "q").alias("external")), F.struct(F.lit("app.bsky.embed.images#view").alias("$type"), F.array(image(F.lit("q"))).alias("images"), card(99, "").alias("external")))
    said = lambda when: [F.when(when, F.concat_ws("/", F.col("conv_id") + 1, F.lit("0"))).alias("uri"), F.when(when, F.struct(F.concat(F.lit("did:"), (F.col("conv_id") + 1).cast("string")).alias("did"), F.concat(F.lit("q"), "role").alias("handle"))).alias("author"), F.when(when, F.struct(F.concat(F.lit("quoted "), "role").alias("text"))).alias("value")]
    with_media = F.col("turn") == 6
    record = F.when(F.col("turn") % 2 == 0, F.struct(*said(~with_media), F.when(F.col("turn") == 2, inner).alias("embeds"), F.when(with_media, F.struct(*said(with_media))).alias("record")))
    video = F.col("turn") == 5
    embed = F.struct(F.when(video, "app.bsky.embed.video#view").alias("$type"), images.alias("images"), media.alias("media"), record.alias("record"), card(4, "c").alias("external"), F.when(video, F.concat(F.lit("v/"), "uri")).alias("playlist"), F.when(video, F.col("role")).alias("alt"))
    reply = F.when(F.col("turn") > 0, F.struct(F.struct(F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("uri")).alias("parent"), F.struct(F.concat_ws("/", "conv_id", F.lit("0")).alias("uri")).alias("root")))
    feature = F.struct(F.lit("app.bsky.richtext.facet#link").alias("$type"), F.concat(F.lit("https://e.x/"), "uri").alias("uri"))
    facets = F.array(F.struct(F.struct(F.lit(0).alias("byteStart"), F.octet_length("text").alias("byteEnd")).alias("index"), F.array(feature).alias("features")))
    view = F.struct("uri", F.struct(F.concat(F.lit("did:"), F.col("conv_id").cast("string")).alias("did"), F.col("role").alias("handle")).alias("author"), F.struct("text", reply.alias("reply"), F.when(F.col("turn") == 1, facets).alias("facets")).alias("record"), embed.alias("embed"), F.col("turn").alias("likeCount"))
    return c.select(F.when(F.col("conv_id") % 17 == 5, "{broken").otherwise(F.to_json(view)).alias("json"))


def flatten_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.flatten_posts(_views(spark, sf_dir), "json")["posts"].select("uri", "did", "handle", "text", "parent_uri", "root_uri", "quote_uri", "like_count")


def flatten_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.flatten_posts(_views(spark, sf_dir), "json")["images"]


def flatten_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.flatten_posts(_views(spark, sf_dir), "json")["facets"]


def flatten_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.flatten_posts(_views(spark, sf_dir), "json")["videos"]


def flatten_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.flatten_posts(_views(spark, sf_dir), "json")["links"]


def flatten_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.flatten_posts(_views(spark, sf_dir), "json")["quotes"]


def alt_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts.flatten_posts(_views(spark, sf_dir), "json")
    return posts.alt_text_coverage(flat["images"].join(flat["posts"].select("uri", "handle"), "uri"), ["handle"])


def quotes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts.flatten_posts(_views(spark, sf_dir), "json")["posts"]
    return posts.quotes_of(p.select("uri", "quote_uri", "like_count"), p.select("uri"), ["like_count", "uri"], 2)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))


def write_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plan(spark, sf_dir)
    got = p.where("(conv_id + turn) % 6 != 5").select("conv_id", "turn", F.when(F.col("size") % 7 != 0, F.concat(F.lit("r"), F.col("turn").cast("string"))).alias("ref"), F.lit(True).alias("attempted"))
    return posts.write_outcome(p, got, "conv_id", "turn").withColumn("written", F.array_join("written", "|"))


def validate_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "474946383961")]), (F.col("turn") % 4 + 1).cast("int"))
    data = F.when(F.col("turn") != 6, F.concat(head, F.col("text").cast("binary")))
    image = F.struct(F.lit("p").alias("path"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("alt"), data.alias("data"))
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array_repeat(image, (F.col("conv_id") % 6).cast("int")).alias("images"))
    return posts.validate_posts(p, "conv_id").select("conv_id", "turn", F.array_join("violations", "; ").alias("violations"))


def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    who = F.concat(F.lit("User"), F.col("user_id").cast("string"))
    ref = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("https://bsky.app/profile/"), who, F.lit("/post/"), F.col("event_id").cast("string"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("at://did:"), who, F.lit("/app.bsky.feed.post/k"))).when(F.col("event_id") % 4 == 2, "https://bsky.app:99/profile/a/post/b").otherwise(F.concat(F.lit("at://"), who, F.lit("/app.bsky.feed.post/k")))
    handles = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("USER"), F.col("c_custkey").cast("string")).alias("handle"), F.concat(F.lit("did:c"), F.col("c_custkey").cast("string")).alias("did"))
    return posts.resolve_refs(e.select("event_id", ref.alias("ref")), "ref", handles)


def distinct_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("hé @u"), F.col("user_id").cast("string"), F.lit(" and @U"), (F.col("event_id") % 50).cast("string"), F.lit(" x@y.z https://a.b/@c")).alias("text"))
    handles = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("handle"), F.col("s_suppkey").alias("did"))
    return posts.distinct_mentions(e, "event_id", "text", handles)


def resolve_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return posts.resolve_first(table(spark, sf_dir, "customer").select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority"), ["c_custkey"], "o_orderkey", "o_orderpriority")


def delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    targets = o.select(F.col("o_orderkey").alias("uri"), F.col("o_custkey").alias("did"), F.col("o_orderstatus").alias("cid"))
    now = o.where("o_orderkey % 9 != 0").select(F.col("o_orderkey").alias("uri"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("cid"))
    return posts.delete_plan(targets, now, F.when(F.col("did") % 3 != 0, F.col("did")))


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A model a nation: customers as points of a strip of triangles, each point with the next two or three."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("model"), F.col("c_custkey").alias("k"))
    v = c.select("model", F.floor(F.col("k") / 3).alias("v_id")).distinct().select("model", "v_id", (F.col("v_id") % 7).cast("double").alias("x"), (F.col("v_id") % 11).cast("double").alias("y"), (F.col("v_id") % 5).cast("double").alias("z"))
    w = W.partitionBy("model").orderBy("v_id")
    f = v.select("model", F.row_number().over(w).cast("long").alias("face_id"), F.array("v_id", *[F.lead("v_id", k).over(w) for k in (1, 2, 3)]).alias("v"))
    f = f.select("model", "face_id", F.array_compact(F.slice("v", 1, F.when(F.col("face_id") % 13 == 0, 4).otherwise(3))).alias("v")).where("size(v) > 2")
    again = f.where("face_id % 5 = 0").select("model", (F.col("face_id") + 10000).alias("face_id"), F.reverse("v").alias("v"))
    return f.unionByName(again), v


def mesh_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.mesh_quality(*_mesh(spark, sf_dir), 2.0)


def mesh_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = meshes.mesh_measures(*_mesh(spark, sf_dir))
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns if c != "model"])


def duplicate_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.duplicate_faces(_mesh(spark, sf_dir)[0])


def tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' quantities, with more discounts than taxes as defects and the dearest line as extent."""
    items = table(spark, sf_dir, "lineitem")
    defects = items.groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") > 0.05).alias("after"), F.count_if(F.col("l_tax") > 0.03).alias("before"))
    extents = items.groupBy("l_suppkey").agg((F.max("l_extendedprice") / 300).alias("extent"))
    return meshes.tolerance_check(items, ["l_suppkey"], "l_quantity", 45.5, defects=defects, extents=extents)


def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("model"), "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])
    return meshes.within_radius(e, e.where("vec_id % 20 = 0"), 0.1).select("vec_id")


def read_state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written out as log lines, some malformed, and read back."""
    e = table(spark, sf_dir, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    iso = F.when(F.col("event_id") % 20 == 1, F.lit("2024-13-01T00:00:00Z")).otherwise(iso)
    state = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "on").when(F.col("event_type") == "error", "off").otherwise("gone")
    start = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("for_start="), iso)).otherwise("for_start=x")
    line = F.concat_ws(" ", iso, F.concat(F.lit("session="), F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).otherwise("")), F.lit("a=1 =b a=2"), F.concat(F.lit("id="), F.col("event_id").cast("string")), start, state)
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    lines = written(e.select(line.alias("value")), "lines")
    lines.write.mode("overwrite").text(path)
    entries, _ = logs.read_state_log(spark, path)
    return entries.select("iso", "session", "state", F.element_at("kv", "a").alias("a"), F.element_at("kv", "id").cast("long").alias("id"))


def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of views, then of all events, appended by key: each user stands once."""
    e = table(spark, sf_dir, "events").select("user_id")
    users = Snapshots(spark, f"{shared_folder(spark)}/once-{uuid.uuid4().hex}")
    users.append_once(e.where("user_id % 3 = 0"), ["user_id"])
    users.append_once(e, ["user_id"])
    return users.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.replay(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def absent_partner_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    return jobs.drained(jobs.absent_partner_stream(s.where("event_type = 'view'"), _stream(spark, sf_dir).where("event_type = 'click'"), "user_id", 30, 21600, 3600))


def presence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views without a click around, told by timers."""
    e = _stream(spark, sf_dir).select("user_id", "ts", "event_type")
    with jobs.timers(spark):
        return jobs.drained(jobs.presence_stream(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", 30, 21600, 3600))


def first_start_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay is longer than the table, so each user stands once; which event it is depends on arrival."""
    return jobs.drained(jobs.first_start_stream(_stream(spark, sf_dir).select("user_id", "ts"), ["user_id"], 90 * 86400)).select("user_id")


def daily_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "on").when(F.col("event_type") == "error", "off")
    out = jobs.drained(jobs.daily_states_stream(_stream(spark, sf_dir).withColumn("state", state)), "update")
    return out.groupBy("day").agg(*[F.max_by(c, "batch").alias(c) for c in ("starts", "ons", "offs")])


QUERIES = {f.__name__: f for f in (flatten_posts, flatten_images, flatten_facets, flatten_videos, flatten_links, flatten_quotes, alt_text_coverage, quotes_of, write_outcome, validate_posts, resolve_refs, distinct_mentions, resolve_first, delete_plan, mesh_quality, mesh_measures, duplicate_faces, tolerance_check, within_radius, read_state_log, append_once, absent_partner_stream, presence_stream, first_start_stream, daily_states_stream)}

_P = "SELECT *, conv_id || '/' || turn AS uri FROM conversations WHERE conv_id % 17 <> 5"
_IMG = f"""SELECT uri, role AS handle, 0 AS pos, role AS alt, 'f/' || uri AS fullsize FROM ({_P}) WHERE turn % 3 = 0
UNION ALL SELECT uri, role, 1, NULL, 'f/' || uri FROM ({_P}) WHERE turn % 3 = 0 UNION ALL SELECT uri, role, 0, 'm', 'f/' || uri FROM ({_P}) WHERE turn % 3 = 1 UNION ALL SELECT uri, role, 0, 'q', 'f/' || uri FROM ({_P}) WHERE turn = 2"""
_MESH = """
WITH vs AS (SELECT DISTINCT c_nationkey AS model, c_custkey // 3 AS v_id FROM customer), w AS (SELECT model, list(v_id ORDER BY v_id) AS ids FROM vs GROUP BY 1),
f AS (SELECT model, i AS face_id, ids[i : i + CASE WHEN i % 13 = 0 THEN least(4, len(ids) - i + 1) ELSE 3 END - 1] AS v FROM w, range(1, (SELECT max(len(ids)) FROM w)) r(i) WHERE i <= len(ids) - 2),
faces AS (SELECT * FROM f UNION ALL SELECT model, face_id + 10000, list_reverse(v) FROM f WHERE face_id % 5 = 0),
sides AS (SELECT model, face_id, v, unnest(range(1, len(v) + 1)) AS i FROM faces),
e AS (SELECT model, face_id, least(v[i], v[i % len(v) + 1]) AS a, greatest(v[i], v[i % len(v) + 1]) AS b FROM sides),
c AS (SELECT model, face_id, v[1] % 7 AS ax, v[1] % 11 AS ay, v[1] % 5 AS az, v[2] % 7 AS bx, v[2] % 11 AS by_, v[2] % 5 AS bz, v[3] % 7 AS cx, v[3] % 11 AS cy, v[3] % 5 AS cz FROM faces WHERE len(v) = 3),
n AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM c),
t AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n)
"""
ORACLE_SQL = {
    "mesh_quality": _MESH + """, u AS (SELECT model, a, b, count(*) AS uses, sqrt((a % 7 - b % 7) ** 2 + (a % 11 - b % 11) ** 2 + (a % 5 - b % 5) ** 2) AS d FROM e GROUP BY ALL)
SELECT g.model, coalesce((SELECT count(*) FILTER (l / 2 < 2) FROM t WHERE t.model = g.model), 0) AS small_faces, (SELECT count(*) FILTER (d < 2) FROM u WHERE u.model = g.model) AS short_edges,
 (SELECT count(*) FILTER (uses <> 2) FROM u WHERE u.model = g.model) AS bad_edges, count(*) FILTER (len(v) <> 3) AS not_triangles FROM faces g GROUP BY 1""",
    "mesh_measures": _MESH + """, m AS (SELECT model, sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6.0 AS volume, sum(l / 2) AS area, sum(CASE WHEN l > 0 AND nz / l < -0.707 THEN l / 2 ELSE 0 END) AS down_area FROM t GROUP BY 1),
b AS (SELECT model, max(v_id % 7) AS x1, min(v_id % 7) AS x0, max(v_id % 11) AS y1, min(v_id % 11) AS y0, max(v_id % 5) AS z1, min(v_id % 5) AS z0 FROM vs GROUP BY 1)
SELECT b.model, (x1 - x0)::DOUBLE AS size_x, (y1 - y0)::DOUBLE AS size_y, (z1 - z0)::DOUBLE AS size_z, (x1 + x0) / 2.0 AS off_x, (y1 + y0) / 2.0 AS off_y, z0::DOUBLE AS off_z,
 round(volume, 6) AS volume, round(area, 6) AS area, round(down_area, 6) AS down_area FROM b LEFT JOIN m ON b.model = m.model""",
    "duplicate_faces": _MESH + """, o AS (SELECT model, a, b FROM e GROUP BY ALL HAVING count(*) > 2),
s AS (SELECT DISTINCT e.model, e.face_id FROM e JOIN o ON e.model = o.model AND e.a = o.a AND e.b = o.b)
SELECT model, face_id FROM (SELECT g.model, g.face_id, row_number() OVER (PARTITION BY g.model, list_sort(v) ORDER BY g.face_id) AS rn FROM faces g JOIN s ON g.model = s.model AND g.face_id = s.face_id) WHERE rn > 1""",
    "flatten_posts": f"""SELECT uri, 'did:' || conv_id AS did, role AS handle, text, CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent_uri,
 CASE WHEN turn > 0 THEN conv_id || '/0' END AS root_uri, CASE WHEN turn % 2 = 0 THEN (conv_id + 1) || '/0' END AS quote_uri, turn AS like_count FROM ({_P})""",
    "flatten_images": f"SELECT uri, pos, alt, fullsize, CASE WHEN alt IS NOT NULL THEN fullsize END AS url FROM ({_IMG})",
    "flatten_facets": f"SELECT uri, 0 AS facet, 0::BIGINT AS byte_start, strlen(text)::BIGINT AS byte_end, 'link' AS kind, 'https://e.x/' || uri AS target FROM ({_P}) WHERE turn = 1",
    "flatten_videos": f"SELECT uri, 'v/' || uri AS playlist, NULL::VARCHAR AS thumbnail, role AS alt FROM ({_P}) WHERE turn = 5",
    "flatten_links": f"SELECT uri, 0 AS pos, 'https://' || CASE turn WHEN 4 THEN 'c' WHEN 7 THEN 'm' ELSE 'q' END || '.x/' || uri AS link, role AS title, 'd' AS description FROM ({_P}) WHERE turn IN (2, 4, 7)",
    "flatten_quotes": f"SELECT uri, (conv_id + 1) || '/0' AS quote_uri, 'did:' || (conv_id + 1) AS quoted_did, 'q' || role AS quoted_handle, 'quoted ' || role AS quoted_text FROM ({_P}) WHERE turn % 2 = 0",
    "alt_text_coverage": f"SELECT handle, count(*) AS images, count(*) FILTER (trim(coalesce(alt, '')) <> '') AS with_alt FROM ({_IMG}) GROUP BY 1",
    "quotes_of": f"""
WITH p AS (SELECT uri, (conv_id + 1) || '/0' AS quote_uri, turn AS like_count FROM ({_P}) WHERE turn % 2 = 0)
SELECT *, row_number() OVER (PARTITION BY quote_uri ORDER BY like_count DESC, uri DESC)::INT AS rank FROM p WHERE quote_uri IN (SELECT uri FROM ({_P})) QUALIFY rank <= 2""",
    "write_outcome": """
WITH r AS (SELECT conv_id, turn, (conv_id + turn) % 6 <> 5 AS tried, (conv_id + turn) % 6 <> 5 AND length(text) % 7 <> 0 AS ok FROM conversations),
f AS (SELECT conv_id, min(turn) FILTER (NOT ok) AS t, coalesce(arg_min(tried, turn) FILTER (NOT ok), false) AS uncertain FROM r GROUP BY 1)
SELECT f.conv_id, coalesce(string_agg('r' || turn, '|' ORDER BY turn) FILTER (t IS NULL OR turn < t), '') AS written, t + 1 AS failed_at, uncertain FROM f JOIN r USING (conv_id) GROUP BY f.conv_id, t, uncertain""",
    "validate_posts": """
SELECT conv_id, turn, concat_ws('; ', CASE WHEN length(text) > 300 THEN 'text has more than 300 characters' END, CASE WHEN trim(text) = '' AND conv_id % 6 = 0 THEN 'neither text nor image' END,
 CASE WHEN conv_id % 6 > 4 THEN 'more than 4 images' END, CASE WHEN conv_id % 6 > 0 AND (turn % 2 = 1 OR trim(coalesce(role, '')) = '') THEN 'image without path or alt text' END,
 CASE WHEN conv_id % 6 > 0 AND turn <> 6 AND strlen(text) + 12 > 1000000 THEN 'image over 1,000,000 bytes' END, CASE WHEN conv_id % 6 > 0 AND turn % 4 = 3 THEN 'unknown image type' END) AS violations FROM conversations""",
    "resolve_refs": """
WITH e AS (SELECT event_id, user_id, event_id % 4 AS m FROM events)
SELECT event_id, CASE m WHEN 0 THEN 'https://bsky.app/profile/User' || user_id || '/post/' || event_id WHEN 1 THEN 'at://did:User' || user_id || '/app.bsky.feed.post/k' WHEN 2 THEN 'https://bsky.app:99/profile/a/post/b' ELSE 'at://User' || user_id || '/app.bsky.feed.post/k' END AS ref,
 CASE WHEN m = 1 THEN 'at://did:User' || user_id || '/app.bsky.feed.post/k' WHEN m IN (0, 3) AND c_custkey IS NOT NULL THEN 'at://did:c' || user_id || '/app.bsky.feed.post/' || CASE WHEN m = 0 THEN event_id::VARCHAR ELSE 'k' END END AS uri,
 CASE WHEN m = 2 THEN 'not a post reference' WHEN m <> 1 AND c_custkey IS NULL THEN 'unknown handle' END AS error
FROM e LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0""",
    "distinct_mentions": "SELECT DISTINCT event_id, 'u' || s_suppkey AS handle, s_suppkey AS did FROM events JOIN supplier ON s_suppkey = user_id OR s_suppkey = event_id % 50",
    "resolve_first": "SELECT c_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS resolved FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "delete_plan": """
SELECT o_orderkey AS uri, o_custkey AS did, o_orderstatus AS cid, CASE WHEN o_custkey % 3 = 0 THEN 'REFUSED' WHEN o_orderkey % 9 = 0 THEN 'GONE' WHEN o_orderkey % 5 = 0 THEN 'CONFLICT' ELSE 'DELETE' END AS action FROM orders""",
    "tolerance_check": """
SELECT l_suppkey, quantile_cont(l_quantity, 0.99) AS p99, quantile_cont(l_quantity, 0.999) AS p999, max(l_quantity) AS largest,
 CASE WHEN max(l_extendedprice) / 300 NOT BETWEEN 10 AND 300 THEN 'SKIPPED' WHEN p99 <= 45.5 * 1.1 AND p999 <= 91 * 1.1 AND count(*) FILTER (l_discount > 0.05) <= count(*) FILTER (l_tax > 0.03) THEN 'PASS' ELSE 'FAIL' END AS status
FROM lineitem GROUP BY 1""",
    "within_radius": """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT vec_id FROM e WHERE EXISTS (SELECT 1 FROM e s WHERE s.vec_id % 20 = 0 AND (s.x - e.x) ** 2 + (s.y - e.y) ** 2 + (s.z - e.z) ** 2 <= 0.1 * 0.1)""",
    "read_state_log": """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, user_id::VARCHAR AS session, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'on' ELSE 'off' END AS state, '2' AS a, event_id AS id
FROM events WHERE event_id % 20 <> 1 AND event_id % 7 <> 0 AND (event_type IN ('view', 'click') OR (event_type = 'error' AND event_id % 3 = 0))""",
    "append_once": "SELECT DISTINCT user_id, 1::BIGINT AS n FROM events",
    "absent_partner_stream": """
WITH w AS (SELECT min(m) AS wm FROM (SELECT max(ts) AS m FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type))
SELECT DISTINCT s.user_id, s.ts FROM events s, w WHERE s.event_type = 'view' AND s.ts + INTERVAL 25200 SECOND < wm
AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'click' AND o.user_id = s.user_id AND o.ts BETWEEN s.ts - INTERVAL 30 SECOND AND s.ts + INTERVAL 21600 SECOND)""",
    "presence_stream": """
WITH w AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS wm FROM events WHERE event_type IN ('view', 'click'))
SELECT DISTINCT s.user_id, s.ts FROM events s, w WHERE s.event_type = 'view' AND (epoch_us(s.ts) + 21600000000) // 1000 + 1 <= wm
AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'click' AND o.user_id = s.user_id AND o.ts BETWEEN s.ts - INTERVAL 30 SECOND AND s.ts + INTERVAL 21600 SECOND)""",
    "first_start_stream": "SELECT DISTINCT user_id FROM events",
    "daily_states_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS starts, count(*) FILTER (event_type = 'click') AS ons, count(*) FILTER (event_type = 'error') AS offs FROM events GROUP BY 1",
}
