"""Posts: flattening nested views, references, validation, quotes, deletes, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.columns import facet_spans, graphemes, mime_of, post_uri
from tidemill.operators.graphs import looked_up


def flatten_posts(df: DataFrame, json: str) -> dict[str, DataFrame]:
    """posts, images, videos, links, quotes and facets of nested post views in JSON; what can't be parsed contributes nothing.

    Images, videos and link cards stand in the embed itself, in a record's media and in all embeds of quoted records, their media included; an image keeps its
    alt text and has url = fullsize where both are texts. A quote has the quoted post's author and text. Facets keep their byte range, kind and whole target.
    """
    rows = df.select(F.try_parse_json(json).alias("v")).where("v is not null")
    text = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    base = rows.where(text("uri").isNotNull()).withColumn("uri", text("uri"))
    posts = base.select(
        "uri", text("cid").alias("cid"), text("author.did").alias("did"), text("author.handle").alias("handle"),
        text("record.text").alias("text"), text("record.createdAt").alias("created_at"),
        text("record.reply.parent.uri").alias("parent_uri"), text("record.reply.root.uri").alias("root_uri"),
        F.coalesce(text("embed.record.uri"), text("embed.record.record.uri")).alias("quote_uri"),
        *[text(f"{c}Count", "long").alias(f"{c}_count") for c in ("like", "reply", "repost", "quote")],
    )
    kind = "array<struct<alt: string, fullsize: string, thumb: string>>"
    part = lambda path, kind: F.from_json(F.to_json(F.try_variant_get("v", f"$.{path}", "variant")), kind)
    card = "struct<uri: string, title: string, description: string>"
    plain = f"images: {kind}, playlist: string, thumbnail: string, alt: string, external: {card}"
    view = f"struct<{plain}, media: struct<{plain}>>"
    outer = F.array(part("embed", view))
    quoted = [F.coalesce(part(f"embed.{p}.embeds", f"array<{view}>"), F.array().cast(f"array<{view}>")) for p in ("record", "record.record")]
    views = base.select("uri", F.filter(F.concat(outer, *quoted), lambda x: x.isNotNull()).alias("views"))
    none = F.array().cast(kind)
    every = F.flatten(F.transform("views", lambda x: F.concat(F.coalesce(x["images"], none), F.coalesce(x["media"]["images"], none))))
    clips = F.flatten(F.transform("views", lambda x: F.array(*[F.struct(y["playlist"].alias("playlist"), y["thumbnail"].alias("thumbnail"), y["alt"].alias("alt")) for y in (x, x["media"])])))
    videos = views.select("uri", F.explode(clips).alias("video")).where("video.playlist is not null").select("uri", "video.*")
    spans = "array<struct<index: struct<byteStart: bigint, byteEnd: bigint>, features: array<struct<`$type`: string, uri: string, did: string, tag: string>>>>"
    facets = base.select("uri", F.posexplode(part("record.facets", spans)).alias("facet", "f")).select("uri", "facet", F.col("f.index.byteStart").alias("byte_start"), F.col("f.index.byteEnd").alias("byte_end"), F.explode("f.features").alias("feature"))
    facets = facets.select("uri", "facet", "byte_start", "byte_end", F.substring_index(F.col("feature.$type"), "#", -1).alias("kind"), F.coalesce("feature.uri", "feature.did", "feature.tag").alias("target"))
    images = views.select("uri", F.posexplode(every).alias("pos", "image")).select("uri", "pos", "image.alt", "image.fullsize", F.when(F.col("image.alt").isNotNull(), F.col("image.fullsize")).alias("url"))
    cards = F.filter(F.flatten(F.transform("views", lambda x: F.array(x["external"], x["media"]["external"]))), lambda x: x["uri"].isNotNull())
    links = views.select("uri", F.posexplode(cards).alias("pos", "card")).select("uri", "pos", F.col("card.uri").alias("link"), "card.title", "card.description")
    of_quoted = lambda path: F.coalesce(text(f"embed.record.{path}"), text(f"embed.record.record.{path}"))
    quotes = base.select("uri", of_quoted("uri").alias("quote_uri"), of_quoted("author.did").alias("quoted_did"), of_quoted("author.handle").alias("quoted_handle"), of_quoted("value.text").alias("quoted_text")).where("quote_uri is not null")
    return {"posts": posts, "images": images, "videos": videos, "links": links, "quotes": quotes, "facets": facets}


def validate_posts(df: DataFrame, thread: str) -> DataFrame:
    """Adds violations to posts (text, images array<struct<path, alt, data>>) of threads."""
    counts = df.groupBy(F.col(thread).alias("thread@")).agg(F.count(F.lit(1)).alias("n@"))
    n = F.coalesce("n@", F.lit(0))
    images = F.coalesce("images", F.array().cast("array<struct<path:string,alt:string,data:binary>>"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    found = [
        F.when(n > 100, "thread has more than 100 posts"),
        F.when(F.coalesce(graphemes("text"), F.lit(0)) > 300, "text has more than 300 characters"),
        F.when(blank(F.col("text")) & (F.size(images) == 0), "neither text nor image"),
        F.when(F.size(images) > 4, "more than 4 images"),
        F.when(F.exists(images, lambda i: blank(i["path"]) | blank(i["alt"])), "image without path or alt text"),
        F.when(F.exists(images, lambda i: F.coalesce(F.length(i["data"]), F.lit(0)) > 1_000_000), "image over 1,000,000 bytes"),
        F.when(F.exists(images, lambda i: i["data"].isNotNull() & mime_of(i["data"]).isNull()), "unknown image type"),
    ]
    out = df.join(counts, F.col(thread).eqNullSafe(F.col("thread@")), "left")
    return out.withColumn("violations", F.array_compact(F.array(*found))).drop("thread@", "n@")


def resolve_refs(df: DataFrame, ref: str, handles: DataFrame) -> DataFrame:
    """Adds uri and error to references: page addresses or at-URIs, whose handle is looked up in ``handles`` (handle, did)."""
    raw = F.trim(F.col(ref))
    at = F.when(raw.startswith("at://"), raw).otherwise(post_uri(raw))
    part = lambda i: F.regexp_extract(F.coalesce(at, F.lit("")), r"^at://([^/]+)/app\.bsky\.feed\.post/([^/?#]+)\z", i)
    out = df.withColumns({"actor@": F.nullif(F.coalesce(F.when(part(1).startswith("did:"), part(1)).otherwise(F.lower(part(1))), F.lit("")), F.lit("")), "key@": part(2)})
    known = handles.select(F.lower("handle").alias("actor@"), F.col("did").alias("did@")).dropDuplicates(["actor@"])
    out = looked_up(out, "actor@", known)  # a handle may be asked for very often
    did = F.when(F.col("actor@").startswith("did:"), F.col("actor@")).otherwise(F.col("did@"))
    error = F.when(F.col("actor@").isNull(), "not a post reference").when(did.isNull(), "unknown handle")
    return out.withColumn("uri", F.when(did.isNotNull(), F.concat(F.lit("at://"), did, F.lit("/app.bsky.feed.post/"), F.col("key@")))).withColumn("error", error).drop("actor@", "key@", "did@")


def quotes_of(posts: DataFrame, uris: DataFrame, order: list[str], limit: int) -> DataFrame:
    """For each uri the newest posts that quote it."""
    w = W.partitionBy("quote_uri").orderBy(*[F.desc(c) for c in order])
    return posts.join(uris.select(F.col("uri").alias("quote_uri")).distinct(), "quote_uri", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def alt_text_coverage(images: DataFrame, by: list[str]) -> DataFrame:
    has = F.trim(F.coalesce("alt", F.lit(""))) != ""
    return images.groupBy(*by).agg(F.count(F.lit(1)).alias("images"), F.count_if(has).alias("with_alt"))


def mentions(posts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, handle) of each post's mentions, lower-cased, each once."""
    found = F.transform(F.filter(facet_spans(text), lambda f: f["kind"] == "mention"), lambda f: F.lower(F.substring(f["value"], F.lit(2), F.length(f["value"]))))
    return posts.select(id_col, F.explode(F.array_distinct(found)).alias("handle"))


def distinct_mentions(posts: DataFrame, id_col: str, text: str, handles: DataFrame) -> DataFrame:
    """(id, handle, did): each handle of the whole batch is looked up once, and one that very many posts name in several tasks."""
    each = mentions(posts, id_col, text)
    known = handles.where("handle is not null").select(F.lower("handle").alias("handle"), "did", F.lit(True).alias("found@")).dropDuplicates(["handle"])
    return looked_up(each, "handle", known).where("`found@`").select(id_col, "handle", "did")


def resolve_first(df: DataFrame, candidates: DataFrame, keys: list[str], value: str, priority: str) -> DataFrame:
    """Each row's candidate of the lowest priority number that exists; null if there is none."""
    best = candidates.groupBy(*keys).agg(F.min_by(value, F.struct(priority, value)).alias("resolved"))
    return df.join(best, keys, "left")


def delete_plan(targets: DataFrame, current: DataFrame, owner: Column) -> DataFrame:
    """DELETE, REFUSED (another's), CONFLICT (changed since) or GONE for targets (uri, did, cid); nothing is deleted."""
    now = current.select("uri", F.col("cid").alias("now@"))
    out = targets.join(now, "uri", "left")
    action = F.when(~F.coalesce(F.col("did") == owner, F.lit(False)), "REFUSED").when(F.col("now@").isNull(), "GONE").when(F.col("now@") != F.col("cid"), "CONFLICT").otherwise("DELETE")
    return out.withColumn("action", action).drop("now@")


def write_outcome(plan: DataFrame, results: DataFrame, thread: str, pos: str) -> DataFrame:
    """A thread's written (references before the first failure, in order), failed_at (from 1), uncertain.

    ``results`` has thread, pos, ref (null on failure), attempted. A post without a result counts as failed.
    """
    rows = plan.select(thread, pos).join(results, [thread, pos], "left")
    failed = F.min(F.when(F.col("ref").isNull(), F.struct(pos, F.coalesce("attempted", F.lit(False)).alias("attempted"))))
    first = rows.groupBy(thread).agg(failed.alias("f"))
    good = rows.join(first, thread).where(F.col("f").isNull() | (F.col(pos) < F.col(f"f.{pos}"))).groupBy(thread).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "ref"))), lambda x: x["ref"]).alias("written"))
    out = first.join(good, thread, "left")
    return out.select(thread, F.coalesce("written", F.array().cast("array<string>")).alias("written"), (F.col(f"f.{pos}") + 1).alias("failed_at"), F.coalesce("f.attempted", F.lit(False)).alias("uncertain"))
