"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that command rules count as white space, as a regular expression class.
_SPACES = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = "[" + "".join(map(chr, _SPACES)) + "]"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_token(c: Column | str) -> Column:
    """White space and control characters, run by run, as one underscore."""
    return F.regexp_replace(col(c), r"[\s\x{0085}\p{Z}\x00-\x1f\x7f]+", "_")


def parse_instant(c: Column | str) -> Column:
    """A timestamp from strict ISO-8601 with Z; null for anything else, impossible dates included."""
    c = col(c)
    seconds = F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    fraction = F.coalesce(F.rpad(F.substring(F.regexp_extract(c, r"\.(\d+)Z\z", 1), 1, 6), 6, "0").try_cast("long"), F.lit(0))
    return F.when(c.rlike(INSTANT), F.timestamp_micros(F.unix_micros(seconds) + fraction))


def elapsed_seconds(c: Column | str) -> Column:
    """[[dd-]hh:]mm:ss as seconds; null for anything else."""
    c, p = col(c), r"^(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+)\z"
    part = lambda i: F.coalesce(F.regexp_extract(c, p, i).try_cast("long"), F.lit(0))
    return F.when(c.rlike(p), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def payload_code(c: Column | str) -> Column:
    """Sixteen digits of the SHA-256 of a JSON text in canonical form (keys sorted at every level)."""
    return F.substring(F.sha2(F.to_json(F.try_parse_json(col(c))), 256), 1, 16)


def integrity(c: Column | str) -> Column:
    return F.concat(F.lit("sha384-"), F.base64(F.unhex(F.sha2(col(c).cast("binary"), 384))))


def slug(c: Column | str) -> Column:
    """Lower case, other characters than word characters, spaces and hyphens dropped, spaces as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^A-Za-z0-9_\s-]", ""), r"\s+", "-")


def page_path(c: Column | str) -> Column:
    """content/blog/post.md as /blog/post/."""
    c = F.regexp_replace(col(c), r"^content/", "/")
    return F.regexp_replace(F.regexp_replace(c, r"(?:/_?index)?\.md\z", "/"), "/+", "/")


def stored_path(c: Column | str) -> Column:
    """A request's path as the file that serves it: /about as /about/index.html."""
    c = col(c)
    return F.when(c.endswith("/"), F.concat(c, F.lit("index.html"))).when(c.rlike(r"\.[A-Za-z0-9]+\z"), c).otherwise(F.concat(c, F.lit("/index.html")))


def cache_policy(c: Column | str) -> Column:
    """How long a file may be cached, by its ending."""
    ending = F.lower(F.regexp_extract(col(c), r"\.([A-Za-z0-9]+)\z", 1))
    year, day, hour = "public, max-age=31536000, immutable", "public, max-age=86400", "public, max-age=3600"
    return F.when(ending.isin("css", "js", "woff", "woff2", "ttf"), year).when(ending.isin("png", "jpg", "jpeg", "gif", "svg", "webp", "ico"), day).when(ending.isin("xml", "json", "txt"), hour).otherwise("no-cache")


def graphemes(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"\X"))


def mime_of(c: Column | str) -> Column:
    """Image type by the first bytes; null for others."""
    h = F.hex(F.substring(col(c), 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")


def norm_command(c: Column | str, strip: bool = True) -> Column:
    """A command as a shell holds it: without NUL and, for ``strip``, without newlines at the end."""
    c = F.replace(col(c), F.lit("\0"), F.lit(""))
    return F.regexp_replace(c, r"\n+\z", "") if strip else c


def effective_level(suffix: Column | str, body: Column | str, default: str, allowed: list[str] | None = None, aliases: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(level, where it came from): suffix before body before default; unknown levels fall back to the highest allowed."""
    filled = [F.nullif(col(x), F.lit("")) for x in (suffix, body)]
    level = F.coalesce(*filled, F.lit(default))
    for a, b in (aliases or {}).items():
        level = F.when(level == a, b).otherwise(level)
    if allowed:
        level = F.when(level.isin(*allowed), level).otherwise(allowed[-1])
    return level, F.when(filled[0].isNotNull(), "suffix").when(filled[1].isNotNull(), "body").otherwise("default")


def pct_of(a: Column | str, b: Column | str) -> Column:
    """a as a rounded percentage of b; null where b is 0."""
    return F.round(F.try_divide(col(a) * 100, col(b))).cast("long")


def post_uri(url: Column | str) -> Column:
    """at://actor/app.bsky.feed.post/key of a post's page."""
    c, p = col(url), r"^https://bsky\.app/profile/([^/?#]+)/post/([A-Za-z0-9._~:-]+)/?\z"
    return F.when(c.rlike(p), F.concat(F.lit("at://"), F.regexp_extract(c, p, 1), F.lit("/app.bsky.feed.post/"), F.regexp_extract(c, p, 2)))


def post_url(uri: Column | str) -> Column:
    c, p = col(uri), r"^at://([^/]+)/app\.bsky\.feed\.post/([^/]+)\z"
    return F.when(c.rlike(p), F.concat(F.lit("https://bsky.app/profile/"), F.regexp_extract(c, p, 1), F.lit("/post/"), F.regexp_extract(c, p, 2)))


def facet_spans(c: Column | str) -> Column:
    """Links and mentions of a text with their UTF-8 byte offsets."""
    c, p = col(c), r"(?:https?://[^\s]+|(?<![\w@])@[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9])"
    found, gaps = F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.split(c, p, -1)
    before = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + F.octet_length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, x: a + F.octet_length(x))
    return F.transform(found, lambda x, i: F.struct(before(i).alias("start"), (before(i) + F.octet_length(x)).alias("end"), F.when(x.startswith("@"), "mention").otherwise("link").alias("kind"), x.alias("value")))
