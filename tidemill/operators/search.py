"""Search of posts by an inverted index: postings in blocks, newest first, of which a query reads its own words' alone.

Posts are numbered newest first: by the range of the order that a post lies in, and its place there, so that whole posts are
shuffled and written once. A token's posting list is cut into blocks of ``BLOCK`` numbers: a row has the token, the block,
the posts' numbers in it, in order, and the token's places in each. Tasks make these rows of the posts they hold, so a block
may be several rows of a token, those of different posts, and a token is not sent once for each time it stands. Rows are laid out by a hash of the token (a folder a
bucket) and sorted within, so that a query opens the buckets of its tokens, and of each file the row groups that hold them.
A word finds every token that contains it, which the list of distinct tokens tells, so the result is the scan's.

A search goes through ranges of blocks, newest first, each some times as wide as the one before, and stops as soon as it has
enough posts. In a block each word's numbers are one list; lists are intersected from the shortest. No list is larger than a
block, so a word that all posts hold is as many small lists as there are blocks.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.store import written

BLOCK, BUCKETS, FIRST, STEP = 4096, 64, 8, 8
#: Places of a post that phrases are found at.
MOST_PLACES = 1 << 26
#: Words that a task makes postings of at once.
WORDS = 1 << 21
SPACE = r"[\x20\x09-\x0D]+"


def ranged(posts: DataFrame, order: list[str]) -> DataFrame:
    """``posts`` by ranges, newest first, with part@, which rises along the ranges, and row@, from 0 in each; posts that are equal in ``order`` in any order."""
    newest = [F.desc(c) for c in order]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return posts.repartitionByRange(*newest).sortWithinPartitions(*newest).select("*", F.spark_partition_id().alias("part@"), row.alias("row@"))


def first_numbers(posts: DataFrame) -> dict[int, int]:
    """By part@, which are as many as a shuffle has partitions, the number of its first post."""
    sizes = sorted(posts.groupBy("part@").count().collect())
    return dict(zip([p for p, _ in sizes], itertools.accumulate([n for _, n in sizes], initial=0), strict=False))


def number(first: dict[int, int]) -> Column:
    """A post's number, from 0, newest first."""
    pairs = [F.lit(x) for p in first.items() for x in p]
    return (F.element_at(F.create_map(*pairs), F.col("part@")) if pairs else F.lit(0)).cast("long") + F.col("row@")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, block, numbers and places of (number, words) rows."""
    for b in batches:
        ends = b["words"].offsets.to_numpy()
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + WORDS, side="right")) - 1)
            if ends[j] > ends[i]:
                yield _posting_rows(b["number"].to_numpy()[i:j], np.diff(ends[i : j + 1]), b["words"].values.slice(ends[i], ends[j] - ends[i]))
            i = j


def _posting_rows(numbers: np.ndarray, sizes: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    coded = words.dictionary_encode()
    code, number = coded.indices.to_numpy(), np.repeat(numbers, sizes)
    place = (np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    order = np.lexsort((place, number, code))
    code, number, place = code[order], number[order], place[order]
    changes = lambda *x: np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in x], axis=0)]))
    post = changes(code, number)
    row = changes(code[post], number[post] // BLOCK)
    at = post[row]
    lists = lambda cut, n, values: pa.ListArray.from_arrays(pa.array(np.append(cut, n), pa.int32()), values)
    places = lists(post, len(place), pa.array(place))
    columns = [coded.dictionary.take(pa.array(code[at])), pa.array(number[at] // BLOCK), lists(row, len(post), pa.array(number[post])), lists(row, len(post), places)]
    return pa.RecordBatch.from_arrays(columns, ["token", "block", "numbers", "places"])


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build_index(posts: DataFrame, text: str, order: list[str], path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``posts`` to a folder: posts by number, tokens, and postings."""
    docs = f"{path}/posts"
    ranged(posts, order).write.parquet(docs)
    rows = posts.sparkSession.read.parquet(docs)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE, -1), lambda t: t != "")
    lists = rows.select(number(first_numbers(rows)).alias("number"), words.alias("words")).mapInArrow(_postings, "token string, block long, numbers array<bigint>, places array<array<int>>")
    lists = lists.select(bucket(F.col("token"), buckets).alias("bucket"), "*")
    lists.repartitionByRange("bucket", "token", "block").sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    kept = posts.sparkSession.read.schema("token string, block long, numbers array<bigint>, places array<array<int>>, bucket int").parquet(f"{path}/postings")
    kept.groupBy("token", "bucket").agg(F.sum(F.size("numbers")).alias("posts")).write.parquet(f"{path}/tokens")


class Index:
    """An index that ``build_index`` has written. ``log`` gets, for each range of blocks, how many rows of postings it read."""

    def __init__(self, spark: SparkSession, path: str, log: list | None = None):
        self.posts = spark.read.parquet(f"{path}/posts")
        self.first = first_numbers(self.posts)
        self.tokens = spark.read.schema("token string, bucket int, posts long").parquet(f"{path}/tokens")
        self.postings = spark.read.schema("token string, block long, numbers array<bigint>, places array<array<int>>, bucket int").parquet(f"{path}/postings")
        self.log = log

    def search(self, query: str, limit: int = 20, phrase: bool = False) -> DataFrame:
        """The newest ``limit`` posts that hold every word of the query, whatever the case, or (``phrase``) its words as tokens in a row."""
        words = query.lower().split()
        if not words:
            return self.posts.orderBy("part@", "row@").limit(limit).drop("part@", "row@")
        each = list(enumerate(words)) if phrase else list(enumerate(dict.fromkeys(words)))
        fits = F.filter(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(w).alias("word")) for i, w in each]), lambda x: F.col("token") == x["word"] if phrase else F.contains(F.col("token"), x["word"]))
        asked = self.tokens.select("token", "bucket", F.explode(F.transform(fits, lambda x: x["at"])).alias("at"))
        found = self._found(written(asked, "asked"), len(each), limit, phrase)
        starts = sorted((n, p) for p, n in self.first.items())
        at = [(n, *starts[bisect.bisect_right(starts, n, key=lambda x: x[0]) - 1]) for n in found]
        # parts and rows are asked for besides, as the files hold their bounds
        hit = F.col("part@").isin([p for _, _, p in at]) & F.col("row@").isin([n - first for n, first, _ in at]) & number(self.first).isin(found)
        return self.posts.where(hit).orderBy("part@", "row@").drop("part@", "row@")

    def _found(self, asked: DataFrame, n: int, limit: int, phrase: bool) -> list[int]:
        words, buckets = asked.agg(F.count_distinct("at"), F.collect_set("bucket")).first()  # at most as many buckets as there are
        if words < n:
            return []
        mine = self.postings.where(F.col("bucket").isin(buckets))
        last = (self.posts.count() - 1) // BLOCK
        found, lo, width = [], 0, FIRST
        while lo <= last and len(found) < limit:
            here = mine.where(F.col("block").between(lo, lo + width - 1)).join(asked, ["token", "bucket"])
            if self.log is not None:
                self.log.append(here.count())
            # a phrase's words start at the same place; number and place are one long, as arrays of those are hashed
            starts = F.flatten(F.transform(F.arrays_zip("numbers", "places"), lambda x: F.transform(F.filter(x["places"], lambda p: (p >= F.col("at")) & (p < MOST_PLACES)), lambda p: x["numbers"] * MOST_PLACES + p - F.col("at"))))
            item = starts if phrase else F.col("numbers")
            lists = here.select("block", "at", item.alias("items")).groupBy("block", "at").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
            both = lists.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.size("items").alias("n"), "items"))).alias("lists")).where(F.size("lists") == n)
            common = F.aggregate(F.slice("lists", 2, n), F.get("lists", F.lit(0))["items"], lambda a, x: F.array_intersect(a, x["items"]))
            rows = both.select(F.explode(common).alias("item")).select((F.shiftright("item", 26) if phrase else F.col("item")).alias("number")).distinct()
            found += [r["number"] for r in rows.orderBy("number").limit(limit - len(found)).collect()]
            lo, width = lo + width, width * STEP
        return found
