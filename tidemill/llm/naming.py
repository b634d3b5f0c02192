"""Exact copies by deterministic block naming.

A text without its white space is cut into blocks of ``BLOCK`` characters. All distinct blocks are sorted, and a block's
place in that order is its name; then adjacent names are paired, the distinct pairs sorted and named in their turn, and so
on, until a text has one name. Two texts have the same last name at the same level exactly if they are equal: at each
level two names are the same only where what they stand for is (a last name without a partner is a pair with nothing).

* The order is by the task that a block hashes to, then by the block, so that one exchange, of blocks already made distinct
  in each task, both gathers and sorts: a name is a number (task, place). Names are written down before they are used.
* A text that holds a block, or later a pair, which stands nowhere else has no copy: that name is its identity, and it
  leaves the levels above, which therefore see the texts with copies and few others.
* Occurrences ask for names by a 128-bit key of the block instead of the block. That no two blocks share a key is checked
  over all of them; should two do so, all is done anew with other keys. So no hash decides.
* A name of very many occurrences is dealt to many tasks (``spread``), and so is a large group of copies at the end. A
  text's own names are the largest group that meets in a task.

Defined results: a null text is an empty one, and all empty texts (or of white space alone) are copies of each other; the
row with the most code points stays, then the smallest doc_id, rows without doc_id last, and of rows equal in both any one;
repeated rows are rows of their own; other columns are ignored; an empty table gives an empty one. ``docs`` is read twice,
so it has to be a table, or a plan that gives the same rows each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.store import materialise, texts
from tidemill.operators.graphs import most_rows, spread
from tidemill.sources import tables

BLOCK = 1024
SPACE = r"[\x20\x09-\x0D]+"


def squeezed(text: Column | str) -> Column:
    return F.regexp_replace(text, SPACE, "")


def blocks(text: Column | str, size: int = BLOCK) -> Column:
    """The text's blocks in order; an empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def block_key(block: Column, seed: int) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), block).cast("binary")))


def _named(groups: DataFrame, *by: str) -> DataFrame:
    """Distinct rows, each with its place in the sorted order as its name."""
    return groups.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of the texts all of whose names occur elsewhere too; ``m`` is the number of a text's names."""
    return rows.withColumn("c@", F.count("name").over(W.partitionBy("row"))).where("`c@` = m").drop("c@")


def _occurrences(docs: DataFrame, size: int, key: Callable[[Column, int], Column], most_seeds: int = 8) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their blocks' keys, the names of blocks that stand in several places, and the number of all blocks."""
    rows = texts(docs).select("doc_id", F.length("text").cast("long").alias("chars"), squeezed("text").alias("text"))
    for seed in range(most_seeds):
        distinct = rows.select(F.explode(blocks("text", size)).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n@"))
        names = materialise(_named(distinct, "block").select(key(F.col("block"), seed).alias("key"), "name", "n@"), "names")
        total, single = names.agg(F.coalesce(F.sum("n@"), F.lit(0)), F.count(F.lit(1))).first()
        if names.select("key").distinct().count() == single:
            keys = F.transform(blocks("text", size), lambda b: key(b, seed))  # noqa: B023
            made = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "chars", F.sha2("text", 256).alias("text_sha256"), keys.alias("keys"))
            return materialise(made, "rows"), names.where("`n@` > 1"), total
    raise RuntimeError(f"blocks share keys under {most_seeds} seeds")


def identities(docs: DataFrame, size: int = BLOCK, key: Callable[[Column, int], Column] = block_key) -> DataFrame:
    """doc_id, chars, text_sha256, row, and identity: (level, name) of a text that may have copies, null of one that has none."""
    rows, names, total = _occurrences(docs, size, key)
    found = rows.select("row", F.size("keys").alias("m"), F.posexplode("keys").alias("pos", "key"))
    found = spread(found, names, "key", most_rows(total), "left").select("row", "m", "pos", "name")
    level, done = 0, []
    while True:
        now = materialise(_whole(found), "named")
        done.append(now.where("m = 1").select("row", F.struct(F.lit(level).alias("level"), "name").alias("identity")))
        more = now.where("m > 1")
        total = more.count()
        if not total:
            break
        side = lambda k: F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(-1).cast("long"))
        pairs = more.groupBy("row", F.ceil(F.col("m") / 2).cast("int").alias("m"), F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(side(0).alias("left"), side(1).alias("right"))
        pairs = materialise(pairs.select("row", "m", F.col("at").alias("pos"), F.struct("left", "right").alias("key")), "pairs")
        names = _named(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n@")), "key")
        names = materialise(names.where("`n@` > 1"), "names")
        found = spread(pairs, names, "key", most_rows(total), "left").select("row", "m", "pos", "name")
        level += 1
    same = done[0]
    for d in done[1:]:
        same = same.unionByName(d)
    return rows.drop("keys").join(same, "row", "left")


def exact_copies(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    ids = materialise(identities(docs, size), "identities")
    first = F.min(F.struct((-F.col("chars")).alias("longest"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = ids.where("identity is not null").groupBy("identity").agg(F.count(F.lit(1)).alias("n@"), first.alias("first"))
    groups = groups.select("identity", "n@", F.col("n@").alias("n"), F.col("first.doc_id").alias("keep"), F.col("first.row").alias("keep_row"))
    out = spread(ids.drop("chars"), groups, "identity", most_rows(ids.count()), "left")
    alone = F.col("keep_row").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def op11_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(tables.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
