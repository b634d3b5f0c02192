"""Temperature mixing of sources.

A source's weight is its token share to the power of an exponent between 0 and 1, normalised. The exponent, in steps
of 1e-6, is found by bisection: the largest at which the weights' entropy is still ``entropy`` of the most possible,
or, where that would repeat some source more than ``repeats`` times within the budget, the smallest at which it does
not. Each probe is a sum over the sources' table, 31 probes at a time, so sources are never gathered.

The weights become a budget of tokens a source. Its documents, in the order of a keyed hash of id and text, fill the budget: whole
epochs, then the documents of one more epoch while they fit. Running sums go over hashed buckets of a few thousand
documents, so no source is ever one task. The stream is cut into blocks that each hold every source by its
weight, and within a block documents stand in keyed random order.

Tokens here are runs of characters other than white space. Defined results: a null source is one source of its own; a
null text is an empty one; a text without tokens follows its source at no cost; a source without tokens is left out, as
is everything if there are no tokens; repeated rows are documents of their own; other columns are carried along
(columns named like those made here are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.store import materialise, table
from tidemill.operators.ordering import earlier, in_parts

STEPS, PROBES, BUCKET = 1_000_000, 31, 4096
ENTROPY, REPEATS, BLOCK_TOKENS, SEED = 0.9, 4.0, 200_000, "mix"
#: So that a quota that is a whole number but for rounding isn't cut by one.
WHOLE = 1 + 1e-12
MADE = ("epoch", "block", "position", "n_tokens")


def exponent(shares: DataFrame, entropy: float, repeats: float, budget_ratio: float) -> float:
    """The exponent for token shares ``p`` (one row a source, all positive); ``budget_ratio``: budget over all tokens."""

    def probe(ks: list[int]) -> list[tuple[bool, bool]]:
        power = [F.pow("p", F.lit(k / STEPS)) for k in ks]
        sums = [F.sum(x) for x in power] + [F.sum(x * F.ln("p")) for x in power]
        row = shares.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least"), *[x.alias(f"s{i}") for i, x in enumerate(sums)])
        z, zl = (lambda i: F.col(f"s{i}")), (lambda i: F.col(f"s{i + len(ks)}"))
        flat = [F.ln(z(i)) - k / STEPS * zl(i) / z(i) >= entropy * F.ln("n") - 1e-12 for i, k in enumerate(ks)]
        rare = [F.pow("least", F.lit(k / STEPS - 1)) / z(i) * budget_ratio <= repeats for i, k in enumerate(ks)]
        got = list(row.select(*flat, *rare).first())
        return list(zip(got[: len(ks)], got[len(ks) :], strict=True))

    def last(what: int, holds: bool) -> int:
        """The largest step at which the condition is as at 0, given that it changes at most once; -1 if never."""
        lo, hi = -1, STEPS + 1
        while hi - lo > 1:
            ks = sorted({lo + 1 + (hi - lo - 2) * i // (PROBES - 1) for i in range(PROBES)})
            for k, x in zip(ks, probe(ks), strict=True):
                if bool(x[what]) == holds:
                    lo = max(lo, k)
                else:
                    hi = min(hi, k)
                    break
        return lo

    flat = min(last(0, True), STEPS) if entropy > 0 else STEPS
    kept = last(1, False) + 1
    return max(0, min(STEPS, max(flat, kept))) / STEPS


def plan(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each copy that the mix takes, without its text: key@ (of id and text), row@ (of all columns), source, the
    columns in ``keep``, and epoch, block, position in the block, n_tokens."""
    rows = _keyed(docs, seed).select("key@", "row@", F.col("source").alias("source@"), *keep, F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))
    names = ["key@", "row@", "source@", *keep]
    rows = materialise(rows, "mixed")
    sources = rows.groupBy(F.col("source@").alias("s@")).agg(F.sum("n_tokens").alias("t@"), F.count(F.lit(1)).alias("c@")).where("`t@` > 0")
    total = sources.agg(F.sum("t@")).first()[0]
    if not total:
        return rows.withColumns({"epoch": F.lit(0), "block": F.lit(0).cast("long"), "position": F.lit(0)}).select(*names, *MADE).where("false")
    budget = budget or total
    shares = sources.select((F.col("t@") / total).alias("p"))
    a = exponent(shares, entropy, repeats, budget / total)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    quota = sources.withColumn("q@", F.floor(F.pow(F.col("t@") / total, F.lit(a)) / z * budget * WHOLE).cast("long")).withColumn("b@", F.ceil(F.col("c@") / BUCKET).cast("long"))

    bucket = F.pmod(F.conv(F.substring("key@", 1, 8), 16, 10).cast("long"), F.col("b@"))
    on = F.col("source@").eqNullSafe(F.col("s@"))
    placed = rows.join(quota, on).withColumn("u@", bucket)
    # sums of buckets before each, over ranges of buckets, as a source may have very many
    sums = in_parts(placed.groupBy("s@", "u@").agg(F.sum("n_tokens").alias("n@")), ["s@"], [F.col("u@")])
    sums = earlier(sums, ["s@"], **{"far@": ("sum", F.sum("n@"))})
    near = F.sum("n@").over(W.partitionBy("s@", "part@").orderBy("u@")) - F.col("n@")
    before = sums.select(F.col("s@").alias("s2@"), F.col("u@").alias("u2@"), (F.coalesce("far@", F.lit(0)) + near).alias("base@"))
    placed = placed.join(before, F.col("s@").eqNullSafe(F.col("s2@")) & (F.col("u@") == F.col("u2@")))
    within = W.partitionBy("s@", "u@").orderBy("key@", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("end@", F.col("base@") + F.sum("n_tokens").over(within))

    whole = F.floor(F.col("q@") / F.col("t@"))
    copies = (whole + (F.col("end@") <= F.col("q@") - whole * F.col("t@")).cast("long")).cast("int")
    blocks = -(-budget // block_tokens)
    out = placed.withColumn("copies@", copies).where("`copies@` > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies@") - 1)))
    place = F.col("epoch") * F.col("t@") + F.col("end@") - F.col("n_tokens")
    out = out.withColumn("block", F.least(F.floor(place * blocks / F.greatest("q@", F.lit(1))).cast("long"), F.lit(blocks - 1)))
    order = F.md5(F.concat_ws(":", F.col("key@"), F.col("epoch").cast("string")).cast("binary"))
    return out.withColumn("position", F.row_number().over(W.partitionBy("block").orderBy(order, "n_tokens"))).select(*names, *MADE)


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with key@, by which documents are ordered, and row@, which with it tells rows apart that differ anywhere."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).cast("binary"))
    return docs.withColumns({"key@": key, "row@": F.xxhash64(*[_plain(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields])})


def _plain(c: Column, kind: T.DataType) -> Column:
    """The same value without maps and variants, which have no hash: entries and JSON in their place."""
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(_plain(e["key"], kind.keyType), _plain(e["value"], kind.valueType)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _plain(e, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(F.lit(0), *[_plain(c[f.name], f.dataType) for f in kind.fields]))
    return F.to_json(c) if isinstance(kind, T.VariantType) else c


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, marks: bool = True) -> DataFrame:
    """``docs`` with a row for each copy that the mix takes, and epoch, block, position in the block, n_tokens.

    Documents are placed by their keys and sizes alone; whole rows are joined once, at the end. Without ``marks`` the rows
    have the columns of ``docs`` and no others, whatever they are called.
    """
    placed = materialise(plan(docs, budget, entropy, repeats, block_tokens, seed), "plan").drop("source@")
    names = [c for c in docs.columns if not marks or c not in MADE]
    rows = _keyed(docs, seed).select("key@", "row@", *names)
    again = placed.where("epoch = 0").groupBy("key@", "row@").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():  # rows that repeat stand in the plan once each
        rows = rows.dropDuplicates(["key@", "row@"])
    placed = placed if marks else placed.select("key@", "row@")
    return placed.join(rows, ["key@", "row@"]).select(*names, *(MADE if marks else ()))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs, keep=("doc_id",)).select("doc_id", F.col("source@").alias("source"), "epoch", "block", "position", "n_tokens")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t, count(*) AS c FROM d GROUP BY source HAVING sum(n_tokens) > 0),
tot AS (SELECT sum(t)::BIGINT AS b, count(*) AS n FROM s),
p AS (SELECT t / b::DOUBLE AS p FROM s, tot),
coarse AS (SELECT range * 1000 AS i FROM range(0, 1001)),
hc AS (SELECT i, ln(sum(pow(p, i / 1e6))) - i / 1e6 * sum(pow(p, i / 1e6) * ln(p)) / sum(pow(p, i / 1e6)) AS h,
              pow(min(p), i / 1e6 - 1) / sum(pow(p, i / 1e6)) AS r FROM coarse, p GROUP BY i),
lim AS (SELECT coalesce((SELECT max(i) FROM hc, tot WHERE h >= {ENTROPY} * ln(n) - 1e-12), -1000) AS e,
               coalesce((SELECT max(i) FROM hc WHERE r > {REPEATS}), -1000) AS f),
fine AS (SELECT e + range AS i, 'e' AS what FROM lim, range(0, 1001) UNION ALL SELECT f + range, 'f' FROM lim, range(0, 1001)),
hf AS (SELECT what, i, ln(sum(pow(p, i / 1e6))) - i / 1e6 * sum(pow(p, i / 1e6) * ln(p)) / sum(pow(p, i / 1e6)) AS h,
              pow(min(p), i / 1e6 - 1) / sum(pow(p, i / 1e6)) AS r
       FROM (SELECT DISTINCT what, i FROM fine WHERE i BETWEEN 0 AND 1000000), p GROUP BY what, i),
a AS (SELECT greatest(0, least(1000000, greatest(
        coalesce((SELECT max(i) FROM hf, tot WHERE what = 'e' AND h >= {ENTROPY} * ln(n) - 1e-12), -1),
        coalesce((SELECT max(i) FROM hf WHERE what = 'f' AND r > {REPEATS}), -1) + 1))) / 1e6 AS a),
q AS (SELECT source, t, floor(pow(t / b::DOUBLE, a) / (SELECT sum(pow(p, a)) FROM p, a) * b * {WHOLE})::BIGINT AS q,
             ceil(c / {BUCKET}.0)::BIGINT AS nb, (b + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS} AS blocks FROM s, tot, a),
u AS (SELECT d.*, t, q, blocks, ('0x' || substr(k, 1, 8))::BIGINT % nb AS u FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY u, k, n_tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM u),
x AS (SELECT *, q // t + (e <= q - q // t * t)::BIGINT AS copies FROM e),
y AS (SELECT *, unnest(range(0, copies))::INTEGER AS epoch FROM x WHERE copies > 0),
z AS (SELECT *, least(floor((epoch * t + e - n_tokens) * blocks / greatest(q, 1)::DOUBLE)::BIGINT, blocks - 1) AS block FROM y)
SELECT doc_id, source, epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY md5(k || ':' || epoch), n_tokens)::INTEGER AS position, n_tokens
FROM z
"""
