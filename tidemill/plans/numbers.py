"""Queries over parts, orders, suppliers and customers: fronts, peers, tiers, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import scores
from tidemill.sources.tables import table

TIERS = [(float("-inf"), 10.0, 1.0), (10.0, 30.0, 1.5), (30.0, float("inf"), 2.0)]
CLASSES = [("tiny", 0.0, 5.0), ("small", 5.0, 15.0), ("medium", 15.0, 35.0), ("large", 35.0, 1e9), ("none", -10.0, 0.0)]


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")


def unpivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda level, k: F.when(F.col("o_orderkey") % 7 == k, "—").when(F.col("o_orderkey") % 5 == k, F.concat(F.lit("~"), (F.col("o_custkey") % 100).cast("string"), F.lit(" @ $"), (F.col("o_orderkey") % 9 + k).cast("string"), F.lit(".5"))).otherwise(F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(" @ ~$2.10"))).alias(level)
    return scores.unpivot_scores(table(spark, sf_dir, "orders").select("o_orderkey", cell("low", 0), cell("high", 1)), "o_orderkey", ["low", "high"]).withColumn("cost", F.col("cost").cast("double"))


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.pareto_front(_part(spark, sf_dir), ["p_brand"], "p_size", "p_retailprice")


def dominated_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.dominated_by(_part(spark, sf_dir), ["p_brand"], "p_partkey", "p_size", "p_retailprice")


def nearest_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 50 + 1).alias("cost"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 50 + 1).alias("cost"))
    return scores.nearest_peer(c, s, "id", "score", "cost", ["nation"]).where("peer is not null").drop("gap")


def assign_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and status; pairs come from the distinct ones of customers' first orders."""
    o = table(spark, sf_dir, "orders")
    pairs = o.groupBy(F.col("o_orderpriority").alias("proposer"), F.col("o_orderstatus").alias("level")).agg(F.min("o_custkey").alias("challenger"), F.max("o_custkey").alias("escalation"), F.min("o_orderkey").alias("fallback_challenger"), F.max("o_orderkey").alias("fallback_escalation"))
    return scores.assign_challenger(o.select("o_orderkey", F.col("o_orderpriority").alias("proposer"), F.col("o_orderstatus").alias("level")), pairs, F.col("o_orderkey") % 3 == 0)


def price_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = scores.price_requests(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), TIERS, "l_quantity", "l_extendedprice")
    return priced.groupBy("l_orderkey").agg(F.sum(F.col("cost").cast("decimal(18,4)")).cast("double").alias("cost"), F.max("multiplier").alias("top"))


def lowest_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    per = m.groupBy("l_suppkey", "l_quantity").agg(F.min("l_discount").alias("least"), F.count(F.lit(1)).alias("n"))
    return scores.lowest_passing(per, ["l_suppkey"], "l_quantity", (F.col("least") >= 0.03) & (F.col("n") >= 10))


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.best_candidate(_part(spark, sf_dir), ["p_brand"], "p_partkey", "p_partkey", {"p_size": 10.0, "p_retailprice": 1.0}).withColumn("total", F.round("total", 2))


def size_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.size_mix(table(spark, sf_dir, "part"), "p_size", CLASSES)


def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 5).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"))
    return scores.catalog_diff(s, c, "id", "name")


def set_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.set_mismatch(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), ["k"])


QUERIES = {f.__name__: f for f in (unpivot_scores, pareto_front, dominated_by, nearest_peer, assign_challenger, price_requests, lowest_passing, best_candidate, size_mix, catalog_diff, set_mismatch)}

_DOM = "o.p_brand = p.p_brand AND o.p_size >= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice < p.p_retailprice)"
ORACLE_SQL = {
    "unpivot_scores": """
WITH c AS (SELECT o_orderkey, unnest([{'level': 'low', 'k': 0}, {'level': 'high', 'k': 1}], recursive := true), o_custkey FROM orders)
SELECT o_orderkey, level, CASE WHEN o_orderkey % 7 = k THEN NULL WHEN o_orderkey % 5 = k THEN o_custkey % 100 ELSE o_orderkey % 100 END::DOUBLE AS score,
 CASE WHEN o_orderkey % 7 = k THEN NULL WHEN o_orderkey % 5 = k THEN o_orderkey % 9 + k + 0.5 ELSE 2.1 END::DOUBLE AS cost, o_orderkey % 7 <> k AS approx FROM c""",
    "pareto_front": f"SELECT p_partkey, p_brand, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE {_DOM})",
    "dominated_by": f"""
SELECT p.p_brand, p.p_partkey, o.p_partkey AS dominator FROM part p JOIN part o ON {_DOM}
WHERE NOT EXISTS (SELECT 1 FROM part p2 WHERE {_DOM.replace('o.', 'p2.').replace('p.', 'o.').replace('p2o.', 'p2.')})
QUALIFY row_number() OVER (PARTITION BY p.p_partkey ORDER BY o.p_retailprice, o.p_size DESC, o.p_partkey) = 1""",
    "nearest_peer": """
WITH s AS (SELECT s_nationkey AS nation, s_suppkey AS sid, s_acctbal AS ss, s_suppkey % 50 + 1 AS sc FROM supplier)
SELECT c_nationkey AS nation, c_custkey AS id, sid AS peer, round(sc * 100.0 / (c_custkey % 50 + 1))::BIGINT AS pct_cost
FROM customer JOIN s ON s.nation = c_nationkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(ss - c_acctbal), sc, sid) = 1""",
    "assign_challenger": """
WITH p AS (SELECT o_orderpriority AS proposer, o_orderstatus AS level, min(o_custkey) a, max(o_custkey) b, min(o_orderkey) c, max(o_orderkey) d FROM orders GROUP BY ALL)
SELECT o_orderkey, p.proposer, p.level, CASE WHEN o_orderkey % 3 = 0 THEN a ELSE c END AS challenger, CASE WHEN o_orderkey % 3 = 0 THEN b ELSE d END AS escalation
FROM orders JOIN p ON o_orderpriority = p.proposer AND o_orderstatus = p.level""",
    "price_requests": """
WITH c AS (SELECT *, CASE WHEN l_quantity <= 10 THEN 1.0 WHEN l_quantity <= 30 THEN 1.5 ELSE 2.0 END::DOUBLE AS m FROM lineitem)
SELECT l_orderkey, sum((l_extendedprice * m)::DECIMAL(18,4))::DOUBLE AS cost, max(m) AS top FROM c GROUP BY 1""",
    "lowest_passing": """
WITH p AS (SELECT l_suppkey, l_quantity, min(l_discount) AS least, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, min(l_quantity) FILTER (least >= 0.03 AND n >= 10) AS setting, CASE WHEN setting IS NULL THEN 'FAIL' ELSE 'PASS' END AS status FROM p GROUP BY 1""",
    "best_candidate": "SELECT p_brand, p_partkey AS candidate, round(p_size * 10.0 + p_retailprice, 2) AS total FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 10.0 + p_retailprice, p_partkey) = 1",
    "size_mix": "SELECT class, count(p_size) AS n FROM (VALUES ('tiny', 0, 5), ('small', 5, 15), ('medium', 15, 35), ('large', 35, 1000000000), ('none', -10, 0)) t(class, lo, hi) LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY 1",
    "catalog_diff": """
WITH s AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS name FROM supplier), c AS (SELECT c_custkey + 5 AS id, 'n' || c_nationkey AS name FROM customer)
SELECT coalesce(s.id, c.id) AS id, s.name AS old_name, c.name AS new_name, CASE WHEN s.id IS NULL THEN 'NEW' WHEN c.id IS NULL THEN 'GONE' WHEN s.name = c.name THEN 'SAME' ELSE 'RENAMED' END AS status
FROM s FULL JOIN c ON s.id = c.id""",
    "set_mismatch": """
SELECT *, 'left' AS side FROM (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)
UNION ALL SELECT *, 'right' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""",
}
