"""Queries on requests to decide on runs, to make accounts and to set replacements: orders are runs, their lines are requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import upkeep
from corvane.sources.tables import table


def _submitted(spark, folder):
    status = F.when(F.col("o_orderstatus") == "O", "awaiting_review").when(F.col("o_orderstatus") == "F", "completed").otherwise("working")
    agent = F.when(F.col("o_orderpriority").startswith("1"), "unheard-of").when(F.col("o_orderpriority").startswith("2"), "tagging").otherwise("sanitization")
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 5).alias("created_by"), agent.alias("agent"), status.alias("status"))
    lines, reviewer = table(spark, folder, "lineitem"), F.col("l_suppkey") % 5
    decision = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").otherwise("edited")
    run = F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 7, 1000000000).otherwise(0)
    requests = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("request"), run.alias("run_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("seq"),
        reviewer.alias("reviewer"), F.when(reviewer == 0, "admin").otherwise("km_reviewer").alias("role"), decision.alias("decision"),
    )
    agents = spark.sql("SELECT * FROM VALUES ('sanitization'), ('tagging') AS t(agent)")
    return upkeep.reviews_submitted(runs, requests, agents)


def reviews_submitted(spark, folder):
    return _submitted(spark, folder).select("request", "outcome")


def review_items_after(spark, folder):
    """Runs with an even customer have one or two items before."""
    before = table(spark, folder, "orders").where("o_custkey % 2 = 0 and o_custkey % 3 > 0").select(F.col("o_orderkey").alias("run_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("o_custkey") % 3)).alias("item"))
    items = before.select("run_id", "item", F.lit(None).cast("long").alias("reviewer"), F.lit("waiting").alias("decision"))
    return upkeep.review_items_after(items, _submitted(spark, folder))


def review_audit(spark, folder):
    return upkeep.review_audit(_submitted(spark, folder))


def accounts_created(spark, folder):
    """Customers ask for accounts by their segment and nation; those of nations are there already."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise(F.concat_ws(" ", "c_mktsegment", "n_name"))
    asked = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    requests = asked.select(F.col("c_custkey").alias("request"), (-F.col("c_custkey")).alias("seq"), name.alias("name"))
    return upkeep.accounts_created(table(spark, folder, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")), requests).select("request", "outcome")


def aliases_set(spark, folder):
    """Suppliers are entities; orders of the customer with their number set, or take away, what replaces them."""
    entities = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("Before")).alias("custom"))
    custom = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" Partner "), "o_orderkey"))
    requests = table(spark, folder, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("seq"), custom.alias("custom"))
    return upkeep.aliases_set(entities, requests)


_ASKED = """WITH q AS MATERIALIZED (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS request, l_orderkey + CASE WHEN l_partkey % 50 = 7 THEN 1000000000 ELSE 0 END AS run_id, l_linenumber * 10000000 + l_partkey AS seq, l_suppkey % 5 AS reviewer, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'edited' END AS decision FROM lineitem),
j AS MATERIALIZED (SELECT q.*, CASE left(o_orderpriority, 1) WHEN '2' THEN 'tagging' ELSE 'sanitization' END AS agent, CASE WHEN o_orderkey IS NULL THEN 'no such run' WHEN o_orderstatus = 'F' THEN 'run is completed' WHEN o_orderstatus <> 'O' THEN 'run is working' WHEN o_custkey % 5 = reviewer AND reviewer <> 0 THEN 'own run' WHEN left(o_orderpriority, 1) = '1' THEN 'unknown agent' END AS refused FROM q LEFT JOIN orders ON o_orderkey = run_id),
a AS MATERIALIZED (SELECT run_id, min(seq) AS decided_at, arg_min(decision, seq) AS decided FROM j WHERE refused IS NULL GROUP BY run_id),
s AS MATERIALIZED (SELECT j.*, CASE WHEN seq > decided_at THEN 'run is ' || CASE WHEN decided = 'rejected' THEN 'rejected' ELSE 'completed' END ELSE coalesce(refused, 'accepted') END AS outcome FROM j LEFT JOIN a USING (run_id)),
ok AS MATERIALIZED (SELECT * FROM s WHERE outcome = 'accepted'),
i AS (SELECT o_orderkey AS run_id, unnest(generate_series(1, o_custkey % 3)) AS item FROM orders WHERE o_custkey % 2 = 0)
"""
ORACLE = {
    "reviews_submitted": _ASKED + "SELECT request, outcome FROM s",
    "review_audit": _ASKED + "SELECT run_id, reviewer AS actor, 'review_' || decision || ': ' || agent AS action FROM ok",
    "review_items_after": _ASKED + "SELECT i.run_id, i.item, CASE WHEN item = m THEN reviewer END AS reviewer, CASE WHEN item = m THEN coalesce(decision, 'waiting') ELSE 'waiting' END AS decision FROM (SELECT *, max(item) OVER (PARTITION BY run_id) AS m FROM i) i LEFT JOIN ok ON ok.run_id = i.run_id UNION ALL SELECT run_id, 1, reviewer, decision FROM ok WHERE run_id NOT IN (SELECT run_id FROM i)",
    "accounts_created": (
        "SELECT c_custkey AS request, CASE WHEN name IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) OR c_custkey < max(c_custkey) "
        "OVER (PARTITION BY name) THEN 'conflict' ELSE 'created' END AS outcome FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name "
        "ELSE c_mktsegment || ' ' || n_name END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)"
    ),
    "aliases_set": (
        "SELECT s_suppkey AS entity_id, CASE WHEN k IS NULL THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Before' END "
        "WHEN k % 3 = 1 THEN 'Partner ' || k END AS custom FROM supplier LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) "
        "ON o_custkey = s_suppkey"
    ),
}
QUERIES = {name: globals()[name] for name in ORACLE}
