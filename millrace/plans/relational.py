"""Queries over the relational tables, events and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.metrics import nearest
from millrace.plans.registry import query
from millrace.runtime import table
from millrace.streaming.windows import tumbling


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def nation_orders(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier")
def schema_union(spark, d):
    """Tables of different columns under one another."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def set_intersection(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, d, "customer").where("c_acctbal < 0").select("c_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT p_brand, p_partkey, p_retailprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def top_parts(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    return tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")]).withColumnRenamed("window_start", "start")


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 1800000000 GROUP BY 1")
def user_sessions(spark, d):
    """Sessions that a pause of half an hour ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", F.lag("ts").over(w).alias("prev"))
    return e.where(F.col("prev").isNull() | (F.col("ts") > F.col("prev") + F.expr("interval 30 minutes"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("""SELECT k, n, x FROM (SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, max(json_extract_string(props, '$.k')) AS x FROM events GROUP BY 1)""")
def event_props(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy(k.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("x"))


_HIT = "WITH q AS (SELECT vec_id AS qid, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.qid, q.ql, e.label, row_number() OVER (PARTITION BY q.qid ORDER BY round(list_inner_product(q.qe::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS r FROM q, embeddings e WHERE e.vec_id <> q.qid)"


def _searched(spark, d, k):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = nearest(e.where(F.col("id") % 100 == 0), e, k + 1).where("query_id <> corpus_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    lab = e.select("id", "label")
    return near.join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(lab.select(F.col("id").alias("corpus_id"), "label"), "corpus_id")


@query(_HIT + " SELECT k::INT AS k, round(avg(h), 6) AS hit FROM (SELECT qid, k, max((r <= k AND label = ql)::INT) AS h FROM s, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY 1, 2) GROUP BY 1")
def retrieval_hit_at_k(spark, d):
    """Share of queries with a neighbour of their label among the first k."""
    s = _searched(spark, d, 10).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("r"))).alias("best"))
    each = s.withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))))
    return each.groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("best") <= F.col("k")).cast("int"), F.lit(0))), 6).alias("hit"))


@query(_HIT + " SELECT qid AS query_id, label, count(*) AS n FROM s WHERE r <= 10 GROUP BY 1, 2")
def retrieval_labels(spark, d):
    return _searched(spark, d, 10).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
