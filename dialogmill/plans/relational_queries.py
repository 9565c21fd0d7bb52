"""Generic relational operators on the star schema: Spark-native additions beside the curation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialogmill.plans.base import query, table

C = F.col


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def rel_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def rel_join(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey")).join(n.select("n_nationkey", "n_name"), C("c_nationkey") == C("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select("o_custkey"), C("c_custkey") == C("o_custkey"), "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, C("c_custkey") == C("o_custkey"), "left_semi")


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice < 20000")
def rel_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_totalprice > 200000").select(C("o_custkey").alias("k")).intersect(o.where("o_totalprice < 20000").select(C("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def rel_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(C("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select(C("o_custkey").alias("k")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(C("o_totalprice").desc(), "o_orderkey").limit(25)


@query("SELECT o_custkey, o_orderkey, (row_number() OVER w)::INT AS rn, rank() OVER w::INT AS rk, lag(o_totalprice) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)".replace("rank() OVER w::INT", "(rank() OVER w)::INT"))
def rel_window(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.lag("o_totalprice").over(w).alias("before"))
