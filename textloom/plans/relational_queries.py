"""Relational queries over the star schema and the event table: joins, windows, grouping sets, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text_queries import docs as table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def money(c: str | Column) -> Column:
    """Exact cents, so that sums do not depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(14,2)")


def total(c: str | Column, name: str) -> Column:
    return F.sum(money(c)).cast("double").alias(name)


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS sum_base, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01' GROUP BY ALL
""")
def tpch_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-01").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), total("l_extendedprice", "sum_base"), F.count("*").alias("n"))


@query("""
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS revenue, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey < 3 GROUP BY n_name
""")
def tpch_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, l, n, r = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem", "nation", "region"))
    # lines are summed by order before they meet customers: one shuffle of lineitem, on the key of both joins
    by_order = l.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("price"), F.count("*").alias("lines"))
    joined = by_order.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = n.join(r.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.join(named, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("price").cast("double").alias("revenue"), F.sum("lines").alias("n_lines"), F.count("*").alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def tpch_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def tpch_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("""
SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def tpch_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    return table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query("""
SELECT coalesce(s, c) AS nation_key, n_suppliers, n_customers FROM (SELECT s_nationkey AS s, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) FULL JOIN (SELECT c_nationkey AS c, count(*) AS n_customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) ON s = c
""")
def tpch_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.count("*").alias("n_suppliers"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation_key")).agg(F.count("*").alias("n_customers"))
    return s.join(c, "nation_key", "full")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def tpch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def tpch_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def tpch_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return _sets(spark, sf_dir).groupingSets([[a], [b], []], a, b).agg(F.sum("l_quantity").alias("qty"))


@query("""
SELECT p_brand, p_partkey, p_retailprice, rank() OVER w AS place, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS quartile FROM part
WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC)
""")
def tpch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", F.rank().over(w).cast("long").alias("place"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("quartile"))


@query("""
SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three, lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER w AS first
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def tpch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum(money("o_totalprice")).over(w.rowsBetween(-2, 0)).cast("double").alias("last_three"), F.lag("o_orderkey").over(w).alias("before"), F.first("o_orderkey").over(w).alias("first"))


@query("""
(SELECT c_nationkey AS k, 'either' AS kind FROM customer UNION SELECT s_nationkey, 'either' FROM supplier) UNION ALL
(SELECT c_nationkey, 'both' FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL
(SELECT c_nationkey, 'only' FROM customer EXCEPT SELECT s_nationkey, 'only' FROM supplier)
""")
def tpch_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    all_c, rich = c.select(F.col("c_nationkey").alias("k")), c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    kind = lambda df, name: df.select("k", F.lit(name).alias("kind"))
    return kind(all_c.union(s).distinct(), "either").unionByName(kind(rich.intersect(s), "both")).unionByName(kind(all_c.subtract(s), "only"))


@query("""
SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY o_orderstatus
""")
def tpch_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return p.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT p_type, count(*) AS n, median(p_retailprice) AS mid, quantile_disc(p_retailprice, 0.9) AS p90 FROM part GROUP BY p_type")
def tpch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.median("p_retailprice").alias("mid"), F.expr("percentile_disc(0.9) within group (order by p_retailprice)").alias("p90"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def tpch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""
SELECT p_partkey, lo, count(*) AS n_lines FROM part JOIN (SELECT * FROM (VALUES (0, 10), (10, 25), (25, 51)) t(lo, hi)) ON p_size >= lo AND p_size < hi JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= lo AND l_quantity < hi GROUP BY ALL
""")
def tpch_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range lookup in a table of fixed size, broadcast; then an equi join with a range condition."""
    bands = F.broadcast(spark.createDataFrame([(0, 10), (10, 25), (25, 51)], "lo int, hi int"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(bands, (F.col("p_size") >= F.col("lo")) & (F.col("p_size") < F.col("hi")))
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    return l.join(p, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi"))).groupBy("p_partkey", "lo").agg(F.count("*").alias("n_lines"))


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS total FROM events GROUP BY ALL
""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), total("value", "total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, session
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1)
    s = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", fresh.alias("fresh")).withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""
WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts AS pts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, e.user_id, p.purchase_id FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.pts
""")
def event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase before each error."""
    from ..operators.asof import asof_join

    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    return asof_join(errors, bought, ["user_id"], "ts", ["purchase_id"]).select("event_id", "user_id", "purchase_id")


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90
""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k >= 90")


@query("""
SELECT user_id, event_type, count(*) AS n, max_by(event_id, value * 1000000 + event_id) AS top_event FROM events GROUP BY ALL
""")
def event_top_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.col("value") * 1000000 + F.col("event_id")).alias("top_event"))
