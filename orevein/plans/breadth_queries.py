"""Queries beyond retrieval: relational, window and event-time forms over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orevein.registry import query
from orevein.session import load


@query(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
)
def pricing_summary(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query(
    "region_revenue",
    "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL",
)
def region_revenue(spark, sf_dir):
    lineitem, orders, customer, nation, region = load(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    customer, orders = load(spark, sf_dir, "customer", "orders")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey")


@query("rollup_segments", "SELECT c_mktsegment, n_name, count(*) AS n, grouping(c_mktsegment, n_name)::BIGINT AS level FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")
def rollup_segments(spark, sf_dir):
    customer, nation = load(spark, sf_dir, "customer", "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders_per_customer(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(order).alias("rank")).filter("rank <= 3")


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("window.start", "event_type", "n", "total")


@query("as_of_previous", "SELECT e.event_id, p.event_id AS previous FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) p ON e.user_id = p.user_id AND e.ts > p.ts")
def as_of_previous(spark, sf_dir):
    """As-of join by one window: the latest event of the first type strictly before each event."""
    events = load(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("first_type"))
    rows = events.crossJoin(F.broadcast(first))  # one row
    before = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("event_type") == F.col("first_type"), F.struct("ts", "event_id"))
    return rows.withColumn("p", F.max(mark).over(before)).select("event_id", F.col("p.event_id").alias("previous"))


@query("set_operations", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) EXCEPT SELECT user_id FROM events")
def set_operations(spark, sf_dir):
    orders, customer, events = load(spark, sf_dir, "orders", "customer", "events")
    return orders.select(F.col("o_custkey").alias("k")).intersect(customer.select("c_custkey")).subtract(events.select("user_id"))
