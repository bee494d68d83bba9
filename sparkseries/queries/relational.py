"""Joins, set operations, grouping and top-k over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series
from ..plans.catalog import query, table


def t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark, sf):
    o, c = t(spark, sf, "orders", "customer")
    return o.join(c.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_left(spark, sf):
    c, o = t(spark, sf, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000")
def join_right(spark, sf):
    c, o = t(spark, sf, "customer", "orders")
    return o.filter("o_totalprice > 300000").join(c, F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT a.p_partkey AS k1, b.s_suppkey AS k2 FROM part a FULL JOIN supplier b ON a.p_partkey = b.s_suppkey * 3")
def join_full(spark, sf):
    p, s = t(spark, sf, "part", "supplier")
    return p.join(s, F.col("p_partkey") == F.col("s_suppkey") * 3, "full_outer").select(F.col("p_partkey").alias("k1"), F.col("s_suppkey").alias("k2"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(spark, sf):
    c, o = t(spark, sf, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf):
    c, o = t(spark, sf, "customer", "orders")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, sf):
    """Two dimension tables of 5 and 25 rows."""
    region, nation = t(spark, sf, "region", "nation")
    return region.crossJoin(nation).select("r_name", "n_name")


@query(
    """WITH s AS (SELECT user_id AS sid, event_id AS lo, event_id + user_id % 5 + 1 AS hi FROM events WHERE event_type = 'signup')
    SELECT e.event_id, s.sid, s.lo FROM events e JOIN s ON e.event_id >= s.lo AND e.event_id < s.hi"""
)
def join_range(spark, sf):
    e = table(spark, sf, "events")
    spans = e.filter("event_type = 'signup'").select(F.col("user_id").alias("sid"), F.col("event_id").alias("lo"), (F.col("event_id") + F.col("user_id") % 5 + 1).alias("hi"))
    return series.range_join(e.select("event_id"), spans, at="event_id", start="lo", end="hi", width=8).select("event_id", "sid", "lo")


@query(
    """SELECT p.event_id, c.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def join_asof(spark, sf):
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return series.as_of(left, e.filter("event_type = 'click'"), by=["user_id"], on="ts", value="value").select("event_id", "asof_value")


@query(
    """SELECT p.event_id, c.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts <= c.ts"""
)
def join_asof_forward(spark, sf):
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return series.as_of(left, e.filter("event_type = 'click'"), by=["user_id"], on="ts", value="value", direction="forward").select("event_id", "asof_value")


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def join_star(spark, sf):
    li, s, n = t(spark, sf, "lineitem", "supplier", "nation")
    d = li.select("l_suppkey", "l_extendedprice", "l_discount").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(spark, sf):
    c, s = t(spark, sf, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def set_union(spark, sf):
    return set_union_all(spark, sf).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def set_intersect(spark, sf):
    o, e = t(spark, sf, "orders", "events")
    return o.select(F.col("o_custkey").alias("k")).intersect(e.select("user_id"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf):
    c, o = t(spark, sf, "customer", "orders")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.select("o_custkey"))


@query("SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation")
def set_except_all(spark, sf):
    s, n = t(spark, sf, "supplier", "nation")
    return s.select(F.col("s_nationkey").alias("k")).exceptAll(n.select("n_nationkey"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def agg_distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


_LINES = "count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem"


def _lines(grouped):
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"SELECT l_returnflag, l_linestatus, {_LINES} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf):
    return _lines(table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(f"SELECT l_returnflag, l_linestatus, {_LINES} GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf):
    return _lines(table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus"))


@query(f"SELECT l_returnflag, l_linestatus, {_LINES} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark, sf):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return _lines(table(spark, sf, "lineitem").groupingSets([[f], [s], []], f, s))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query()
def agg_approximate(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def topk_per_group(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("c_nationkey", "c_custkey", "rank")


@query(
    """SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w2 AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, nth_value(c_custkey, 2) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey), w2 AS (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey)"""
)
def window_ranking(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy("c_nationkey")
    w2 = Window.partitionBy("c_mktsegment").orderBy("c_nationkey", "c_custkey")
    whole = w2.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "customer").select(
        "c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(w2).alias("q"), F.round(F.percent_rank().over(w), 6).alias("p"), F.round(F.cume_dist().over(w), 6).alias("c"), F.nth_value("c_custkey", 2).over(whole).alias("second")
    )


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")
def window_range_frame(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)
    return table(spark, sf, "part").select("p_partkey", F.count(F.lit(1)).over(w).alias("near"))


@query("SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def semi_and_lookup(spark, sf):
    n, r, c = t(spark, sf, "nation", "region", "customer")
    n = n.join(r.filter("r_name LIKE 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    k = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"))
    return n.join(k, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("k", F.lit(0)).cast("long").alias("customers"))


@query("SELECT n_name, n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def graphql_resolve_reference(spark, sf):
    from ..schema.export import resolve_reference

    n, r = t(spark, sf, "nation", "region")
    out = resolve_reference(n.withColumn("key", F.col("n_regionkey")), r.withColumnRenamed("r_regionkey", "key"), "key")
    return out.select("n_name", "n_nationkey", "r_name")
