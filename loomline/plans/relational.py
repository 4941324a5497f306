"""Relational coverage on the star schema: joins of every kind, windows, set operations, star aggregates."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.plans.registry import query


@query("join_inner", "SELECT n_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(t):
    d = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("join_left", "SELECT c_custkey, count(o_orderkey)::BIGINT AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def join_left(t):
    o = t("orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return t("customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*)::BIGINT AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier WHERE s_acctbal < 2000 GROUP BY 1) b ON a.k = b.k")
def join_full(t):
    a = t("customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(t("supplier").where("s_acctbal < 2000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers")), "k", "full")


@query("join_right_semi_anti", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS semi, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))::BIGINT AS anti, (SELECT count(*) FROM (SELECT * FROM orders WHERE o_totalprice > 1e5) o RIGHT JOIN customer ON c_custkey = o_custkey)::BIGINT AS right_rows")
def join_right_semi_anti(t):
    c, o = t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    rows = lambda d, kind: d.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    u = rows(c.join(o, "c_custkey", "left_semi"), "semi").union(rows(c.join(o, "c_custkey", "left_anti"), "anti")).union(rows(o.where("o_totalprice > 1e5").join(c, "c_custkey", "right"), "right_rows"))
    return u.groupBy().pivot("kind", ["semi", "anti", "right_rows"]).agg(F.first("n"))


@query("join_range", "SELECT r_name, p_size, count(*)::BIGINT AS n FROM part JOIN region ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 9 GROUP BY r_name, p_size")
def join_range(t):
    # equi-join on the range's bucket instead of comparing all pairs
    p = t("part").select("p_size", F.floor(F.col("p_size") / 10).cast("int").alias("r_regionkey"))
    return p.join(F.broadcast(t("region")), "r_regionkey").groupBy("r_name", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("windows_ranking", "SELECT l_orderkey, l_linenumber, row_number() OVER w::INT AS rn, rank() OVER w::INT AS rk, dense_rank() OVER w::INT AS dr, ntile(3) OVER w::INT AS nt, round(percent_rank() OVER w, 4) AS pr, round(cume_dist() OVER w, 4) AS cd FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice)".replace("OVER w::INT", "OVER w"))
def windows_ranking(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    own = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "nt": F.ntile(3)}
    return t("lineitem").select("l_orderkey", "l_linenumber", *[f.over(w).cast("long").alias(n) for n, f in own.items()], F.round(F.percent_rank().over(w), 4).alias("pr"), F.round(F.cume_dist().over(w), 4).alias("cd"))


@query("windows_frames", "SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER w AS before, lead(l_quantity) OVER w AS after, first_value(l_quantity) OVER w AS first, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def windows_frames(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    q = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.lag(q).over(w).alias("before"), F.lead(q).over(w).alias("after"), F.first(q).over(w).alias("first"), F.round(F.sum(q).over(w.rowsBetween(-1, 1)), 2).alias("near"))


@query("setops_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def setops_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("setops_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def setops_intersect(t):
    return t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("setops_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def setops_except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("topn_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def topn_per_group(t):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t("customer").withColumn("r", F.row_number().over(w)).where("r <= 5").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_quantity), 4) AS avg_qty, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    d = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    e = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("base"), F.round(F.sum(e), 2).alias("disc"), F.round(F.sum(e * (1 + F.col("l_tax"))), 2).alias("charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey GROUP BY n_name")
def revenue_by_nation(t):
    li = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    d = (li.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
           .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
           .join(t("customer").select("c_custkey", "c_nationkey"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
           .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")))
    return d.groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("pivot_priority", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority LIKE '1%')::BIGINT AS p1, count(*) FILTER (WHERE o_orderpriority LIKE '2%')::BIGINT AS p2, count(*) FILTER (WHERE o_orderpriority LIKE '3%')::BIGINT AS p3 FROM orders GROUP BY o_orderstatus")
def pivot_priority(t):
    d = t("orders").select("o_orderstatus", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("p"))
    return d.groupBy("o_orderstatus").pivot("p", ["p1", "p2", "p3"]).agg(F.count(F.lit(1))).na.fill(0)


@query("unpivot_balances", "SELECT c_custkey, 'balance' AS what, c_acctbal AS amount FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer")
def unpivot_balances(t):
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot("c_custkey", ["balance", "nation"], "what", "amount")
