"""Graphs made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.graph import Graph
from weft.property_graph import EdgeGroup, PropertyGraph, VertexGroup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, with their number of events; an edge from each event's user to that of the next event of the same type within the hour."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    e = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(order).alias("dst"), "event_type", "event_id")
    return Graph(events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events")), e.where("dst is not null"))


def geo_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers -> nations -> regions; ids are kind and key."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier")}
    v = [t["region"].select(key("r", "r_regionkey").alias("id"), F.lit("region").alias("kind")), t["nation"].select(key("n", "n_nationkey"), F.lit("nation")), t["customer"].select(key("c", "c_custkey"), F.lit("customer")), t["supplier"].select(key("s", "s_suppkey"), F.lit("supplier"))]
    e = [t["nation"].select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("in").alias("rel")), t["customer"].select(key("c", "c_custkey"), key("n", "c_nationkey"), F.lit("lives")), t["supplier"].select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit("sells"))]
    return Graph(v[0].unionAll(v[1]).unionAll(v[2]).unionAll(v[3]), e[0].unionAll(e[1]).unionAll(e[2]))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, with an edge from the supplier's to the customer's nation where the ordered items have more than average worth; weight in thousands."""
    pairs = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        .join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("dst")), "o_custkey")
        .join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("src")), "l_suppkey")
        .groupBy("src", "dst").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    )
    mean = pairs.agg(F.sum("quantity").alias("q"), F.count("*").alias("n"))
    e = pairs.join(F.broadcast(mean), F.col("quantity") * F.col("n") > F.col("q")).select("src", "dst", "quantity")  # one row
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return Graph(v, e)


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; each has edges to the nations of the suppliers that follow its first and its last supplier by key. Sparse: all its cycles can be listed."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("src"))
    after = s.withColumn("dst", F.lead("src").over(Window.orderBy("k"))).where("dst is not null")
    ends = after.groupBy("src").agg(F.min(F.struct("k", "dst")).alias("x"), F.max(F.struct("k", "dst")).alias("y"))
    e = ends.select("src", F.explode(F.array("x.dst", "y.dst")).alias("dst")).distinct()
    return Graph(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), e)


def field_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers in rows of ten by key, with a field of their balance, coupled to the right and down by a function of the key."""
    name = lambda k: F.concat_ws(",", F.floor(k / 10).cast("string"), (k % 10).cast("string"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 5000 - 0.9).cast("double").alias("a"))
    v = v.select(name(F.col("k")).alias("id"), F.floor(F.col("k") / 10).cast("int").alias("i"), (F.col("k") % 10).cast("int").alias("j"), "a", "k")
    side = lambda step, unit: v.select(F.col("id").alias("src"), name(F.col("k") + step).alias("dst"), (F.col("k") % unit / float(unit) - 0.4).alias("b"), "j")
    e = side(1, 7).where("j < 9").unionAll(side(10, 5)).drop("j")
    v = v.drop("k")
    return Graph(v, e.join(v.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "b"))


def rating_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (2 x key) who bought parts (2 x key + 1), weight 1 to 5 by quantity."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    e = items.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.least(F.lit(5.0), F.floor(F.col("l_quantity") / 10) + 1).cast("double").alias("weight"))
    return Graph(Graph.from_edges(e).vertices, e, True)


def link_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and the targets of their links."""
    pages = table(spark, sf_dir, "pages")
    e = pages.select(F.col("url").alias("src"), F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("dst"))
    return Graph.from_edges(e)


def store_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers, parts and suppliers as typed groups, with what they buy and sell."""
    items = table(spark, sf_dir, "lineitem")
    customer = VertexGroup("customer", table(spark, sf_dir, "customer"), "c_custkey")
    part = VertexGroup("part", table(spark, sf_dir, "part"), "p_partkey")
    supplier = VertexGroup("supplier", table(spark, sf_dir, "supplier"), "s_suppkey", apply_mask_on_id=False)
    bought = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "l_quantity")
    sold = items.select("l_suppkey", "l_partkey").distinct()
    return PropertyGraph([customer, part, supplier], [EdgeGroup("buys", bought, customer, part, True, "o_custkey", "l_partkey", "l_quantity"), EdgeGroup("sells", sold, supplier, part, False, "l_suppkey", "l_partkey")])
