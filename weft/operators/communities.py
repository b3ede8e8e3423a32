"""Labels, triangles, cores, independent sets and spectral clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.columns import quote, unit_hash
from weft.operators.components import canonical
from weft.plans.iterate import Rounds


def attach(g, found: DataFrame, name: str) -> DataFrame:
    """The vertices with one more column of `found` (id, name); a column of that name is replaced."""
    kept = [c for c in g.vertices.columns if c != name]
    return g.vertices.select(*[F.col(quote(c)) for c in kept]).join(found, "id", "left").select(*[F.col(quote(c)) for c in kept], F.col(name))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))


def label_propagation(g, max_iter: int, is_directed: bool = False) -> DataFrame:
    """The vertices with `label`: each takes the commonest label among its messages, the smallest of ties, max_iter times at most.

    Labels travel along edges both ways, or from src to dst only if is_directed; without a message a label stays.
    """
    if max_iter < 1:
        raise ValueError("at least one iteration is needed")
    rounds = Rounds(g.vertices.sparkSession, "labels")
    e = g.edges.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    if not is_directed:
        e = e.unionAll(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    e = rounds.cache(e.groupBy("x", "y").agg(F.count("*").alias("n")).repartition("x"))
    state = rounds.cut(g.vertices.select("id").distinct().select("id", F.col("id").alias("label"), F.lit(True).alias("moved")))
    for _ in range(max_iter):
        votes = e.join(state.select(F.col("id").alias("x"), "label"), "x").groupBy(F.col("y").alias("id"), F.col("label").alias("vote")).agg(F.sum("n").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "vote")).alias("b")).select("id", F.col("b.vote").alias("vote"))
        state = rounds.cut(state.join(best, "id", "left").select("id", F.coalesce("vote", "label").alias("label"), F.coalesce(F.col("vote") != F.col("label"), F.lit(False)).alias("moved")))
        rounds.forget(2)
        if state.where("moved").isEmpty():
            break
    return attach(g, rounds.close(state.select("id", "label")), "label")


def triangle_rows(g) -> DataFrame:
    """(a, b, c) of every triangle once. Edges point from the smaller to the larger degree, so that no vertex, hubs included, has more
    than about sqrt(2 E) of them. A vertex sends each of its ends the list of those that come after it, which meets that end's own list,
    so wedges are never rows."""
    e = canonical(g.edges.select("src", "dst"))
    degree = both_ways(e).groupBy("x").agg(F.count("*").alias("d"))
    e = e.join(degree.select(F.col("x").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("x").alias("v"), F.col("d").alias("dv")), "v")
    low, high = F.struct(F.col("du").alias("d"), F.col("u").alias("i")), F.struct(F.col("dv").alias("d"), F.col("v").alias("i"))
    up = low < high
    after = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, high).otherwise(low).alias("to")).groupBy("a").agg(F.array_sort(F.collect_list("to")).alias("l")).select("a", F.col("l.i").alias("l"))
    sent = after.select("a", "l", F.posexplode("l").alias("k", "b")).select("a", "b", F.expr("slice(l, k + 2, size(l))").alias("rest")).where(F.size("rest") > 0)
    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed, as lists are more than the rows that adaptive execution would go by
    met = sent.repartition(n, "b").join(after.select(F.col("a").alias("b"), F.col("l").alias("own")).repartition(n, "b"), "b")
    return met.select("a", "b", F.explode(F.array_intersect("rest", "own")).alias("c"))


def triangle_count(g, algorithm: str = "exact", lg_nom_entries: int = 12) -> DataFrame:
    """The vertices with `count`, the number of triangles through each (0 where there is none); edges are taken as undirected and simple.

    approx: by Theta sketches of neighbourhoods with 2 ** lg_nom_entries entries.
    """
    if algorithm == "exact":
        rows = triangle_rows(g)
        counts = rows.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("count"))
    elif algorithm == "approx":
        if not 4 <= lg_nom_entries <= 24:
            raise ValueError("lg_nom_entries must be from 4 to 24")
        e = canonical(g.edges.select("src", "dst"))
        sketches = both_ways(e).groupBy("x").agg(F.expr(f"theta_sketch_agg(y, {lg_nom_entries})").alias("s"))
        pairs = e.join(sketches.select(F.col("x").alias("u"), F.col("s").alias("su")), "u").join(sketches.select(F.col("x").alias("v"), F.col("s").alias("sv")), "v")
        common = pairs.select("u", "v", F.expr("theta_sketch_estimate(theta_intersection(su, sv))").alias("n"))
        counts = common.select(F.explode(F.array("u", "v")).alias("id"), "n").groupBy("id").agg(F.floor(F.sum("n") / 2).cast("long").alias("count"))
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}: exact or approx")
    done = attach(g, counts, "count")
    return done.withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def k_core(g) -> DataFrame:
    """The vertices with `kcore`, the largest k for which they are in the k-core; edges are taken as undirected and simple.

    Each round, a vertex lowers its value to the largest k such that k neighbours have at least k.
    """
    rounds = Rounds(g.vertices.sparkSession, "kcore")
    e = rounds.cache(both_ways(canonical(g.edges.select("src", "dst"))).repartition("x"))
    state = rounds.cut(e.groupBy(F.col("x").alias("id")).agg(F.count("*").cast("int").alias("k")).withColumn("moved", F.lit(True)))
    while not state.where("moved").isEmpty():
        # h-index without lists: neighbours' values are counted, so a hub is one row for each distinct value
        seen = e.join(state.select(F.col("id").alias("y"), "k"), "y").groupBy("x", "k").agg(F.count("*").alias("n"))
        above = Window.partitionBy("x").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        h = seen.select("x", F.least(F.col("k"), F.sum("n").over(above)).alias("h")).groupBy("x").agg(F.max("h").cast("int").alias("h"))
        state = rounds.cut(state.join(h.withColumnRenamed("x", "id"), "id").select("id", F.least("k", "h").alias("k"), (F.col("h") < F.col("k")).alias("moved")))
        rounds.forget(2)
    done = attach(g, rounds.close(state.select("id", F.col("k").alias("kcore"))), "kcore")
    return done.withColumn("kcore", F.coalesce("kcore", F.lit(0)))


def maximal_independent_set(g, seed: int = 42) -> DataFrame:
    """(id) of a maximal independent set. In each round a vertex joins if its hash of (id, seed, round) is the smallest in its
    neighbourhood; it and its neighbours are then done. The same seed gives the same set."""
    rounds = Rounds(g.vertices.sparkSession, "mis")
    live = rounds.cut(g.vertices.select("id").distinct())
    e = rounds.cut(both_ways(canonical(g.edges.select("src", "dst"))))
    e = e.join(live.withColumnRenamed("id", "x"), "x", "left_semi").join(live.withColumnRenamed("id", "y"), "y", "left_semi").select("x", "y")
    members, k = rounds.collector("members"), 0
    members.add(live.limit(0))
    while not live.isEmpty():
        mark = lambda c: F.struct(unit_hash(F.col(c), seed, k).alias("h"), F.col(c).alias("i"))
        rival = e.groupBy("x").agg(F.min(mark("y")).alias("r"))
        joined = live.join(rival, live["id"] == rival["x"], "left").where(F.col("r").isNull() | (mark("id") < F.col("r"))).select("id")
        joined = members.add(joined)
        near = e.join(joined.withColumnRenamed("id", "x"), "x", "left_semi").select(F.col("y").alias("id"))
        gone = rounds.cut(joined.unionAll(near).distinct())
        live = rounds.cut(live.join(gone, "id", "left_anti"))
        e = rounds.cut(e.join(gone.withColumnRenamed("id", "x"), "x", "left_anti").join(gone.withColumnRenamed("id", "y"), "y", "left_anti").select("x", "y"))
        k += 1
    done = rounds.close(members.all())
    members.remove()
    return done


def power_iteration_clustering(g, k: int, max_iter: int, weight_col: str | None = None) -> DataFrame:
    """(id, cluster) by spectral clustering of a graph with non-negative weights; ids of any type."""
    from pyspark.ml.clustering import PowerIterationClustering

    from weft.graph import long_ids

    weight = F.lit(1.0) if weight_col is None else F.col(quote(weight_col)).cast("double")
    index = long_ids(g.vertices.select("id"))
    e = g.edges.select("src", "dst", weight.alias("weight"))
    e = e.join(index.select(F.col("id").alias("src"), F.col("new_id").alias("s")), "src").join(index.select(F.col("id").alias("dst"), F.col("new_id").alias("d")), "dst")
    model = PowerIterationClustering(k=k, maxIter=max_iter, srcCol="s", dstCol="d", weightCol="weight")
    found = model.assignClusters(e.select("s", "d", "weight"))
    return index.join(found.withColumnRenamed("id", "new_id"), "new_id").select("id", F.col("cluster").cast("int").alias("cluster"))
