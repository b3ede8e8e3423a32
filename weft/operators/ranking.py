"""PageRank in its variants, as DataFrame loops over (id, rank) rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import quote
from weft.operators.paths import check_vertices
from weft.plans.iterate import Rounds, fitting, shuffled_to

UNROLLED = 4  # rounds between two cuts
TOGETHER = 8  # the same, where a round is cheap and there are many of them
ROWS = 250_000  # edges of a partition in such rounds


def weighted(g) -> DataFrame:
    """src, dst and w = 1 / out-degree; parallel edges count. Edges to what isn't a vertex take their share of it along."""
    out = g.edges.groupBy("src").agg(F.count("*").alias("n"))
    e = g.edges.select("src", "dst").join(g.vertices.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return e.join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("w"))


def edge_weights(g) -> DataFrame:
    out = g.edges.groupBy("src").agg((1.0 / F.count("*")).alias("weight"))
    kept = [c for c in g.edges.columns if c != "weight"]
    return g.edges.select(*[F.col(quote(c)) for c in kept]).join(out, "src").select(*[F.col(quote(c)) for c in kept], "weight")


def with_ranks(g, ranks: DataFrame, name: str):
    kept = [c for c in g.vertices.columns if c != name]
    v = g.vertices.select(*[F.col(quote(c)) for c in kept]).join(ranks, "id").select(*[F.col(quote(c)) for c in kept], F.col(name))
    return type(g)(v, edge_weights(g))


def page_rank(g, reset_probability: float = 0.15, source_id=None, max_iter: int | None = None, tol: float | None = None, initial_ranks: DataFrame | None = None):
    """A graph whose vertices have `pagerank` and whose edges have `weight`.

    Ranks add up to the number of vertices, or to 1 when personalised by source_id. Exactly one of max_iter (rounds of the power
    iteration) and tol (changes above it are passed on until there are none). initial_ranks (id, pagerank): start of a fixed run.
    """
    if (max_iter is None) == (tol is None):
        raise ValueError("exactly one of max_iter and tol is needed")
    if source_id is not None:
        check_vertices(g, [source_id])
    rounds = Rounds(g.vertices.sparkSession, "pagerank")
    ids = g.vertices.select("id").distinct()
    if tol is None:
        ranks = fixed(ids, rounds.cache(weighted(g).repartition("src")), rounds, reset_probability, source_id, max_iter, initial_ranks)
    else:
        ranks = converged(ids, weighted(g), rounds, reset_probability, source_id, tol)
    total, n = ranks.agg(F.sum("rank"), F.count("*")).first()
    scale = (1.0 if source_id is not None else n) / total if total else 0.0
    return with_ranks(g, rounds.close(ranks.select("id", (F.col("rank") * scale).alias("pagerank"))), "pagerank")


def fixed(ids: DataFrame, e: DataFrame, rounds: Rounds, p: float, source, max_iter: int, initial: DataFrame | None) -> DataFrame:
    home = F.lit(1.0) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    # teleports join the contributions as rows, so a round is one join and one aggregation
    base = rounds.cut(ids.select("id", (p * home).alias("rank")), "-base")
    ranks = ids.select("id", home.alias("rank")) if initial is None else ids.join(initial.select("id", F.col("pagerank").cast("double").alias("rank")), "id")
    if initial is not None and ranks.count() != ids.count():
        raise ValueError("initial ranks are needed for every vertex")
    for k in range(max_iter):
        sent = e.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), ((1 - p) * F.col("rank") * F.col("w")).alias("rank"))
        ranks = base.unionAll(sent).groupBy("id").agg(F.sum("rank").alias("rank"))
        if (k + 1) % UNROLLED == 0:
            ranks = rounds.cut(ranks)
    return rounds.cut(ranks)


def converged(ids: DataFrame, e: DataFrame, rounds: Rounds, p: float, source, tol: float) -> DataFrame:
    first = F.lit(p) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    state = rounds.cut(ids.select("id", first.alias("rank"), first.alias("delta")))
    # a row from each vertex to itself carries its rank along with what edges carry, so a round is one join and one aggregation,
    # and the plan of several grows by as many; rounds after the last change nothing
    edges = rounds.write(e.select("src", "dst", "w", F.lit(False).alias("own")).unionAll(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("own"))), "-edges")
    n = fitting(edges.sparkSession, edges.count(), ROWS)
    rounds.made.remove(kept := rounds.made[-1])  # the edges outlive the states
    with shuffled_to(edges.sparkSession, n):
        edges = rounds.cache(edges.repartition(n, "src").sortWithinPartitions("src"))
        live, left, got = F.col("own") | (F.col("delta") > tol), state.withColumnRenamed("id", "src"), (1 - p) * F.col("delta") * F.col("w")
        key, sums = F.col("dst").alias("src"), [F.sum(F.when(F.col("own"), F.col("rank")).otherwise(got)).alias("rank"), F.sum(F.when(F.col("own"), 0.0).otherwise(got)).alias("delta")]
        while not left.where(F.col("delta") > tol).isEmpty():
            for _ in range(TOGETHER):
                left = edges.join(left, "src").where(live).groupBy(key).agg(*sums)
            left = rounds.cut(left)
            rounds.forget(2)
    rounds.made.insert(0, kept)
    return left.select(F.col("src").alias("id"), "rank")


def parallel_personalized(g, reset_probability: float = 0.15, source_ids: list | None = None, max_iter: int | None = None):
    """A graph whose vertices have `pageranks`, a vector with one slot for each source in the given order; each slot adds up to 1."""
    if not source_ids or max_iter is None:
        raise ValueError("source_ids and max_iter are needed")
    check_vertices(g, source_ids)
    ranks = personalized_rows(g, reset_probability, source_ids, max_iter)
    slots = F.array(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col("rank"))), F.lit(0.0)) for s in source_ids])
    vectors = g.vertices.select("id").distinct().join(ranks, "id", "left").groupBy("id").agg(array_to_vector(slots).alias("pageranks"))
    return with_ranks(g, vectors, "pageranks")


def personalized_rows(g, p: float, sources: list, max_iter: int) -> DataFrame:
    """(id, source, rank): all sources in one loop; only ranks above 0 have rows."""
    rounds = Rounds(g.vertices.sparkSession, "ppr")
    e = rounds.cache(weighted(g).repartition("src"))
    ids = g.vertices.select("id").distinct()
    start = rounds.cut(ids.where(F.col("id").isin(list(sources))).select("id", F.col("id").alias("source"), F.lit(1.0).alias("rank")), "-start")
    ranks = start
    for k in range(max_iter):
        sent = e.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "source", ((1 - p) * F.col("rank") * F.col("w")).alias("rank"))
        ranks = start.withColumn("rank", F.lit(p)).unionAll(sent).groupBy("id", "source").agg(F.sum("rank").alias("rank"))
        if (k + 1) % UNROLLED == 0:
            ranks = rounds.cut(ranks)
    ranks = rounds.cut(ranks)
    totals = ranks.groupBy("source").agg(F.sum("rank").alias("total"))
    return rounds.close(ranks.join(totals, "source").select("id", "source", (F.col("rank") / F.col("total")).alias("rank")))
