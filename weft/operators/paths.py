"""Paths: breadth-first search, distances to landmarks, hop-wise accumulation, cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.errors import NoSuchVertex
from weft.functions.columns import expression, nest, quote
from weft.plans.iterate import Rounds


def bfs(g, from_expr, to_expr, edge_filter=None, max_path_length: int = 10) -> DataFrame:
    """All shortest paths from vertices that match from_expr to ones that match to_expr.

    Columns from, e0, v1, e1, ..., to; only from and to where a vertex matches both (length 0), and no rows where there
    is no path within max_path_length. A first pass finds each vertex's hop level with a frontier free of
    duplicates; paths are then put together through edges from level to level only, so nothing is extended that isn't a
    shortest path.
    """
    if from_expr is None or to_expr is None:
        raise ValueError("bfs needs both ends")
    v, e = g.vertices, g.edges.where(expression(edge_filter)) if edge_filter is not None else g.edges
    starts, ends = v.where(expression(from_expr)), v.where(expression(to_expr))
    both = v.where(expression(from_expr) & expression(to_expr))
    if not both.isEmpty():
        return both.select(F.struct(*[F.col(quote(c)) for c in v.columns]).alias("from"), F.struct(*[F.col(quote(c)) for c in v.columns]).alias("to"))
    none = nest(v, "from").crossJoin(nest(v, "to")).where(F.lit(False))
    rounds = Rounds(v.sparkSession, "bfs")
    goal = ends.select("id").distinct()
    steps = rounds.cache(e.select("src", "dst").where("src <> dst").join(v.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").distinct().repartition("src"))
    seen = rounds.collector("seen")
    level = seen.add(starts.select("id").distinct())
    levels, found = [level], None
    for _ in range(max_path_length):
        following = steps.join(level.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        level = seen.add(following.join(seen.all(), "id", "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        found = level.join(goal, "id", "left_semi")
        if not found.isEmpty():
            break
        found = None
    if found is None:
        rounds.close(none.limit(0), 0)
        seen.remove()
        return none
    # backwards, keep of each level only what leads to the goal
    wanted = [found]
    for k in range(len(levels) - 2, -1, -1):
        into = steps.join(wanted[0].withColumnRenamed("id", "dst"), "dst", "left_semi")
        wanted.insert(0, rounds.cut(levels[k].join(into.select(F.col("src").alias("id")), "id", "left_semi")))
    last = len(levels) - 1
    vertex = lambda k, name: nest(v.join(wanted[k], "id", "left_semi").select(*[F.col(quote(c)) for c in v.columns]), name)
    paths = vertex(0, "from")
    for k in range(last):
        name, before = ("to" if k + 1 == last else f"v{k + 1}"), ("from" if k == 0 else f"v{k}")
        paths = paths.join(nest(e, f"e{k}"), F.col(before)["id"] == F.col(f"e{k}")["src"])
        paths = paths.join(vertex(k + 1, name), F.col(f"e{k}")["dst"] == F.col(name)["id"])
    done = rounds.close(paths)
    seen.remove()
    return done


def distance_rows(g, landmarks: list, directed: bool = True) -> DataFrame:
    """(id, landmark, distance) for every vertex and each landmark that it reaches. The frontier alone is joined in each round."""
    v = g.vertices
    spark = v.sparkSession
    given = spark.createDataFrame([(x,) for x in dict.fromkeys(landmarks)], f"id {dict(v.dtypes)['id']}")
    rounds = Rounds(spark, "distance")
    done = rounds.collector("known")
    frontier = done.add(v.select("id").distinct().join(given, "id", "left_semi").select("id", F.col("id").alias("landmark"), F.lit(0).alias("distance")))
    # messages go against the edges: a distance is from the vertex to the landmark
    back = g.edges.select(F.col("dst").alias("at"), F.col("src").alias("id"))
    if not directed:
        back = back.unionAll(back.select(F.col("id").alias("at"), F.col("at").alias("id")))
    back = rounds.cache(back.where("at <> id").distinct().repartition("at"))
    k = 0
    while not frontier.isEmpty():
        k += 1
        following = back.join(frontier.select(F.col("id").alias("at"), "landmark"), "at").select("id", "landmark").distinct()
        frontier = done.add(following.join(done.all(), ["id", "landmark"], "left_anti").withColumn("distance", F.lit(k)))
    known = rounds.close(done.all().join(v.select("id").distinct(), "id", "left_semi"))
    done.remove()
    return known


def shortest_paths(g, landmarks: list, is_directed: bool = True) -> DataFrame:
    """The vertices with `distances`, a map from each landmark that can be reached to the number of edges."""
    rows = distance_rows(g, landmarks, is_directed)
    kinds = dict(g.vertices.dtypes)["id"]
    maps = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("landmark", "distance"))).alias("distances"))
    empty = F.expr(f"cast(map() as map<{kinds}, int>)")
    return g.vertices.join(maps, "id", "left").select(*[F.col(quote(c)) for c in g.vertices.columns], F.coalesce("distances", empty).alias("distances"))


def check_vertices(g, ids: list) -> None:
    known = {r.id for r in g.vertices.where(F.col("id").isin(list(ids))).select("id").distinct().collect()}  # as many as were given
    if missing := [x for x in ids if x not in known]:
        raise NoSuchVertex(f"not a vertex: {missing[0]!r}")


def aggregate_neighbors(g, starting_vertices, accumulator_names: list[str], accumulator_inits: list, accumulator_updates: list, max_hops: int = 3, stopping_condition=None, target_condition=None, required_vertex_attributes: list[str] | None = None, required_edge_attributes: list[str] | None = None, edge_filter=None, remove_loops: bool = False) -> DataFrame:
    """Expand paths hop by hop with accumulators; returns accumulators, id and hop of the collected paths.

    Updates and conditions are expressions over the accumulators, src_attributes, dst_attributes, edge_attributes, src_id, dst_id and
    hop; all see the accumulators as they were before the hop. A path ends where the stopping or the target condition holds;
    collected are target paths where there is a target condition, else all ended ones. Paths alive after max_hops are dropped.
    """
    if stopping_condition is None and target_condition is None:
        raise ValueError("a stopping or a target condition is needed")
    if max_hops < 1:
        raise ValueError("max_hops must be positive")
    if not (len(accumulator_names) == len(accumulator_inits) == len(accumulator_updates)) or not accumulator_names:
        raise ValueError("accumulators need a name, an initial value and an update each")
    if bad := {"id", "hop", "src_id", "dst_id"} & set(accumulator_names):
        raise ValueError(f"not a name for an accumulator: {min(bad)}")
    v, e = g.vertices, g.edges if edge_filter is None else g.edges.where(expression(edge_filter))
    if remove_loops:
        e = e.where("src <> dst")
    v_cols = ["id", *[c for c in (required_vertex_attributes if required_vertex_attributes is not None else v.columns) if c != "id"]]
    e_cols = ["src", "dst", *[c for c in (required_edge_attributes if required_edge_attributes is not None else e.columns) if c not in ("src", "dst")]]
    attributes = v.select(F.struct(*[F.col(quote(c)) for c in v_cols]).alias("a"), F.col("id").alias("__id"))
    steps = e.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.struct(*[F.col(quote(c)) for c in e_cols]).alias("edge_attributes"))
    steps = steps.join(attributes.select(F.col("a").alias("dst_attributes"), F.col("__id").alias("dst_id")), "dst_id", "left")
    rounds = Rounds(v.sparkSession, "neighbors")
    steps = rounds.cache(steps.repartition("src_id"))
    first = v.where(expression(starting_vertices))
    frontier = first.select(F.struct(*[F.col(quote(c)) for c in v_cols]).alias("src_attributes"), F.col("id").alias("src_id"), *[expression(i).alias(n) for n, i in zip(accumulator_names, accumulator_inits)])
    frontier, parts = rounds.cut(frontier), []
    stop = expression(stopping_condition) if stopping_condition is not None else F.lit(False)
    target = expression(target_condition) if target_condition is not None else None
    for k in range(1, max_hops + 1):
        moved = frontier.join(steps, "src_id").withColumn("hop", F.lit(k))
        ended = F.coalesce(stop, F.lit(False)) | (F.coalesce(target, F.lit(False)) if target is not None else F.lit(False))
        taken = F.coalesce(target, F.lit(False)) if target is not None else ended
        moved = moved.select(*[expression(u).alias(n) for n, u in zip(accumulator_names, accumulator_updates)], F.col("dst_id").alias("id"), "hop", F.col("dst_attributes").alias("src_attributes"), ended.alias("__ended"), taken.alias("__taken"))
        moved = rounds.cut(moved)
        parts.append(moved.where("__taken").select(*[F.col(quote(n)) for n in accumulator_names], "id", "hop"))
        frontier = moved.where("not __ended").select("src_attributes", F.col("id").alias("src_id"), *[F.col(quote(n)) for n in accumulator_names])
        if frontier.isEmpty():
            break
    return rounds.close(reduce(DataFrame.unionAll, parts))


def src_attr(name: str) -> Column:
    return F.col("src_attributes")[name]


def dst_attr(name: str) -> Column:
    return F.col("dst_attributes")[name]


def edge_attr(name: str) -> Column:
    return F.col("edge_attributes")[name]


def detect_cycles(g, max_length: int | None = None) -> DataFrame:
    """found_cycles: each simple directed cycle once, from its smallest id and back to it, e.g. [1, 2, 3, 1].

    Paths start at every vertex and never go to smaller ids than their start. They grow until none is left, or up to max_length edges.
    Vertices that can't be on a cycle (no edge in or none out, repeatedly) are trimmed first.
    """
    rounds = Rounds(g.vertices.sparkSession, "cycles")
    e = rounds.cut(g.edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = e.count()
    while n:
        e = rounds.cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = e.count()
        if now == n:
            break
        n = now
    steps = rounds.cache(e.repartition("src"))
    paths = rounds.cut(steps.where("dst >= src").select(F.col("src").alias("first"), F.array("src").alias("path"), F.col("dst").alias("next")))
    found, k = rounds.collector("found"), 1
    while True:
        found.add(paths.where("next = first").select(F.array_append("path", F.col("next")).alias("found_cycles")))
        if max_length is not None and k >= max_length:
            break
        grown = paths.where("next > first and not array_contains(path, next)").select("first", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("src"))
        paths = rounds.cut(grown.join(steps, "src").where("dst >= first").select("first", "path", F.col("dst").alias("next")))
        k += 1
        if paths.isEmpty():
            break
    done = rounds.close(found.all())
    found.remove()
    return done
