"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected simple edges: self-loops and nulls dropped, u < v, distinct."""
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.col("src").alias("s"), F.col("dst").alias("d"))
    return e.where("s is not null and d is not null and u <> v").select("u", "v").distinct()


def large_star(e: DataFrame) -> DataFrame:
    """Hang every larger neighbour of x under the smallest vertex of x's closed neighbourhood."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v").distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Hang x and its smaller neighbours under the smallest of them."""
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    inner = e.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v")
    return inner.unionAll(least.select(F.col("m").alias("u"), "v")).distinct()


class NotConverged(RuntimeError):
    """A bound on the number of rounds was reached first; there is no partial result."""


def star_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """(id, component) of every vertex that occurs in a proper edge; component is the smallest id.

    `cut` materialises a round's edges and ends their lineage. Rows shrink towards one a vertex, and both
    steps are joins on aggregated keys, so a hub costs one aggregate and an AQE-split join. Rounds go on until nothing
    changes; with max_rounds, NotConverged is raised if that isn't enough.
    """
    e = cut(canonical(edges), "cc-0")
    if e.isEmpty():
        return e.select(F.col("v").alias("id"), F.col("u").alias("component"))
    before = None
    for k in itertools.count():
        if k == max_rounds:
            raise NotConverged(f"no end after {max_rounds} rounds")
        e = cut(small_star(large_star(e)), f"cc-{k + 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("id")).distinct()
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))


def contraction_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], seed: int = 42, max_rounds: int | None = None) -> DataFrame:
    """(id, component) by randomised contraction: each round a vertex joins the member of its closed neighbourhood
    with the smallest hash, edges are contracted, and the representatives are composed at the end. component is the smallest id. Rounds go on until no edge is left;
    with max_rounds, NotConverged is raised if that isn't enough."""
    e = cut(canonical(edges), "rc-0")
    steps = []
    for k in itertools.count():
        if e.isEmpty():
            break
        if k == max_rounds:
            raise NotConverged(f"no end after {max_rounds} rounds")
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        closed = both.unionAll(both.select("x", F.col("x").alias("y")))
        order = F.struct(F.xxhash64("y", F.lit(seed + k)).alias("h"), F.col("y").alias("y"))
        rep = cut(closed.groupBy("x").agg(F.min(order).alias("m")).select("x", F.col("m.y").alias("r")), f"rc-rep-{k}")
        steps.append(rep)
        a = e.join(rep.select(F.col("x").alias("u"), F.col("r").alias("ru")), "u").join(rep.select(F.col("x").alias("v"), F.col("r").alias("rv")), "v")
        e = cut(a.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), f"rc-{k + 1}")
    if not steps:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    label = steps[0].select(F.col("x").alias("id"), F.col("r").alias("c"))
    for k, rep in enumerate(steps[1:]):
        label = label.join(rep.select(F.col("x").alias("c"), "r"), "c", "left").select("id", F.coalesce("r", "c").alias("c"))
        if k % 8 == 7:
            label = cut(label, f"rc-labels-{k}")  # a plan of bounded size
    label = cut(label, "rc-labels")
    least = label.groupBy("c").agg(F.min("id").alias("component"))
    return label.join(least, "c").select("id", "component")


def propagated_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], max_iter: int | None = None) -> DataFrame:
    """(id, component) by passing on the smallest id; as many rounds as the longest shortest path, unless max_iter ends it."""
    e = cut(canonical(edges), "mp-0")
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    state = cut(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("component")), "mp-1")
    changed, k = state, 1
    while not changed.isEmpty() and (max_iter is None or k < max_iter):
        news = both.join(changed.select(F.col("id").alias("x"), "component"), "x").groupBy(F.col("y").alias("id")).agg(F.min("component").alias("m"))
        state = cut(state.select("id", "component").join(news, "id", "left").select("id", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved")), f"mp-{k + 1}")
        changed = state.where("moved").select("id", "component")
        k += 1
    return state.select("id", "component")


def strong_components(vertices: DataFrame, edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], collector: Callable, max_iter: int) -> DataFrame:
    """(id, component): component is the smallest id of the strongly connected component. Rounds of trimming vertices with no edge in or none out,
    colouring forwards by the smallest id, and confirming backwards from each colour's root; after max_iter rounds what is left is its own component."""
    live = cut(vertices.select("id").distinct(), "scc-v")
    e = edges.select("src", "dst").where("src <> dst").distinct()
    ends = live.select("id")
    e = cut(e.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "scc-e")
    done = []
    for k in range(max_iter):
        n = None
        while True:  # trim
            kept = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), f"scc-t{k}")
            now, before = kept.count(), e.count() if n is None else n
            e = kept
            if now == before:
                break
            n = now
        inner = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()
        done.append(live.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
        live = cut(inner, f"scc-live{k}")
        if live.isEmpty():
            break
        color = live.select("id", F.col("id").alias("color"))
        moved = color
        while True:
            news = e.join(moved.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("m"))
            color = cut(color.select("id", "color").join(news, "id", "left").select("id", F.least("color", "m").alias("color"), F.coalesce(F.col("m") < F.col("color"), F.lit(False)).alias("moved")), f"scc-c{k}")
            moved = color.where("moved").select("id", "color")
            if moved.isEmpty():
                break
        color = color.select("id", "color")
        tinted = cut(e.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("color")), f"scc-in{k}")
        found = collector(f"scc-r{k}")
        front = found.add(color.where("id = color"))
        while not front.isEmpty():
            back = tinted.join(front.select(F.col("id").alias("dst"), "color"), ["dst", "color"]).select(F.col("src").alias("id"), "color").distinct()
            front = found.add(back.join(found.all(), ["id", "color"], "left_anti"))
        sure = cut(found.all(), f"scc-s{k}")
        found.remove()
        done.append(sure.select("id", F.col("color").alias("component")))
        live = cut(live.join(sure, "id", "left_anti"), f"scc-v{k}")
        e = cut(e.join(sure.select(F.col("id").alias("src")), "src", "left_anti").join(sure.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), f"scc-e{k}")
        if live.isEmpty():
            break
    done.append(live.select("id", F.col("id").alias("component")))
    every = done[0]
    for part in done[1:]:
        every = every.unionAll(part)
    return every.groupBy("id").agg(F.min("component").alias("component"))
