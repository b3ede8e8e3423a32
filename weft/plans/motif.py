"""Motifs to join plans. Nothing runs before an action; every named element is one struct column."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.functions.columns import nest
from weft.plans.hops import two_hops
from weft.plans.motif_parser import Edge, VarLength, Vertex, names_in_order, only_negated, parse

TAGS = ("_pattern", "_direction")


def at(element: str, field: str) -> Column:
    return F.col(f"`{element}`").getField(field)


def connected_order(terms: list[Vertex | Edge]) -> list[Vertex | Edge]:
    """The terms in an order that joins rather than multiplies: of each run of terms without negation, those that touch what is bound
    come first, in the given order otherwise. A negated term keeps its place, as it drops duplicates there; so do undirected ones,
    which tag the rows."""
    out: list[Vertex | Edge] = []
    bound: set[str] = set()
    names = lambda t: {t.name} if isinstance(t, Vertex) else {t.src, t.dst} - {""}
    fixed = lambda t: isinstance(t, Edge) and (t.negated or not t.directed)
    rest = list(terms)
    while rest:
        run = list(itertools.takewhile(lambda t: not fixed(t), rest))
        rest = rest[len(run) :]
        while run:
            # an edge before a lone vertex: it may bind that too
            k = next((i for i, t in enumerate(run) if names(t) & bound), next((i for i, t in enumerate(run) if isinstance(t, Edge)), 0))
            bound |= names(run[k])
            out.append(run.pop(k))
        if rest:
            bound |= names(rest[0])
            out.append(rest.pop(0))
    return out


class Planner:
    """Folds terms, in their connected order, into one DataFrame."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, assume_valid: bool):
        self.v, self.e = vertices, edges
        # with no attributes to fetch and no dangling edges to drop, a vertex is its id in the edge
        self.skip_vertices = assume_valid and vertices.columns == ["id"]
        self.helpers = 0

    def find(self, terms: list[Vertex | Edge]) -> DataFrame:
        if not terms:
            return self.v.sparkSession.createDataFrame([], StructType([]))
        terms = [Vertex(n) for n in only_negated(terms)] + terms
        df, bound = None, set()
        for t in connected_order(terms):
            df, bound = self.step(df, bound, t)
        names = names_in_order(terms)
        tags = [c for c in TAGS if c in df.columns]
        done = df.select(*[F.col(f"`{n}`") for n in names], *tags) if names else df
        return done.orderBy("_direction") if tags else done

    def step(self, df: DataFrame | None, bound: set[str], t: Vertex | Edge) -> tuple[DataFrame, set[str]]:
        if isinstance(t, Vertex):
            if t.name in bound:
                return df, bound
            lone = nest(self.v, t.name)
            return (lone if df is None else df.crossJoin(lone)), bound | {t.name}
        if t.negated:
            return self.without(df, t), bound
        if t.directed:
            return self.edge(df, bound, t.name, t.src, t.dst)
        edge = f"[{t.name}]"
        both = []
        for text, way, s, d in ((f"({t.src})-{edge}->({t.dst})", "out", t.src, t.dst), (f"({t.src})<-{edge}-({t.dst})", "in", t.dst, t.src)):
            one, now = self.edge(df, bound, t.name, s, d)
            both.append(one.withColumns({"_pattern": F.lit(text), "_direction": F.lit(way)}))
        return both[0].unionByName(both[1], allowMissingColumns=True), now

    def edge(self, df: DataFrame | None, bound: set[str], name: str, src: str, dst: str) -> tuple[DataFrame, set[str]]:
        self.helpers += 1
        col = name or f"__e{self.helpers}"
        e = nest(self.e, col)
        on = [at(end, "id") == at(col, side) for end, side in ((src, "src"), (dst, "dst")) if end and end in bound]
        if df is None:
            df = e
        elif on:
            df = df.join(e, reduce(lambda a, b: a & b, on))
        else:
            df = df.crossJoin(e)
        for end, side in ((src, "src"), (dst, "dst")):
            if not end or end in bound:
                continue
            same = src == dst
            if self.skip_vertices:
                df = df.where(at(col, "src") == at(col, "dst")) if same else df
                df = df.withColumn(end, F.struct(at(col, side).alias("id")))
            else:
                cond = at(col, side) == at(end, "id")
                df = df.join(nest(self.v, end), cond & (at(col, "dst") == at(end, "id")) if same else cond)
            bound = bound | {end}
        return (df if name else df.drop(col)), bound

    def without(self, df: DataFrame, t: Edge) -> DataFrame:
        """Set difference: matches with such an edge are dropped, and duplicates collapse."""
        for s, d in [(t.src, t.dst)] + ([] if t.directed else [(t.dst, t.src)]):
            ends = self.e.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
            on = [at(end, "id") == F.col(c) for end, c in ((s, "__s"), (d, "__d")) if end]
            df = df.join(ends, reduce(lambda a, b: a & b, on), "left_anti")
        return df.distinct()


def hop_pair(terms) -> tuple[str, str] | None:
    """The ends of a motif of two unnamed edges in a row, over three vertices."""
    if isinstance(terms, VarLength) or len(terms) != 2 or not all(isinstance(t, Edge) and t.directed and not t.negated and not t.name and t.src and t.dst for t in terms):
        return None
    for x, y in (terms, terms[::-1]):
        if x.dst == y.src and len({x.src, x.dst, y.dst}) == 3:
            return x.src, y.dst
    return None


def counts(vertices: DataFrame, edges: DataFrame, pattern: str, by: list[str], assume_valid: bool = False) -> DataFrame:
    """(by..., n): how many matches of a motif have these vertices, by their ids. Two hops counted by both ends send lists instead of matches."""
    terms = parse(pattern)
    ends = hop_pair(terms)
    if not ends or set(ends) != set(by):
        found = find(vertices, edges, pattern, assume_valid)
        return found.groupBy(*[at(b, "id").alias(b) for b in by]).agg(F.count("*").alias("n"))
    e = edges.select("src", "dst")
    if not assume_valid:
        e = e.join(vertices.select(F.col("id").alias("dst")), "dst")  # a repeated vertex makes as many matches
    left = e if assume_valid else e.join(vertices.select(F.col("id").alias("src")), "src")
    pairs = two_hops(left, e).select(F.col("a").alias(ends[0]), F.col("c").alias(ends[1]), "n")
    return pairs.groupBy(*by).agg(F.sum("n").alias("n"))


def find(vertices: DataFrame, edges: DataFrame, pattern: str, assume_valid: bool = False) -> DataFrame:
    """All matches of a motif, one row each.

    assume_valid: every edge's ends are known to be vertices; saves the joins with vertices that have no attributes.
    """
    parsed = parse(pattern)
    planner = Planner(vertices, edges, assume_valid)
    if not isinstance(parsed, VarLength):
        return planner.find(parsed)
    p, parts = parsed, []
    for way in ("out",) if p.directed else ("out", "in"):
        for k in range(p.most, p.least - 1, -1):
            arrow = f"({p.src})-[{p.name}*{k}]->({p.dst})" if way == "out" else f"({p.src})<-[{p.name}*{k}]-({p.dst})"
            one = planner.find(parse(arrow))
            parts.append(one.withColumns({"_hop": F.lit(k), "_pattern": F.lit(arrow), "_direction": F.lit(way)}))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.orderBy("_hop", "_direction")
