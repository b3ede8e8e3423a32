"""Typed property graphs: named groups of vertices and edges, each a DataFrame with its own schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from weft.errors import InvalidPropertyGroup
from weft.functions.columns import expression, quote
from weft.graph import Graph
from weft.plans.hops import lists, partitions


HUB = 4096  # rows of a block


class VertexGroup:
    """Rows with a primary key. Internal ids are the group's name and the SHA-256 of the key as text, or the plain text."""

    def __init__(self, name: str, data: DataFrame, primary_key_column: str = "id", apply_mask_on_id: bool = True):
        if primary_key_column not in data.columns:
            raise InvalidPropertyGroup(f"vertex group {name!r} has no column {primary_key_column!r}")
        self.name, self.data, self.key, self.masked = name, data, primary_key_column, apply_mask_on_id

    def internal_id(self, column: str) -> Column:
        text = F.col(quote(column)).cast("string")
        return F.concat(F.lit(self.name), F.sha2(text, 256)) if self.masked else text

    def vertices(self, condition=None) -> DataFrame:
        rows = self.data if condition is None else self.data.where(expression(condition))
        return rows.select(self.internal_id(self.key).alias("id"), F.lit(self.name).alias("property_group"))

    def id_mapping(self) -> DataFrame:
        return self.data.select(self.internal_id(self.key).alias("id"), F.col(quote(self.key)).cast("string").alias("external_id"))


class EdgeGroup:
    """Rows that link two vertex groups by their keys. weight: a numeric column's name, an expression, or None for 1.0."""

    def __init__(self, name: str, data: DataFrame, src_group: VertexGroup, dst_group: VertexGroup, is_directed: bool = True, src_column: str = "src", dst_column: str = "dst", weight: str | Column | None = None):
        if missing := [c for c in (src_column, dst_column) if c not in data.columns]:
            raise InvalidPropertyGroup(f"edge group {name!r} has no column {missing[0]!r}")
        self.name, self.data, self.src_group, self.dst_group, self.is_directed = name, data, src_group, dst_group, is_directed
        self.src_column, self.dst_column = src_column, dst_column
        if isinstance(weight, str):
            if weight not in data.columns:
                raise InvalidPropertyGroup(f"edge group {name!r} has no column {weight!r}")
            weight = F.col(quote(weight))
        self.weight = F.lit(1.0) if weight is None else weight
        if not isinstance(data.select(self.weight.alias("w")).schema[0].dataType, NumericType):
            raise InvalidPropertyGroup(f"the weight of edge group {name!r} is not numeric")

    def edges(self, condition=None) -> DataFrame:
        rows = self.data if condition is None else self.data.where(expression(condition))
        one = rows.select(self.src_group.internal_id(self.src_column).alias("src"), self.dst_group.internal_id(self.dst_column).alias("dst"), self.weight.cast("double").alias("weight"))
        return one if self.is_directed else one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


class PropertyGraph:
    def __init__(self, vertex_groups: list[VertexGroup], edge_groups: list[EdgeGroup]):
        self.vertex_groups = {g.name: g for g in vertex_groups}
        self.edge_groups = {g.name: g for g in edge_groups}
        if len(self.vertex_groups) != len(vertex_groups) or len(self.edge_groups) != len(edge_groups):
            raise InvalidPropertyGroup("group names repeat")

    def _known(self, groups: dict, names) -> list:
        if missing := [n for n in names if n not in groups]:
            raise InvalidPropertyGroup(f"unknown property group {missing[0]!r}")
        return [groups[n] for n in names]

    def to_graph(self, vertex_groups: list[str], edge_groups: list[str], edge_filters: dict | None = None, vertex_filters: dict | None = None) -> Graph:
        """The chosen groups as one graph: vertices (id, property_group), edges (src, dst, weight). Filters apply to the groups' own rows."""
        vf, ef = vertex_filters or {}, edge_filters or {}
        v = [g.vertices(vf.get(g.name)) for g in self._known(self.vertex_groups, vertex_groups)]
        e = [g.edges(ef.get(g.name)) for g in self._known(self.edge_groups, edge_groups)]
        if not v or not e:
            raise InvalidPropertyGroup("at least one group of vertices and one of edges are needed")
        return Graph(reduce(DataFrame.unionAll, v), reduce(DataFrame.unionAll, e))

    def projection_by(self, left: str, right: str, edge_group: str, new_edge_weight=None) -> PropertyGraph:
        """Pairs of left vertices with a common right one, a row for each that they share, as undirected edges `projected_<name>`;
        the right group and the old edges go. new_edge_weight: function of both weights; else 1.0."""
        a, b = self._known(self.vertex_groups, [left, right])
        (group,) = self._known(self.edge_groups, [edge_group])
        if (group.src_group.name, group.dst_group.name) != (left, right):
            raise InvalidPropertyGroup(f"edge group {edge_group!r} doesn't go from {left!r} to {right!r}")
        rows = group.data.select(F.col(quote(group.src_column)).alias("s"), F.col(quote(group.dst_column)).alias("via"), group.weight.alias("w")).where("via is not null")
        # a right vertex of d left ones makes about d * d / 2 pairs. A left vertex gets the lists of those that come after it, so that pairs
        # are made where they can be counted by src without a shuffle; of a hub's list, each block meets all
        weighted = new_edge_weight is not None
        some = lists(rows.where("s is not null"), "via", F.struct("s", "w") if weighted else F.col("s"), most=HUB).select("via", "block", F.array_sort("l").alias("l"))
        meet = some.join(some.select("via", F.col("block").alias("other"), F.col("l").alias("l2")), "via").select("block", "other", "l2", F.posexplode("l").alias("k", "one"))
        rest = F.when(F.col("block") == F.col("other"), F.expr("slice(l2, k + 2, size(l2))")).otherwise(F.col("l2"))
        sent = meet.select((F.col("one.s") if weighted else F.col("one")).alias("src"), *([F.col("one.w").alias("w1")] if weighted else []), rest.alias("rest")).where(F.size("rest") > 0)
        pairs = sent.repartition(partitions(group.data), "src").select("src", *(["w1"] if weighted else []), F.explode("rest").alias("two"))
        pairs = pairs.withColumns({"dst": F.col("two.s"), "w2": F.col("two.w")}) if weighted else pairs.withColumnRenamed("two", "dst")
        pairs = pairs.where("src < dst").select("src", "dst", (new_edge_weight(F.col("w1"), F.col("w2")) if weighted else F.lit(1.0)).alias("weight"))
        kept_v = [g for g in self.vertex_groups.values() if g.name != right]
        kept_e = [g for g in self.edge_groups.values() if g.name != edge_group and right not in (g.src_group.name, g.dst_group.name)]
        return PropertyGraph(kept_v, [*kept_e, EdgeGroup(f"projected_{edge_group}", pairs, a, a, False, weight="weight")])

    def join_vertices(self, result: DataFrame, groups: list[str]) -> DataFrame:
        """An algorithm's result with external_id and property_group, for the rows of the chosen groups."""
        rest = result.drop("property_group", "external_id")
        parts = [rest.join(g.id_mapping(), "id").withColumn("property_group", F.lit(g.name)) for g in self._known(self.vertex_groups, groups)]
        return reduce(DataFrame.unionByName, parts)
