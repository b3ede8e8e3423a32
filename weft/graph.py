"""The graph: a DataFrame of vertices (id, ...) and one of edges (src, dst, ...)."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from weft.errors import InvalidGraph
from weft.functions.columns import draw, expression, nest, quote
from weft.operators import communities, components, factorization, messages, paths, ranking, walks
from weft.operators.pregel import Pregel
from weft.plans import motif
from weft.plans.iterate import Rounds, setting, tuned

INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def long_ids(ids: DataFrame) -> DataFrame:
    """(id, new_id): integral ids themselves; others get a dense number by their order, the same in each run.

    The order is by range partitions with an offset each, not by one task over all ids.
    """
    kind = dict(ids.dtypes)["id"]
    if kind in INTEGRAL:
        return ids.select("id", F.col("id").cast("long").alias("new_id")).distinct()
    rounds = Rounds(ids.sparkSession, "index")
    ranged = ids.where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    ranged = rounds.cut(ranged.select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")))
    offsets, before = [], 0
    for r in ranged.groupBy("p").count().orderBy("p").collect():  # one row a partition
        offsets += [F.lit(r.p), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*offsets), F.col("p")) if offsets else F.lit(0)
    return ranged.select("id", (F.col("k") + start).cast("long").alias("new_id"))


ALGORITHMS = ("two_phase", "randomized_contraction", "propagation")


def engine(name: str | None) -> None:
    """The name of an engine, as older callers give it: one implementation stands for all."""
    if name:
        warnings.warn(f"algorithm {name!r} has no effect: there is one implementation", stacklevel=3)


def renamed(given: dict, options: dict, **names: str) -> dict:
    """The options, with those that were given by an older name; other names are errors."""
    for old, value in given.items():
        if old not in names:
            raise TypeError(f"unexpected argument {old!r}")
        options[names[old]] = value
    return options


class Graph:
    """An immutable directed multigraph. Methods are lazy unless they iterate; those materialise their result."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, ends_known: bool = False):
        """ends_known: all ends of edges are known to be vertices, each once; motifs over bare ids then need no joins with them."""
        if "id" not in vertices.columns:
            raise InvalidGraph(f"vertices have no column id: {vertices.columns}")
        if missing := [c for c in ("src", "dst") if c not in edges.columns]:
            raise InvalidGraph(f"edges have no column {missing[0]}: {edges.columns}")
        self._vertices, self._edges, self._ends_known = vertices, edges, ends_known

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        """Vertices are the distinct ends of the edges; edges without one of them have no place in a graph."""
        return cls(edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct().where("id is not null"), edges.where("src is not null and dst is not null"), True)

    # ---- structure

    @property
    def vertices(self) -> DataFrame:
        return self._vertices

    nodes = vertices

    @property
    def edges(self) -> DataFrame:
        return self._edges

    vertex_columns = vertexColumns = property(lambda self: self._vertices.columns)
    edge_columns = edgeColumns = property(lambda self: self._edges.columns)
    vertex_column_map = vertexColumnMap = property(lambda self: {c: i for i, c in enumerate(self._vertices.columns)})
    edge_column_map = edgeColumnMap = property(lambda self: {c: i for i, c in enumerate(self._edges.columns)})

    @property
    def triplets(self) -> DataFrame:
        """src, edge and dst as structs; edges without both ends disappear."""
        e = nest(self._edges, "edge")
        e = e.join(nest(self._vertices, "src"), F.col("edge")["src"] == F.col("src")["id"])
        return e.join(nest(self._vertices, "dst"), F.col("edge")["dst"] == F.col("dst")["id"]).select("src", "edge", "dst")

    def filter_vertices(self, condition: Column | str) -> Graph:
        """Vertices that match, and the edges both of whose ends do."""
        v = self._vertices.where(expression(condition))
        ids = v.select("id")
        e = self._edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(v, e.select(*[F.col(quote(c)) for c in self._edges.columns]))

    def filter_edges(self, condition: Column | str) -> Graph:
        return Graph(self._vertices, self._edges.where(expression(condition)))

    def drop_isolated_vertices(self) -> Graph:
        ends = self._edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return Graph(self._vertices.join(ends, "id", "left_semi").select(*[F.col(quote(c)) for c in self._vertices.columns]), self._edges)

    def as_reversed(self) -> Graph:
        swap = {"src": "dst", "dst": "src"}
        return Graph(self._vertices, self._edges.select(*[F.col(swap[c]).alias(c) if c in swap else F.col(quote(c)) for c in self._edges.columns]))

    def as_undirected(self) -> Graph:
        """Every edge and its reverse; self-loops and edges that already go both ways are doubled."""
        return Graph(self._vertices, self._edges.unionAll(self.as_reversed().edges))

    def group_edges(self, *aggregates: Column) -> Graph:
        """Parallel edges merged by aggregates."""
        return Graph(self._vertices, self._edges.groupBy("src", "dst").agg(*aggregates))

    def canonical_edges(self, *aggregates: Column) -> Graph:
        """Edges turned so that src <= dst, then merged; without aggregates, distinct."""
        low = self._edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        return Graph(self._vertices, low.groupBy("src", "dst").agg(*aggregates) if aggregates else low.select("src", "dst").distinct())

    def remove_self_edges(self) -> Graph:
        return self.filter_edges("src <> dst")

    def mask(self, other: Graph) -> Graph:
        """What is also in other, with this graph's attributes."""
        v = self._vertices.join(other.vertices.select("id"), "id", "left_semi").select(*[F.col(quote(c)) for c in self._vertices.columns])
        e = self._edges.join(other.edges.select("src", "dst"), ["src", "dst"], "left_semi").select(*[F.col(quote(c)) for c in self._edges.columns])
        return Graph(v, e)

    def subgraph(self, vertex_condition="true", edge_condition="true") -> Graph:
        return self.filter_vertices(vertex_condition).filter_edges(edge_condition)

    def filter(self, preprocess: Callable[[Graph], Graph], edge_condition="true", vertex_condition="true") -> Graph:
        """What of this graph is left when the conditions, over attributes that `preprocess` adds, are applied to preprocess(self)."""
        return self.mask(preprocess(self).subgraph(vertex_condition, edge_condition))

    def map_vertices(self, **columns: Column | str) -> Graph:
        """Vertices with these attributes, made of their own columns, instead of theirs; the ids stay."""
        if "id" in columns:
            raise ValueError("ids can't be mapped")
        return Graph(self._vertices.select("id", *[expression(x).alias(c) for c, x in columns.items()]), self._edges, self._ends_known)

    def map_edges(self, **columns: Column | str) -> Graph:
        """Edges with these attributes, made of their own columns, instead of theirs; the ends stay."""
        if bad := {"src", "dst"} & set(columns):
            raise ValueError(f"ends can't be mapped: {min(bad)}")
        return Graph(self._vertices, self._edges.select("src", "dst", *[expression(x).alias(c) for c, x in columns.items()]), self._ends_known)

    def map_triplets(self, **columns: Column | str) -> Graph:
        """Edges with these attributes, expressions over the structs src, edge and dst, instead of theirs; edges without both ends disappear."""
        if bad := {"src", "dst"} & set(columns):
            raise ValueError(f"ends can't be mapped: {min(bad)}")
        ends = [F.col("edge")[c].alias(c) for c in ("src", "dst")]
        return Graph(self._vertices, self.triplets.select(*ends, *[expression(x).alias(c) for c, x in columns.items()]), self._ends_known)

    def join_vertices(self, table: DataFrame, how: str = "left") -> Graph:
        """Vertices with the columns of a table keyed by id."""
        return Graph(self._vertices.join(table, "id", how), self._edges)

    def pick_random_vertex(self, seed: int = 42):
        """The id with the smallest hash."""
        row = self._vertices.select("id").orderBy(draw(F.col("id"), seed), "id").first()
        return row.id if row else None

    def partition_by(self, strategy: str, n: int | None = None) -> Graph:
        """Edges repartitioned: edge1d (by src), edge2d (a grid of src and dst), random (by both), canonical (by both, whatever the direction)."""
        n = n or int(self._edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        side = max(1, round(n**0.5))
        cell = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        keys = {"edge1d": [F.col("src")], "edge2d": [cell("src"), cell("dst")], "random": [F.col("src"), F.col("dst")], "canonical": [F.least("src", "dst"), F.greatest("src", "dst")]}
        if strategy not in keys:
            raise ValueError(f"unknown strategy {strategy!r}: {', '.join(keys)}")
        return Graph(self._vertices, self._edges.repartition(n, *keys[strategy]))

    def validate(self, check_vertices: bool = True) -> None:
        """Raises InvalidGraph for repeated ids and for edges whose ends aren't vertices."""
        total, distinct = self._vertices.agg(F.count("id"), F.count_distinct("id")).first()
        if total != distinct:
            raise InvalidGraph(f"{total - distinct} vertex ids are repeated")
        if check_vertices:
            ends = self._edges.select(F.explode(F.array("src", "dst")).alias("id"))
            lost = ends.join(self._vertices.select("id"), "id", "left_anti").select(F.count_distinct("id")).first()[0]
            if lost:
                raise InvalidGraph(f"{lost} ends of edges are not vertices")

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Graph:
        self._vertices.persist(level)
        self._edges.persist(level)
        return self

    def cache(self) -> Graph:
        return self.persist()

    def unpersist(self, blocking: bool = False) -> Graph:
        self._vertices.unpersist(blocking)
        self._edges.unpersist(blocking)
        return self

    def __repr__(self) -> str:
        order = lambda df, first: ", ".join(f"{c}: {t}" for c, t in sorted(df.dtypes, key=lambda x: (x[0] not in first, first.index(x[0]) if x[0] in first else 0)))
        return f"Graph(v: [{order(self._vertices, ['id'])}], e: [{order(self._edges, ['src', 'dst'])}])"

    # ---- degrees

    @property
    def out_degrees(self) -> DataFrame:
        return self._edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("outDegree"))

    @property
    def in_degrees(self) -> DataFrame:
        return self._edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("int").alias("inDegree"))

    @property
    def degrees(self) -> DataFrame:
        """Edges at each vertex that has any; a self-loop counts twice."""
        return self._edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").cast("int").alias("degree"))

    def _typed(self, ends: DataFrame, kind: str, types: list | None, name: str) -> DataFrame:
        if types is None:
            types = [r[0] for r in self._edges.select(kind).where(F.col(quote(kind)).isNotNull()).distinct().orderBy(kind).collect()]  # edge types: few by nature; give them to save this
        counts = [F.count(F.when(F.col("t") == t, 1)).cast("int").alias(str(t)) for t in types]
        return ends.groupBy("id").agg(F.struct(*counts).alias(name))

    def type_out_degree(self, edge_type_col: str, edge_types: list | None = None) -> DataFrame:
        return self._typed(self._edges.select(F.col("src").alias("id"), F.col(quote(edge_type_col)).alias("t")), edge_type_col, edge_types, "outDegrees")

    def type_in_degree(self, edge_type_col: str, edge_types: list | None = None) -> DataFrame:
        return self._typed(self._edges.select(F.col("dst").alias("id"), F.col(quote(edge_type_col)).alias("t")), edge_type_col, edge_types, "inDegrees")

    def type_degree(self, edge_type_col: str, edge_types: list | None = None) -> DataFrame:
        return self._typed(self._edges.select(F.explode(F.array("src", "dst")).alias("id"), F.col(quote(edge_type_col)).alias("t")), edge_type_col, edge_types, "degrees")

    def collect_neighbor_ids(self, direction: str = "either", limit: int | None = None) -> DataFrame:
        """(id, neighbors): sorted distinct neighbours; direction in, out or either. limit keeps the smallest so many of each."""
        return self._collected(F.col("nbr"), "neighbors", direction, limit)

    def collect_edges(self, direction: str = "either") -> DataFrame:
        """(id, edges): the edges at each vertex as structs."""
        e = nest(self._edges, "edge")
        sides = {"out": ["src"], "in": ["dst"], "either": ["src", "dst"]}[direction]
        rows = e.select(F.explode(F.array(*[F.col("edge")[s] for s in sides])).alias("id"), "edge")
        return rows.groupBy("id").agg(F.collect_list("edge").alias("edges"))

    def collect_neighbors(self, direction: str = "either") -> DataFrame:
        """(id, neighbors): the neighbours at each vertex's edges as structs of all their columns, one for each edge."""
        e = self._edges.select("src", "dst")
        out, into = e.select(F.col("src").alias("id"), F.col("dst").alias("nbr")), e.select(F.col("dst").alias("id"), F.col("src").alias("nbr"))
        rows = {"out": out, "in": into, "either": out.unionAll(into)}[direction]
        found = rows.join(nest(self._vertices, "vertex"), F.col("nbr") == F.col("vertex")["id"])
        return found.groupBy("id").agg(F.collect_list("vertex").alias("neighbors"))

    def _collected(self, value: Column, name: str, direction: str, limit: int | None) -> DataFrame:
        out, into = self._edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr")), self._edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"))
        rows = {"out": out, "in": into, "either": out.unionAll(into)}[direction].distinct()
        if limit is not None:
            rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("nbr"))).where(F.col("k") <= limit)
        return rows.groupBy("id").agg(F.array_sort(F.collect_list(value)).alias(name))

    # ---- queries and algorithms

    def find(self, pattern: str, assume_valid: bool = False) -> DataFrame:
        """Matches of a motif; see weft.plans.motif_parser for the language."""
        return motif.find(self._vertices, self._edges, pattern, assume_valid or self._ends_known)

    def count_matches(self, pattern: str, by: list[str]) -> DataFrame:
        """(by..., n): the number of matches of a motif for each combination of the ids of the named vertices."""
        return motif.counts(self._vertices, self._edges, pattern, by, self._ends_known)

    def bfs(self, from_expr, to_expr, edge_filter=None, max_path_length: int = 10, **old) -> DataFrame:
        return tuned(paths.bfs)(self, from_expr, to_expr, **renamed(old, {"edge_filter": edge_filter, "max_path_length": max_path_length}, edgeFilter="edge_filter", maxPathLength="max_path_length"))

    def aggregate_messages(self, aggregates, to_src=None, to_dst=None, **old) -> DataFrame:
        return messages.aggregate_messages(self.triplets, aggregates, **renamed(old, {"to_src": to_src, "to_dst": to_dst}, sendToSrc="to_src", sendToDst="to_dst"))

    def aggregateMessages(self, aggCol, sendToSrc=None, sendToDst=None) -> DataFrame:
        return messages.aggregate_messages(self.triplets, aggCol, sendToSrc, sendToDst)

    @property
    def pregel(self) -> Pregel:
        return Pregel(self)

    @tuned
    def aggregate_neighbors(self, *args, **options) -> DataFrame:
        return paths.aggregate_neighbors(self, *args, **options)

    aggregate_neighbors.__doc__ = paths.aggregate_neighbors.__doc__
    src_attr, dst_attr, edge_attr = staticmethod(paths.src_attr), staticmethod(paths.dst_attr), staticmethod(paths.edge_attr)

    @tuned
    def shortest_paths(self, landmarks: list, is_directed: bool = True) -> DataFrame:
        return paths.shortest_paths(self, landmarks, is_directed)

    @tuned
    def detect_cycles(self, max_length: int | None = None) -> DataFrame:
        return paths.detect_cycles(self, max_length)

    @tuned
    def connected_components(self, algorithm: str | None = None, max_iter: int | None = None, use_labels_as_components: bool | None = None) -> DataFrame:
        """The vertices with `component`, the smallest id that can be reached whatever the direction.

        algorithm: two_phase (default, or setting weft.connectedComponents.algorithm), randomized_contraction, or
        propagation (the only one that max_iter stops early). use_labels_as_components (setting weft.useLabelsAsComponents, true): if false, the component
        is the number of that id in the order of all ids, or the id itself where it is a whole number.
        """
        spark = self._vertices.sparkSession
        name = (algorithm or setting(spark, "connectedComponents.algorithm", "two_phase")).lower()
        if name not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {name!r}: {', '.join(ALGORITHMS)}")
        labels = setting(spark, "useLabelsAsComponents", True) if use_labels_as_components is None else use_labels_as_components
        rounds = Rounds(spark, "components", "connectedComponents")
        ids = self._vertices.select("id")
        e = self._edges.select("src", "dst")
        if not self._ends_known:
            e = e.join(ids.withColumnRenamed("id", "src").distinct(), "src", "left_semi").join(ids.withColumnRenamed("id", "dst").distinct(), "dst", "left_semi")
        run = {"two_phase": components.star_components, "randomized_contraction": components.contraction_components}
        found = components.propagated_components(e, rounds.cut, max_iter) if name == "propagation" else run[name](e, rounds.cut)
        kept = [c for c in self._vertices.columns if c != "component"]
        done = self._vertices.select(*[F.col(quote(c)) for c in kept]).join(found, "id", "left").select(*[F.col(quote(c)) for c in kept], F.coalesce("component", "id").alias("component"))
        if not labels:
            numbers = long_ids(ids).select(F.col("id").alias("component"), "new_id")
            done = done.join(numbers, "component", "left").select(*[F.col(quote(c)) for c in kept], F.col("new_id").alias("component"))
        return rounds.close(done)

    @tuned
    def strongly_connected_components(self, max_iter: int) -> DataFrame:
        if max_iter < 1:
            raise ValueError("max_iter must be positive")
        rounds = Rounds(self._vertices.sparkSession, "scc")
        found = components.strong_components(self._vertices, self._edges, rounds.cut, rounds.collector, max_iter)
        return rounds.close(communities.attach(self, found, "component"))

    @tuned
    def label_propagation(self, max_iter: int, is_directed: bool = False) -> DataFrame:
        return communities.label_propagation(self, max_iter, is_directed)

    @tuned
    def triangle_count(self, algorithm: str = "exact", lg_nom_entries: int = 12) -> DataFrame:
        return communities.triangle_count(self, algorithm, lg_nom_entries)

    @tuned
    def k_core(self) -> DataFrame:
        return communities.k_core(self)

    @tuned
    def maximal_independent_set(self, seed: int = 42) -> DataFrame:
        return communities.maximal_independent_set(self, seed)

    def power_iteration_clustering(self, k: int, max_iter: int, weight_col: str | None = None) -> DataFrame:
        return communities.power_iteration_clustering(self, k, max_iter, weight_col)

    @tuned
    def page_rank(self, reset_probability: float = 0.15, source_id=None, max_iter: int | None = None, tol: float | None = None, initial_ranks: DataFrame | None = None) -> Graph:
        return ranking.page_rank(self, reset_probability, source_id, max_iter, tol, initial_ranks)

    @tuned
    def parallel_personalized_page_rank(self, reset_probability: float = 0.15, source_ids: list | None = None, max_iter: int | None = None) -> Graph:
        return ranking.parallel_personalized(self, reset_probability, source_ids, max_iter)

    @tuned
    def svd_plus_plus(self, rank: int = 10, max_iter: int = 2, min_value: float = 0.0, max_value: float = 5.0, gamma1: float = 0.007, gamma2: float = 0.007, gamma6: float = 0.005, gamma7: float = 0.015, seed: int = 42) -> tuple[DataFrame, float]:
        return factorization.svd_plus_plus(self, rank, max_iter, min_value, max_value, gamma1, gamma2, gamma6, gamma7, seed)

    @tuned
    def random_walks(self, **options) -> DataFrame:
        return walks.random_walks(self, **options)

    # ---- the same under the usual camel-case names

    filterVertices, filterEdges, dropIsolatedVertices = filter_vertices, filter_edges, drop_isolated_vertices
    asUndirected, asReversed = as_undirected, as_reversed
    outDegrees, inDegrees = out_degrees, in_degrees
    typeOutDegree, typeInDegree, typeDegree = type_out_degree, type_in_degree, type_degree
    fromEdges = from_edges

    collectNeighborIds, collectNeighbors, collectEdges = collect_neighbor_ids, collect_neighbors, collect_edges
    mapVertices, mapEdges, mapTriplets, groupEdges = map_vertices, map_edges, map_triplets, group_edges
    joinVertices, removeSelfEdges, convertToCanonicalEdges, pickRandomVertex, partitionBy = join_vertices, remove_self_edges, canonical_edges, pick_random_vertex, partition_by

    def shortestPaths(self, landmarks: list, algorithm: str | None = None, use_local_checkpoints: bool = False, checkpoint_interval: int | None = None, storage_level=None, is_directed: bool = True) -> DataFrame:
        engine(algorithm)
        return self.shortest_paths(landmarks, is_directed, use_local_checkpoints=use_local_checkpoints, checkpoint_interval=checkpoint_interval, storage_level=storage_level)

    def detectingCycles(self, checkpoint_interval: int | None = None, use_local_checkpoints: bool = False, storage_level=None) -> DataFrame:
        return self.detect_cycles(checkpoint_interval=checkpoint_interval, use_local_checkpoints=use_local_checkpoints, storage_level=storage_level)

    def connectedComponents(self, algorithm: str | None = None, checkpointInterval: int | None = None, broadcastThreshold: int | None = None, useLabelsAsComponents: bool | None = None, use_local_checkpoints: bool = False, max_iter: int | None = None, storage_level=None) -> DataFrame:
        """algorithm: one of ours; other names, as older callers give them, mean the default, which runs to its end."""
        name = algorithm if algorithm is None or algorithm.lower() in ALGORITHMS else engine(algorithm)
        limit = max_iter if name and name.lower() == "propagation" else None
        return self.connected_components(name, limit, useLabelsAsComponents, checkpoint_interval=checkpointInterval, broadcast_threshold=broadcastThreshold, use_local_checkpoints=use_local_checkpoints, storage_level=storage_level)

    def stronglyConnectedComponents(self, maxIter: int) -> DataFrame:
        return self.strongly_connected_components(maxIter)

    def labelPropagation(self, maxIter: int, algorithm: str | None = None, use_local_checkpoints: bool = False, checkpoint_interval: int | None = None, storage_level=None, is_directed: bool = False) -> DataFrame:
        engine(algorithm)
        return self.label_propagation(maxIter, is_directed, use_local_checkpoints=use_local_checkpoints, checkpoint_interval=checkpoint_interval, storage_level=storage_level)

    def triangleCount(self, storage_level=None, algorithm: str = "exact", lg_nom_entries: int = 12) -> DataFrame:
        return self.triangle_count(algorithm, lg_nom_entries, storage_level=storage_level)

    def powerIterationClustering(self, k: int, maxIter: int, weightCol: str | None = None) -> DataFrame:
        return self.power_iteration_clustering(k, maxIter, weightCol)

    def pageRank(self, resetProbability: float = 0.15, sourceId=None, maxIter: int | None = None, tol: float | None = None) -> Graph:
        return self.page_rank(resetProbability, sourceId, maxIter, tol)

    def parallelPersonalizedPageRank(self, resetProbability: float = 0.15, sourceIds: list | None = None, maxIter: int | None = None) -> Graph:
        return self.parallel_personalized_page_rank(resetProbability, sourceIds, maxIter)

    def svdPlusPlus(self, rank: int = 10, maxIter: int = 2, minValue: float = 0.0, maxValue: float = 5.0, gamma1: float = 0.007, gamma2: float = 0.007, gamma6: float = 0.005, gamma7: float = 0.015) -> tuple[DataFrame, float]:
        return self.svd_plus_plus(rank, maxIter, minValue, maxValue, gamma1, gamma2, gamma6, gamma7)
