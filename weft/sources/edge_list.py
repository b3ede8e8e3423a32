"""Graphs from files: text edge lists and tables under other column names; and back to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.graph import Graph


def read_edge_list(spark: SparkSession, path: str, canonical_orientation: bool = False, num_partitions: int | None = None, id_type: str = "long") -> Graph:
    """Lines of two ids parted by white space; blank lines and ones that begin with # are skipped, and a line with one field is an error.

    Edges and vertices get attr 1. canonical_orientation turns edges so that src < dst.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).where("line <> '' and line not like '#%'")
    two = F.split("line", " ")
    checked = F.when(F.size(two) >= 2, two).otherwise(F.raise_error(F.concat(F.lit("an edge needs two ids: "), F.col("line"))))
    e = lines.select(checked.alias("x")).select(F.col("x")[0].cast(id_type).alias("src"), F.col("x")[1].cast(id_type).alias("dst"))
    if canonical_orientation:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    e = e.withColumn("attr", F.lit(1))
    e = e.repartition(num_partitions, "src") if num_partitions else e
    g = Graph.from_edges(e)
    return Graph(g.vertices.withColumn("attr", F.lit(1)), e)


def edges_from_columns(df: DataFrame, src: str, dst: str) -> DataFrame:
    """A table with its end columns renamed to src and dst."""
    return df.withColumnsRenamed({src: "src", dst: "dst"})


def read_graph(spark: SparkSession, path: str, fmt: str = "parquet", src: str = "src", dst: str = "dst", **options) -> Graph:
    """A graph saved as path/vertices and path/edges in any format that Spark reads."""
    load = lambda part: spark.read.format(fmt).options(**options).load(f"{path}/{part}")
    return Graph(load("vertices"), edges_from_columns(load("edges"), src, dst))


def write_graph(g: Graph, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> None:
    g.vertices.write.format(fmt).mode(mode).options(**options).save(f"{path}/vertices")
    g.edges.write.format(fmt).mode(mode).options(**options).save(f"{path}/edges")


def from_edge_tuples(edges: DataFrame, default: object = 1, unique: bool = False) -> Graph:
    """(src, dst) rows with one attribute for all vertices; unique merges parallel edges into one with their count as attr."""
    e = edges.groupBy("src", "dst").agg(F.count("*").cast("int").alias("attr")) if unique else edges.withColumn("attr", F.lit(1))
    return Graph(Graph.from_edges(e).vertices.withColumn("attr", F.lit(default)), e)


def with_default_vertices(vertices: DataFrame, edges: DataFrame, defaults: dict) -> Graph:
    """Ends of edges that aren't among the vertices are added with default attributes."""
    ends = Graph.from_edges(edges).vertices.join(vertices.select("id"), "id", "left_anti")
    more = ends.select("id", *[F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in vertices.schema.fields if f.name != "id"])
    return Graph(vertices.unionByName(more), edges)
