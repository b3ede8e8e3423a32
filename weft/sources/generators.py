"""Graphs to try things on. Random ones are hashes of a seed: the same in every run and with any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.functions.columns import unit_hash
from weft.graph import Graph


def empty(spark: SparkSession, id_type: str = "long") -> Graph:
    return Graph(spark.createDataFrame([], f"id {id_type}"), spark.createDataFrame([], f"src {id_type}, dst {id_type}"))


def chain(spark: SparkSession, n: int) -> Graph:
    """0 -> 1 -> ... -> n - 1."""
    if n < 1:
        raise ValueError("n must be positive")
    v = spark.range(n)
    return Graph(v, v.where(F.col("id") < n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def star(spark: SparkSession, n: int) -> Graph:
    """0 -> each of 1 to n."""
    return Graph(spark.range(n + 1), spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))


def grid(spark: SparkSession, rows: int, cols: int) -> Graph:
    """Vertices r * cols + c; edges to the right and down."""
    v = spark.range(rows * cols).select("id", (F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    right = v.where(F.col("col") < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = v.where(F.col("row") < rows - 1).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return Graph(v, right.unionAll(down))


def friends(spark: SparkSession) -> Graph:
    """Seven people and eight relations."""
    people = zip("abcdefg", "Alice Bob Charlie David Esther Fanny Gabby".split(), (34, 36, 30, 29, 32, 36, 60))
    v = spark.createDataFrame(list(people), "id string, name string, age int")
    kinds = {"friend": "ab ed da ae", "follow": "bc cb fc ef"}
    e = spark.createDataFrame([(*pair, kind) for kind, pairs in kinds.items() for pair in pairs.split()], "src string, dst string, relationship string")
    return Graph(v, e)


def two_blobs(spark: SparkSession, size: int) -> Graph:
    """Two complete graphs (self-loops included) of `size` vertices, joined by the edge 0 -> size."""
    v = spark.range(2 * size).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v_attr1"), F.col("id").cast("int").alias("v_attr2"))
    pair = spark.range(2 * size * size).select((F.col("id") % size).alias("i"), (F.floor(F.col("id") / size) % size).alias("j"), (F.floor(F.col("id") / (size * size)) * size).alias("o"))
    e = pair.select((F.col("i") + F.col("o")).cast("long").alias("src"), (F.col("j") + F.col("o")).cast("long").alias("dst"))
    e = e.unionAll(spark.range(1).select(F.lit(0).cast("long"), F.lit(size).cast("long")))
    return Graph(v, e.withColumn("e_attr1", F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))))


def ratings(spark: SparkSession) -> Graph:
    """Four users (2 x number) who rate four items (2 x number + 1): two like the odd ones, two the even ones."""
    e = [(2 * u, 2 * i + 1, float(5 if (i % 2 == 1) == (u <= 2) else 1)) for u in range(1, 5) for i in range(1, 5)]
    e = spark.createDataFrame(e, "src long, dst long, weight double")
    return Graph(Graph.from_edges(e).vertices, e)


def ising_grid(spark: SparkSession, n: int, v_std: float = 1.0, e_std: float = 1.0, seed: int = 42) -> Graph:
    """n x n vertices "i,j" with field a, and couplings b to the right and down, both Gaussian."""
    name = lambda i, j: F.concat_ws(",", i.cast("string"), j.cast("string"))
    v = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    v = v.select("i", "j", name(F.col("i"), F.col("j")).alias("id"))
    right = v.where(F.col("j") < n - 1).select(F.col("id").alias("src"), name(F.col("i"), F.col("j") + 1).alias("dst"))
    down = v.where(F.col("i") < n - 1).select(F.col("id").alias("src"), name(F.col("i") + 1, F.col("j")).alias("dst"))
    return Graph(v.withColumn("a", gaussian("id", seed=seed) * v_std), right.unionAll(down).withColumn("b", gaussian("src", "dst", seed=seed) * e_std))


def gaussian(*columns: str, seed: int):
    """A standard normal number for each row, by the Box-Muller transform of two hashes."""
    u = [unit_hash(*[F.col(c) for c in columns], seed, k) for k in (1, 2)]
    return F.sqrt(-2 * F.log(1 - u[0])) * F.cos(2 * math.pi * u[1])


def log_normal(spark: SparkSession, n: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 42) -> Graph:
    """n vertices with log-normal out-degrees (n at most) and uniform targets."""
    v = spark.range(n).withColumn("degree", F.least(F.lit(n), F.floor(F.exp(mu + sigma * gaussian("id", seed=seed)))).cast("int"))
    e = v.where("degree > 0").select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("k"))
    return Graph(v.select("id"), e.select("src", F.floor(unit_hash(F.col("src"), F.col("k"), seed) * n).cast("long").alias("dst")).withColumn("attr", F.lit(1)))


def rmat(spark: SparkSession, n: int, num_edges: int, a: float = 0.45, b: float = 0.15, c: float = 0.15, seed: int = 42) -> Graph:
    """About num_edges distinct edges among the next power of two of n vertices, by recursive quadrants."""
    bits = max(1, math.ceil(math.log2(max(2, n))))
    e = spark.range(int(num_edges * 1.2))
    src = dst = F.lit(0).cast("long")
    for k in range(bits):
        u = unit_hash(F.col("id"), k, seed)
        src = src * 2 + F.when(u >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when(((u >= a) & (u < a + b)) | (u >= a + b + c), 1).otherwise(0)
    e = e.select(src.alias("src"), dst.alias("dst"), "id").groupBy("src", "dst").agg(F.min("id").alias("k"))
    # the first num_edges by draw: a sampling limit, as the generator's definition
    e = e.orderBy("k").limit(num_edges).select("src", "dst")
    return Graph(spark.range(1 << bits), e)
