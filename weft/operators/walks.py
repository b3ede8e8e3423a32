"""Random walks, and embeddings learnt from them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import UnsupportedVertexType
from weft.functions.columns import draw, quote, unit_hash
from weft.plans.hops import partitions
from weft.plans.iterate import Rounds, remove_table

WALK_ID_TYPES = ("string", "tinyint", "smallint", "int", "bigint")


def sampled_neighbors(g, max_nbrs: int, use_edge_direction: bool, seed: int) -> DataFrame:
    """(id, nbr): at most max_nbrs distinct neighbours of each vertex, those of the smallest hash; the limit is applied before the shuffle ends."""
    e = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
    if not use_edge_direction:
        e = e.unionAll(e.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")))
    order = Window.partitionBy("id").orderBy(draw(F.col("id"), F.col("nbr"), seed), "nbr")
    return e.where("id is not null and nbr is not null").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_nbrs)


def random_walks(g, max_nbrs: int = 50, num_walks_per_node: int = 5, batch_size: int = 10, num_batches: int = 5, use_edge_direction: bool = False, restart_probability: float = 0.1, seed: int = 42, path: str | None = None, run_id: str | None = None, starting_batch: int = 0) -> DataFrame:
    """(random_walk_uuid, random_walk): walks with restart of num_batches x batch_size vertices.

    Each step appends the current vertex, then goes to the start with restart_probability or to a sampled neighbour; from a vertex without
    neighbours it goes to the start. Vertices without neighbours start no walks. All choices are hashes of (walk, step, seed): runs repeat.
    path: folder to keep the walks in, as <path>/<run_id>/batch=<number>, each batch written whole before the next begins (run_id: a new one if none is given).
    starting_batch: go on from there with the batches before it that run_id has in path; the walks are those of an uninterrupted run.
    """
    kind = dict(g.vertices.dtypes)["id"]
    if kind not in WALK_ID_TYPES:
        raise UnsupportedVertexType(f"walks need string or integral ids, not {kind}")
    if not 0 <= starting_batch < num_batches:
        raise ValueError("starting_batch must be one of the batches")
    if starting_batch and not (path and run_id):
        raise ValueError("to go on, path and run_id are needed")
    spark = g.vertices.sparkSession
    rounds = Rounds(spark, "walks")
    home = f"{path or rounds.home}/{run_id or uuid.uuid4().hex}"
    batch = lambda b: f"{home}/batch={b}"
    schema = f"walk string, home {kind}, at {kind}, seen array<{kind}>"
    nbrs = rounds.cut(sampled_neighbors(g, max_nbrs, use_edge_direction, seed))
    sizes = nbrs.groupBy("id").agg(F.max("k").alias("size"))
    lists = rounds.cache(nbrs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "nbr"))).alias("l")).select("id", F.expr("transform(l, x -> x.nbr)").alias("nbrs")).repartition("id"))
    if starting_batch:
        state = spark.read.schema(schema).parquet(batch(starting_batch - 1)).select("walk", "home", "at")
    else:
        starts = sizes.join(g.vertices.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.sequence(F.lit(1), F.lit(num_walks_per_node))).alias("w"))
        state = rounds.cut(starts.select(F.concat_ws("-", F.col("id").cast("string"), F.col("w").cast("string")).alias("walk"), F.col("id").alias("home"), F.col("id").alias("at")))
    for b in range(starting_batch, num_batches):
        part = state.withColumn("seen", F.array().cast(f"array<{kind}>"))
        for s in range(batch_size):
            k = b * batch_size + s
            moved = part.join(lists, part["at"] == lists["id"], "left").drop("id")
            pick = F.element_at("nbrs", (draw(F.col("walk"), k, seed) % F.size("nbrs") + 1).cast("int"))
            away = F.col("nbrs").isNull() | (unit_hash(F.col("walk"), k, seed, "restart") < restart_probability)
            part = moved.select("walk", "home", F.when(away, F.col("home")).otherwise(pick).alias("next"), F.array_append("seen", F.col("at")).alias("seen")).withColumnRenamed("next", "at")
            if s % 5 == 4:
                part = rounds.cut(part)
        part.select("walk", "home", "at", "seen").write.mode("overwrite").parquet(batch(b))
        state = spark.read.schema(schema).parquet(batch(b)).select("walk", "home", "at")
    every = [spark.read.schema(schema).parquet(batch(b)).select("walk", F.lit(b).alias("b"), "seen") for b in range(num_batches)]
    joined = reduce(DataFrame.unionAll, every).groupBy("walk").agg(F.flatten(F.expr("transform(array_sort(collect_list(struct(b, seen))), x -> x.seen)")).alias("random_walk"))
    done = rounds.close(joined.select(F.col("walk").alias("random_walk_uuid"), "random_walk"))
    if not path:
        remove_table(spark, home)
    return done


def hash2vec(walks: DataFrame, column: str = "random_walk", context_size: int = 5, dim: int = 512, decay: str = "gaussian", sigma: float = 1.0, hash_seed: int = 42, sign_seed: int = 18, normalize: bool = True, safe_norm: bool = True) -> DataFrame:
    """(id, embedding): for each position and each context position within context_size, the sign hash of the context times the weight
    of the distance is added to the context's bucket; sums are over all walks. decay: gaussian exp(-d^2 / sigma^2) or constant.
    normalize: to length 1; safe_norm adds a slot ln(length + 1) / sqrt(dim)."""
    if decay not in ("gaussian", "constant"):
        raise ValueError("decay must be gaussian or constant")
    if dim < 1 or context_size < 1:
        raise ValueError("dim and context_size must be positive")
    # slot and sign of an element are worked out once; a position sends the codes around it to its own element, so what is added up
    # there is one partition's share of elements, however many pairs a task makes. The element itself adds 0, so that none is lost.
    codes = F.transform(column, lambda c: (draw(c, hash_seed) % dim * 2 + draw(c, sign_seed) % 2).cast("int"))
    places = walks.select(F.posexplode(column).alias("i", "id"), codes.alias("h")).withColumn("from", F.greatest(F.lit(0), F.col("i") - context_size))
    sent = places.select("id", (F.col("i") - F.col("from")).alias("at"), F.expr(f"slice(h, from + 1, least(size(h), i + {context_size} + 1) - from)").alias("near"))
    near = sent.repartition(partitions(walks), "id").select("id", "at", F.posexplode("near").alias("j", "h")).withColumn("d", F.abs(F.col("j") - F.col("at")))
    weight = F.exp(-(F.col("d") * F.col("d")) / F.lit(float(sigma * sigma))) if decay == "gaussian" else F.lit(1.0)
    signed = F.when(F.col("d") == 0, 0.0).otherwise(weight * F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0))
    slot = near.groupBy("id", F.shiftright("h", 1).alias("slot")).agg(F.sum(signed).alias("x"))
    maps = slot.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dense = F.expr(f"transform(sequence(0, {dim - 1}), k -> coalesce(m[k], 0D))")
    if normalize:
        dense = F.transform(dense, lambda x: x / (F.col("length") + F.lit(1e-6)))
        if safe_norm:
            dense = F.concat(dense, F.array(F.log(F.col("length") + 1) / F.sqrt(F.lit(float(dim)))))
    return maps.select("id", array_to_vector(dense).alias("embedding"))


def word2vec(walks: DataFrame, column: str = "random_walk", vector_size: int = 100, max_iter: int = 1, window_size: int = 5, min_count: int = 0, num_partitions: int = 1, step_size: float = 0.025, seed: int = 42, id_type: str = "string") -> DataFrame:
    """(id, embedding) by Spark ML's Word2Vec; ids are cast to strings for it, and back to id_type."""
    from pyspark.ml.feature import Word2Vec

    text = walks.select(F.transform(column, lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=vector_size, maxIter=max_iter, windowSize=window_size, minCount=min_count, numPartitions=num_partitions, stepSize=step_size, seed=seed, inputCol="words", outputCol="v").fit(text)
    return model.getVectors().select(F.col("word").cast(id_type).alias("id"), F.col("vector").alias("embedding"))


def sampling_convolution(g, features: DataFrame, column: str = "embedding", max_nbrs: int = 50, use_edge_direction: bool = False, seed: int = 42, concat: bool = True) -> DataFrame:
    """Each vertex's vector with the mean of a sample of its neighbours' vectors: appended to it, or as nbr_embedding."""
    from pyspark.ml.stat import Summarizer

    nbrs = sampled_neighbors(g, max_nbrs, use_edge_direction, seed).select("id", "nbr")
    own = features.select("id", F.col(quote(column)).alias("v"))
    mean = nbrs.join(own.withColumnRenamed("id", "nbr"), "nbr").groupBy("id").agg(Summarizer.mean(F.col("v")).alias("m"))
    both = own.join(mean, "id", "left")
    nbr = F.when(F.col("m").isNull(), F.transform(vector_to_array("v"), lambda x: F.lit(0.0))).otherwise(vector_to_array("m"))
    if concat:
        return both.select("id", array_to_vector(F.concat(vector_to_array("v"), nbr)).alias(column))
    return both.select("id", F.col("v").alias(column), array_to_vector(nbr).alias("nbr_" + column))


class RandomWalkEmbeddings:
    """Walks, then a sequence model, then neighbour aggregation."""

    def __init__(self, graph):
        self.graph, self.walks_path, self.walk_options, self.model, self.nbrs, self.clean_up = graph, None, {}, None, None, False

    def use_cached_random_walks(self, path: str):
        """Take the walks from a Parquet folder instead of making them."""
        self.walks_path = path
        return self

    def set_rw_model(self, **options):
        self.walk_options = options
        return self

    def set_hash2vec(self, **options):
        self.model = lambda w: hash2vec(w, **options)
        return self

    def set_word2vec(self, **options):
        kind = dict(self.graph.vertices.dtypes)["id"]
        self.model = lambda w: word2vec(w, id_type=kind, **options)
        return self

    def set_neighbors_aggregation(self, max_neighbors: int = 50, seed: int = 42, concat: bool = True):
        self.nbrs = {"max_nbrs": max_neighbors, "seed": seed, "concat": concat}
        return self

    def unset_neighbors_aggregation(self):
        self.nbrs = None
        return self

    def set_clean_up_after_run(self, clean_up: bool = True):
        """The walks that the run makes are deleted when it ends, also where a path was given for them; those of use_cached_random_walks never are."""
        self.clean_up = clean_up
        return self

    def run(self) -> DataFrame:
        if self.model is None:
            raise ValueError("set a sequence model first: set_hash2vec or set_word2vec")
        spark = self.graph.vertices.sparkSession
        if self.walks_path:
            walks = spark.read.parquet(self.walks_path)
        else:
            options = dict(self.walk_options)
            if self.clean_up and options.get("path"):
                options.setdefault("run_id", uuid.uuid4().hex)
            walks = random_walks(self.graph, **options)
        found = self.model(walks)
        done = sampling_convolution(self.graph, found, **self.nbrs) if self.nbrs else found
        if not self.clean_up or self.walks_path:
            return done
        done = Rounds(spark, "embeddings").close(done)  # written, so that it needs the walks no more
        for made in [walks.inputFiles()[0].rsplit("/", 1)[0], *([f"{options['path']}/{options['run_id']}"] if options.get("path") else [])]:
            remove_table(spark, made)
        return done


def k_min(df: DataFrame, key: str, value: str, weight: Column, k: int) -> DataFrame:
    """(key, value) of the k rows of each key with the smallest (weight, value)."""
    order = Window.partitionBy(key).orderBy(weight, value)
    return df.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).select(key, value)
