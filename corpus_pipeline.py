"""A corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read again.

Every stage but the last returns the columns of `documents`; n_chars follows the text. The last returns the mix:
how many words of each remaining document are taken. Rows are told apart by id (null is one of its own) and text, whatever else they hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import plain, row_key
from weft.llm.decontamination import find_contamination
from weft.llm.jaccard_join import jaccard_join
from weft.llm.line_dedup import line_dedup
from weft.llm.mixing import mix_sources
from weft.llm.toxicity import toxicity
from weft.plans.iterate import remove_table, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ..., which nothing else is called, and the new name of each column."""
    rows = plain(docs)
    return rows, dict(zip(docs.columns, rows.columns))


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with k_id and k_row, and the names that their own columns have there."""
    rows, own = renamed(docs)
    return rows.withColumns({"k_id": F.col(own["doc_id"]).cast("long"), "k_row": row_key(F.col(own["text"]).cast("string"))}), list(own.values())


def same(left: DataFrame, right: DataFrame) -> Column:
    return left["k_id"].eqNullSafe(right["k_id"]) & (left["k_row"] == right["k_row"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rates toxic go."""
    rows, own = renamed(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", own["doc_id"])
    return toxicity(rows, labels, own["doc_id"], own["text"]).where("predicted = 0").select(*own.values()).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines and of single lines of over 50 words go, and documents of which nothing is left by that."""
    rows, own = renamed(docs)
    done = line_dedup(rows, own["doc_id"], own["text"]).where("not all_removed")
    changed = {own["text"]: F.col("kept_text")}
    if "n_chars" in own:
        changed[own["n_chars"]] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(own["n_chars"]))
    return done.withColumns(changed).select(*own.values()).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the first by (id, null last; hash of the text) stays; repeated rows of it become one row.
    Documents without words are in no group and stay, as do those that are linked with none, whatever their ids."""
    links = jaccard_join(docs, representatives=True).where("n_shingles > 0").select(F.col("doc_id").alias("k_id"), F.col("row_key").alias("k_row"), "is_first")
    gone = links.where("not is_first").select("k_id", "k_row").distinct()
    copies = links.where("is_first").groupBy("k_id", "k_row").agg(F.count("*").alias("k")).where("k > 1").select("k_id", "k_row")
    rows, own = keyed(docs)
    kept = rows.join(gone.hint("shuffle_hash"), same(rows, gone), "left_anti")
    single = kept.join(copies.hint("shuffle_hash"), same(kept, copies), "left_anti").select(*own)
    # equal rows: an aggregate that combines before the shuffle keeps the least of each kind, so reruns agree
    several = kept.join(copies.hint("shuffle_hash"), same(kept, copies), "left_semi")
    several = several.groupBy("k_id", "k_row").agg(F.min(F.struct(*own)).alias("least")).select("least.*")
    return single.unionAll(several).toDF(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("k_id"), F.col("_row").alias("k_row")).distinct()
    rows, own = keyed(docs)
    return rows.join(found.hint("shuffle_hash"), same(rows, found), "left_anti").select(*own).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take of each document, so that the sources meet their target weights."""
    return mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("mixing sources", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/weft-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            remove_table(spark, f"{home}/{k - 1}")
    return docs
