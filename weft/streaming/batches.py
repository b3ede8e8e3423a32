"""Graph algorithms on streams of edges: each micro-batch is appended to a table, and the algorithm runs over all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.graph import Graph
from weft.plans.iterate import remove_table


def results_of(spark: SparkSession, result_path: str) -> list[int]:
    """Numbers of the batches with a complete result, ascending: those whose folder holds the mark of a finished write."""
    jvm = spark._jvm
    home = jvm.org.apache.hadoop.fs.Path(result_path)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(home):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(home)]
    done = [n for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{result_path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


def latest_result(spark: SparkSession, result_path: str) -> DataFrame:
    """The result of the last batch that was finished."""
    done = results_of(spark, result_path)
    if not done:
        raise FileNotFoundError(f"no finished result in {result_path}")
    return spark.read.parquet(f"{result_path}/batch={done[-1]}")


def on_each_batch(edges: DataFrame, table_path: str, algorithm: Callable[[Graph], DataFrame], result_path: str, checkpoint: str, keep: int = 2):
    """Start a streaming query over streamed (src, dst, ...) rows. Returns the query; latest_result reads what it has found.

    Batches are kept in a folder of their own each, so a batch that is run again after a failure replaces itself. A batch's
    result has a folder of its own too: readers see the last finished one, never a half. The last `keep` of them are kept.
    """
    if keep < 1:
        raise ValueError("keep must be positive")

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        every = batch.sparkSession.read.parquet(table_path).drop("batch")
        algorithm(Graph.from_edges(every)).write.mode("overwrite").parquet(f"{result_path}/batch={number}")
        for old in results_of(batch.sparkSession, result_path)[:-keep]:
            remove_table(batch.sparkSession, f"{result_path}/batch={old}")

    return edges.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
