"""Rows that meet at a middle vertex, sent to their left end as lists: what counts them by ends needs no shuffle of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUB = 4096  # elements of a list
FINE = 4  # partitions of pairs, as a multiple of the session's


def partitions(df: DataFrame, times: int = 1) -> int:
    """A fixed number, as pairs are many more than the rows that adaptive execution would go by."""
    return times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lists(rows: DataFrame, key: str, value: Column, *also: str, most: int = HUB) -> DataFrame:
    """(key, also..., block, l): the values of each key, a hub's in blocks of about `most`."""
    rows = rows.select(key, *also, value.alias("x")).withColumn("block", F.pmod(F.xxhash64("x"), F.ceil(F.count("*").over(Window.partitionBy(key)) / most)))
    return rows.groupBy(key, *also, "block").agg(F.collect_list("x").alias("l"))


def two_hops(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, c, n): how often edges of `left` (src, dst) meet edges of `right` from a to c, in rows to be added up; by partitions of a.

    Parallel edges are merged before they multiply."""
    merged = lambda e, n: e.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias(n))
    onward = lists(merged(right, "m").withColumnRenamed("src", "via"), "via", F.col("dst"), "m")
    meet = merged(left, "n").select(F.col("src").alias("a"), F.col("dst").alias("via"), "n").join(onward, "via")
    meet = meet.select("a", (F.col("n") * F.col("m")).alias("n"), "l").repartition(partitions(left, FINE), "a")
    return meet.select("a", F.explode("l").alias("c"), "n")
