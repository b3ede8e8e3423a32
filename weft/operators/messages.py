"""One step of message passing along edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.columns import expression


class _Reference:
    """A struct column of the triplet: AggregateMessages.src["age"]."""

    def __init__(self, name: str):
        self.name = name

    def __get__(self, obj, owner) -> Column:
        return F.col(self.name)


class AggregateMessages:
    """Columns to write messages and aggregates with."""

    src, dst, edge, msg = _Reference("src"), _Reference("dst"), _Reference("edge"), _Reference("MSG")


def many(x) -> list[Column]:
    return [] if x is None else [expression(c) for c in (x if isinstance(x, (list, tuple)) else [x])]


def aggregate_messages(triplets: DataFrame, aggregates, to_src=None, to_dst=None) -> DataFrame:
    """(id, aggregates...): messages are expressions over src, dst and edge; several make MSG a struct.

    Lazy; vertices without messages are absent. Both directions feed one aggregation.
    """
    aggregates, parts = many(aggregates), []
    if not aggregates:
        raise ValueError("at least one aggregate is needed")
    for end, messages in (("src", many(to_src)), ("dst", many(to_dst))):
        if messages:
            msg = messages[0] if len(messages) == 1 else F.struct(*messages)
            parts.append(triplets.select(F.col(end)["id"].alias("id"), msg.alias("MSG")))
    if not parts:
        raise ValueError("messages to src, to dst or to both are needed")
    return reduce(DataFrame.unionAll, parts).groupBy("id").agg(*aggregates)
