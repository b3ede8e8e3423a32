"""Bulk-synchronous vertex programs on DataFrames."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from weft.functions.columns import expression, quote
from weft.plans.iterate import NO_LOCAL, Rounds, as_storage_level

MSG, ACTIVE = "_pregel_msg_", "_pregel_is_active"


class Pregel:
    """A builder; run() returns the vertices with `_pregel_is_active` and the added columns.

    A superstep joins the edges with the state of their sources (and of their destinations only where a message
    reads more of them than the id), drops null messages, aggregates by receiver, and computes all updates from the previous state.
    """

    def __init__(self, graph):
        self.graph = graph
        self.columns: list[tuple[str, Column, Column]] = []
        self.to_src: list[Column] = []
        self.to_dst: list[Column] = []
        self.aggregate: Column | None = None
        self.max_iter, self.interval = 10, 2
        self.early_stopping = self.stop_if_inactive = self.skip_inactive = False
        self.first_active: Column = F.lit(True)
        self.next_active: Column = F.lit(True)
        self.src_columns: list[str] | None = None
        self.dst_columns: list[str] | None = None
        self.needs_dst: bool | None = None
        self.level = None

    def setMaxIter(self, value: int):
        if value < 1:
            raise ValueError("at least one iteration is needed")
        self.max_iter = value
        return self

    def setCheckpointInterval(self, value: int):
        if value < 1:
            raise ValueError("checkpoint interval must be positive")
        self.interval = value
        return self

    def setEarlyStopping(self, value: bool):
        self.early_stopping = value
        return self

    def setStopIfAllNonActiveVertices(self, value: bool):
        self.stop_if_inactive = value
        return self

    def setInitialActiveVertexExpression(self, value):
        self.first_active = expression(value)
        return self

    def setUpdateActiveVertexExpression(self, value):
        self.next_active = expression(value)
        return self

    def setSkipMessagesFromNonActiveVertices(self, value: bool):
        self.skip_inactive = value
        return self

    def setUseLocalCheckpoints(self, value: bool):
        """Known for compatibility: rounds are always written to the shared folder, so that they survive lost executors; true gives a warning."""
        if value:
            warnings.warn(NO_LOCAL, stacklevel=2)
        return self

    def setIntermediateStorageLevel(self, level):
        """Of the edges, which are cached for all supersteps."""
        self.level = as_storage_level(level)
        return self

    def setNeedsDst(self, value: bool):
        """Overrides the decision whether messages read the destination's state."""
        self.needs_dst = value
        return self

    def withVertexColumn(self, name: str, initial, update):
        if name in ("id", MSG, ACTIVE) or name in [c for c, *_ in self.columns]:
            raise ValueError(f"column {name!r} can't be added")
        self.columns.append((name, expression(initial), expression(update)))
        return self

    def sendMsgToSrc(self, message):
        self.to_src.append(expression(message))
        return self

    def sendMsgToDst(self, message):
        self.to_dst.append(expression(message))
        return self

    def aggMsgs(self, aggregate):
        self.aggregate = expression(aggregate)
        return self

    def required_src_columns(self, *names: str):
        self.src_columns = list(names)
        return self

    def required_dst_columns(self, *names: str):
        self.dst_columns = list(names)
        return self

    @staticmethod
    def msg() -> Column:
        return F.col(MSG)

    @staticmethod
    def src(name: str) -> Column:
        return F.col("src")[name]

    @staticmethod
    def dst(name: str) -> Column:
        return F.col("dst")[name]

    @staticmethod
    def edge(name: str) -> Column:
        return F.col("edge")[name]

    def reads_dst(self, state: DataFrame, edges: DataFrame) -> bool:
        """Do messages need more of the destination than its id? Decided by analysing them against a destination
        that has nothing else but a marker."""
        if self.needs_dst is not None:
            return self.needs_dst
        if self.dst_columns:
            return True
        fields = {f.name: f for f in state.schema.fields}
        marked = StructType([fields["id"], StructField("__marker", BooleanType())])
        probe = state.sparkSession.createDataFrame([], StructType([StructField("src", StructType(state.schema.fields)), StructField("edge", StructType(edges.schema.fields)), StructField("dst", marked)]))
        try:
            shape = probe.select(*[m.alias(f"m{i}") for i, m in enumerate(self.to_src + self.to_dst)]).schema
        except AnalysisException:
            return True
        return "__marker" in shape.simpleString()

    def run(self) -> DataFrame:
        if not self.columns or not (self.to_src or self.to_dst) or self.aggregate is None:
            raise ValueError("a vertex column, a message and an aggregate are needed")
        g = self.graph
        rounds = Rounds(g.vertices.sparkSession, "pregel")
        rounds.level = self.level or rounds.level
        state = g.vertices.select("*", self.first_active.alias(ACTIVE), *[i.alias(n) for n, i, _ in self.columns])
        state = rounds.cut(state)
        reads_dst = self.reads_dst(state, g.edges)
        side = lambda df, want: df.columns if want is None else list(dict.fromkeys(["id", ACTIVE, *want]))
        src_cols, dst_cols = side(state, self.src_columns), side(state, self.dst_columns)
        edges = g.edges.select(F.struct(*[F.col(quote(c)) for c in g.edges.columns]).alias("edge"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
        edges = rounds.cache(edges.repartition("__s"))
        for k in range(self.max_iter):
            ends = state.select(F.struct(*[F.col(quote(c)) for c in src_cols]).alias("src"))
            if self.skip_inactive and not reads_dst:
                ends = ends.where(F.col("src")[ACTIVE])
            triplets = edges.join(ends, F.col("__s") == F.col("src")["id"])
            if reads_dst:
                others = state.select(F.struct(*[F.col(quote(c)) for c in dst_cols]).alias("dst"))
                triplets = triplets.join(others, F.col("__d") == F.col("dst")["id"])
                if self.skip_inactive:
                    triplets = triplets.where(F.col("src")[ACTIVE] | F.col("dst")[ACTIVE])
            else:
                triplets = triplets.withColumn("dst", F.struct(F.col("__d").alias("id")))
            sent = [F.struct(F.col(end)["id"].alias("id"), m.alias("m")) for end, ms in (("src", self.to_src), ("dst", self.to_dst)) for m in ms]
            messages = triplets.select(F.explode(F.array(*sent)).alias("x")).select(F.col("x.id").alias("id"), F.col("x.m").alias(MSG)).where(F.col(MSG).isNotNull())
            if self.early_stopping and messages.isEmpty():
                break
            received = messages.groupBy("id").agg(self.aggregate.alias(MSG))
            joined = state.join(received, "id", "left")
            plain = [F.col(quote(c)) for c in g.vertices.columns]
            state = joined.select(*plain, self.next_active.alias(ACTIVE), *[u.alias(n) for n, _, u in self.columns])
            if self.stop_if_inactive or self.early_stopping or (k + 1) % max(1, self.interval) == 0:
                state = rounds.cut(state)
                rounds.forget(3)
            if self.stop_if_inactive and state.where(ACTIVE).isEmpty():
                break
        return rounds.close(state)
