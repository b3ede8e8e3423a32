"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / w, with u from a hash of its id and w its quality
weight; within a source, ascending keys are a weighted random order without replacement. A source's
target is met by complete passes over it, then by documents in key order up to the words that
remain (the last of them in part).

Prefix sums don't need a source in one task: words are summed by (source, leading bits of the key), which
combines before the shuffle, and only the bucket in which a source's budget ends is looked at again, by further
bits of the key, then of the id, the size and a tie-breaker, until few rows are left in it. Those alone are sorted.
Any weights and any number of equal keys are split like this.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import Scratch, pick

JUNK = "0123456789#$%&*@^~|<>{}[]\\=+_"
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 20_000
EDGE_ROWS = 200_000
# What orders the documents of a source, and the shifts at which prefixes of it make buckets: at most 2 ** 20 of them.
LEVELS = [("key", 42), ("key", 26), ("key", 10), ("key", 0), ("no_id", 0), ("id_bits", 44), ("id_bits", 26), ("id_bits", 8), ("id_bits", 0), ("size", 16), ("size", 0), ("tie", 44), ("tie", 26), ("tie", 8), ("tie", 0)]


def quality_weight(text: Column) -> Column:
    """Squared share of characters that are neither digits nor symbols, 0.05 at least. Labels of quality exist for some documents
    only, and a mix needs a weight for each, so the weight is made of the text alone; callers may give another."""
    n = F.length(text)
    return F.greatest(F.lit(0.05), F.when(n == 0, 0.05).otherwise(F.pow(F.length(F.translate(text, JUNK, "")) / n, F.lit(2))))


def water_level(sizes: np.ndarray, w: np.ndarray, ratio: float, cap: float) -> float:
    """The level at which sum(min(w * level, cap * size)) is ratio x all sizes; each round fills up at least one more source."""
    total, level = float(sizes.sum()), 0.0
    while True:
        full = w * level > cap * sizes
        open_ = float(w[~full].sum())
        now = (ratio * total - float((cap * sizes[full]).sum())) / open_ if open_ else level
        if now <= level * (1 + 1e-15):
            return level
        level = now


def source_targets(scratch: Scratch, sizes: DataFrame, ratio: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, target): sources in code point order, null last, weigh `weights` in turn and share
    ratio x all words; what exceeds cap x a source's size is shared among the others by weight."""
    # a global rank without a single-task window: range partitions, then an offset for each
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = scratch.cut(ranged.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")), "rank")
    before, offsets = 0, []
    for p, c in sorted(ranged.groupBy("p").count().collect()):  # as many rows as partitions
        offsets.append((p, before))
        before += c
    starts = F.create_map(*[F.lit(x) for o in offsets for x in o]) if offsets else F.lit(None)
    rank = F.col("k") + (F.element_at(starts, F.col("p")) if offsets else F.lit(0))
    table = ranged.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")).alias("w"))
    most = F.col("source_size") * cap
    if before <= BROADCAST_SOURCES:
        few = table.select("source_size", "w").toArrow()  # a bounded number of pairs
        level = water_level(few["source_size"].to_numpy().astype(float), few["w"].to_numpy(), ratio, cap)
    else:  # the same rounds, one aggregate each
        total, level = table.agg(F.sum("source_size")).first()[0], 0.0
        while True:
            full = F.col("w") * level > most
            taken, open_ = table.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
            now = (ratio * total - taken) / open_ if open_ else level
            if now <= level * (1 + 1e-15):
                break
            level = now
    return table.select("source", "source_size", F.least(F.col("w") * level, most).cast("double").alias("target"))


def prefix(depth: int) -> list[Column]:
    """The parts of a row's place that the first `depth` levels tell."""
    finest = dict(LEVELS[:depth])
    return [F.shiftright(F.col(c), s).alias(c) for c, s in finest.items()]


def at_source(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source's plan (source in s)."""
    if few:
        return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    # many sources: a salted join, as one source may hold a third of all rows
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return rows.withColumn("salt_", F.pmod(F.col("tie"), F.lit(32))).join(salted.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("salt_") == F.col("salt"))).drop("salt_", "salt")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, ratio: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 42) -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target (of its source), taken (words the mix takes).

    taken sums up to each source's target, less at most one word; it never exceeds (whole passes + 1) x size.
    weight: an expression over the columns of docs, positive. Nulls: a null text has size 0; null sources form one source, after all others; a null id is hashed
    like any other value and comes after all ids. Ties and repeated rows share a key and are taken in order of (id, size); rows equal in all of that
    are interchangeable. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    if weight is not None:
        docs = docs.select("*", weight.cast("double").alias("weft weight"))
    rows = pick(docs, id=id_col, text=text_col, source=source_col, **({"w": "weft weight"} if weight is not None else {}))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    weight = quality_weight(text) if weight is None else F.col("w")
    unit = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(str(seed)))), 1, 12), 16, 10).cast("long") + 1) / F.lit(float(2**48 + 1))
    # equal rows are interchangeable, so the tie-breaker needn't be the same in each run; it is written once for this one
    stored = scratch.cut(rows.select("id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(unit) / weight).alias("z"), F.xxhash64(F.monotonically_increasing_id()).alias("tie")), "sized")
    sizes = scratch.cut(stored.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("z").alias("most")), "sizes")
    most = sizes.agg(F.max("most")).first()[0] or 0.0
    # whole numbers in the order of z, as fine as the largest of them allows
    scale = 2.0 ** min(52, 61 - math.ceil(math.log2(most + 1)))
    sized = stored.select("*", F.floor(F.col("z") * scale).cast("long").alias("key"), F.col("id").isNull().cast("long").alias("no_id"), F.coalesce(F.col("id").try_cast("long"), F.lit(0)).alias("id_bits"))
    targets = source_targets(scratch, sizes.select("source", "source_size"), ratio, cap, weights)
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size") + 1e-12)).cast("long")
    targets = targets.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 1e-6)).cast("long"))
    plan = scratch.cut(targets.select(F.col("source").alias("s"), "source_size", "target", "passes", F.col("rest").alias("budget")), "plan-0")
    few = plan.count() <= BROADCAST_SOURCES
    for depth in range(1, len(LEVELS) + 1):
        # of each source: the first bucket at which its budget is used up, and the budget for that bucket
        now, before = prefix(depth), prefix(depth - 1)
        names = [c for c in dict.fromkeys(c for c, _ in LEVELS[:depth])]
        inside = at_source(sized, plan.select("s", "edge") if depth > 1 else plan.select("s"), few)
        if depth > 1:
            inside = inside.where(F.struct(*before) == F.col("edge"))
        buckets = inside.groupBy("source", *now).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        order = Window.partitionBy("source").orderBy(*names)
        buckets = buckets.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumnRenamed("source", "of")
        ends = plan.join(buckets.hint("merge"), F.col("s").eqNullSafe(F.col("of")) & (F.col("upto") > F.col("budget")), "left")
        place = F.struct(*names)
        first = F.min(F.struct(place.alias("edge"), (F.col("upto") - F.col("words")).alias("b"), "n")).alias("at")
        ends = ends.groupBy("s").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "passes", "budget")], first)
        # where the budget is never used up, all documents come before the edge
        plan = scratch.cut(ends.select("s", "source_size", "target", "passes", (F.col("budget") - F.coalesce("at.b", F.lit(0))).alias("budget"), F.when(F.col("at.edge").isNotNull(), F.col("at.edge")).alias("edge"), "at.n"), f"plan-{depth}")
        if (plan.agg(F.max("n")).first()[0] or 0) <= EDGE_ROWS:
            break
    scratch.keep(stored, plan)
    here = F.struct(*prefix(depth))
    joined = at_source(sized, plan, few)
    whole = joined.where(F.col("edge").isNull() | (here != F.col("edge")))
    whole = whole.withColumn("extra", F.when(F.col("edge").isNull() | (here < F.col("edge")), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "no_id", "id_bits", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = joined.where(here == F.col("edge")).withColumn("extra", F.sum("size").over(order)).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("extra") + F.col("size"))))
    columns = [F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken")]
    return whole.select(*columns).unionAll(edge.select(*columns))


SQL = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':42'), 1, 12))::bigint + 1) / 281474976710657.0::double)
    / greatest(0.05, case when length(coalesce(text, '')) = 0 then 0.05 else pow(length(translate(text, '0123456789#$%&*@^~|<>{}[]\=+_', '')) / length(text)::double, 2) end) as z
  from documents),
src as (select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from sized group by source),
levels as (
  select 0 as k, 0.0::double as level
  union all
  select l.k + 1, (select case when sum(case when w * l.level > 2.0 * source_size then 0 else w end) > 0 then (1.5 * sum(source_size) - sum(case when w * l.level > 2.0 * source_size then 2.0 * source_size else 0 end)) / sum(case when w * l.level > 2.0 * source_size then 0 else w end) else l.level end from src)
  from levels l where l.k < 60),
targets as (select source, source_size, least(w * (select max(level) from levels), 2.0 * source_size)::double as target from src),
plan as (select *, case when source_size = 0 then 0 else floor(target / source_size + 1e-12)::bigint end as passes from targets),
budget as (select *, greatest(0, floor(target - passes * source_size + 1e-6)::bigint) as rest from plan),
pre as (select s.doc_id, s.size, s.source, s.z, sum(s.size) over (partition by s.source order by s.z, s.doc_id nulls last, s.size rows unbounded preceding) as upto from sized s)
select p.doc_id, p.size, b.source_size, b.target, (b.passes * p.size + greatest(0, least(p.size, b.rest - p.upto + p.size)))::bigint as taken
from pre p join budget b on p.source is not distinct from b.source
"""
