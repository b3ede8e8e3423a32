"""Exact top-k inner products by MaxScore.

A vector's components are its terms; a shard (a packed block of rows) keeps each term's postings as one
column, with the largest and smallest value of the term in the shard. For a query, a term's contribution ranges
between two bounds; terms are ordered by the width of that range. Those of the smallest width, whose
widths can't lift a row from its worst case to the k-th best score so far, are non-essential: essential postings are traversed
for all rows, and the others are probed, widest first, only for rows that are still competitive.
A task goes through its shards with the best scores so far; the tasks' rows are merged by score and id.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import Scratch, batch_of, batch_rows, dec, enc, pick

SHARD_ROWS, QUERY_BYTES = 4096, 32 << 20
PACK = pa.schema([("ids", pa.binary()), ("width", pa.int32()), ("body", pa.binary())])
HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
EXACT = 1 << 53


def matrix(lists: pa.Array) -> np.ndarray:
    """A row for each list; shorter ones are filled up with zeros."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(n.max()) if len(n) else 0
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def shards(vectors: DataFrame, size: int) -> DataFrame:
    """(id, v) rows in packed blocks of at most `size` rows."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b.slice(lo, size)
                body = matrix(part.column(1))
                yield batch_of(PACK, [(enc(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)), body.shape[1], enc(body))])

    return vectors.mapInArrow(run, "ids binary, width int, body binary")


def opened(r: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = dec(r["ids"], np.int64)
    return ids, dec(r["body"], np.int64).reshape(len(ids), r["width"])


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def top_of_shard(query: np.ndarray, ids: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, smallest id first) rows of one shard and of `best`. terms: a row per term, a column per vector.

    Numbers are int64, or float64 where all sums are below 2 ** 53 and so exact."""
    a, b = query * low, query * high
    floor, width = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(width, kind="stable")
    order = order[width[order] > 0]
    base = floor.sum()
    rest = np.concatenate([[0], np.cumsum(width[order])])  # rest[i]: of the i narrowest terms
    best_s, best_i = best if best is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    step = 1024
    for lo in range(0, len(ids), step):
        block = terms[:, lo : lo + step]
        at = np.arange(block.shape[1])
        score = np.full(block.shape[1], base)
        limit = best_s[-1] if len(best_s) == k else None
        if limit is not None and base + rest[-1] < limit:
            break  # no row of this shard can reach the k-th best
        # non-essential: the narrowest terms that together can't reach the limit from the base
        split = 0 if limit is None else int(np.searchsorted(rest, limit - base, "left")) - 1
        split = max(0, min(split, len(order)))
        essential = order[split:]
        score += query[essential] @ block[essential] - floor[essential].sum()
        for t in range(split, 0, -1):
            keep = score + rest[t] >= limit
            if not keep.all():
                at, score = at[keep], score[keep]
            if not len(at):
                break
            term = order[t - 1]
            score = score + query[term] * block[term, at] - floor[term]
        if limit is not None:
            keep = score >= limit
            at, score = at[keep], score[keep]
        i = ids[lo + at]
        other = i != own
        if not other.any():
            continue
        best_s, best_i = np.concatenate([best_s, score[other].astype(np.int64)]), np.concatenate([best_i, i[other]])
        keep = np.lexsort((best_i, -best_s))[:k]
        best_s, best_i = best_s[keep], best_i[keep]
    return best_s, best_i


def max_score_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products, ties to the smaller id.

    Both inputs: (id long, v array<long>). A row never matches a query of its own id. Null ids are left out, as are
    null vectors; shorter vectors, empty ones too, count as filled up with zeros. Fewer than k candidates: all of them. Repeated
    rows of one id are separate candidates, and separate queries are counted once. Empty tables give an empty result.
    The shards stay where they are: queries are sent to them in blocks of at most QUERY_BYTES, one block after the other, and each
    task returns k rows a query.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "topk")
    ok = "id is not null and v is not null"
    rows = scratch.cut(shards(vectors.where(ok).select("id", "v"), SHARD_ROWS), "rows")
    asked = scratch.cut(shards(queries.where(ok).select("id", "v").dropDuplicates(["id"]), SHARD_ROWS).withColumn("m", F.monotonically_increasing_id()), "queries")
    size = F.length("ids") + F.length("body")
    numbers, blocks, left = asked.select("m", (F.col("width") * 8 * SHARD_ROWS + size).alias("n")).orderBy("m").collect(), [], 0  # a row for 4096 queries
    for m, n in numbers:
        if not blocks or n > left:
            blocks.append([])
            left = QUERY_BYTES
        blocks[-1].append(m)
        left -= n
    parts = []
    for block in blocks:
        packed = [opened(r.asDict()) for r in asked.where(F.col("m").between(block[0], block[-1])).collect()]
        width = max(q.shape[1] for _, q in packed)
        shared = spark.sparkContext.broadcast((np.concatenate([i for i, _ in packed]), np.concatenate([widened(q, width) for _, q in packed])))

        def run(batches):
            q_ids, query = shared.value
            best: list = [None] * len(q_ids)
            most = np.abs(query).max(initial=0)
            for batch in batches:
                for r in batch_rows(batch):
                    ids, body = opened(r)
                    width = max(body.shape[1], query.shape[1])
                    terms = np.ascontiguousarray(widened(body, width).T)
                    q = widened(query, width)
                    if int(most) * int(np.abs(terms).max(initial=0)) * 4 * max(1, width) < EXACT:
                        terms, q = terms.astype(np.float64), q.astype(np.float64)
                    low, high = terms.min(1), terms.max(1)
                    for n, own in enumerate(q_ids.tolist()):
                        best[n] = top_of_shard(q[n], ids, terms, low, high, own, k, best[n])
            for lo in range(0, len(q_ids), 4096):
                out = [(own, i, s) for own, x in zip(q_ids[lo : lo + 4096].tolist(), best[lo : lo + 4096]) if x is not None for s, i in zip(x[0].tolist(), x[1].tolist())]
                yield batch_of(HIT, out)

        hits = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        if len(blocks) > 1:
            hits = scratch.cut(hits, "hits")
            shared.destroy()
        parts.append(hits)
    hits = parts[0] if parts else spark.createDataFrame([], "query_id long, vec_id long, score long")
    for part in parts[1:]:
        hits = hits.unionAll(part)
    # row_number <= k under a window: Spark keeps k rows a group before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of every component, x as double; rows with a null vector or with null, NaN or infinite components are left out."""
    df, v = pick(df, id=id_col, v=vector_col), F.col("v").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(good).select(F.col("id").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


SQL = """
with v as (select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.e, c.e)])::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
