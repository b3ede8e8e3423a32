"""Shared plumbing: written cuts, packed chunks of text, codecs."""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.iterate import remove_table, shared_dir

CHUNK_BYTES = 2 << 20
CHUNK_DOCS = 60_000
CHUNK_SCHEMA = "chunk long, n_docs int, n_words long, ids binary, nulls binary, rows binary, offs binary, body binary"
NO_ID = np.iinfo(np.int64).max


def worker_cache() -> dict:
    """A dict that outlives one task in a reused Python worker."""
    import pyspark

    return pyspark.__dict__.setdefault("_weft_cache", {})


TRAINED: dict = {}


def in_a_task(spark: SparkSession, train, *args):
    """What train(*args) returns, computed in one task of the cluster, so that its time and memory aren't the driver's; kept for later calls."""
    key = (train.__module__, train.__qualname__, args)
    if key not in TRAINED:

        def run(batches):
            for _ in batches:
                pass
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(*args))], pa.binary())], names=["model"])

        TRAINED[key] = pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "model binary").first()[0])
    return TRAINED[key]


class Scratch:
    """Tables of one call in the shared folder. Each ends the lineage of what it holds and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.home, self.made = spark, f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}", 0
        self.tables: list[tuple[str, DataFrame]] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.home}/{self.made}-{name}"
        self.made += 1
        df.write.parquet(path)
        done = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, done))
        return done

    def keep(self, *kept: DataFrame) -> None:
        """Delete all tables but these: what was made of the others is written itself."""
        stay = [(p, t) for p, t in self.tables if any(t is k for k in kept)]
        for path, _ in set(self.tables) - set(stay):
            remove_table(self.spark, path)
        self.tables = stay


def plain(docs: DataFrame) -> DataFrame:
    """The rows with their columns named c0, c1, ..., so that no column, whatever its name, clashes with ours."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """The columns of these exact names, renamed: pick(docs, id="doc_id")."""
    return plain(docs).select(*[F.col(f"c{docs.columns.index(c)}").alias(k) for k, c in columns.items()])


def row_key(text: Column) -> Column:
    """A hash of a text that tells apart rows of one id; 0 for null."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text, F.length(text)))


# == words as numpy arrays

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    r = int(rng.integers(1 << 62)) * 2 + 1
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r, pow(r, -1, 1 << 64)


FAMILIES = (_tables(11), _tables(12))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, kept between calls."""
    cache = worker_cache()
    have = cache.get(("pow", base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        cache[("pow", base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = (a.cast(pa.large_binary()) if a.type != pa.large_string() else a).fill_null(b"" if a.type != pa.large_string() else "")
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(a) and a.buffers()[2] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and each document's n + 1 word offsets."""
    solid = ~WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of every word. Words of over 256 bytes are hashed by blake2b."""
    table, r, r_inv = FAMILIES[family]
    out = np.empty(len(starts), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            e = max(k + 1, int(np.searchsorted(starts, starts[k] + (1 << 19))))
            e = e - 1 if e - k > 1 and ends[e - 1] - starts[k] > 1 << 20 else e
            lo, hi = int(starts[k]), int(ends[e - 1])
            if hi - lo > 1 << 20:
                out[k:e] = 0
            else:
                sums = np.empty(hi - lo + 1, np.uint64)
                sums[0] = 0
                np.cumsum(table[data[lo:hi]] * powers(r, hi - lo), out=sums[1:])
                s = starts[k:e] - lo
                out[k:e] = (sums[ends[k:e] - lo] - sums[s]) * powers(r_inv, hi - lo)[s]
            k = e
        lengths = (ends - starts).astype(np.uint64)
        out = mix(out ^ (lengths * np.uint64(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(lengths > 256):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([family])).digest(), "little")
    return out


def window_hash(words: np.ndarray, m: int, family: int = 0) -> np.ndarray:
    """A hash of every m consecutive values (also across documents; the caller masks those)."""
    n = len(words) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, r, r_inv = FAMILIES[1 - family]
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, n, 1 << 19):
            hi = min(n, lo + (1 << 19))
            sums = np.empty(hi - lo + m, np.uint64)
            sums[0] = 0
            np.cumsum(words[lo : hi + m - 1] * powers(r, hi - lo + m - 1), out=sums[1:])
            out[lo:hi] = mix((sums[m:] - sums[: hi - lo]) * powers(r_inv, hi - lo) + np.uint64(m))
    return out


# == packed arrays


def squeeze(raw: bytes | memoryview) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def stretch(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def enc_sorted(codes: np.ndarray) -> bytes:
    """Sorted uint64 values as byte planes of their differences."""
    if not len(codes):
        return b""
    steps = np.diff(codes, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8)
    used = 8 - int(np.argmax(planes[:, ::-1].any(0)))
    return bytes([used]) + squeeze(np.ascontiguousarray(planes[:, :used].T))


def dec_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(stretch(blob[1:]), np.uint8).reshape(blob[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : blob[0]] = planes.T
    return np.cumsum(steps.view("<u8")[:, 0])


def enc(a: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(a)) if len(a) else b""


def dec(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(stretch(blob), kind) if blob else np.zeros(0, kind)


def enc_bits(a: np.ndarray) -> bytes:
    return enc(np.packbits(a))


def dec_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(dec(blob, np.uint8), count=n).astype(bool)


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key, by its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


# == chunks of documents


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """Documents in compressed chunks of about 2 MB: one row each, with a chunk number.

    A null id is kept as the largest long and marked in `nulls` (empty where no id is null); a null text is an empty one.
    with_rows: also each document's row_key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 20
        seq = 0
        for b in batches:
            data, offs = flat(b.column(1))
            ids = b.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
            none = b.column(0).is_null().to_numpy(zero_copy_only=False)
            keys = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if with_rows else None
            at = 0
            while at < len(ids):
                to = int(np.searchsorted(offs, offs[at] + CHUNK_BYTES))
                to = min(max(at + 1, to), at + CHUNK_DOCS, len(ids))
                part, own = data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
                n_words = len(word_spans(part, own)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + seq], pa.int64()), pa.array([to - at], pa.int32()), pa.array([n_words], pa.int64()), *(pa.array([x], pa.binary()) for x in (enc(ids[at:to]), enc_bits(none[at:to]) if none[at:to].any() else b"", enc(keys[at:to]) if with_rows else b"", enc(own), enc(part)))],
                    ["chunk", "n_docs", "n_words", "ids", "nulls", "rows", "offs", "body"],
                )
                seq += 1
                at = to

    text = F.col("t").cast("string")
    columns = pick(docs, i=id_col, t=text_col).select(F.col("i").cast("long").alias("i"), text.alias("t"), *([row_key(text).alias("r")] if with_rows else []))
    return columns.mapInArrow(run, CHUNK_SCHEMA)


class Chunk:
    """A packed chunk, opened: words as byte spans, hashed on demand."""

    def __init__(self, row: dict, lower: bool = False):
        self.chunk = row["chunk"]
        self.ids, self.offs = dec(row["ids"], np.int64), dec(row["offs"], np.int64)
        self.null = dec_bits(row["nulls"], len(self.ids)) if row["nulls"] else np.zeros(len(self.ids), bool)
        self.rows = dec(row["rows"], np.int64) if row["rows"] else np.zeros(len(self.ids), np.int64)
        self.data = dec(row["body"], np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.starts, self.ends, self.words = word_spans(self.data, self.offs)
        self.counts = np.diff(self.words)
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)

    def real_ids(self) -> list:
        """Ids as they were given, null as None."""
        return [None if none else i for i, none in zip(self.ids.tolist(), self.null.tolist())]

    def hashes(self, family: int = 0) -> np.ndarray:
        return hash_words(self.data, self.starts, self.ends, family)

    def valid(self, m: int) -> np.ndarray:
        """Positions at which m words follow within the document."""
        left = np.repeat(self.words[1:], self.counts) - np.arange(len(self.doc))
        return np.flatnonzero(left >= m)


def batch_rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch one by one; only one row's values are Python objects at a time."""
    for i in range(b.num_rows):
        yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch_of(schema, rows)], schema)
