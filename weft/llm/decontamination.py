"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted Jaccard similarity of word shingles.

For every benchmark item of L words, every window of L consecutive words of every document is held against the item.

1. An inverted index of the items' shingles gives the weight that each item shares with a whole document. An item that shares too little
   can't pass in any window, so this loses nothing.
2. For the items that are left, all windows get a SimHash fingerprint of 256 bits. Features weigh the square root of the shingle's weight, so
   the cosine of two sets is at least 2 J / (1 + J) for a weighted Jaccard similarity of J, and the bits that differ are a binomial
   number. The radius lies 4.5 standard deviations above its mean at the threshold: a window at the threshold is lost with a
   probability of 3e-6, one above it with less. Fingerprints within the radius r are found by four blocks of 64 bits: by the pigeonhole
   principle one block differs in r / 4 bits at most, so none within r is lost; the other windows are dropped by that block test alone.
3. The windows within the radius are verified by the exact weighted Jaccard similarity. The weight of the distinct shingles of each
   window comes from running sums: a shingle counts in the windows that begin after its previous place. Weights are whole
   multiples of 2^-24, so sums are exact in any order.

The benchmark is used in blocks of a bounded number of items, each sent to the workers as a whole. Weights are those
of the whole benchmark for every block, so results don't depend on how it is split; for that, the shingles of more than one item
are counted once and sent along (all others have one weight).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import CHUNK_BYTES, LOWER, Scratch, batch_of, flat, hash_words, mix, pick, row_key, window_hash, word_spans

COUNTS = pa.schema([("s", pa.int64())])
FOUND = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64()), ("at", pa.int64()), ("windows", pa.int64())])
ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 20_000, 32 << 20
SHINGLE = 3
ONE = 1 << 24
BITS, BLOCKS = 256, 4
WINDOWS = 4096  # fingerprints made at a time
MOST_REPEATED = 16_000_000  # 16 bytes each


def shingled(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """Number of words and shingles of each text; a text of fewer than SHINGLE words is one shingle."""
    data, offs = flat(pa.array(texts, pa.large_string()))
    data = LOWER[data]
    starts, ends, words = word_spans(data, offs)
    hashed = hash_words(data, starts, ends)
    own = [hashed[a:b] for a, b in zip(words[:-1], words[1:])]
    return [(len(x), window_hash(x, min(SHINGLE, len(x))) if len(x) else x) for x in own]


def places(found: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `values` are in the sorted array `found`, and where there."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    same = np.flatnonzero(found[at] == values)
    return same, at[same]


class Weights:
    """Weight of any shingle: log(1 + items / items that have it) + 1. One that no item has weighs like one of a single item."""

    def __init__(self, count: int, repeated: np.ndarray, times: np.ndarray):
        self.repeated = repeated  # sorted: the shingles of more than one item
        self.of_repeated = np.rint((np.log(1 + count / times) + 1) * ONE).astype(np.int64)
        self.top = round((math.log(1 + count) + 1) * ONE)

    @classmethod
    def of_items(cls, items: list[np.ndarray]) -> Weights:
        found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, items)]), return_counts=True)
        return cls(len(items), found[times > 1], times[times > 1])

    @classmethod
    def of_table(cls, items: DataFrame) -> Weights:
        """The same from a table of any size, with texts in column t: one aggregate, of which repeated shingles come to the driver."""

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    for n, s in shingled(b.column(0).slice(lo, 1000).to_pylist()):
                        if n:  # a null for the item itself
                            yield pa.record_batch([pa.array([None, *np.unique(s).view(np.int64).tolist()], pa.int64())], schema=COUNTS)

        found = items.select("t").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("c")).where("c > 1 or s is null").limit(MOST_REPEATED + 1).toArrow()
        if found.num_rows > MOST_REPEATED:
            raise ValueError(f"more than {MOST_REPEATED} shingles repeat in the benchmark: too many to send to each worker; split it")
        shingles, times = found["s"].fill_null(0).to_numpy().view(np.uint64), found["c"].to_numpy()
        one = found["s"].is_null().to_numpy()
        order = np.argsort(shingles[~one])
        return cls(int(times[one].sum()), shingles[~one][order], times[~one][order])

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.top, np.int64)
        which, at = places(self.repeated, shingles)
        out[which] = self.of_repeated[at]
        return out


def earlier(values: np.ndarray) -> np.ndarray:
    """Place of the previous equal value, -1 where there is none."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1, np.int64)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def radius(threshold: float) -> int:
    """Bits in which a pair of sets at the threshold differs: the mean and 4.5 standard deviations."""
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return math.floor(BITS * p + 4.5 * math.sqrt(BITS * p * (1 - p)))


def votes(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What each shingle adds to each bit's sum: plus or minus the square root of its weight."""
    words = np.stack([mix(shingles + np.uint64(77 + 1000 * k)) for k in range(BITS // 64)], 1)
    signs = np.unpackbits(words.view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    return signs * np.rint(np.sqrt(weights / ONE) * 4096).astype(np.int32)[:, None]


def prints_of(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def window_prints(shingles: np.ndarray, weights: np.ndarray, before: np.ndarray, span: int, windows: int) -> np.ndarray:
    """SimHash fingerprints (four numbers of 64 bits) of the distinct shingles of each window of `span` places."""
    out = np.empty((windows, BITS // 64), np.uint64)
    for s in range(0, windows, WINDOWS):
        e = min(windows, s + WINDOWS)
        at = np.arange(s, e + span - 1)
        lo, hi = np.maximum(np.maximum(before[at], at - span) + 1, s) - s, np.minimum(at, e - 1) + 1 - s
        ok = np.flatnonzero(lo < hi)
        vote = votes(shingles[at[ok]], weights[at[ok]])
        kind = np.int32 if len(ok) * int(np.abs(vote[:, 0]).max(initial=0)) < 1 << 30 else np.int64
        parts = []
        for edge in (lo[ok], hi[ok]):  # a shingle counts from window lo on, and from hi on no more
            order = np.argsort(edge, kind="stable")
            running = np.zeros((len(ok) + 1, BITS), kind)
            np.cumsum(vote[order], axis=0, dtype=kind, out=running[1:])
            parts.append(running[np.searchsorted(edge[order], np.arange(e - s), "right")])
        out[s:e] = prints_of(parts[0] - parts[1])
    return out


def within(prints: np.ndarray, item: np.ndarray, most: int) -> np.ndarray:
    """Windows whose fingerprint lies within `most` bits of the item's: those of which a block does by its share, then by all bits."""
    maybe = np.zeros(len(prints), bool)
    for k in range(BLOCKS):
        maybe |= np.bitwise_count(prints[:, k] ^ item[k]) <= most // BLOCKS
    at = np.flatnonzero(maybe)
    return at[np.bitwise_count(prints[at] ^ item).sum(1, dtype=np.int64) <= most]


def distinct_sums(at: np.ndarray, weights: np.ndarray, before: np.ndarray, span: int, windows: int) -> np.ndarray:
    """For each window of `span` places, the weight of the distinct shingles among those at `at`."""
    lo, hi = np.maximum(np.maximum(before, at - span) + 1, 0), np.minimum(at, windows - 1) + 1
    ok = lo < hi
    steps = np.zeros(windows + 1, np.int64)
    np.add.at(steps, lo[ok], weights[ok])
    np.subtract.at(steps, hi[ok], weights[ok])
    return np.cumsum(steps[:-1])


class Index:
    """Benchmark items with their shingles, and the items that have a shingle."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, weights: Weights | None = None):
        """weights: those of the whole benchmark if `rows` are only a part of it."""
        kept = [(item, n, s) for (item, _), (n, s) in zip(rows, shingled([t for _, t in rows])) if n]
        self.threshold = threshold
        self.weights = weights or Weights.of_items([s for _, _, s in kept])
        self.item, self.words = [i for i, _, _ in kept], np.array([n for _, n, _ in kept], np.int64)
        sets = [np.unique(s) for _, _, s in kept]
        self.known, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        self.known_w = self.weights.of(self.known)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.known & np.uint64((1 << 20) - 1)] = True
        # own: the known shingles of each item; having: the items of each known shingle
        sizes = [len(x) for x in sets]
        self.own = np.split(inverse, np.cumsum(sizes)[:-1]) if sets else []
        self.full = np.array([self.known_w[x].sum() for x in self.own], np.int64)
        self.prints = np.concatenate([np.zeros((0, BITS // 64), np.uint64), *[prints_of(votes(self.known[x], self.known_w[x]).sum(0, dtype=np.int64, keepdims=True)) for x in self.own]])
        self.radius = radius(threshold)
        self.having = np.repeat(np.arange(len(sets)), sizes)[np.argsort(inverse, kind="stable")]
        self.bounds = np.searchsorted(np.sort(inverse), np.arange(len(self.known) + 1))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"weights": None}  # sent by themselves, once for all blocks

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shingles that some item has, and which of the known ones they are."""
        maybe = np.flatnonzero(self.sieve[shingles & np.uint64((1 << 20) - 1)])
        which, at = places(self.known, shingles[maybe])
        return maybe[which], at

    def search(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, best similarity, its first word, windows that pass) for one document's word hashes."""
        best: dict[int, tuple[float, int, int]] = {}
        sizes = np.minimum(SHINGLE, self.words)
        for g in np.unique(sizes).tolist():
            if len(words) < g:
                continue
            shingles = window_hash(words, g)
            at, which = self.hits(shingles)
            if not len(at):
                continue
            # the weight that each item shares with the whole document
            seen = np.unique(which)
            many = self.bounds[seen + 1] - self.bounds[seen]
            entries = np.repeat(self.bounds[seen] - np.cumsum(many) + many, many) + np.arange(many.sum())
            shared = np.zeros(len(self.item), np.int64)
            np.add.at(shared, self.having[entries], np.repeat(self.known_w[seen], many))
            picked = np.flatnonzero((shared >= self.threshold * self.full) & (sizes == g))
            if not len(picked):
                continue
            before, weights, last = earlier(shingles), self.weights.of(shingles), None
            for k in picked[np.argsort(self.words[picked], kind="stable")].tolist():
                span = min(int(self.words[k]), len(words)) - g + 1
                windows = len(shingles) - span + 1
                if span != last:
                    prints, total, last = window_prints(shingles, weights, before, span, windows), None, span
                near = within(prints, self.prints[k], self.radius)
                if not len(near):
                    continue
                if total is None:
                    total = distinct_sums(np.arange(len(shingles)), weights, before, span, windows)
                own = at[np.isin(which, self.own[k])]
                common = distinct_sums(own, weights[own], before[own], span, windows)
                similarity = common / (self.full[k] + total - common)
                passed = near[similarity[near] >= self.threshold]
                if len(passed):
                    p = int(passed[np.argmax(similarity[passed])])
                    have = best.get(self.item[k], (0.0, 0, 0))
                    s, p = max((have[0], -have[1]), (float(similarity[p]), -p))
                    best[self.item[k]] = (s, -p, have[2] + len(passed))
        return [(i, *b) for i, b in best.items()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains, whole or nearly.

    Columns: id, _row (a hash of the text; tells apart rows of one id), item_id, similarity (of the best window),
    at (its first word), windows (number of windows that pass). A-Z are lower-cased; words are runs of anything
    but ASCII white space. A pair is found if a window of the item's length has a weighted Jaccard similarity of
    3-word shingles of at least `threshold`, but for a probability of 3e-6 for each such window (see the module). Items of fewer than 3 words are compared as a whole. Nulls: a null or blank text or item matches nothing; null ids are kept as null.
    Repeated rows give repeated pairs once each. A benchmark in which more than MOST_REPEATED shingles repeat is refused. Other columns are ignored; empty tables give an empty result.
    """
    items = pick(benchmark, i=item_col, t=item_text_col).select(F.col("i").cast("long").alias("i"), F.col("t").cast("string").alias("t")).where("trim(t) <> ''")
    rows = pick(docs, i=id_col, t=text_col).select(F.col("i").cast("long").alias("i"), F.col("t").cast("string").alias("t"))
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / ITEMS_PER_BLOCK), math.ceil(size / BYTES_PER_BLOCK))
    context, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "decontamination")
    weights = Weights.of_table(items) if blocks > 1 else None
    common, result = None, None
    for k in range(blocks):
        # a bounded number of items at a time
        block = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()]
        index = Index(block, threshold, weights)
        common = common or context.broadcast(index.weights)
        shared = context.broadcast(index)
        part = scan(rows, shared, common, min(index.full.tolist(), default=0) * threshold).distinct()
        if blocks > 1:
            part = scratch.cut(part, "block")
            shared.destroy()  # one block in memory at a time
        result = part if result is None else result.unionAll(part)
    if blocks > 1:
        # one row for an item id whose texts lie in several blocks, as within a block
        best = F.max(F.struct("similarity", (-F.col("at")).alias("p"))).alias("best")
        result = result.groupBy("id", "row", "item").agg(best, F.sum("windows").alias("windows")).select("*", "best.similarity", (-F.col("best.p")).alias("at"))
    return result.select(F.col("id").alias(id_col), F.col("row").alias("_row"), F.col("item").alias("item_id"), "similarity", "at", "windows")


def scan(docs: DataFrame, shared: Broadcast, common: Broadcast, least: float) -> DataFrame:
    """Pairs of the documents (i, t) and the items of one block."""

    def run(batches):
        idx = shared.value
        idx.weights = common.value
        lengths = np.unique(np.minimum(SHINGLE, idx.words)).tolist()
        for b in batches:
            data, offs = flat(b.column(2))
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            at, out = 0, []
            while at < len(ids) and lengths:
                to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES))), len(ids))
                text, own = LOWER[data[offs[at] : offs[to]]], offs[at : to + 1] - offs[at]
                starts, ends, words = word_spans(text, own)
                hashed = hash_words(text, starts, ends)
                weight = np.zeros(len(hashed) + 1, np.int64)
                for g in lengths:
                    at_hit, which = idx.hits(window_hash(hashed, g))
                    weight[at_hit] += idx.known_w[which]
                sums = np.concatenate([[0], np.cumsum(weight)])
                for i in np.flatnonzero(sums[words[1:]] - sums[words[:-1]] >= least).tolist():
                    if words[i + 1] > words[i]:
                        out += [(ids[at + i], rows[at + i], item, s, p, n) for item, s, p, n in idx.search(hashed[words[i] : words[i + 1]])]
                at = to
            yield batch_of(FOUND, out)

    return docs.select("i", row_key(F.col("t")).alias("r"), "t").mapInArrow(run, "id long, row long, item long, similarity double, at long, windows long")
