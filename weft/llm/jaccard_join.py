"""Exact n-gram Jaccard self-join by PartEnum signatures.

Sets are put into bands by size; two sets of sufficient similarity lie in the
same band or in adjacent ones, and so meet in the instance of the lower band.
There, their symmetric difference has at most k elements. The feature domain is
split by a hash into n > k partitions: at most k of them can differ, so at
least n - k are equal in both sets. A set's signatures are its non-empty
partitions (first-level PartEnum with subsets of one partition); n is chosen so
that nearly every set has more than k non-empty ones, which makes a common
signature sure. Of those, only the k + 1 with the most elements (ties by hash) are
emitted: two similar sets with e and f empty partitions have at least
n - k - min(e, f) non-empty ones in common, each leaves out fewer than that of its last ones in an order that
is the same for all sets, and so the first common one is emitted by both. The
few sets with no more than k non-empty partitions ("sparse") also emit
signatures under further hash seeds, and what is sparse under all of them one
common signature, so no pair is lost.

Equal sets are collapsed to one class before any signature is made. Candidates
are first compared by short vectors, one byte for each of about s / 2 partitions of
the domain: every partition that differs holds an element of the symmetric difference, so
a pair with too many of them is surely not similar. The rest are verified against the whole sets. Within a group of classes with a common
signature every pair of different sets has to be verified, as each may be a
link; large groups are emitted as blocks of ids and expanded in other tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import (Chunk, Scratch, batch_of, batch_rows, dec, dec_bits, dec_sorted, enc, enc_bits, enc_sorted, hash_words, mix, pack, parts_of, table_of, window_hash)
from weft.llm.substring_dedup import ddl, slices
from weft.operators.components import star_components

MEMBERS = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("cid", pa.int64()), ("vector", pa.binary())])
SIGNATURES = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()), ("at", pa.binary()), ("high", pa.binary())])
BLOCKS = pa.schema([("pairwise", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SETS = pa.schema([("key", pa.int64()), ("cid", pa.int64()), ("body", pa.binary())])
CODE = np.uint64((1 << 40) - 1)
SEEDS, BLOCK, CELL_PAIRS = 3, 512, 500_000.0


def ngram_sets(c: Chunk, n: int) -> list[np.ndarray]:
    """Each document's distinct n-word shingles as sorted hashes; with fewer words, the whole sequence as one."""
    words = c.hashes()
    at = c.valid(n)
    grams = window_hash(words, n)
    out = [None] * len(c.ids)
    ends = np.searchsorted(c.doc[at], np.arange(len(c.ids) + 1)) if len(at) else np.zeros(len(c.ids) + 1, int)
    grams = grams[at]
    for i, k in enumerate(c.counts.tolist()):
        if k >= n:
            out[i] = np.unique(grams[ends[i] : ends[i + 1]])
        else:
            out[i] = window_hash(words[c.words[i] : c.words[i + 1]], k) if k else grams[:0]
    return out


def bands(limit: int, percent: int) -> list[int]:
    """Lower bounds of the size bands: a set and one that may be similar are at most one band apart."""
    b = [1, 2]
    while b[-1] <= limit:
        b.append(max(b[-1] + 1, (b[-1] - 1) * 100 // percent + 1))
    return [*b, max(b[-1] + 1, (b[-1] - 1) * 100 // percent + 1)]


def partitions(bound: list[int], i: int, percent: int) -> tuple[int, int]:
    """Of instance i: the largest possible symmetric difference k, and the number of partitions n."""
    r = bound[i + 1] - 1
    s = min(r * 100 // percent, bound[i + 2] - 1)
    k = max((x + y) * (100 - percent) // (100 + percent) for x, y in ((r, r), (r, s)))
    n, small = k + 1, bound[i]
    while n < 64 * (k + 1):
        full = math.exp(-small / n)
        mean = n * (1 - (1 - 1 / n) ** small)
        sd = math.sqrt(max(0.0, n * full * (1 - (1 + small / n) * full)))
        if mean - 4.5 * sd > k + (0 if k == 0 else 0.5):
            break
        n += max(1, k // 16)
    return k, n


def signatures(sets: list[np.ndarray], at: np.ndarray, percent: int):
    """(keys, index into `at`, is the set in the higher band of the instance) of all signatures."""
    sizes = np.array([len(sets[i]) for i in at], np.int64)
    bound = bands(int(sizes.max()), percent)
    band = np.searchsorted(bound, sizes, "right") - 1
    plan = {i: partitions(bound, i, percent) for i in {*band.tolist(), *(band - 1).tolist()} if i >= 0}
    every = np.concatenate([sets[i] for i in at])
    owner = np.repeat(np.arange(len(at)), sizes)
    keys, who, high = [], [], []
    for up in (0, 1):
        inst = band - up
        k = np.array([plan.get(i, (0, 0))[0] for i in inst.tolist()], np.int64)
        n = np.array([plan.get(i, (0, 0))[1] for i in inst.tolist()], np.int64)
        open_ = inst >= 0
        for seed in range(SEEDS + 1):
            if not open_.any():
                break
            if seed == SEEDS:
                left = np.flatnonzero(open_)
                keys.append(mix((inst[left].astype(np.uint64) << np.uint64(8)) + np.uint64(255)))
                who.append(left)
                high.append(np.full(len(left), bool(up)))
                break
            own = open_[owner]
            x, o = every[own], owner[own]
            salt = np.uint64((seed + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))
            p = (((mix(x ^ salt) >> np.uint64(32)) * n[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n * open_)])
            slot = first[o] + p
            sums, counts = np.zeros(first[-1], np.uint64), np.bincount(slot, minlength=first[-1])
            np.add.at(sums, slot, mix(x + salt))
            used = np.flatnonzero(counts)
            doc = np.searchsorted(first, used, "right") - 1
            tag = (inst[doc].astype(np.uint64) << np.uint64(40)) | (np.uint64(seed) << np.uint64(36)) | (used - first[doc]).astype(np.uint64)
            key = mix(sums[used] + mix(tag))
            order = np.lexsort((key, -counts[used], doc))
            rank = np.arange(len(order)) - np.searchsorted(doc, doc)  # doc is ascending, before and after
            emitted = order[rank <= k[doc]]
            keys.append(key[emitted])
            who.append(doc[emitted])
            high.append(np.full(len(emitted), bool(up)))
            open_ = open_ & (np.bincount(doc, minlength=len(at)) <= k)
    return np.concatenate(keys), np.concatenate(who), np.concatenate(high)


def vector(s: np.ndarray) -> np.ndarray:
    """One byte for each of 2 ** i partitions, at least len(s) / 3 of them: the sum of hashes of its elements."""
    size = 1 << max(0, int(math.log2(max(1.0, 0.75 * len(s)))))
    h = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    out = np.bincount((h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(56)).astype(np.float64), size)
    return out.astype(np.int64).astype(np.uint8)


def candidates(table: pa.Table) -> pa.Table:
    """Pairs of classes with a common signature in one part; big groups as blocks."""
    rows = [r for b in table.to_batches() for r in batch_rows(b)]
    codes = np.concatenate([dec_sorted(r["codes"]) for r in rows])
    cid = np.concatenate([(np.int64(r["chunk"]) << 16) | dec(r["at"], np.uint16).astype(np.int64) for r in rows])
    high = np.concatenate([dec_bits(r["high"], r["n"]) for r in rows])
    order = np.argsort(codes, kind="stable")
    codes, cid, high = codes[order], cid[order], high[order]
    first = np.flatnonzero(np.diff(codes, prepend=~codes[:1]))
    size = np.diff(np.append(first, len(codes)))
    left, right, out = [], [], []
    two = first[size == 2]
    two = two[~(high[two] & high[two + 1])]
    left.append(cid[two])
    right.append(cid[two + 1])
    for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        ids, up = cid[f : f + s], high[f : f + s]
        low, top = ids[~up], ids[up]
        if s <= BLOCK:
            i, j = np.triu_indices(len(low), 1)
            left += [low[i], np.repeat(low, len(top))]
            right += [low[j], np.tile(top, len(low))]
        else:
            cut_ = lambda x: [x[k : k + BLOCK] for k in range(0, len(x), BLOCK)]
            a, b = cut_(np.unique(low)), cut_(np.unique(top))
            out += [(0, enc(x), enc(y)) for i, x in enumerate(a) for y in a[i:] + b]
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    out += [(1, enc(pairs[k : k + 200_000, 0]), enc(pairs[k : k + 200_000, 1])) for k in range(0, len(pairs), 200_000)]
    return table_of(BLOCKS, out)


def expand(batches):
    for batch in batches:
        for r in batch_rows(batch):
            a, b = dec(r["a"], np.int64), dec(r["b"], np.int64)
            if not r["pairwise"]:
                a, b = np.repeat(a, len(b)), np.tile(b, len(a))
            low, top = np.minimum(a, b), np.maximum(a, b)
            keep = low != top
            yield pa.RecordBatch.from_arrays([pa.array(low[keep]), pa.array(top[keep])], schema=PAIRS)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, sigs_per_part: int = 2_000_000, representatives: bool = False) -> DataFrame:
    """Link documents whose sets of distinct n-word shingles have a Jaccard similarity of at least percent / 100.

    Returns one row per input row: id, n_shingles (size of its set), n_similar (other rows linked directly,
    equal sets included), component_id (smallest id reachable by links, its own included). A-Z are lower-cased;
    words are runs of anything but ASCII white space. A document of fewer than n words has its whole sequence as
    one shingle; a null, empty or blank text has none, n_similar 0, and its own id as component. Repeated rows
    are separate documents with equal sets. A null id is never the smallest unless all in its component are null.
    Other columns are ignored; an empty table gives an empty result.

    representatives: two more columns, row_key (common.row_key of the text, which tells apart rows of one id) and is_first: is the row the first of its
    component by (id, null last; row_key)? Rows equal in both are first together; rows without a set are always.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    cut = scratch.cut
    packed = cut(pack(docs, id_col, text_col, representatives), "text")

    def members(batches):
        for b in batches:
            for row in batch_rows(b):
                c = Chunk(row, lower=True)
                out = []
                for i, (doc, key, s) in enumerate(zip(c.real_ids(), c.rows.tolist(), ngram_sets(c, n))):
                    with np.errstate(over="ignore"):
                        a, z = (np.sum(mix(s + np.uint64(k))) for k in (1, 2)) if len(s) else (0, 0)
                    out.append((int(np.uint64(a).astype(np.int64)), int(np.uint64(z).astype(np.int64)), len(s), doc, key, (row["chunk"] << 16) | i, vector(s).tobytes()))
                yield batch_of(MEMBERS, out)

    member = cut(packed.mapInArrow(members, ddl(MEMBERS)), "members")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = member.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("cid").alias("cid"), F.min("id").alias("least"), F.min(place).alias("lead"), F.count("*").alias("copies"))
    classes = cut(classes, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(12, math.ceil(total * 0.8 / sigs_per_part))
    chosen = classes.select(F.expr("cid >> 16").alias("chunk"), F.expr("cast(cid & 65535 as int)").alias("i")).groupBy("chunk").agg(F.collect_list("i").alias("at"))

    def emit(batches):
        for b in batches:
            for row in batch_rows(b):
                c = Chunk(row, lower=True)
                at = np.sort(np.array(row["at"], np.int64))
                keys, who, high = signatures(ngram_sets(c, n), at, percent)
                part = parts_of(keys, parts)
                order = np.lexsort((keys & CODE, part))
                part, keys, who, high = part[order], keys[order] & CODE, at[who[order]].astype(np.uint16), high[order]
                out = [(p, row["chunk"], z - a, enc_sorted(keys[a:z]), enc(who[a:z]), enc_bits(high[a:z])) for p, a, z in slices(part)]
                for k in range(0, len(out), 2000):
                    yield batch_of(SIGNATURES, out[k : k + 2000])

    sigs = packed.join(chosen.hint("shuffle_hash"), "chunk").mapInArrow(emit, ddl(SIGNATURES))
    blocks = sigs.groupBy("part").applyInArrow(candidates, ddl(BLOCKS)).repartition(parts)
    pairs = cut(blocks.mapInArrow(expand, ddl(PAIRS)).distinct(), "pairs")
    likely = cut(compared(scratch, member, pairs, percent), "likely")
    scratch.keep(packed, member, classes, likely)
    links = cut(verified(scratch, packed, likely, n, percent), "links")
    scratch.keep(member, classes, links)
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = classes.select(F.col("cid").alias("b"), "copies")
    degree = both.join(copies.hint("merge"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("copies").alias("near"))
    groups = star_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), cut)
    placed = classes.join(groups.withColumnRenamed("id", "cid").hint("merge"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.min("lead").alias("first"))
    known = placed.join(names.hint("merge"), "component").join(degree.hint("merge"), "cid", "left")
    known = cut(known.select("set_a", "set_b", "n", F.expr("copies - 1 + coalesce(near, 0)").alias("n_similar"), "component_id", "first"), "known")
    scratch.keep(member, known)
    done = member.join(known.hint("merge"), ["set_a", "set_b", "n"], "left")
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")]
    return done.select(*columns, *([F.col("row").alias("row_key"), ((F.col("n") == 0) | (place == F.col("first"))).alias("is_first")] if representatives else []))


def keyed_pairs(scratch: Scratch, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with the key of the task that handles them, and (task, cid) of what each task needs to know. Pairs are grouped at
    the smallest partner of their lower class, in a grid of tasks where there are many."""
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    root = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("root"))
    rooted = pairs.join(root.hint("merge"), "a")
    grid = rooted.groupBy("root").agg(F.expr(f"cast(ceil(sqrt(count(*) / {CELL_PAIRS})) as int)").alias("grid"))
    keyed = rooted.join(grid.hint("merge"), "root").select("a", "b", F.expr("xxhash64(root, pmod(xxhash64(a), grid), pmod(xxhash64(b), grid))").alias("key"))
    keyed = scratch.cut(keyed, "keyed")
    return keyed, keyed.select(F.col("key").alias("task"), F.col("a").alias("cid")).unionAll(keyed.select("key", F.col("b").alias("cid"))).distinct()


def ranks(pair: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ends of the pairs, as places in the sorted ids, and the order that sorts them."""
    order = np.argsort(ids)
    return order, *(np.searchsorted(ids[order], pair[c].to_numpy()) for c in ("a", "b"))


def kept_pairs(pair: pa.Table, keep: np.ndarray) -> pa.Table:
    return pair.select(["a", "b"]).filter(pa.array(keep)).cast(PAIRS)


def compared(scratch: Scratch, member: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and vectors leave it possible that they are similar."""
    keyed, needs = keyed_pairs(scratch, pairs)
    bodies = needs.join(member.select("cid", "n", "vector").hint("shuffle_hash"), "cid")

    def check(pair: pa.Table, body: pa.Table) -> pa.Table:
        order, a, b = ranks(pair, body["cid"].to_numpy())
        size = body["n"].to_numpy()[order]
        x, y = size[a], size[b]
        keep = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        most = (x + y) * (100 - percent) // (100 + percent)
        vectors = body["vector"].to_pylist()
        level = np.array([len(vectors[i]) for i in order], np.int64)
        # vectors of one length are rows of a matrix; a pair is compared at the shorter of its two lengths
        for k in np.unique(np.minimum(level[a], level[b])[keep]).tolist() if keep.any() else []:
            at = np.flatnonzero(keep & (np.minimum(level[a], level[b]) == k))
            used = np.unique(np.concatenate([a[at], b[at]]))
            rows = np.stack([np.frombuffer(vectors[order[i]], np.uint8).reshape(-1, k).sum(0, dtype=np.uint8) for i in used])
            left, right = np.searchsorted(used, a[at]), np.searchsorted(used, b[at])
            step = max(1, (8 << 20) // k)
            for lo in range(0, len(at), step):
                part = slice(lo, lo + step)
                differ = (rows[left[part]] != rows[right[part]]).sum(1)
                keep[at[part]] &= differ <= most[at[part]]
        return kept_pairs(pair, keep)

    return keyed.groupBy("key").cogroup(bodies.groupBy("task")).applyInArrow(check, ddl(PAIRS))


def verified(scratch: Scratch, packed: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that are similar enough, by their whole sets."""
    keyed, needs = keyed_pairs(scratch, pairs)
    needs = needs.groupBy(F.expr("cid >> 16").alias("chunk")).agg(F.collect_list(F.struct(F.expr("cid & 65535").alias("i"), F.col("task").alias("key"))).alias("needs"))

    def bodies(batches):
        for b in batches:
            for row in batch_rows(b):
                sets = ngram_sets(Chunk(row, lower=True), n)
                kept: dict[int, bytes] = {}
                out = []
                for x in row["needs"]:
                    i = x["i"]
                    kept[i] = kept.get(i) or enc_sorted(sets[i])
                    out.append((x["key"], (row["chunk"] << 16) | i, kept[i]))
                    if len(out) == 500:
                        yield batch_of(SETS, out)
                        out = []
                yield batch_of(SETS, out)

    sets = packed.join(needs.hint("shuffle_hash"), "chunk").mapInArrow(bodies, ddl(SETS))

    def check(pair: pa.Table, body: pa.Table) -> pa.Table:
        order, a, b = ranks(pair, body["cid"].to_numpy())
        blobs = body["body"].to_pylist()
        known = [dec_sorted(blobs[i]) for i in order]
        size = np.array([len(x) for x in known], np.int64)
        keep = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        at = np.flatnonzero(keep)
        at = at[np.argsort(a[at], kind="stable")]
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.diff(a[at], prepend=-1)), len(at)).tolist())):
            # one set against all of its partners, a bounded number of elements at a time
            own, mine = known[a[at[lo]]], at[lo:hi]
            ends = np.cumsum(size[b[mine]])
            while len(mine):
                k = max(1, int(np.searchsorted(ends, (ends[0] - size[b[mine[0]]]) + (1 << 20))))
                part, mine, ends = mine[:k], mine[k:], ends[k:]
                every = np.concatenate([known[i] for i in b[part]])
                hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[b[part]]) - size[b[part]])
                keep[part] = 100 * shared >= percent * (len(own) + size[b[part]] - shared)
        return kept_pairs(pair, keep)

    return keyed.groupBy("key").cogroup(sets.groupBy("key")).applyInArrow(check, ddl(PAIRS))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as p from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * i.i >= 80 * (x.n + y.n - i.i)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select distinct a, a from e union select e.b, r.root from r join e on e.a = r.id),
c as (select id, min(root) as root from r group by id),
d as (select a, count(*) as k from e group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(d.k, 0)::bigint as n_similar, coalesce(c.root, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join d on d.a = w.doc_id left join c on c.id = w.doc_id
"""
