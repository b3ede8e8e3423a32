"""Substring dedup by fixed-block anchors.

Each document's words are cut into non-overlapping reference blocks; every
rolling window of block length probes the index of those blocks. Around the
hits, maximal exact repeats are found: a hit is extended to all the windows of
`window` words that hold it, and each of those is compared by two hashes, 96 bits in all,
with the first document that has it. Nothing is listed pair by pair: both
probes and windows are pre-aggregated within a chunk of documents before they
move, so a passage that a third of all documents share costs one entry a chunk. Where there are many chunks, teams of them
are merged first, so that no task holds an entry of each chunk either.

The blocks have at most (window + 1) / 2 words, so that every window of any
reference document holds a whole one of its blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import (Chunk, Scratch, batch_of, batch_rows, dec, dec_bits, dec_sorted, enc, enc_bits, enc_sorted, pack, parts_of, table_of, window_hash)

LOW = np.uint64(0xFFFFFFFF)
PROBES = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()), ("block", pa.binary()), ("multi", pa.binary())])
HITS = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("codes", pa.binary())])
WINDOWS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("second", pa.binary()), ("doc", pa.binary())])
EARLIER = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])
FIRSTS = pa.schema([("part", pa.int64()), ("team", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("second", pa.binary()), ("doc", pa.binary())])
#: Chunks whose entries of one part are merged in one task. Where there are more chunks, teams of so many are merged first, then what is left of each.
TEAM = 4096
DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def slices(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of an ascending array of parts."""
    at = np.flatnonzero(np.diff(part, prepend=np.uint64(part[0] + 1) if len(part) else 0))
    for i, a in enumerate(at):
        yield int(part[a]), int(a), int(at[i + 1]) if i + 1 < len(at) else len(part)


def probes(c: Chunk, block: int, parts: int) -> Iterator[tuple]:
    rolling = window_hash(c.hashes(), block)
    at = c.valid(block)
    keys, doc = rolling[at], c.doc[at]
    is_block = (at - c.words[doc]) % block == 0
    short = (parts_of(keys, parts) << np.uint64(32)) | (keys & LOW)
    order = np.argsort(short, kind="stable")
    short, doc, is_block = short[order], doc[order], is_block[order]
    first = np.flatnonzero(np.diff(short, prepend=~short[:1]))
    if not len(first):
        return
    last = np.append(first[1:], len(short)) - 1
    multi, is_block, short = doc[first] != doc[last], np.logical_or.reduceat(is_block, first), short[first]
    for p, a, z in slices(short >> np.uint64(32)):
        yield p, c.chunk, z - a, enc_sorted(short[a:z] & LOW), enc_bits(is_block[a:z]), enc_bits(multi[a:z])


def rows_of(table: pa.Table) -> list[dict]:
    return [r for b in table.to_batches() for r in batch_rows(b)]


def merged(rows: list[dict]):
    """Codes of rows of one part, one after the other, with their order and the first of each distinct one in it; is a code a block
    somewhere, and in two documents?"""
    codes = [dec_sorted(r["codes"]).astype(np.uint32) for r in rows]
    n = [len(x) for x in codes]
    every = np.concatenate(codes)
    block = np.concatenate([dec_bits(r["block"], k) for r, k in zip(rows, n)])
    multi = np.concatenate([dec_bits(r["multi"], k) for r, k in zip(rows, n)])
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.diff(every[order].astype(np.int64), prepend=-1))
    size = np.diff(np.append(first, len(every)))
    return codes, every, order, first, size, np.logical_or.reduceat(block[order], first), (size > 1) | np.logical_or.reduceat(multi[order], first)


def match(table: pa.Table) -> pa.Table:
    """Codes of one part that are a block somewhere and occur in two documents, by chunk."""
    rows = rows_of(table)
    codes, every, order, _, size, block, multi = merged(rows)
    hit = np.zeros(len(every), bool)
    hit[order] = np.repeat(block & multi, size)
    out, at = [], 0
    for r, x in zip(rows, codes):
        if (own := hit[at : at + len(x)]).any():
            out.append((r["chunk"], r["part"], enc_sorted(x[own].astype(np.uint64))))
        at += len(x)
    return table_of(HITS, out)


def team_codes(table: pa.Table) -> pa.Table:
    """What a team has of one part, as if it were one chunk (its number is the team's)."""
    rows = rows_of(table)
    _, every, order, first, _, block, multi = merged(rows)
    own = every[order[first]].astype(np.uint64)
    return table_of(PROBES, [(rows[0]["part"], rows[0]["team"], len(own), enc_sorted(own), enc_bits(block), enc_bits(multi))])


def team_hits(table: pa.Table, hits: pa.Table) -> pa.Table:
    """The hits of a team, given to those of its chunks that have them."""
    known = [dec_sorted(r["codes"]) for r in rows_of(hits)]
    if not known or not table.num_rows:
        return table_of(HITS, [])
    out = []
    for r in rows_of(table):
        own = dec_sorted(r["codes"])
        own = own[np.isin(own, known[0], assume_unique=True)]
        if len(own):
            out.append((r["chunk"], r["part"], enc_sorted(own)))
    return table_of(HITS, out)


def shared_codes(probes: DataFrame, teams: int, scratch: Scratch) -> DataFrame:
    """(chunk, part, codes): the hits of each chunk."""
    if teams <= 1:
        return probes.groupBy("part").applyInArrow(match, ddl(HITS))
    probes = scratch.cut(probes.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams))), "probes")
    of_teams = probes.groupBy("part", "team").applyInArrow(team_codes, ddl(PROBES))
    hits = of_teams.groupBy("part").applyInArrow(match, ddl(HITS)).withColumnRenamed("chunk", "team")
    return probes.groupBy("part", "team").cogroup(hits.groupBy("part", "team")).applyInArrow(team_hits, ddl(HITS))


def candidates(c: Chunk, hits: list[dict], block: int, window: int, parts: int):
    """The windows that hold a hit: starts, number of the distinct window at each start, and of each
    distinct window: part, both hashes and its smallest document id here."""
    words = c.hashes()
    rolling = window_hash(words, block)
    known = np.sort(np.concatenate([(np.uint64(h["part"]) << np.uint64(32)) | dec_sorted(h["codes"]) for h in hits]))
    at = c.valid(block)
    short = (parts_of(rolling[at], parts) << np.uint64(32)) | (rolling[at] & LOW)
    sieve = np.zeros(1 << 22, bool)
    small = np.uint64((1 << 22) - 1)
    sieve[known & small] = True
    maybe = np.flatnonzero(sieve[short & small])
    found = np.searchsorted(known, short[maybe])
    marked = at[maybe[known[np.minimum(found, len(known) - 1)] == short[maybe]]]
    marks = np.zeros(len(words) + block + window + 1, np.int64)
    marks[marked + 1] = 1
    marks = np.cumsum(marks)
    at = c.valid(window)
    at = at[marks[at + window - block + 1] > marks[at]]
    h1, h2 = window_hash(words, window)[at], window_hash(c.hashes(1), window, 1)[at]
    part = parts_of(h1, parts)
    order = np.lexsort((h2, h1 >> np.uint64(32), h1 & LOW, part))
    p, a, b = part[order], h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    ids = c.ids[c.doc[at]]
    least = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
    return at, number, p[first], a[first], b[first], least


def windows_of(rows: list[dict]):
    """Hashes (both) and documents of rows of one part, one after the other, with their order and the first of each distinct window in it."""
    low = np.concatenate([dec_sorted(r["low"]) for r in rows])
    high, second = (np.concatenate([dec(r[k], np.uint32) for r in rows]) for k in ("high", "second"))
    doc = np.concatenate([dec(r["doc"], np.int64) for r in rows])
    h = (high.astype(np.uint64) << np.uint64(32)) | low
    order = np.lexsort((second, high, low))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
    return h, second, doc, order, np.flatnonzero(new)


def marked(rows: list[dict], earlier: np.ndarray) -> pa.Table:
    out, at = [], 0
    for r in rows:
        own = earlier[at : at + r["n"]]
        if own.any():
            out.append((r["chunk"], r["part"], r["n"], enc_bits(own)))
        at += r["n"]
    return table_of(EARLIER, out)


def first_docs(table: pa.Table) -> pa.Table:
    """For each chunk's distinct windows of one part: has a smaller document id of another chunk it too?"""
    rows = rows_of(table)
    _, _, doc, order, first = windows_of(rows)
    earlier = np.empty(len(order), bool)
    earlier[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order)))) < doc[order]
    return marked(rows, earlier)


def firsts_row(part: int, team: int, h: np.ndarray, second: np.ndarray, doc: np.ndarray) -> tuple:
    return part, team, enc_sorted(h & LOW), enc((h >> np.uint64(32)).astype(np.uint32)), enc(second), enc(doc)


def team_firsts(table: pa.Table) -> pa.Table:
    """The distinct windows that a team has of one part, each with its smallest document id."""
    rows = rows_of(table)
    h, second, doc, order, first = windows_of(rows)
    at = order[first]
    return table_of(FIRSTS, [firsts_row(rows[0]["part"], rows[0]["team"], h[at], second[at], np.minimum.reduceat(doc[order], first))])


def all_firsts(table: pa.Table) -> pa.Table:
    """The same for each team, with the smallest document id of all teams."""
    rows = rows_of(table)
    h, second, doc, order, first = windows_of(rows)
    doc = doc.copy()
    doc[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    ends = np.cumsum([len(dec(r["doc"], np.int64)) for r in rows])
    return table_of(FIRSTS, [firsts_row(r["part"], r["team"], h[a:z], second[a:z], doc[a:z]) for r, a, z in zip(rows, np.append(0, ends), ends)])


def team_earlier(table: pa.Table, firsts: pa.Table) -> pa.Table:
    rows, known = rows_of(table), rows_of(firsts)
    if not rows or not known:
        return table_of(EARLIER, [])
    h, second, doc, order, first = windows_of(rows)
    _, _, least, by, _ = windows_of(known)  # as many distinct windows, in the same order
    earlier = np.empty(len(order), bool)
    earlier[order] = np.repeat(least[by], np.diff(np.append(first, len(order)))) < doc[order]
    return marked(rows, earlier)


def earlier_windows(found: DataFrame, teams: int, scratch: Scratch) -> DataFrame:
    """(chunk, part, n, bits): which of a chunk's windows are in a smaller document of another chunk too."""
    if teams <= 1:
        return found.groupBy("part").applyInArrow(first_docs, ddl(EARLIER))
    found = scratch.cut(found.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams))), "windows")
    firsts = found.groupBy("part", "team").applyInArrow(team_firsts, ddl(FIRSTS)).groupBy("part").applyInArrow(all_firsts, ddl(FIRSTS))
    return found.groupBy("part", "team").cogroup(firsts.groupBy("part", "team")).applyInArrow(team_earlier, ddl(EARLIER))


def removed_words(c: Chunk, hits: list[dict] | None, bits: list[dict] | None, block: int, window: int, parts: int) -> np.ndarray:
    gone = np.zeros(len(c.doc), bool)
    if not hits:
        return gone
    at, number, part, _, _, least = candidates(c, hits, block, window, parts)
    if not len(at):
        return gone
    earlier = np.zeros(len(part), bool)
    for r in bits or []:
        lo, hi = np.searchsorted(part, [r["part"], r["part"] + 1])
        earlier[lo:hi] = dec_bits(r["bits"], r["n"])
    take = at[earlier[number] | (least[number] < c.ids[c.doc[at]])]
    cover = np.zeros(len(gone) + 1, np.int64)
    np.add.at(cover, take, 1)
    np.add.at(cover, take + window, -1)
    return np.cumsum(cover[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep_text: bool = False, codes_per_part: int = 3_000_000) -> DataFrame:
    """Remove from every document the words that lie in a window of `window` consecutive words which
    also starts in a document of smaller id. All documents are judged on the input.

    Returns one row per input row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and, with keep_text, kept_text. Words are runs of anything but ASCII white space. Nulls:
    a null text has no words; a null id counts like the largest long, and equal ids (repeated rows, null ids)
    never remove each other's words. Empty tables give an empty result; other columns are ignored.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    block = (window + 1) // 2
    scratch = Scratch(docs.sparkSession, "substring")
    packed = scratch.cut(pack(docs, id_col, text_col), "text")
    total, chunks = packed.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    parts, teams = max(12, math.ceil(total / codes_per_part)), math.ceil(chunks / TEAM)

    def probe(batches):
        for b in batches:
            for row in batch_rows(b):
                out = list(probes(Chunk(row), block, parts))
                for k in range(0, len(out), 2000):
                    yield batch_of(PROBES, out[k : k + 2000])

    hits = scratch.cut(shared_codes(packed.mapInArrow(probe, ddl(PROBES)), teams, scratch), "hits")
    scratch.keep(packed, hits)
    by_chunk = hits.groupBy("chunk").agg(F.collect_list(F.struct("part", "codes")).alias("hits"))

    def windows(batches):
        for b in batches:
            for row in batch_rows(b):
                _, _, part, h1, h2, least = candidates(Chunk(row), row["hits"], block, window, parts)
                out = [(p, row["chunk"], z - a, enc_sorted(h1[a:z] & LOW), enc((h1[a:z] >> np.uint64(32)).astype(np.uint32)), enc((h2[a:z] & LOW).astype(np.uint32)), enc(least[a:z])) for p, a, z in slices(part)]
                for k in range(0, len(out), 2000):
                    yield batch_of(WINDOWS, out[k : k + 2000])

    found = packed.join(by_chunk.hint("shuffle_hash"), "chunk").mapInArrow(windows, ddl(WINDOWS))
    bits = scratch.cut(earlier_windows(found, teams, scratch), "first")
    scratch.keep(packed, hits, bits)
    bits_by_chunk = bits.groupBy("chunk").agg(F.collect_list(F.struct("part", "n", "bits")).alias("earlier"))
    result = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text)

    def finish(batches):
        for b in batches:
            for row in batch_rows(b):
                c = Chunk(row)
                gone = removed_words(c, row["hits"], row["earlier"], block, window, parts)
                lost = np.concatenate([[0], np.cumsum(gone)])
                body, rows = c.data.tobytes(), []
                for i, doc in enumerate(c.real_ids()):
                    lo, hi = c.words[i], c.words[i + 1]
                    words = body[c.offs[i] : c.offs[i + 1]].split()
                    n = int(lost[hi] - lost[lo])
                    if n:
                        words = [words[k] for k in np.flatnonzero(~gone[lo:hi])]
                    kept = b" ".join(words)
                    rows.append((doc, int(hi - lo), n, hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "replace"),) if keep_text else ()))
                yield batch_of(result, rows)

    joined = packed.join(by_chunk.hint("shuffle_hash"), "chunk", "left").join(bits_by_chunk.hint("shuffle_hash"), "chunk", "left")
    done = joined.mapInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)
    return done.withColumnRenamed("id", id_col)


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, p, array_to_string(w[p:p + 49], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from w where len(w) >= 50)),
late as (select doc_id, p from (select *, min(doc_id) over (partition by k) as f from win) where f < doc_id),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as i from late),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
kept as (select doc_id, string_agg(x, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(l.n, 0)::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from w left join lost l using (doc_id) left join kept k using (doc_id)
"""
