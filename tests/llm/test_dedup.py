"""Line dedup, substring dedup, Jaccard join, decontamination: against brute force, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import rows
from weft.llm import common, decontamination, jaccard_join as jj, line_dedup as line_dedup_module, substring_dedup as substrings
from weft.llm.decontamination import find_contamination
from weft.llm.jaccard_join import jaccard_join
from weft.llm.line_dedup import line_dedup
from weft.llm.substring_dedup import substring_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Documents with copies, near copies and common passages, and awkward ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(70)]
    docs = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and docs:
            w = W.findall(r.choice(docs)[1] or "")
        elif kind < 0.4 and docs:
            w = W.findall(r.choice(docs)[1] or "")
            for k in range(0, len(w), 40):
                w[k] = word()
        else:
            w = [word() for _ in range(r.choice([0, 1, 3, 5, 20, 120, 300]))]
        if r.random() < 0.3:
            k = r.randint(0, len(w))
            w = w[:k] + passage[r.randint(0, 10) :] + w[k:]
        docs.append((i * 3, r.choice([" ", "\n", " \t"]).join(w)))
    same = " ".join(word() for _ in range(80))
    docs += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "x " * 60), (1004, same), (1004, same), (None, same), (1005, same + " \x1c\xa0 tail"), (1006, "Ab cD ef gh ij"), (1007, "ab cd EF gh ij")]
    r.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, source string, n int, chunk int").repartition(3)


def test_hashing_is_positional():
    text = "ab ab\tab b\x0bab".encode()
    data, offs = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    s, e, words = common.word_spans(data, offs)
    assert [data[a:b].tobytes() for a, b in zip(s, e)] == text.split() * 2 or words.tolist() == [0, 5, 10]
    h = common.hash_words(data, s, e)
    assert h[0] == h[1] == h[2] == h[4] != h[3]
    assert len(set(common.window_hash(h, 2).tolist())) < 9
    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 1000).astype(np.uint64))
    assert (common.dec_sorted(common.enc_sorted(codes)) == codes).all() and len(common.dec_sorted(b"")) == 0
    giant = np.frombuffer(b"x" * 3_000_000 + b" y", np.uint8)
    s, e, _ = common.word_spans(giant, np.array([0, len(giant)]))
    assert len(set(common.hash_words(giant, s, e).tolist())) == 2


@pytest.mark.parametrize("window, team", [(50, 4096), (7, 4096), (7, 2), (50, 3)])
def test_substring_dedup(spark, window, team, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(substrings, "TEAM", team)
    monkeypatch.setattr(common, "CHUNK_BYTES", 4096 if team < 4096 else 2 << 20)
    got = Counter(tuple(r) for r in substring_dedup(frame(spark, docs), window=window, codes_per_part=500).collect())
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in docs:
        w = W.findall(t or "")
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, key(i)), key(i))
    want = Counter()
    for i, t in docs:
        w = W.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < key(i):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want
    assert sum(r[2] > 0 for r in want) > 5


def test_jaccard_join(spark):
    docs = corpus(2, 90)
    got = sorted((tuple(r) for r in jaccard_join(frame(spark, docs), sigs_per_part=300).collect()), key=repr)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in docs:
        w = W.findall((t or "").translate(lower))
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least.setdefault(find(k), []).append(i)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    n = Counter(x for ab in links for x in ab)
    assert got == sorted(((i, len(sets[k]), n[k], low(least[find(k)])) for k, (i, _) in enumerate(docs)), key=repr)
    assert len(links) > 20


def test_signatures_lose_no_pair():
    r = np.random.default_rng(3)
    for size in [1, 2, 3, 4, 5, 6, 9, 14, 30, 77, 200]:
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 60, size).astype(np.uint64))
            cut = int(r.integers(0, max(1, size // 5) + 1))
            extra = int(r.integers(0, max(1, size // 5) + 1))
            b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 60, extra).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if not len(b) or 100 * inter < 80 * (len(a) + len(b) - inter):
                continue
            keys, who, high = jj.signatures([a, b], np.array([0, 1]), 80)
            common_keys = set(keys[(who == 0)].tolist()) & set(keys[who == 1].tolist())
            assert common_keys, (size, len(a), len(b), inter)
            d = len(a) + len(b) - 2 * inter
            x, y = sorted((jj.vector(a), jj.vector(b)), key=len)
            assert (y.reshape(-1, len(x)).sum(0, dtype=np.uint8) != x).sum() <= d


def test_first_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = [(7, a), (3, a + " z"), (None, a), (None, b), (5, c), (5, c), (5, a + " y"), (8, None), (None, ""), (None, None), ((1 << 63) - 1, b)]
    got = jaccard_join(frame(spark, docs), representatives=True)
    assert got.columns == ["doc_id", "n_shingles", "n_similar", "component_id", "row_key", "is_first"]
    first = sorted(((i, n) for i, n in got.where("is_first").select("doc_id", "n_shingles").collect()), key=repr)
    assert first == sorted([(3, 27), (5, 26), (5, 26), (8, 0), (None, 0), (None, 0), ((1 << 63) - 1, 26)], key=repr)
    assert {r.component_id for r in got.where("n_shingles = 26 and n_similar = 1").collect()} == {5, (1 << 63) - 1}


def test_the_largest_id_is_not_null(spark):
    top = (1 << 63) - 1
    docs = [(top, "w " * 60), (None, "w " * 60), (1, "v")]
    assert rows(substring_dedup(frame(spark, docs)), "doc_id", "n_removed") == sorted([(top, 0), (None, 0), (1, 0)], key=repr)
    assert rows(jaccard_join(frame(spark, docs)), "doc_id", "component_id") == sorted([(top, top), (None, top), (1, 1)], key=repr)
    assert rows(line_dedup(frame(spark, docs)), "doc_id", "n_removed") == sorted([(top, 0), (None, 0), (1, 0)], key=repr)


def test_big_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join(base[:50] + [f"z{k}"])) for k in range(15)]
    got = rows(jaccard_join(frame(spark, docs)), "doc_id", "n_similar", "component_id")
    assert got == sorted([(k, 14, 0) for k in range(15)], key=repr)


def test_line_dedup_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a\nb", 3, 4, 5), (2, "a\nb", 6, 7, 8)], "doc_id long, text string, k_id int, `gone` int, `x.y` int")
    got = line_dedup(d)
    assert got.columns == [*d.columns, "n_lines", "n_removed", "kept_text", "all_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb", 3, 4, 5, 2, 0, "a\nb", False), (2, "a\nb", 6, 7, 8, 2, 2, "", True)]


def test_line_dedup(spark):
    docs = [(1, "a b\nc d\n\nx"), (2, "q\n a b \nc d\nr"), (3, "c d\na b"), (4, "only"), (5, "only"), (6, "s\ns\ns\ns"), (7, None), (8, ""), (9, "a b\nc d"), (9, "a b\nc d"), (None, "q\n a b"), (10, "\n\n"), (11, "long " * 20000 + "\nq\na b")]
    got = {(i, t): (n, k) for i, t, n, k in line_dedup(frame(spark, docs), long_words=None).select("doc_id", "text", "n_removed", "kept_text").collect()}
    want = {}
    seqs = [[(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for _, t in docs]
    first = {}
    key = lambda i: (i is None, i or 0)
    windows = []
    for (i, t), s in zip(docs, seqs):
        own = [(tuple(x for _, x in s[p : p + 2]), [k for k, _ in s[p : p + 2]]) for p in range(max(1 if s else 0, len(s) - 1))]
        windows.append(own)
        for w, at in own:
            first[w] = min(first.get(w, (key(i), at[0])), (key(i), at[0]))
    for (i, t), s, own in zip(docs, seqs, windows):
        gone = {k for w, at in own for k in at if (key(i), at[0]) > first[w]}
        lines = (t or "").split("\n")
        kept = t if not gone else "" if len(gone) == len(s) else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want[(i, t)] = (len(gone), kept)
    assert got == want
    assert got[(9, "a b\nc d")] == (2, "") and got[(6, "s\ns\ns\ns")][0] == 3 and got[(7, None)] == (0, None)
    assert line_dedup(frame(spark, docs)).columns == ["doc_id", "text", "source", "n", "chunk", "n_lines", "n_removed", "kept_text", "all_removed"]


def test_long_lines_alone(spark):
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    a, b, short = line("a", 51), line("b", 80), line("c", 50)
    docs = [(1, f"p\n{a}\nq"), (2, f"r\n\t{a} \ns\n{b}"), (3, a), (4, f"{short}\nt"), (5, f"u\n{short}\nv"), (6, f"w\n{b}\nx\n{b}\ny"), (7, f"p\n{a}\nz"), (8, b), (8, b), (None, f"k\n{a}"), (9, short), (10, None), (11, "y " * 50 + "y" * 9), (12, "o\n" + "y " * 50 + "y" * 9)]
    got = Counter((i, n, k) for i, n, k in line_dedup(frame(spark, docs)).select("doc_id", "n_removed", "kept_text").collect())
    want = [(1, 0, docs[0][1]), (2, 1, f"r\ns\n{b}"), (3, 1, ""), (4, 0, docs[3][1]), (5, 0, docs[4][1]), (6, 2, "w\nx\ny"), (7, 2, "z"), (8, 1, ""), (8, 1, ""), (None, 1, "k"), (9, 0, short), (10, 0, None), (11, 0, docs[12][1]), (12, 1, "o")]
    assert got == Counter(want)
    kept = corpus_pipeline.dedup_lines(spark, frame(spark, docs).withColumn("n_chars", F.lit(1)), "")
    assert Counter((i, t) for i, t in kept.select("doc_id", "text").collect()) == Counter((i, k) for i, n, k in want if n == 0 or k)


def test_winnowing_of_longer_runs(spark, monkeypatch):
    lines = [f"line {k}" for k in range(30)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["p"] + lines[5:9] + ["q"] + lines[20:22] + ["r"]))]
    for run, gram, written_out in ((4, 2, 6), (3, 1, 6), (5, 3, 6), (4, 2, 1), (3, 3, 1), (5, 3, 1), (4, 4, 6)):
        monkeypatch.setattr(line_dedup_module, "UNROLLED", written_out)
        got = dict(rows(line_dedup(frame(spark, docs), run=run, gram=gram), "doc_id", "n_removed"))
        assert got == {1: 0, 2: 4 if run <= 4 else 0}


def test_decontamination(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(r.randint(12, 40)))) for k in range(12)] + [(90, "two words"), (91, None), (92, " ")]
    clean = [(k, " ".join(word() for _ in range(200))) for k in range(30)]
    docs, want = list(clean), set()
    for k in range(12):
        w = items[k][1].split()
        docs.append((100 + k, f"{clean[k][1]} {items[k][1].upper()} {clean[k + 1][1]}"))
        want.add((100 + k, k))
        w[len(w) // 2] = "changed"
        docs.append((200 + k, f"{clean[k][1]}\n{' '.join(w)}\n"))
        if len(w) >= 20:
            want.add((200 + k, k))
    docs += [(300, items[3][1]), (301, None), (302, ""), (None, items[4][1]), (303, "so two words here"), (300, items[3][1])]
    want |= {(300, 3), (None, 4), (303, 90)}
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = find_contamination(frame(spark, docs), bench)
    pairs = {(a, b) for a, b in rows(got, "doc_id", "item_id")}
    assert want <= pairs and all(a is None or a >= 100 for a, _ in pairs)
    assert all(s >= 0.5 for s, in rows(got, "similarity"))
    assert find_contamination(frame(spark, docs), bench.limit(0)).count() == 0


def brute_pairs(docs, items, threshold=0.5):
    """(document, item): (best similarity, its first place, windows that pass) of all windows; 3-word shingles only."""
    sets = {k: {tuple(w[p : p + 3]) for p in range(len(w) - 2)} for k, t in items if (w := t.split())}
    df = Counter(x for s in sets.values() for x in s)
    weigh = lambda s: sum(math.log(1 + len(sets) / df[x]) + 1 if x in df else math.log(1 + len(sets)) + 1 for x in s)
    want = {}
    for d, t in docs:
        w = t.split()
        for k, item in items:
            size = min(len(item.split()), len(w))
            found = [(round(weigh(own & sets[k]) / weigh(own | sets[k]), 6), -p) for p in range(len(w) - size + 1) if (own := {tuple(w[q : q + 3]) for q in range(p, p + size - 2)})]
            passed = [x for x in found if x[0] >= threshold]
            if passed:
                want[d, k] = (max(passed)[0], -max(passed)[1], len(passed))
    return want


def edited_benchmark(seed=6):
    """Items that share phrases; documents that hold items with some words changed, left out or put in."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    phrases = [" ".join(word() for _ in range(6)) for _ in range(4)]
    items = [(k, " ".join([*(word() for _ in range(r.randint(6, 26))), r.choice(phrases), *(word() for _ in range(r.randint(6, 26)))])) for k in range(30)]
    items[7] = (7, "so so so so so " * 3 + "and so on and so on")
    docs = []
    for k, t in items:
        for edits in range(5):
            w = t.split()
            for _ in range(edits):
                p = r.randrange(len(w))
                w[p : p + r.randint(0, 1)] = [word()] * r.randint(0, 2)
            docs.append((10 * k + edits, " ".join([*(word() for _ in range(r.randint(0, 40))), *w, *(word() for _ in range(r.randint(0, 40)))])))
    return items, docs


def test_decontamination_finds_what_brute_force_finds(spark):
    items, docs = edited_benchmark()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r["at"], r.windows) for r in find_contamination(frame(spark, docs), bench).collect()}
    want = brute_pairs(docs, items)
    assert {k: x[1:] for k, x in got.items()} == {k: x[1:] for k, x in want.items()} and len(want) > 100
    assert {k: x[0] for k, x in got.items()} == pytest.approx({k: x[0] for k, x in want.items()}, abs=2e-6)


def test_fingerprints_of_windows():
    r = np.random.default_rng(5)
    shingles = r.integers(0, 40, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weights = (1 + shingles % np.uint64(7)).astype(np.int64) << 24
    for span, block in ((1, 4096), (12, 64), (300, 7)):
        decontamination.WINDOWS = block
        got = decontamination.window_prints(shingles, weights, decontamination.earlier(shingles), span, 300 - span + 1)
        decontamination.WINDOWS = 4096
        for p in range(0, 300 - span + 1, 17):
            own, first = np.unique(shingles[p : p + span], return_index=True)
            assert (got[p] == decontamination.prints_of(decontamination.votes(own, weights[p + first]).sum(0, keepdims=True))[0]).all()
    prints = r.integers(0, 1 << 63, (4000, 4)).astype(np.uint64) * np.uint64(2)
    for k in range(4000):  # around the radius, spread over the blocks at random
        prints[k] = prints[0]
        for bit in r.choice(256, r.integers(80, 120), replace=False):
            prints[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    item = prints[0].copy()
    scan = np.flatnonzero([sum(int(x ^ y).bit_count() for x, y in zip(p.tolist(), item.tolist())) <= 100 for p in prints])
    assert decontamination.radius(0.5) == 100 and 100 < len(scan) < 3900
    assert (decontamination.within(prints, item, 100) == scan).all()


def test_the_radius_covers_the_threshold():
    """Sets of chosen weighted similarity: the share within the radius, by size and by how weights lie."""
    r, lost, n = np.random.default_rng(8), 0, 0
    for _ in range(3000):
        size = int(r.integers(4, 80))
        every, w = r.integers(0, 1 << 62, 2 * size).astype(np.uint64), (r.integers(15, 65, 2 * size) << 24) // 10
        cut = int(r.integers(0, size))
        a, b = np.arange(size), np.arange(cut, size + cut)
        both = np.intersect1d(a, b)
        j = w[both].sum() / w[np.union1d(a, b)].sum()
        if j < 0.5:
            continue
        pa_, pb_ = (decontamination.prints_of(decontamination.votes(every[x], w[x]).sum(0, keepdims=True)) for x in (a, b))
        lost, n = lost + (not len(decontamination.within(pa_, pb_[0], decontamination.radius(0.5)))), n + 1
    assert n > 800 and lost == 0


def test_decontamination_in_blocks_is_the_same(spark, monkeypatch):
    items, docs = edited_benchmark()
    items += [items[3], (5, items[8][1]), (None, items[9][1]), (91, " \t "), (92, "two words"), (93, None)]
    docs += [docs[4], (None, items[2][1]), (5000, "so two words here")]
    found = lambda: sorted((tuple(r) for r in find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    whole = found()
    for size in (9, 1000, 1):
        monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", size if size > 1 else 4)
        assert found() == whole and len(whole) > 100


@pytest.mark.parametrize("run", [substring_dedup, jaccard_join, line_dedup, lambda d: find_contamination(d, d.sparkSession.createDataFrame([(1, "a b c d")], "item_id long, text string"))])
def test_empty_table(spark, run):
    assert run(frame(spark, [(1, "x")]).limit(0)).count() == 0
