"""MaxScore, token counts, mixing, the pipeline's stages: against brute force, with awkward rows."""

import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weft.llm import max_score as ms
from weft.llm import mixing
from weft.llm.mixing import mix_sources
from weft.llm.queries import ORACLES, QUERIES
from weft.llm.token_counts import Counter, token_counts

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_max_score(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(ms, "SHARD_ROWS", 16)
    monkeypatch.setattr(ms, "QUERY_BYTES", block_bytes)
    r = random.Random(1)
    v = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(80)] + [(i, [0.5] * 8) for i in range(80, 100)]
    v += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 8), (103, [float("inf")] * 8), (None, [1.0] * 8), (104, [0.25]), (105, []), (110, [])]
    df = spark.createDataFrame([(*x, 1) for x in v], "vec_id long, embedding array<double>, rank int").repartition(4)
    ints = ms.integer_vectors(df, "vec_id", "embedding")
    got = rows(ms.max_score_top_k(ints.where("id % 10 = 0"), ints, 5), "query_id", "rank", "vec_id", "score")
    ok = {i: [math.floor(1024 * x) for x in e] for i, e in v if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in [i for i in ok if i % 10 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)
    few = ms.max_score_top_k(ints.where("id = 0"), ints.where("id < 3"), 5)
    assert few.count() == 2 and ms.max_score_top_k(ints.limit(0), ints, 5).count() == 0 and ms.max_score_top_k(ints, ints.limit(0), 5).count() == 0


def test_max_score_of_empty_and_of_huge_vectors(spark):
    none = spark.createDataFrame([(i, []) for i in range(5)], "id long, v array<long>")
    assert rows(ms.max_score_top_k(none, none, 2), "query_id", "vec_id", "score") == sorted([(q, i, 0) for q in range(5) for i in [x for x in range(5) if x != q][:2]], key=repr)
    big = [(i, [(1 << 30) + i, 3 - i]) for i in range(9)] + [(9, [5])]
    df = spark.createDataFrame(big, "id long, v array<long>").repartition(3)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = [(q, i, dot(v, dict(big)[i])) for q, v in big for i in sorted((j for j, _ in big if j != q), key=lambda j: (-dot(v, dict(big)[j]), j))[:3]]
    assert rows(ms.max_score_top_k(df, df, 3), "query_id", "vec_id", "score") == sorted(want, key=repr)


def test_max_score_prunes_nothing_it_needs():
    rng = np.random.default_rng(2)
    for n in range(20):
        body = rng.integers(-50, 50, (3000, 12))
        body[:, rng.integers(12)] *= 40
        terms, q, ids = np.ascontiguousarray(body.T), rng.integers(-50, 50, 12), rng.permutation(3000)
        if n % 2:
            terms, q = terms.astype(float), q.astype(float)
        best = None
        for part in (slice(0, 1500), slice(1500, 3000)):
            own = np.ascontiguousarray(terms[:, part])
            best = ms.top_of_shard(q, ids[part], own, own.min(1), own.max(1), -1, 10, best)
        s, i = best
        want = sorted(zip((-(body @ q)).tolist(), ids.tolist()))[:10]
        assert list(zip((-s).tolist(), i.tolist())) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name):
    c, r = Counter(tokenizers.path(name)), random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "23", ".", "'s", "'ll", "<|endoftext|>", "日本", "\x1c", "🙂", "ﬁ", "\r\n", "_", "—", "word", "Word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(800)] + ["", "a" * 3000, " lead", "trail "]
    for t in texts:
        assert c(t) == (c.library(t) if t else 0), t


def test_token_counts_and_cache(spark, tmp_path):
    path, cache = tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    data = [(1, "hello world"), (2, "hello world"), (2, "hello world"), (3, None), (4, ""), (None, "x é"), (5, "word " * 40000), (6, "<|endoftext|>")]
    d = spark.createDataFrame([(*x, 0, b"1") for x in data], "doc_id long, text string, n_tokens int, digest binary").repartition(3)
    got = rows(token_counts(d, path, cache_path=cache), "doc_id", "n_bytes", "n_tokens", "over_limit")
    c = Counter(path)
    assert got == sorted(((i, len((t or "").encode()), c(t or ""), c(t or "") > 512) for i, t in data), key=repr)
    stored = lambda: spark.read.option("recursiveFileLookup", "true").parquet(cache)
    assert stored().count() == 5  # distinct texts; null and empty are one
    more = d.unionAll(spark.createDataFrame([(7, "new text", 0, b"1")], d.schema))
    assert token_counts(more, path, cache_path=cache).count() == 9 and stored().count() == 6
    assert token_counts(d.limit(0), path).count() == 0


def brute_targets(sizes, ratio=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, got, open_ = ratio * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return got | {s: left * w[s] / total for s in open_}
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
        open_ -= over
    return got


def test_mixing(spark, monkeypatch):
    r = random.Random(6)
    docs = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 30, 200]))), r.choice(["a", "a", "a", "b", "é", "Z", None, ""])) for i in range(400)]
    docs += [(500, None, "a"), (None, "x y z", "b"), (None, "x y z", "b"), (501, "x y z", "only one"), (502, None, "nothing")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, size int, target int").repartition(4)
    got = mix_sources(d).collect()
    assert len(got) == len(docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert all(-1 <= taken[s] - want[s] <= 1e-6 for s in want)
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(d.repartition(2)).collect()))
    assert mix_sources(d.limit(0)).count() == 0
    # few rows left before anything is sorted: equal keys, ids and sizes are split too
    monkeypatch.setattr(mixing, "EDGE_ROWS", 1)
    same = docs + [(600, "x y z w", "b")] * 40 + [(None, "v " * 9, "b")] * 30 + [(700 + i, "u u", "b") for i in range(5)]
    e = spark.createDataFrame([(*x, 1, 2) for x in same], d.schema).repartition(3)
    tight = mix_sources(e).collect()
    monkeypatch.setattr(mixing, "EDGE_ROWS", 10_000)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(repr, tight)) == sorted(map(repr, mix_sources(e).collect())) and len(tight) == len(same)
    monkeypatch.undo()
    rare = mix_sources(d, weight=F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(0.02)).where("source = 'a' and size > 0")
    share = dict(rows(rare.groupBy((F.col("doc_id") % 2).alias("odd")).agg((F.sum("taken") / F.sum("size")).alias("s")), "odd", "s"))
    assert share[0] >= share[1]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda df: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(c.execute(ORACLES[name]).df())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(8)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randint(2, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    docs = [(i, text(6)) for i in range(60)]
    near = docs[3][1].split(" ")
    near[20] = "changed"
    item = " ".join(word() for _ in range(25))
    bad = [(100 + k, text(2) + " scumbag morons " + text(1)) for k in range(40)]
    docs += bad + [(200, docs[2][1]), (201, " ".join(near).replace("\n", " ")), (202, text(2) + " " + item), (203, None), (204, ""), (None, text(3)), (205, docs[5][1] + "\nextra words at the end"), (206, docs[6][1]), (206, docs[6][1])]
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 140)) for i in [*range(60), *range(100, 140)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(cp.STAGES) == 5
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        at = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({i for i, in rows(at, "doc_id")})
    clean = set(range(60)) | {203, 204, None}
    assert not any(i is not None and 100 <= i < 140 for i in kept[0]) and clean <= kept[0]
    assert 200 not in kept[1] and 205 in kept[1] and 206 not in kept[1]
    assert clean - {3} <= kept[2] and len(kept[2] & {3, 201}) == 1
    assert 202 not in kept[3] and clean - {3} <= kept[3]
    text1 = dict(rows(spark.read.parquet(f"{tmp_path}/stage1"), "doc_id", "text"))
    assert text1[205] == "extra words at the end"
    assert {"doc_id", "taken", "target"} <= set(at.columns) and at.count() == spark.read.parquet(f"{tmp_path}/stage3").count()
    again = cp.run(spark, str(tmp_path))
    assert rows(again, "doc_id", "taken") == rows(at, "doc_id", "taken")
    assert zlib.crc32(b"1") % 5 is not None


def test_near_copies_of_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    schema = "doc_id long, text string, lang string, source string, n_chars long, k_id int, `C0` string"
    run = lambda docs: sorted((tuple(r) for r in cp.drop_near_copies(spark, spark.createDataFrame([(i, t, "en", s, 1, 5, "x") for i, t, s in docs], schema).repartition(3), "").select("doc_id", "text", "source").collect()), key=repr)
    assert run([(3, a, "s"), (7, a, "s"), (7, b, "s"), (None, a + " z", "s"), (None, c, "s")]) == sorted([(3, a, "s"), (7, b, "s"), (None, c, "s")], key=repr)
    assert run([(None, a, "s"), (None, a, "r"), (None, b, "s"), (None, None, "s"), (None, None, "s"), (4, "", "s"), ((1 << 63) - 1, c, "s"), (None, c, "s"), (None, d, "s")]) == sorted([(None, a, "r"), (None, b, "s"), (None, None, "s"), (None, None, "s"), (4, "", "s"), ((1 << 63) - 1, c, "s"), (None, d, "s")], key=repr)
    assert run([]) == [] and run([(5, a, "s"), (5, a + " z", "s"), (5, b, "s"), (5, b, "s")])[-1] == (5, b, "s")


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_stages_keep_columns_of_any_name(spark, tmp_path, k):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, k_id int, k_row int, `_id` int, n_lines string, score int, predicted string, gone int, least int, `c1` int, `x.y` int"
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text + f" z{i}" * 30 if i else None, "en", "s", 1, 2, 3, 4, "r", 5, "p", 6, 7, 8, 9) for i in range(4)], schema)
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that is in none of them")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.STAGES[k][1](spark, docs, str(tmp_path))
    got = out.collect()
    assert out.columns == docs.columns and len(got) == 4
    assert {tuple(r)[5:] for r in got} == {tuple(r)[5:] for r in docs.collect()}
    assert cp.STAGES[k][1](spark, docs.limit(0), str(tmp_path)).count() == 0
