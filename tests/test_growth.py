"""What would grow past its limits on larger tables: rounds, rows shuffled, wide tables, partitions of a task."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weft import graph_queries
from weft.graph import Graph
from weft.plans.iterate import Rounds

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(monkeypatch):
    """Column lists of the tables that Rounds write."""
    seen, write = [], Rounds.write

    def spy(self, df, name=""):
        seen.append(df.columns)
        return write(self, df, name)

    monkeypatch.setattr(Rounds, "write", spy)
    return seen


def against_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "lineitem", "orders", "customer", "supplier", "part", "nation"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = graph_queries.QUERIES[name](spark, SF)
    want = sorted(db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in found.columns)} from ({graph_queries.ORACLES[name]})").fetchall())
    assert sorted(map(tuple, found.collect())) == want and want


def test_tolerance_pagerank_writes_few_tables(spark, written):
    g = Graph.from_edges(spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(0, 2)], "src long, dst long"))
    found = dict(rows(g.page_rank(tol=1e-6).vertices, "id", "pagerank"))
    rank = dict.fromkeys(range(5), 1.0)
    for _ in range(200):
        into = dict.fromkeys(range(5), 0.0)
        for s, d, w in [(0, 1, 0.5), (0, 2, 0.5), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 0, 1)]:
            into[d] += rank[s] * w
        rank = {k: 0.15 + 0.85 * into[k] for k in rank}
    assert found == pytest.approx(rank, abs=1e-4)
    assert len(written) < 20  # about 75 rounds


def exchanges(df) -> str:
    """The physical plan before it runs, and the keys that its shuffles go by."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_two_hops_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch):
    edges = [(k % 7, k % 5) for k in range(40)] + [(9, 100), (3, 3)]  # parallel ones, a self-loop, one that ends nowhere
    g = Graph(spark.range(10), spark.createDataFrame(edges, "src long, dst long"))
    df = g.count_matches("(p)-[]->(q); (q)-[]->(s)", ["p", "s"])
    want = {}
    for a, b in edges:
        for c, d in edges:
            if b == c and b != 100 and d != 100:
                want[a, d] = want.get((a, d), 0) + 1
    assert rows(df, "p", "s", "n") == sorted(((*k, n) for k, n in want.items()), key=repr)
    old = g.find("(p)-[]->(q); (q)-[]->(s)").groupBy(F.col("p.id").alias("p"), F.col("s.id").alias("s")).agg(F.count("*").alias("n"))
    assert rows(df, "p", "s", "n") == rows(old, "p", "s", "n")
    both = graph_queries.QUERIES["motif_two_hops"](spark, SF)
    assert not [x for x in exchanges(both) if "a#" in x and "c#" in x]
    against_sql(spark, "motif_two_hops")


def test_projection_is_counted_without_a_shuffle_of_pairs(spark):
    assert not [x for x in exchanges(graph_queries.QUERIES["property_graph_projection"](spark, SF)) if "src#" in x and "dst#" in x]


@pytest.mark.parametrize("most", [2, 4096])
def test_weighted_projection(spark, monkeypatch, most):
    from weft import property_graph

    monkeypatch.setattr(property_graph, "HUB", most)
    rated = [(i, j, float(i + 10 * j)) for i in range(7) for j in range(3) if (i + j) % 3] + [(2, 0, 5.0)]  # one twice
    a, b = (property_graph.VertexGroup(n, spark.range(9).toDF("id")) for n in "ab")
    p = property_graph.PropertyGraph([a, b], [property_graph.EdgeGroup("e", spark.createDataFrame(rated, "src long, dst long, w double"), a, b, False, weight="w")])
    got = p.projection_by("a", "b", "e", lambda x, y: x - 2 * y).edge_groups["projected_e"].data
    assert rows(got, "src", "dst", "weight") == sorted(((x, y, u - 2 * v) for x, j, u in rated for y, k, v in rated if j == k and x < y), key=repr)


def test_triangles_without_a_shuffle_of_wedges(spark):
    g = graph_queries.QUERIES["triangle_count"](spark, SF)
    assert not [x for x in exchanges(g) if "b#" in x and "c#" in x]
    edges = [(a, b) for a in range(14) for b in range(a, 14) if (a * b + a) % 4 != 1] + [(5, 0), (5, 0)]
    near = {(a, b) for x, y in edges if x != y for a, b in ((x, y), (y, x))}
    want = sorted((v, sum((v, x) in near and (v, y) in near and (x, y) in near for x in range(14) for y in range(x))) for v in range(14))
    assert rows(Graph.from_edges(spark.createDataFrame(edges, "src long, dst long")).triangle_count(), "id", "count") == sorted(want, key=repr)


def test_hash2vec_adds_up_behind_one_shuffle(spark):
    from weft.operators import walks

    w = spark.createDataFrame([([1, 2, 3, 1],), ([4],), ([],), ([2, 2],)], "random_walk array<long>")
    found = walks.hash2vec(w, dim=4, normalize=False)
    assert len(exchanges(found)) == 1
    assert dict((i, any(v)) for i, v in rows(found, "id", "embedding")) == {1: True, 2: True, 3: True, 4: False}


def plain_svd(edges, rank, rounds, g1=0.007, g2=0.007, g6=0.005, g7=0.015):
    """{id: (column1, column2, column3, column4)} and the loss, edge by edge."""
    from hashlib import md5

    known = [w for _, _, w in edges if w is not None]
    mean, ids = sum(known) / len(known), sorted({x for u, i, _ in edges for x in (u, i)})
    unit = lambda x, tag, k: int(md5(f"{x}:{tag}:{k}:42".encode()).hexdigest()[:12], 16) / 2**48
    f, y = ({x: [unit(x, tag, k) for k in range(rank)] for x in ids} for tag in "py")
    at = {x: [w for u, i, w in edges for end in (u, i) if end == x] for x in ids}
    b = {x: sum(w for w in at[x] if w is not None) / max(1, sum(w is not None for w in at[x])) - mean for x in ids}
    norm = {x: len(at[x]) ** -0.5 for x in ids}
    for t in range(rounds + 1):
        z = {u: [f[u][k] + norm[u] * sum(y[i][k] for v, i, _ in edges if v == u) for k in range(rank)] for u, _, _ in edges}
        err = [(u, i, w - min(5, max(0, mean + b[u] + b[i] + sum(p * q for p, q in zip(z[u], f[i]))))) for u, i, w in edges if w is not None]
        if t == rounds:
            sq = {x: [e * e for _, i, e in err if i == x] for x in ids}
            return {x: (f[x], z.get(x, y[x]), b[x] if any(w is not None for w in at[x]) else None, sum(sq[x]) if sq[x] else norm[x]) for x in ids}, sum(e * e for _, _, e in err) / len(err)
        f2, y2, b2 = {x: [*f[x]] for x in ids}, {x: [*y[x]] for x in ids}, dict(b)
        for u, i, e in err:
            for k in range(rank):
                f2[u][k] += g2 * (e * f[i][k] - g7 * f[u][k])
                f2[i][k] += g2 * (e * z[u][k] - g7 * f[i][k])
                y2[i][k] += g2 * (e * norm[u] * f[i][k] - g7 * y[i][k])
            b2[u] += g1 * (e - g6 * b[u])
            b2[i] += g1 * (e - g6 * b[i])
        f, y, b = f2, y2, b2


@pytest.mark.parametrize("few, most, block, interval", [(50_000, 12_000_000, 16 << 20, None), (3, 4, 200, None), (3, 12_000_000, 200, 3)])
def test_svd_against_every_edge_by_itself(spark, monkeypatch, few, most, block, interval):
    from weft.operators import factorization

    for name, value in (("FEW", few), ("MOST", most), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(factorization, name, value)
    # a hub, repeated edges, ends in both roles, a self-loop, ratings that aren't there, an item and a user without any
    edges = [(f"u{k % 9}", f"i{k * k % 7}", float(k % 5 + 1)) for k in range(50)] + [(f"u{k}", "hub", 4.0) for k in range(9)]
    edges += [("u1", "u2", 2.0), ("i1", "i2", 5.0), ("u3", "u3", 1.0), ("u1", "i0", None), ("u4", "none", None), ("ü", "i3", None)]
    g = Graph(spark.createDataFrame([(x, len(x)) for x in sorted({x for u, i, _ in edges for x in (u, i)} | {"alone"})], "id string, n int"), spark.createDataFrame(edges, "src string, dst string, weight double"))
    v, loss = g.svd_plus_plus(rank=2, max_iter=3, checkpoint_interval=interval)
    want, want_loss = plain_svd(edges, 2, 3)
    got = {r.id: r for r in v.collect()}
    assert loss == pytest.approx(want_loss) and got.keys() == want.keys() and v.count() == len(want)
    for x, (f, z, b, last) in want.items():
        assert got[x].n == len(x) and got[x].column1 == pytest.approx(f) and got[x].column2 == pytest.approx(z)
        assert got[x].column3 == (None if b is None else pytest.approx(b)) and got[x].column4 == pytest.approx(last)


def test_svd_moves_vertices_not_edges(spark, written, monkeypatch):
    from weft.operators import factorization

    monkeypatch.setattr(factorization, "FEW", 500)
    found = graph_queries.QUERIES["svd_plus_plus"](spark, SF)
    assert sum("w" in c for c in written) == 1  # edges are written as rows once, before the rounds
    assert not exchanges(found)  # bare vertices aren't made a second time
    against_sql(spark, "svd_plus_plus")
