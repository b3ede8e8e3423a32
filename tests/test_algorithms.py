import random

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tests.conftest import rows
from weft.errors import NoSuchVertex
from weft.graph import Graph
from weft.operators import components, walks
from weft.operators.paths import dst_attr
from weft.operators.walks import RandomWalkEmbeddings
from weft.plans.iterate import Rounds
from weft.sources import generators as gen


def graph(spark, edges, vertices=None, kind="long"):
    e = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    return Graph.from_edges(e) if vertices is None else Graph(spark.createDataFrame([(v,) for v in vertices], f"id {kind}"), e)


def groups(df):
    by = {}
    for i, c in rows(df, "id", "component"):
        by.setdefault(c, set()).add(i)
    return sorted(map(sorted, by.values()))


BFS6 = [(*pair, kind) for kind, pairs in {"friend": "ab ed da", "follow": "bc cb fc ef", "self": "ff"}.items() for pair in pairs.split()]


def test_bfs(spark):
    g = Graph(spark.createDataFrame([(x,) for x in "abcdef"], "id string"), spark.createDataFrame(BFS6, "src string, dst string, relationship string"))
    assert g.bfs("id = 'x'", "id = 'a'").count() == 0
    assert g.bfs("id = 'a'", "id = 'a'").columns == ["from", "to"]
    one = g.bfs("id = 'a'", "id = 'b'")
    assert one.columns == ["from", "e0", "to"] and one.count() == 1
    two = g.bfs("id = 'e'", "id = 'b'")
    assert two.columns == ["from", "e0", "v1", "e1", "v2", "e2", "to"] and two.count() == 2
    assert g.bfs("id = 'e'", "id = 'b'", max_path_length=2).count() == 0
    assert g.bfs("id = 'e'", "id = 'b'", max_path_length=3).count() == 2
    assert rows(g.bfs("id = 'e'", "id = 'b'", "src <> 'd'"), "e0.dst") == [("f",)]
    assert rows(g.bfs("id = 'e'", "id = 'b'", "relationship = 'friend'"), "e0.dst") == [("d",)]
    with pytest.raises(ValueError):
        g.bfs(None, "id = 'a'")


def test_shortest_paths(spark):
    pairs = [(1, 2), (1, 5), (2, 3), (2, 5), (3, 4), (4, 5), (4, 6)]
    g = graph(spark, pairs + [(b, a) for a, b in pairs])
    got = {i: d for i, d in g.shortest_paths([1, 4]).select("id", "distances").collect()}
    assert got == {1: {1: 0, 4: 2}, 2: {1: 1, 4: 2}, 3: {1: 2, 4: 1}, 4: {1: 2, 4: 0}, 5: {1: 1, 4: 1}, 6: {1: 3, 4: 1}}
    f = gen.friends(spark).shortest_paths(["a", "d"])
    assert f.columns == ["id", "name", "age", "distances"]
    assert {i: d for i, d in f.select("id", "distances").collect()} == {"a": {"a": 0, "d": 2}, "b": {}, "c": {}, "d": {"a": 1, "d": 0}, "e": {"a": 2, "d": 1}, "f": {}, "g": {}}
    assert graph(spark, pairs).shortest_paths([6], is_directed=False).where("size(distances) = 1").count() == 6


def test_aggregate_neighbors(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 4), (1, 3)])
    path = g.aggregate_neighbors("id = 1", ["path"], [F.col("id").cast("string")], [F.concat("path", F.lit("->"), F.col("dst_id").cast("string"))], 5, target_condition=dst_attr("id") == 4)
    assert rows(path, "path", "id") == [("1->2->3->4", 4), ("1->3->4", 4)]
    g = graph(spark, [(1, 2), (2, 3), (3, 1), (1, 3), (2, 1)])
    seen = g.aggregate_neighbors("id = 1", ["seen"], [F.array("id")], [F.array_append("seen", F.col("dst_id"))], 5, stopping_condition=F.array_contains("seen", F.col("dst_id")))
    assert sorted(hop for hop, in rows(seen, "hop")) == [2, 2, 3]
    assert all(n == hop + 1 for n, hop in rows(seen, F.size("seen"), "hop"))
    with pytest.raises(ValueError):
        g.aggregate_neighbors("id = 1", ["x"], ["1"], ["x"], 2)


def test_cycles(spark):
    found = lambda e: sorted(list(r[0]) for r in graph(spark, e).detect_cycles().collect())
    assert found([(1, 2), (2, 3), (3, 1), (1, 4), (2, 5)]) == [[1, 2, 3, 1]]
    assert found([(1, 2), (2, 3), (3, 4), (4, 5)]) == []
    assert found([(1, 2), (2, 1), (1, 3), (3, 1), (2, 5), (5, 1)]) == [[1, 2, 1], [1, 2, 5, 1], [1, 3, 1]]
    assert found([(7, 7)]) == [[7, 7]]
    long = [(i, (i + 1) % 13) for i in range(13)]
    assert found(long) == [[*range(13), 0]]


@pytest.mark.parametrize("algorithm", ["two_phase", "randomized_contraction", "propagation"])
def test_connected_components(spark, algorithm):
    run = lambda g: groups(g.connected_components(algorithm))
    friends = gen.friends(spark)
    assert run(friends) == [list("abcdef"), ["g"]]
    assert friends.connected_components(algorithm).columns == ["id", "name", "age", "component"]
    assert run(graph(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (6, 6)], range(8))) == [[0, 1, 2], [3, 4, 5], [6], [7]]
    top = 2**63 - 1
    assert len(run(graph(spark, [(top - i, top - i - 1) for i in range(9)]))) == 1
    assert run(gen.empty(spark)) == []


def test_connected_components_shapes(spark):
    for g in (gen.chain(spark, 40), gen.star(spark, 5), gen.two_blobs(spark, 3)):
        assert len(groups(g.connected_components())) == 1
    with pytest.raises(ValueError):
        gen.star(spark, 2).connected_components("other")


def test_strong_components(spark):
    ring = graph(spark, [(i, (i + 1) % 7) for i in range(7)])
    assert {c for _, c in rows(ring.strongly_connected_components(10), "id", "component")} == {0}
    two = graph(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (6, 0), (5, 7)])
    assert dict(rows(two.strongly_connected_components(10), "id", "component")) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert groups(graph(spark, [(1, 1)], [1, 2]).strongly_connected_components(3)) == [[1], [2]]


def test_label_propagation(spark):
    g = gen.two_blobs(spark, 4)
    labels = dict(rows(g.label_propagation(8), "id", "label"))
    assert len({labels[i] for i in range(1, 4)}) == 1 and len({labels[i] for i in range(5, 8)}) == 1
    assert dict(rows(graph(spark, [("a", "b")], "abc", "string").label_propagation(1, True), "id", "label")) == {"a": "a", "b": "a", "c": "c"}


def test_triangles(spark):
    assert rows(graph(spark, [(0, 1), (1, 2), (2, 0), (0, 1), (1, 0), (2, 2)]).triangle_count(), "id", "count") == [(0, 1), (1, 1), (2, 1)]
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (0, -1), (-1, -2), (-2, 0)])
    assert dict(rows(g.triangle_count(), "id", "count")) == {0: 2, 1: 1, 2: 1, -1: 1, -2: 1}
    assert rows(g.triangle_count(), "id", "count") == rows(g.triangle_count("approx"), "id", "count")
    assert graph(spark, [(0, 1)]).triangle_count().agg(F.sum("count")).first()[0] == 0


def test_k_core(spark):
    tail = graph(spark, [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5)])
    assert rows(tail.k_core(), "id", "kcore") == [(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)]
    assert rows(tail.as_undirected().k_core(), "id", "kcore") == rows(tail.k_core(), "id", "kcore")
    assert dict(rows(gen.friends(spark).k_core(), "id", "kcore"))["g"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_independent_set(spark, seed):
    g = gen.friends(spark)
    members = {i for i, in rows(g.maximal_independent_set(seed), "id")}
    edges = {(s, d) for s, d in rows(g.edges, "src", "dst") if s != d}
    assert not any(s in members and d in members for s, d in edges)
    assert all(v in members or any({s, d} & members and v in (s, d) for s, d in edges) for v, in rows(g.vertices, "id"))
    few = {i for i, in rows(graph(spark, [(0, 1)], range(4)).maximal_independent_set(seed), "id")}
    assert len(few) == 3 and {2, 3} <= few
    assert members == {i for i, in rows(g.maximal_independent_set(seed), "id")}


def test_page_rank(spark):
    g = gen.star(spark, 4).as_reversed()
    ranks = dict(rows(g.page_rank(max_iter=3).vertices, "id", "pagerank"))
    assert abs(sum(ranks.values()) - 5) < 1e-9 and ranks[0] > ranks[1]
    exact, loose = (dict(rows(gen.friends(spark).page_rank(**k).vertices, "id", "pagerank")) for k in ({"tol": 1e-5}, {"max_iter": 40}))
    assert all(abs(exact[i] - loose[i]) < 1e-2 for i in exact)
    own = dict(rows(gen.friends(spark).page_rank(source_id="a", max_iter=10).vertices, "id", "pagerank"))
    assert own["g"] == 0 and abs(sum(own.values()) - 1) < 1e-9
    double = graph(spark, [(0, 1), (0, 1), (0, 2)]).page_rank(max_iter=2)
    assert rows(double.edges, "src", "dst", F.round("weight", 3)) == [(0, 1, 0.333), (0, 1, 0.333), (0, 2, 0.333)]
    first = gen.friends(spark).page_rank(max_iter=3).vertices
    warm = dict(rows(gen.friends(spark).page_rank(max_iter=1, initial_ranks=first).vertices, "id", "pagerank"))
    assert abs(sum(warm.values()) - 7) < 1e-9 and all(abs(warm[i] - loose[i]) < 0.2 for i in loose)
    with pytest.raises(ValueError):
        g.page_rank(max_iter=1, initial_ranks=first.limit(0))
    with pytest.raises(ValueError):
        g.page_rank(max_iter=1, tol=0.1)
    with pytest.raises(NoSuchVertex):
        gen.friends(spark).page_rank(source_id="zz", max_iter=1)


def test_parallel_page_rank(spark):
    g = gen.friends(spark)
    many = g.parallel_personalized_page_rank(source_ids=["a", "e"], max_iter=10).vertices.select("id", vector_to_array("pageranks").alias("r")).collect()
    for k, s in enumerate("ae"):
        one = dict(rows(g.page_rank(source_id=s, max_iter=10).vertices, "id", "pagerank"))
        assert all(abs(r.r[k] - one[r.id]) < 1e-9 for r in many)


def test_clustering_and_factorization(spark):
    w = [0.5, 0.7, 0.9, 1.1, 1.3]
    e = spark.createDataFrame([(str(i), str(j), w[j]) for i in range(6) for j in range(i)], "src string, dst string, weight double")
    found = dict(rows(Graph.from_edges(e).power_iteration_clustering(2, 40, "weight"), "id", "cluster"))
    assert len(found) == 6 and set(found.values()) == {0, 1}
    v, loss = gen.ratings(spark).svd_plus_plus()
    assert {"id", "column1", "column2", "column3", "column4"} == set(v.columns)
    assert v.where("id % 2 = 1").agg(F.sum("column4")).first()[0] / 16 == pytest.approx(loss) and loss <= 8
    assert loss == gen.ratings(spark).svd_plus_plus()[1]


def test_walks_and_embeddings(spark):
    g = gen.friends(spark)
    w = g.random_walks(num_walks_per_node=10, batch_size=5, num_batches=5)
    assert w.count() == 60 and {n for n, in rows(w, F.size("random_walk"))} == {25}
    near = {(s, d) for s, d in rows(g.as_undirected().edges, "src", "dst")}
    for walk, in rows(w.limit(5), "random_walk"):
        assert all((a, b) in near or b == walk[0] for a, b in zip(walk, walk[1:]))
    assert rows(w, "*") == rows(g.random_walks(num_walks_per_node=10, batch_size=5, num_batches=5), "*")
    sink = graph(spark, [(0, 1)]).random_walks(num_walks_per_node=1, batch_size=4, num_batches=1, use_edge_direction=True, restart_probability=0.0)
    assert rows(sink, "random_walk") == [([0, 1, 0, 1],)]
    emb = walks.hash2vec(w, dim=16, safe_norm=False).select("id", vector_to_array("embedding").alias("x")).collect()
    assert len(emb) == 6 and all(abs(sum(x * x for x in r.x) - 1) < 1e-4 for r in emb)
    both = RandomWalkEmbeddings(g).set_rw_model(num_walks_per_node=2, batch_size=5, num_batches=1).set_hash2vec(dim=8).set_neighbors_aggregation().run()
    assert {n for n, in rows(both, F.size(vector_to_array("embedding")))} == {18}
    with pytest.raises(ValueError):
        RandomWalkEmbeddings(g).run()
    assert rows(walks.k_min(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), "k", "id", -F.col("id"), 2), "k", "id") == [(0, 6), (0, 8), (1, 7), (1, 9)]


@pytest.mark.parametrize("run", [components.star_components, components.contraction_components])
def test_components_converge_or_raise(spark, run):
    ids = list(range(41))
    random.Random(3).shuffle(ids)
    e = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
    cut = Rounds(spark, "t").cut
    assert {r.component for r in run(e, cut).collect()} == {0}
    with pytest.raises(components.NotConverged):
        run(e, cut, max_rounds=1)


def test_walks_go_on_where_they_stopped(spark, tmp_path):
    g = gen.two_blobs(spark, 3)
    options = {"num_walks_per_node": 2, "batch_size": 3, "path": str(tmp_path), "run_id": "r"}
    whole = rows(g.random_walks(num_batches=3, num_walks_per_node=2, batch_size=3), "*")
    g.random_walks(num_batches=1, **options)
    assert rows(g.random_walks(num_batches=3, starting_batch=1, **options), "*") == whole
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    for bad in ({"starting_batch": 3}, {"starting_batch": -1}):
        with pytest.raises(ValueError):
            g.random_walks(num_batches=3, **bad, **options)
    with pytest.raises(ValueError):
        g.random_walks(num_batches=3, starting_batch=1)


def test_walks_are_cleaned_up(spark, tmp_path):
    g = gen.two_blobs(spark, 3)
    make = lambda: RandomWalkEmbeddings(g).set_rw_model(num_walks_per_node=1, batch_size=3, num_batches=1, path=str(tmp_path)).set_hash2vec(dim=4)
    kept = rows(make().run().select("id", vector_to_array("embedding")), "*")
    assert len(list(tmp_path.iterdir())) == 1
    assert rows(make().set_clean_up_after_run().run().select("id", vector_to_array("embedding")), "*") == kept
    assert len(list(tmp_path.iterdir())) == 1


def test_convolution_is_the_mean_of_the_sample(spark):
    g = graph(spark, [(1, 2), (1, 3), (3, 1), (4, 1)])
    own = {i: [float(i), float(i * i)] for i in range(1, 5)}
    f = spark.createDataFrame(list(own.items()), "id long, x array<double>").select("id", array_to_vector("x").alias("embedding"))
    got = dict(walks.sampling_convolution(g, f, use_edge_direction=True).select("id", vector_to_array("embedding")).collect())
    to = {1: [2, 3], 2: [], 3: [1], 4: [1]}
    assert got == {i: own[i] + [sum(own[j][k] for j in to[i]) / len(to[i]) if to[i] else 0.0 for k in (0, 1)] for i in own}
