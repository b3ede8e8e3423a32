import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weft.errors import InvalidPropertyGroup
from weft.examples.belief_propagation import run_bp
from weft.graph import Graph
from weft.property_graph import EdgeGroup, PropertyGraph, VertexGroup
from weft.sources import edge_list, generators as gen
from weft.streaming.batches import latest_result, on_each_batch, results_of


@pytest.fixture(scope="module")
def store(spark):
    people = VertexGroup("people", spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie"), (4, "David"), (5, "Eve")], "id long, name string"))
    movies = VertexGroup("movies", spark.createDataFrame([(1, "Matrix"), (2, "Inception"), (3, "Interstellar")], "id long, title string"))
    likes = EdgeGroup("likes", spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 2), (4, 3), (5, 2)], "src long, dst long"), people, movies, False)
    talk = EdgeGroup("messages", spark.createDataFrame([(1, 2, 5.0), (2, 3, 8.0), (3, 4, 3.0), (4, 5, 6.0), (5, 1, 9.0)], "src long, dst long, weight double"), people, people, True, weight="weight")
    return PropertyGraph([people, movies], [likes, talk])


def test_projection_in_blocks(spark, monkeypatch):
    from weft import property_graph

    monkeypatch.setattr(property_graph, "HUB", 3)
    pairs = [(i, j) for i in range(12) for j in range(3) if (i * j) % 5 < 3]
    a, b = (VertexGroup(n, spark.range(12).toDF("id")) for n in "ab")
    p = PropertyGraph([a, b], [EdgeGroup("e", spark.createDataFrame([*pairs, (1, None)], "src long, dst long"), a, b, False)])
    got = p.projection_by("a", "b", "e").edge_groups["projected_e"].data
    assert rows(got, "src", "dst") == sorted(((x, y) for x, j in pairs for y, k in pairs if j == k and x < y), key=repr)


def test_property_graph(spark, store):
    g = store.to_graph(["people", "movies"], ["likes", "messages"])
    assert g.vertices.count() == 8 and g.edges.count() == 17
    assert g.vertices.where(F.col("id") == F.concat(F.lit("people"), F.sha2(F.lit("1"), 256))).count() == 1
    assert store.to_graph(["people"], ["messages"], {"messages": "weight > 5"}).edges.count() == 3
    pairs = store.projection_by("people", "movies", "likes")
    assert rows(pairs.edge_groups["projected_likes"].data, "src", "dst") == [(1, 2), (1, 3), (1, 5), (3, 5)]
    assert set(pairs.vertex_groups) == {"people"} and set(pairs.edge_groups) == {"messages", "projected_likes"}
    degrees = store.to_graph(["people"], ["messages"]).out_degrees
    assert rows(store.join_vertices(degrees, ["people"]), "external_id", "property_group", "outDegree") == [(str(i), "people", 1) for i in range(1, 6)]
    with pytest.raises(InvalidPropertyGroup):
        store.to_graph(["nobody"], ["likes"])
    with pytest.raises(InvalidPropertyGroup):
        EdgeGroup("x", spark.createDataFrame([(1, 1, "a")], "src long, dst long, w string"), store.vertex_groups["people"], store.vertex_groups["people"], weight="w")


def test_edge_list(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# a comment\n\n2 1\n3\t 4 extra\n")
    g = edge_list.read_edge_list(spark, str(tmp_path / "e.txt"))
    assert rows(g.edges, "src", "dst", "attr") == [(2, 1, 1), (3, 4, 1)] and g.vertices.count() == 4
    assert rows(edge_list.read_edge_list(spark, str(tmp_path / "e.txt"), True).edges, "src", "dst") == [(1, 2), (3, 4)]
    (tmp_path / "bad.txt").write_text("1\n")
    with pytest.raises(Exception, match="two ids"):
        edge_list.read_edge_list(spark, str(tmp_path / "bad.txt")).edges.collect()


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    g = gen.friends(spark)
    edge_list.write_graph(g, str(tmp_path / fmt), fmt)
    back = edge_list.read_graph(spark, str(tmp_path / fmt), fmt)
    assert rows(back.edges, "src", "dst", "relationship") == rows(g.edges, "src", "dst", "relationship")


def test_from_tuples(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long")
    assert rows(edge_list.from_edge_tuples(e, 7, unique=True).edges, "src", "dst", "attr") == [(1, 2, 2), (2, 3, 1)]
    g = edge_list.with_default_vertices(spark.createDataFrame([(1, "a")], "id long, name string"), e, {"name": "?"})
    assert rows(g.vertices, "id", "name") == [(1, "a"), (2, "?"), (3, "?")]


def test_generators(spark):
    assert gen.chain(spark, 5).edges.count() == 4
    assert gen.two_blobs(spark, 3).edges.count() == 19
    assert gen.grid(spark, 3, 4).edges.count() == 3 * 3 + 2 * 4
    assert rows(gen.star(spark, 3).edges, "src", "dst") == [(0, 1), (0, 2), (0, 3)]
    e = gen.rmat(spark, 64, 100).edges
    assert 90 <= e.count() == e.distinct().count() <= 100
    assert rows(gen.log_normal(spark, 20, 1, 0.5).edges, "*") == rows(gen.log_normal(spark, 20, 1, 0.5).edges, "*")
    ising = gen.ising_grid(spark, 3)
    assert ising.edges.count() == 2 * 3 * 2
    beliefs = [b for b, in rows(run_bp(ising, 2), "belief")]
    assert len(beliefs) == 9 and all(0 < b < 1 for b in beliefs)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long").write.parquet(str(src))
    q = on_each_batch(spark.readStream.schema("src long, dst long").parquet(str(src)), str(tmp_path / "all"), Graph.connected_components, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    spark.createDataFrame([(2, 3)], "src long, dst long").write.mode("append").parquet(str(src))
    q.processAllAvailable()
    q.stop()
    assert rows(latest_result(spark, str(tmp_path / "out")), "id", "component") == [(i, 1) for i in (1, 2, 3, 4)]
    assert results_of(spark, str(tmp_path / "out")) == [0, 1] and results_of(spark, str(tmp_path / "none")) == []
    (tmp_path / "out" / "batch=7").mkdir()  # being written
    assert rows(latest_result(spark, str(tmp_path / "out")), "id", "component") == [(i, 1) for i in (1, 2, 3, 4)]


def test_scratch(spark, tmp_path, monkeypatch):
    from weft.plans import iterate

    at = tmp_path / "x"
    spark.range(3).write.parquet(str(at))
    iterate.remove_table(spark, f"file:{at}")
    assert not at.exists()
    rounds = iterate.Rounds(spark, "t")
    grown = rounds.collector("grown")
    for k in range(3):
        assert grown.add(spark.range(k, k + 1)).count() == 1
    assert rows(grown.all(), "id") == [(0,), (1,), (2,)]
    with pytest.raises(ValueError):
        iterate.as_storage_level("nowhere")

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: {"spark.master": "yarn"}.get(name, default))})()

    with pytest.raises(ValueError):
        iterate.shared_dir(Cluster())
