import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weft.errors import InvalidGraph
from weft.graph import Graph, long_ids
from weft.operators.messages import AggregateMessages as AM
from weft.operators.pregel import Pregel
from weft.sources import generators as gen


@pytest.fixture(scope="module")
def local(spark):
    return Graph(spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, name string"), spark.createDataFrame([(1, 2, "love"), (2, 1, "hate"), (2, 3, "follow")], "src long, dst long, action string"))


def test_construction(spark, local):
    with pytest.raises(InvalidGraph):
        Graph(spark.range(1).toDF("x"), local.edges)
    with pytest.raises(ValueError):
        Graph(local.vertices, local.vertices)
    assert rows(Graph.from_edges(local.edges).vertices, "id") == [(1,), (2,), (3,)]
    assert local.vertex_columns == ["id", "name"] and local.edge_column_map == {"src": 0, "dst": 1, "action": 2}
    assert repr(local) == "Graph(v: [id: bigint, name: string], e: [src: bigint, dst: bigint, action: string])"


def test_degrees(local):
    assert rows(local.out_degrees, "id", "outDegree") == [(1, 1), (2, 2)]
    assert rows(local.in_degrees, "id", "inDegree") == [(1, 1), (2, 1), (3, 1)]
    assert rows(local.degrees, "id", "degree") == [(1, 2), (2, 3), (3, 1)]
    out = local.type_out_degree("action", ["love", "hate", "follow"])
    assert rows(out, "id", "outDegrees.*") == [(1, 1, 0, 0), (2, 0, 1, 1)]
    assert rows(local.type_in_degree("action", ["hate"]), "id", "inDegrees.hate") == [(1, 1), (2, 0), (3, 0)]
    assert local.type_degree("action").schema["degrees"].dataType.names == ["follow", "hate", "love"]


def test_restructuring(spark, local):
    g = local.filter_vertices("id < 3")
    assert rows(g.edges, "src", "dst") == [(1, 2), (2, 1)]
    assert rows(local.filter_edges(F.col("action") == "follow").drop_isolated_vertices().vertices, "id") == [(2,), (3,)]
    assert local.as_undirected().edges.count() == 6
    assert rows(local.as_reversed().edges, "src", "dst", "action") == [(1, 2, "hate"), (2, 1, "love"), (3, 2, "follow")]
    assert local.triplets.columns == ["src", "edge", "dst"]
    odd = Graph(spark.createDataFrame([(1, 2)], "id long, `a.b` int"), spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert odd.triplets.select("src.`a.b`").first()[0] == 2
    assert rows(local.collect_neighbor_ids("out"), "id", F.array_join("neighbors", ",")) == [(1, "2"), (2, "1,3")]
    assert local.partition_by("edge2d", 4).edges.rdd.getNumPartitions() == 4
    assert local.pick_random_vertex() in (1, 2, 3)


def test_validate(spark, local):
    local.validate()
    with pytest.raises(InvalidGraph, match="repeated"):
        Graph(local.vertices.unionAll(local.vertices.where("id = 1")), local.edges).validate()
    lost = Graph(local.vertices, local.edges.unionAll(spark.createDataFrame([(1, 4, "x")], local.edges.schema)))
    with pytest.raises(InvalidGraph, match="not vertices"):
        lost.validate()
    lost.validate(check_vertices=False)


def test_long_ids(spark):
    ids = long_ids(spark.createDataFrame([(x,) for x in "dbcaa"], "id string"))
    assert rows(ids, "id", "new_id") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_aggregate_messages(spark):
    g = gen.friends(spark)
    got = g.aggregate_messages([F.sum(AM.msg).alias("s")], to_src=AM.dst["age"], to_dst=AM.src["age"])
    assert dict(rows(got, "id", "s"))["a"] == 36 + 29 + 32 and "g" not in dict(rows(got, "id", "s"))
    with pytest.raises(ValueError):
        g.aggregate_messages([F.sum(AM.msg).alias("s")])


def test_pregel_page_rank(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 4), (2, 0), (3, 4), (4, 0), (4, 2)], "src long, dst long")
    v = Graph.from_edges(e)
    v = Graph(v.vertices.join(v.out_degrees, "id"), e)
    ranks = v.pregel.setMaxIter(5).withVertexColumn("rank", F.lit(1.0 / 5), F.coalesce(Pregel.msg(), F.lit(0.0)) * 0.85 + 0.15 / 5)
    ranks = ranks.sendMsgToDst(Pregel.src("rank") / Pregel.src("outDegree")).aggMsgs(F.sum(Pregel.msg())).run()
    want = [0.245, 0.224, 0.303, 0.030, 0.197]
    assert all(abs(r - w) < 1e-3 for (_, r), w in zip(rows(ranks, "id", "rank"), want))


def test_pregel_decides_on_the_destination(spark):
    g = gen.chain(spark, 4)
    base = lambda: g.pregel.withVertexColumn("x", F.col("id"), F.greatest("x", F.coalesce(Pregel.msg(), F.lit(-1)))).aggMsgs(F.max(Pregel.msg()))
    state = g.vertices.select("id", F.lit(True).alias("_pregel_is_active"), F.col("id").alias("x"))
    assert not base().sendMsgToDst(Pregel.src("x")).reads_dst(state, g.edges)
    assert not base().sendMsgToDst(F.when(Pregel.dst("id") > 1, Pregel.src("x"))).reads_dst(state, g.edges)
    assert base().sendMsgToDst(F.when(Pregel.dst("x") > 1, Pregel.src("x"))).reads_dst(state, g.edges)
    assert base().sendMsgToDst(F.col("dst").getField("x")).reads_dst(state, g.edges)
    done = base().setEarlyStopping(True).sendMsgToDst(F.when(Pregel.src("x") > Pregel.dst("x"), Pregel.src("x"))).sendMsgToSrc(F.when(Pregel.dst("x") > Pregel.src("x"), Pregel.dst("x"))).run()
    assert rows(done, "id", "x") == [(i, 3) for i in range(4)]
    with pytest.raises(ValueError):
        base().run()


def test_pregel_activity(spark):
    g = gen.chain(spark, 6)
    p = g.pregel.setMaxIter(20).withVertexColumn("d", F.when(F.col("id") == 0, 0), F.coalesce("d", Pregel.msg()))
    p = p.setInitialActiveVertexExpression(F.col("id") == 0).setUpdateActiveVertexExpression(F.col("d").isNull() & Pregel.msg().isNotNull())
    p = p.setSkipMessagesFromNonActiveVertices(True).setStopIfAllNonActiveVertices(True)
    done = p.sendMsgToDst(Pregel.src("d") + 1).aggMsgs(F.min(Pregel.msg())).run()
    assert rows(done, "id", "d") == [(i, i) for i in range(6)]


def test_nothing_stays_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    gen.friends(spark).page_rank(max_iter=2)
    gen.friends(spark).label_propagation(2)
    gen.friends(spark).shortest_paths(["a"])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_mapped_attributes(spark):
    g = Graph(spark.createDataFrame([(1, 5), (2, 7)], "id long, n int"), spark.createDataFrame([(1, 2, 3), (2, 2, 4), (1, 9, 5)], "src long, dst long, w int"))
    v = g.map_vertices(twice=F.col("n") * 2, name=F.concat(F.lit("v"), "id")).vertices
    assert v.columns == ["id", "twice", "name"] and rows(v, "*") == [(1, 10, "v1"), (2, 14, "v2")]
    assert rows(g.map_edges(x="w + 1").edges, "*") == [(1, 2, 4), (1, 9, 6), (2, 2, 5)]
    assert rows(g.map_triplets(x="src.n - dst.n + edge.w").edges, "*") == [(1, 2, 1), (2, 2, 4)]
    for bad in (lambda: g.map_vertices(id="n"), lambda: g.map_edges(src="w"), lambda: g.map_triplets(dst="edge.w")):
        with pytest.raises(ValueError):
            bad()


def test_collected_neighbors(spark):
    g = Graph(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, n string"), spark.createDataFrame([(1, 2), (1, 2), (3, 1), (2, 9)], "src long, dst long"))
    found = lambda d: {r.id: sorted(x.n for x in r.neighbors) for r in g.collect_neighbors(d).collect()}
    assert found("out") == {1: ["b", "b"], 3: ["a"]} and found("in") == {2: ["a", "a"], 1: ["c"], 9: ["b"]}
    assert found("either") == {1: ["b", "b", "c"], 2: ["a", "a"], 3: ["a"], 9: ["b"]}


def test_filter_by_what_a_function_adds(spark):
    g = Graph(spark.createDataFrame([(i, "x") for i in range(4)], "id long, n string"), spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 2, 3), (3, 0, 4)], "src long, dst long, w int"))
    kept = g.filter(lambda x: Graph(x.vertices.join(x.degrees, "id"), x.edges), "w > 1", "degree >= 2")
    assert kept.vertices.columns == ["id", "n"] and rows(kept.vertices, "id") == [(0,), (1,), (2,)]
    assert rows(kept.edges, "src", "dst", "w") == [(0, 2, 2), (1, 2, 3)]


def test_unknown_arguments_are_errors(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    for call in (lambda: g.label_propagation(2, max_iters=3), lambda: g.connected_components(algoritm="x"), lambda: g.detect_cycles(maxlength=3), lambda: g.k_core(seed=1), lambda: g.random_walks(steps=3), lambda: g.bfs("id = 1", "id = 2", maxPath=3), lambda: g.aggregate_messages("count(MSG)", to_dest="src.id"), lambda: g.shortest_paths([1], directed=False)):
        with pytest.raises(TypeError):
            call()
    for call in (lambda: g.k_core(checkpoint_interval=0), lambda: g.k_core(storage_level="nowhere"), lambda: g.connected_components("x")):
        with pytest.raises(ValueError):
            call()


def test_options_of_a_call(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "src long, dst long"))
    want = rows(g.connected_components(), "id", "component")
    assert want == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]
    assert rows(g.connected_components(checkpoint_interval=3, storage_level="DISK_ONLY"), "id", "component") == want
    assert rows(g.label_propagation(3, checkpoint_interval=2), "id", "label") == rows(g.label_propagation(3), "id", "label")
    with pytest.warns(UserWarning):
        g.connectedComponents("other", 2, 100, True, True)
    names = Graph.from_edges(spark.createDataFrame([("b", "c"), ("x", "y")], "src string, dst string"))
    assert rows(names.connected_components(), "id", "component") == [("b", "b"), ("c", "b"), ("x", "x"), ("y", "x")]
    assert rows(names.connected_components(use_labels_as_components=False), "id", "component") == [("b", 0), ("c", 0), ("x", 2), ("y", 2)]
