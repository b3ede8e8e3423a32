"""Every registered graph query against its SQL, on the smallest tables."""

import duckdb
import pytest

from weft import graph_queries
from weft.sources import tables

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["out_degrees", "type_degree", "triplets", "filter_vertices", "collect_neighbor_ids", "motif_mutual", "motif_negation", "motif_variable_length", "aggregate_messages", "aggregate_neighbors", "shortest_paths", "connected_components", "page_rank_fixed", "label_propagation", "triangle_count", "k_core", "property_graph_edges", "property_graph_projection", "generated_grid", "generated_rmat", "generated_log_normal", "random_walks", "hash2vec", "belief_propagation", "maximal_independent_set", "triangle_count_approx", "collect_neighbors", "map_triplets", "filter_preprocessed", "svd_plus_plus", "walk_embeddings_with_neighbors", "detect_all_cycles", "pregel_activity", "sampling_convolution", "streamed_components", "saved_graph", "edge_list_reader", "motif_terms_out_of_order", "page_rank_warm_start"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(df, sql_df):
    def plain(d):
        d = d[sorted(d.columns)]
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.itertuples(index=False))

    assert sorted(df.columns) == sorted(sql_df.columns)
    assert plain(df) == plain(sql_df)


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, db, name):
    same(graph_queries.QUERIES[name](spark, SF).toPandas(), db.execute(graph_queries.ORACLES[name]).df())


def test_registered():
    assert set(graph_queries.ORACLES) <= set(graph_queries.QUERIES)


def test_all_cycles_against_brute_force(spark):
    to = {}
    for a, b in tables.supply_graph(spark, "/root/testdata/sf0.01").edges.select("src", "dst").collect():
        to.setdefault(a, set()).add(b)

    def grow(path):
        for b in to.get(path[-1], ()):
            if b == path[0]:
                yield [*path, b]
            elif b > path[0] and b not in path:
                yield from grow([*path, b])

    want = sorted(c for a in to for c in grow([a]))
    assert sorted(list(map(int, r[0].split(">"))) for r in graph_queries.QUERIES["detect_all_cycles"](spark, "/root/testdata/sf0.01").collect()) == want
    assert max(map(len, want)) > 4
