"""Queries over the driver's tables and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from weft.examples.belief_propagation import run_bp
from weft.functions.columns import draw
from weft.graph import Graph, long_ids
from weft.operators import ranking, walks
from weft.operators.messages import AggregateMessages as AM
from weft.operators.pregel import Pregel
from weft.operators.walks import RandomWalkEmbeddings
from weft.plans.iterate import Rounds
from weft.sources import edge_list, generators, tables
from weft.streaming import batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SESSION = """
ev as (select user_id, event_type, event_id, lead(user_id) over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) as nxt from events),
e as (select user_id as src, nxt as dst, event_type, event_id from ev where nxt is not null),
v as (select user_id as id, count(*) as n_events from events group by user_id),
p as (select distinct least(src, dst) as u, greatest(src, dst) as v from e where src <> dst),
nb as (select u as x, v as y from p union all select v, u from p)
"""
GEO = """
v as (select 'r' || r_regionkey as id, 'region' as kind from region union all select 'n' || n_nationkey, 'nation' from nation union all select 'c' || c_custkey, 'customer' from customer union all select 's' || s_suppkey, 'supplier' from supplier),
e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'in' as rel from nation union all select 'c' || c_custkey, 'n' || c_nationkey, 'lives' from customer union all select 's' || s_suppkey, 'n' || s_nationkey, 'sells' from supplier)
"""
TRADE = """
pairs as (select s_nationkey::bigint as src, c_nationkey::bigint as dst, sum(l_quantity::bigint)::bigint as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by 1, 2),
e as (select src, dst, quantity from pairs where quantity * (select count(*) from pairs) > (select sum(quantity) from pairs)),
v as (select n_nationkey::bigint as id, n_name as name from nation)
"""
FIELD = """
k as (select s_suppkey as k, (s_acctbal / 5000 - 0.9)::double as a from supplier),
v as (select (k // 10) || ',' || (k % 10) as id, k, (k // 10)::int as i, (k % 10)::int as j, a from k),
e as (select x.id as src, y.id as dst, x.k % 7 / 7.0::double - 0.4 as b from v x join v y on y.k = x.k + 1 and y.i = x.i union all select x.id, y.id, x.k % 5 / 5.0::double - 0.4 from v x join v y on y.k = x.k + 10)
"""


SUPPLY = """
s as (select s_suppkey as k, s_nationkey::bigint as src, lead(s_nationkey::bigint) over (order by s_suppkey) as dst from supplier),
e as (select distinct src, unnest([arg_min(dst, k), arg_max(dst, k)]) as dst from s where dst is not null group by src)
"""
RATING = """
e as materialized (select (o_custkey * 2)::bigint as u, (l_partkey * 2 + 1)::bigint as i, least(5.0, floor(l_quantity / 10) + 1)::double as w from lineitem join orders on l_orderkey = o_orderkey),
mean as materialized (select avg(w) as m from e), ends as (select u as id, w from e union all select i, w from e)
"""


def draw_sql(*parts: str) -> str:
    """SQL of weft.functions.columns.draw."""
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 12))::bigint"



def query(graph, sql: str | None = None, recursive: bool = False):
    """Registers f(graph) over one of the table graphs, and its SQL after that graph's CTEs."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(graph(spark, sf_dir))
        if sql is not None:
            base = {tables.session_graph: SESSION, tables.geo_graph: GEO, tables.trade_graph: TRADE, tables.field_graph: FIELD, tables.rating_graph: RATING, tables.supply_graph: SUPPLY}[graph]
            ORACLES[f.__name__] = f"with {'recursive ' if recursive else ''}{base.strip()}{sql}"
        return f

    return add


session, geo, trade = tables.session_graph, tables.geo_graph, tables.trade_graph

# == structure


@query(session, " select src as id, count(*)::int as out_degree from e group by 1")
def out_degrees(g):
    return g.out_degrees.withColumnRenamed("outDegree", "out_degree")


@query(session, " select dst as id, count(*)::int as in_degree from e group by 1")
def in_degrees(g):
    return g.in_degrees.withColumnRenamed("inDegree", "in_degree")


@query(session, " select id, count(*)::int as degree from (select src as id from e union all select dst from e) group by 1")
def degrees(g):
    return g.degrees


def typed(df, name):
    return df.select("id", *[F.coalesce(F.col(name)[t], F.lit(0)).alias(t) for t in df.schema[name].dataType.names])


def typed_sql(ends: str) -> str:
    return f" select id, count(*) filter (event_type = 'click')::int as click, count(*) filter (event_type = 'purchase')::int as purchase from ({ends}) group by 1"


@query(session, typed_sql("select src as id, event_type from e"))
def type_out_degree(g):
    return typed(g.type_out_degree("event_type", ["click", "purchase"]), "outDegrees")


@query(session, typed_sql("select dst as id, event_type from e"))
def type_in_degree(g):
    return typed(g.type_in_degree("event_type", ["click", "purchase"]), "inDegrees")


@query(session, typed_sql("select src as id, event_type from e union all select dst, event_type from e"))
def type_degree(g):
    return typed(g.type_degree("event_type", ["click", "purchase"]), "degrees")


@query(session, " select e.src, e.dst, e.event_type, e.event_id, a.n_events as src_events, b.n_events as dst_events from e join v a on a.id = e.src join v b on b.id = e.dst")
def triplets(g):
    return g.triplets.select("edge.src", "edge.dst", "edge.event_type", "edge.event_id", F.col("src.n_events").alias("src_events"), F.col("dst.n_events").alias("dst_events"))


@query(session, " select e.src, e.dst, e.event_id from e join v a on a.id = e.src and a.n_events > 66 join v b on b.id = e.dst and b.n_events > 66")
def filter_vertices(g):
    return g.filter_vertices("n_events > 66").edges.select("src", "dst", "event_id")


@query(session, " select src, dst, event_id from e where event_type = 'purchase' and src <> dst")
def filter_edges(g):
    return g.filter_edges(F.col("event_type") == "purchase").remove_self_edges().edges.select("src", "dst", "event_id")


@query(geo, " select id, kind from v where id in (select dst from e where rel = 'sells' union all select src from e where rel = 'sells')")
def drop_isolated_vertices(g):
    return g.filter_edges("rel = 'sells'").drop_isolated_vertices().vertices


@query(session, " select src, dst, event_id from e union all select dst, src, event_id from e")
def as_undirected(g):
    return g.as_undirected().edges.select("src", "dst", "event_id")


@query(session, " select dst as src, src as dst, event_id from e")
def as_reversed(g):
    return g.as_reversed().edges.select("src", "dst", "event_id")


@query(session, " select src, dst, count(*) as n, max(event_id) as last from e group by 1, 2")
def group_edges(g):
    return g.group_edges(F.count("*").alias("n"), F.max("event_id").alias("last")).edges


@query(session, " select least(src, dst) as src, greatest(src, dst) as dst, count(*) as n from e group by 1, 2")
def canonical_edges(g):
    return g.canonical_edges(F.count("*").alias("n")).edges


@query(session, " select id, len(l)::int as n, l[1] as first, l[-1] as last from (select id, list_sort(list(distinct y)) as l from (select src as id, dst as y from e union all select dst, src from e) group by id)")
def collect_neighbor_ids(g):
    return g.collect_neighbor_ids().select("id", F.size("neighbors").alias("n"), F.col("neighbors")[0].alias("first"), F.element_at("neighbors", -1).alias("last"))


@query(session, " select e.src, e.dst, e.event_id from e where (src, dst) in (select dst, src from e)")
def mask_mutual(g):
    return g.mask(g.as_reversed()).edges.select("src", "dst", "event_id")


@query(session, " select count(*) as n, count(distinct id) as ids, (select count(*) from (select src as id from e union all select dst from e) x where id not in (select id from v)) as lost from v")
def validate(g):
    g.validate()
    lost = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(g.vertices, "id", "left_anti")
    return g.vertices.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).crossJoin(lost.agg(F.count("*").alias("lost")))  # one row each


# == motifs


@query(session, " select a.src as a, a.dst as b, a.event_id as e1, b.event_id as e2 from e a join e b on a.dst = b.src and b.dst = a.src where a.event_type = 'purchase'")
def motif_mutual(g):
    return g.find("(p)-[e]->(q); (q)-[e2]->(p)").where("e.event_type = 'purchase'").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("e.event_id").alias("e1"), F.col("e2.event_id").alias("e2"))


@query(session, " select x.src as a, y.dst as c, count(*) as n from e x join e y on x.dst = y.src group by 1, 2")
def motif_two_hops(g):
    return g.count_matches("(p)-[]->(q); (q)-[]->(s)", ["p", "s"]).withColumnsRenamed({"p": "a", "s": "c"})


@query(trade, " select x.src as a, y.src as b, z.src as c from e x join e y on x.dst = y.src join e z on y.dst = z.src and z.dst = x.src")
def motif_directed_triangle(g):
    return g.find("(p)-[]->(q); (q)-[]->(s); (s)-[]->(p)").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("s.id").alias("c"))


@query(session, " select distinct a.src as a, a.dst as b from e a where not exists (select 1 from e b where b.src = a.dst and b.dst = a.src)")
def motif_negation(g):
    return g.find("(p)-[]->(q); !(q)-[]->(p)").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))


@query(trade, " select a.id as a, b.id as b from v a, v b where not exists (select 1 from e where (src = a.id and dst = b.id) or (src = b.id and dst = a.id))")
def motif_negated_undirected(g):
    return g.find("!(p)-[]-(q)").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))


@query(session, " select src as a, event_id from e where src = dst")
def motif_self_loop(g):
    return g.find("(p)-[e]->(p)").select(F.col("p.id").alias("a"), F.col("e.event_id").alias("event_id"))


@query(trade, " select e.src as a, e.dst as b, v.id as c from e, v")
def motif_lone_vertex(g):
    return g.find("(p)-[]->(q); (s)").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("s.id").alias("c"))


@query(session, " select src as u, dst as w, event_id, 'out' as direction from e where event_type = 'signup' union all select dst, src, event_id, 'in' from e where event_type = 'signup'")
def motif_undirected(g):
    return g.find("(m)-[e]-(z)").where("e.event_type = 'signup'").select(F.col("m.id").alias("u"), F.col("z.id").alias("w"), F.col("e.event_id").alias("event_id"), F.col("_direction").alias("direction"))


@query(trade, " select x.src as u, x.dst as m1, y.dst as m2, z.dst as w from e x join e y on x.dst = y.src join e z on y.dst = z.src")
def motif_fixed_length(g):
    return g.find("(m)-[e*3]->(z)").select(F.col("m.id").alias("u"), F.col("_mz1.id").alias("m1"), F.col("_mz2.id").alias("m2"), F.col("z.id").alias("w"))


@query(trade, " select src as u, dst as w, 1 as hop, quantity as q from e union all select x.src, y.dst, 2, x.quantity + y.quantity from e x join e y on x.dst = y.src")
def motif_variable_length(g):
    found = g.find("(m)-[e*1..2]->(z)")
    return found.select(F.col("m.id").alias("u"), F.col("z.id").alias("w"), F.col("_hop").alias("hop"), (F.col("_e1.quantity") + F.coalesce(F.col("_e2.quantity"), F.lit(0))).alias("q"))


@query(trade, " select x.src as a, x.dst as b, y.dst as c, x.quantity + y.quantity as q from e x join e y on x.dst = y.src where x.quantity < y.quantity")
def motif_stateful_filter(g):
    return g.find("(p)-[x]->(q); (q)-[y]->(s)").where("x.quantity < y.quantity").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("s.id").alias("c"), (F.col("x.quantity") + F.col("y.quantity")).alias("q"))


# == messages


@query(session, " select id, sum(n)::bigint as total, max(n) as top from (select e.dst as id, v.n_events as n from e join v on v.id = e.src union all select e.src, v.n_events from e join v on v.id = e.dst) group by 1")
def aggregate_messages(g):
    return g.aggregate_messages([F.sum(AM.msg).alias("total"), F.max(AM.msg).alias("top")], to_src=AM.dst["n_events"], to_dst=AM.src["n_events"])


@query(session, ", r0 as (select id, id as m from v), " + ", ".join(f"r{k + 1} as (select r.id, greatest(r.m, coalesce((select max(s.m) from e join r{k} s on s.id = e.src where e.dst = r.id), r.m)) as m from r{k} r)" for k in range(3)) + " select id, m as largest from r3")
def pregel_largest_source(g):
    p = g.pregel.setMaxIter(3).withVertexColumn("largest", F.col("id"), F.greatest("largest", F.coalesce(Pregel.msg(), F.col("largest"))))
    return p.sendMsgToDst(Pregel.src("largest")).aggMsgs(F.max(Pregel.msg())).run().select("id", "largest")


@query(geo, " select c.src as customer, c.src || '>' || c.dst || '>' || n.dst as path, 2 as hop from e c join e n on n.src = c.dst where c.rel = 'lives'")
def aggregate_neighbors(g):
    found = g.aggregate_neighbors("kind = 'customer'", ["path"], [F.col("id")], [F.concat_ws(">", "path", "dst_id")], max_hops=3, target_condition=g.dst_attr("kind") == "region")
    return found.select(F.split("path", ">")[0].alias("customer"), "path", "hop")


def belief_sql(rounds: int) -> str:
    steps = ["b0 as materialized (select id, (i + j) % 2 as color, a, 0.0::double as belief from v)", "n as materialized (select src as x, dst as y, b from e union all select dst, src, b from e)"]
    for k in range(2 * rounds):
        steps.append(f"b{k + 1} as materialized (select o.id, o.color, o.a, case when o.color = {k % 2} then 1 / (1 + exp(-(o.a + coalesce((select sum(n.b * p.belief) from n join b{k} p on p.id = n.y where n.x = o.id), 0)))) else o.belief end as belief from b{k} o)")
    return f", {', '.join(steps)} select id, round(belief, 4) as belief from b{2 * rounds}"


@query(tables.field_graph, belief_sql(3))
def belief_propagation(g):
    return run_bp(g, 3).select("id", F.round("belief", 4).alias("belief"))


# == paths


@query(geo, " select c.src as a, c.dst as n, r.dst as b from e c join e r on r.src = c.dst where c.rel = 'sells' and r.dst = 'r1'")
def bfs(g):
    return g.bfs("kind = 'supplier'", "id = 'r1'").select(F.col("from.id").alias("a"), F.col("v1.id").alias("n"), F.col("to.id").alias("b"))


LANDMARKS = [1, 2, 3]
DISTANCES = """, d(id, landmark, k) as (
  select id, id, 0 from v where id in (1, 2, 3)
  union
  select b.id, d.landmark, d.k + 1 from d join (select distinct src as id, dst from e where src <> dst) b on b.dst = d.id where d.k < 12)
select id, landmark, min(k)::int as distance from d group by 1, 2"""


def distances(g, directed=True):
    maps = g.shortest_paths(LANDMARKS, directed).select("id", F.explode("distances").alias("landmark", "distance"))
    return maps


@query(session, DISTANCES, True)
def shortest_paths(g):
    return distances(g)


@query(session, DISTANCES.replace("select distinct src as id, dst from e where src <> dst", "select x as id, y as dst from nb"), True)
def shortest_paths_undirected(g):
    return distances(g, False)


@query(trade, """ select n, count(*) as cycles, sum(s)::bigint as total from (
  select 1 as n, src as s from e where src = dst
  union all select 2, x.src + x.dst from e x join e y on x.dst = y.src and y.dst = x.src where x.src < x.dst
  union all select 3, x.src + y.src + z.src from e x join e y on x.dst = y.src join e z on y.dst = z.src and z.dst = x.src where x.src < y.src and x.src < z.src and y.src <> z.src) group by n""")
def detect_cycles(g):
    # on so dense a graph there are too many longer cycles for any engine
    c = g.detect_cycles(max_length=3).select((F.size("found_cycles") - 1).alias("n"), F.expr("aggregate(slice(found_cycles, 1, size(found_cycles) - 1), 0L, (a, x) -> a + x)").alias("s"))
    return c.groupBy("n").agg(F.count("*").alias("cycles"), F.sum("s").alias("total"))


@query(tables.supply_graph, """, r(first, cur, path) as (
  select src, dst, [src] from e where dst >= src
  union all select r.first, e.dst, list_append(r.path, r.cur) from r join e on e.src = r.cur where r.cur > r.first and not list_contains(r.path, r.cur) and e.dst >= r.first)
select array_to_string(list_append(path, cur), '>') as cycle from r where cur = first""", True)
def detect_all_cycles(g):
    return g.detect_cycles().select(F.array_join("found_cycles", ">").alias("cycle"))


# == components

REACH = """, sym as (select src as a, dst as b from e union select dst, src from e), r(id, root) as (
  select id, id from v where kind = 'region' union select s.b, r.root from r join sym s on s.a = r.id)
select v.id, v.kind, min(m.least) as component from v join r on r.id = v.id join (select root, min(id) as least from r group by root) m on m.root = r.root group by 1, 2"""


@query(geo, REACH, True)
def connected_components(g):
    return g.connected_components()


@query(geo, REACH, True)
def components_by_contraction(g):
    return g.connected_components("randomized_contraction")


@query(geo, REACH, True)
def components_by_propagation(g):
    return g.connected_components("propagation")


@query(trade, """, r(a, b) as (select id, id from v union select r.a, e.dst from r join e on e.src = r.b)
select x.a as id, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by 1""", True)
def strongly_connected_components(g):
    return g.strongly_connected_components(20).select("id", "component")


# == ranks


def rank_sql(rounds: int, home: str, scale: str) -> str:
    steps = ", ".join(f"r{k + 1} as (select v.id, 0.15 * {home} + 0.85 * coalesce(s.m, 0) as r from v left join (select w.dst, sum(r.r * w.w) as m from w join r{k} r on r.id = w.src group by 1) s on s.dst = v.id)" for k in range(rounds))
    return f", w as (select src, dst, 1.0::double / count(*) over (partition by src) as w from e), r0 as (select id, {home} as r from v), {steps} select id, round(r * {scale} / (select sum(r) from r{rounds}), 4) as rank from r{rounds}"


@query(session, rank_sql(8, "1.0::double", "(select count(*) from v)"))
def page_rank_fixed(g):
    return g.page_rank(max_iter=8).vertices.select("id", F.round("pagerank", 4).alias("rank"))


@query(session, rank_sql(8, "(case when v.id = 1 then 1.0::double else 0.0 end)", "1.0"))
def page_rank_personalized(g):
    return g.page_rank(max_iter=8, source_id=1).vertices.select("id", F.round("pagerank", 4).alias("rank"))


@query(session, rank_sql(40, "1.0::double", "(select count(*) from v)").replace(", 4)", ", 2)"))
def page_rank_converged(g):
    return g.page_rank(tol=1e-6).vertices.select("id", F.round("pagerank", 2).alias("rank"))


@query(session, " select src, dst, event_id, round(1.0::double / count(*) over (partition by src), 6) as weight from e")
def page_rank_weights(g):
    return ranking.edge_weights(g).select("src", "dst", "event_id", F.round("weight", 6).alias("weight"))


def parallel_sql() -> str:
    one = lambda s: "select * from (" + rank_sql(5, f"(case when v.id = {s} then 1.0::double else 0.0 end)", "1.0").replace("select id, round", f"select id, {s} as source, round").removeprefix(", ") + ")"
    return ", " + ", ".join(f"q{s} as (with {one(s).removeprefix('select * from (').removesuffix(')')})" for s in (1, 2)) + " select id, source::bigint as source, rank from q1 union all select id, source::bigint, rank from q2"


@query(session, parallel_sql())
def parallel_personalized_page_rank(g):
    v = g.parallel_personalized_page_rank(source_ids=[1, 2], max_iter=5).vertices.select("id", vector_to_array("pageranks").alias("r"))
    return v.select("id", F.posexplode("r").alias("source", "rank")).select("id", (F.col("source") + 1).cast("long").alias("source"), F.round("rank", 4).alias("rank"))


# == communities


def label_sql(rounds: int, ends: str) -> str:
    steps = ", ".join(f"l{k + 1} as (select v.id, coalesce(b.label, l.label) as label from v join l{k} l on l.id = v.id left join (select id, label from (select n.y as id, l.label, row_number() over (partition by n.y order by count(*) desc, l.label) as k from ({ends}) n join l{k} l on l.id = n.x group by n.y, l.label) where k = 1) b on b.id = v.id)" for k in range(rounds))
    return f", l0 as (select id, id as label from v), {steps} select id, label from l{rounds}"


@query(session, label_sql(4, "select src as x, dst as y from e union all select dst, src from e"))
def label_propagation(g):
    return g.label_propagation(4).select("id", "label")


@query(session, label_sql(3, "select src as x, dst as y from e"))
def label_propagation_directed(g):
    return g.label_propagation(3, is_directed=True).select("id", "label")


TRIANGLES = ", t as (select a.u as a, a.v as b, b.v as c from p a join p b on a.v = b.u join p c on c.u = a.u and c.v = b.v), f as (select a as id from t union all select b from t union all select c from t) select v.id, v.n_events, count(f.id) as \"count\" from v left join f on f.id = v.id group by 1, 2"


@query(session, TRIANGLES)
def triangle_count(g):
    return g.triangle_count()


@query(session, TRIANGLES)
def triangle_count_approx(g):
    # a sketch of 2 ** 12 entries is exact up to so many neighbours, which a user of the test tables hasn't
    return g.triangle_count("approx")


def core_sql(rounds: int) -> str:
    steps = ", ".join(f"k{n + 1} as (select x as id, max(h) as k from (select n.x, least(s.k, count(*) over (partition by n.x order by s.k desc)) as h, o.k as cap from nb n join k{n} s on s.id = n.y join k{n} o on o.id = n.x) where h <= cap group by x)" for n in range(rounds))
    return f", k0 as (select x as id, count(*) as k from nb group by x), {steps} select v.id, coalesce(k.k, 0)::int as kcore from v left join k{rounds} k on k.id = v.id"


@query(trade, ", p as (select distinct least(src, dst) as u, greatest(src, dst) as v from e where src <> dst), nb as (select u as x, v as y from p union all select v, u from p)" + core_sql(12))
def k_core(g):
    return g.k_core().select("id", "kcore")


def independent_sql(rounds: int) -> str:
    steps = ["m0 as materialized (select id from v)", "nbs as materialized (select x, y from nb)"]
    for k in range(rounds):
        h = lambda c: draw_sql(c, "'42'", f"'{k}'")  # noqa: E731, B023
        steps.append(f"h{k} as materialized (select id, {h('id')} as h from m{k})")
        steps.append(f"j{k} as materialized (select o.id from h{k} o where not exists (select 1 from nbs join h{k} p on p.id = nbs.y where nbs.x = o.id and (p.h, p.id) < (o.h, o.id)))")
        steps.append(f"m{k + 1} as materialized (select id from m{k} where id not in (select id from j{k}) and id not in (select nbs.y from nbs join j{k} on j{k}.id = nbs.x))")
    return ", " + ", ".join(steps) + " " + " union all ".join(f"select id from j{k}" for k in range(rounds))


@query(session, independent_sql(12))
def maximal_independent_set(g):
    return g.maximal_independent_set()


@query(trade)
def power_iteration_clustering(g):
    e = g.canonical_edges(F.sum("quantity").cast("double").alias("weight")).remove_self_edges()
    return e.power_iteration_clustering(2, 10, "weight")


def factor_sql(rank: int, rounds: int) -> str:
    ks = range(rank)
    each = lambda form: ", ".join(form.format(k=k) for k in ks)
    first = lambda tag, name: ", ".join(f"{draw_sql('id', repr(tag), repr(str(k)), repr('42'))} / 281474976710656.0::double as {name}{k}" for k in ks)
    steps = [f"s0 as materialized (select id, {first('p', 'f')}, {first('y', 'y')}, avg(w) - (select m from mean) as b, 1 / sqrt(count(*)) as norm from ends group by id)"]
    for t in range(rounds + 1):
        guess = " + ".join(f"q.f{k} * (p.f{k} + p.norm * sy{k})" for k in ks)
        steps.append(f"t{t} as materialized (select e.u as t, {each('sum(q.y{k}) as sy{k}')} from e join s{t} q on q.id = e.i group by 1)")
        steps.append(f"r{t} as materialized (select e.u, e.i, p.b as bu, q.b as bi, p.norm, {each('q.f{k} as q{k}')}, {each('q.y{k} as y{k}')}, {each('p.f{k} as p{k}')}, {each('p.f{k} + p.norm * sy{k} as z{k}')}, e.w - least(5.0, greatest(0.0, m + p.b + q.b + {guess})) as err from e join s{t} q on q.id = e.i join s{t} p on p.id = e.u join t{t} on t = e.u, mean)")
        if t < rounds:
            user = f"select u as id, {each('sum((err * q{k} - 0.015 * p{k}) * 0.007) as d{k}')}, {each('0.0::double as g{k}')}, sum((err - 0.005 * bu) * 0.007) as db from r{t} group by 1"
            item = f"select i, {each('sum((err * z{k} - 0.015 * q{k}) * 0.007)')}, {each('sum((err * norm * q{k} - 0.015 * y{k}) * 0.007)')}, sum((err - 0.005 * bi) * 0.007) from r{t} group by 1"
            steps.append(f"m{t} as materialized ({user} union all {item})")
            steps.append(f"s{t + 1} as materialized (select s.id, {each('f{k} + d{k} as f{k}')}, {each('y{k} + g{k} as y{k}')}, b + db as b, norm from s{t} s join m{t} m on m.id = s.id)")
    return f", {', '.join(steps)} select id, round(f0, 4) as factor, round(b, 4) as bias, round((select avg(err * err) from r{rounds}), 4) as loss from s{rounds}"


@query(tables.rating_graph, factor_sql(3, 2))
def svd_plus_plus(g):
    v, loss = g.svd_plus_plus(rank=3, max_iter=2)
    return v.select("id", F.round(F.col("column1")[0], 4).alias("factor"), F.round("column3", 4).alias("bias"), F.lit(round(loss, 4)).alias("loss"))


# == walks and embeddings

WALKS = f""", nn as (select distinct id, nbr from (select src as id, dst as nbr from e union all select dst, src from e)),
few as materialized (select * from (select id, nbr, row_number() over (partition by id order by {draw_sql("id", "nbr", "'42'")}, nbr) as k from nn) where k <= 50),
sz as materialized (select id, max(k) as n from few group by 1),
r(walk, home, cur, step, seen) as (
  select sz.id || '-' || t.w, sz.id, sz.id, 0, cast([] as bigint[]) from sz join v using (id), range(1, 3) t(w)
  union all
  select r.walk, r.home, case when {draw_sql("r.walk", "r.step", "'42'", "'restart'")} / 281474976710656.0::double < 0.1 then r.home else b.nbr end, r.step + 1, list_append(r.seen, r.cur)
  from r join sz on sz.id = r.cur join few b on b.id = r.cur and b.k = {draw_sql("r.walk", "r.step", "'42'")} % sz.n + 1 where r.step < 10)
select walk as random_walk_uuid, array_to_string(seen, '>') as walk from r where step = 10"""


@query(session, WALKS, True)
def random_walks(g):
    return g.random_walks(num_walks_per_node=2, batch_size=5, num_batches=2).select("random_walk_uuid", F.array_join("random_walk", ">").alias("walk"))


def slots(found):
    return found.select("id", F.posexplode(vector_to_array("embedding")).alias("slot", "x")).select("id", "slot", F.round("x", 5).alias("x"))


def hash2vec(spark, sf_dir):
    """Parts by the parts that stand near them in orders."""
    items = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return slots(walks.hash2vec(items.select(F.expr("transform(l, x -> x.l_partkey)").alias("random_walk")), dim=16))


def embed_sql(walks: str, ids: str) -> str:
    """CTEs from lists w to emb (id, slot, x): vectors of 16 slots and one for their length."""
    return f"""w as materialized ({walks}),
at1 as (select w, unnest(range(1, len(w) + 1)) as i from w), at2 as (select w[i] as id, w, i, unnest(range(greatest(1, i - 5), least(len(w), i + 5) + 1)) as j from at1),
near as (select id, w[j] as c, sum(exp(-((i - j) * (i - j))::double)) as w from at2 where i <> j group by 1, 2),
slot as (select id, {draw_sql("c", "'42'")} % 16 as slot, sum(w * case when {draw_sql("c", "'18'")} % 2 = 0 then 1.0 else -1.0 end) as x from near group by 1, 2),
norm as (select id, sqrt(sum(x * x)) as n from slot group by 1), ids as ({ids}),
emb as materialized (select ids.id, k.slot::int as slot, case when n.n is null then 0.0 when k.slot = 16 then ln(n.n + 1) / sqrt(16.0::double) else coalesce(s.x, 0.0) / (n.n + 1e-6) end as x
  from ids cross join range(17) k(slot) left join norm n on n.id = ids.id left join slot s on s.id = ids.id and s.slot = k.slot)"""


QUERIES["hash2vec"] = hash2vec
ORACLES["hash2vec"] = f"with {embed_sql('select list(l_partkey order by l_linenumber, l_partkey) as w from lineitem group by l_orderkey', 'select distinct l_partkey as id from lineitem')} select id, slot, round(x, 5) as x from emb"


@query(session, WALKS.split("select walk as")[0].replace("r.step < 10", "r.step < 5") + ", " + embed_sql("select seen as w from r where step = 5", "select distinct unnest(seen) as id from r where step = 5") + """,
nbr as (select few.id, emb.slot, avg(emb.x) as x from few join emb on emb.id = few.nbr group by 1, 2)
select id, slot, round(x, 5) as x from emb union all select id, slot + 17, round(coalesce(nbr.x, 0.0), 5) from emb left join nbr using (id, slot)""", True)
def walk_embeddings_with_neighbors(g):
    return slots(RandomWalkEmbeddings(g).set_rw_model(num_walks_per_node=2, batch_size=5, num_batches=1).set_hash2vec(dim=16).set_neighbors_aggregation().run())


@query(session)
def word2vec_embeddings(g):
    return slots(RandomWalkEmbeddings(g).set_rw_model(num_walks_per_node=2, batch_size=5, num_batches=1).set_word2vec(vector_size=8).run())


# == property graphs, sources


@query(tables.store_graph)
def property_graph_vertices(p):
    return p.to_graph(["customer", "supplier"], ["buys"]).vertices


ORACLES["property_graph_vertices"] = "select 'customer' || sha256(c_custkey::varchar) as id, 'customer' as property_group from customer union all select s_suppkey::varchar, 'supplier' from supplier"


@query(tables.store_graph)
def property_graph_edges(p):
    return p.to_graph(["customer", "part", "supplier"], ["buys", "sells"], edge_filters={"buys": "l_quantity > 45"}).edges


ORACLES["property_graph_edges"] = """with s as (select distinct l_suppkey::varchar as s, 'part' || sha256(l_partkey::varchar) as p from lineitem)
select 'customer' || sha256(o_custkey::varchar) as src, 'part' || sha256(l_partkey::varchar) as dst, l_quantity::double as weight from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 45
union all select s, p, 1.0 from s union all select p, s, 1.0 from s"""


@query(tables.store_graph)
def property_graph_projection(p):
    pairs = p.projection_by("supplier", "part", "sells").edge_groups["projected_sells"].data
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("shared"))


ORACLES["property_graph_projection"] = "with s as (select distinct l_suppkey as s, l_partkey as p from lineitem) select a.s as src, b.s as dst, count(*) as shared from s a join s b on a.p = b.p and a.s < b.s group by 1, 2"


@query(tables.store_graph)
def property_graph_join_back(p):
    degree = p.to_graph(["customer", "part"], ["buys"]).out_degrees
    return p.join_vertices(degree, ["customer"]).select("external_id", "property_group", F.col("outDegree").alias("n"))


ORACLES["property_graph_join_back"] = "select o_custkey::varchar as external_id, 'customer' as property_group, count(*)::int as n from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey group by 1"


@query(session, " select e.src as id, count(*)::int as n, min(v.n_events) as least, max(v.n_events) as most from e join v on v.id = e.dst group by 1")
def collect_neighbors(g):
    return g.collect_neighbors("out").select("id", F.size("neighbors").alias("n"), F.array_min("neighbors.n_events").alias("least"), F.array_max("neighbors.n_events").alias("most"))


@query(session, " select e.src, e.dst, a.n_events - b.n_events as gap, upper(e.event_type) as kind from e join v a on a.id = e.src join v b on b.id = e.dst")
def map_triplets(g):
    return g.map_triplets(gap=F.col("src.n_events") - F.col("dst.n_events"), kind=F.upper("edge.event_type")).edges


@query(session, " select src, dst, event_id from e where src in (select dst from e group by 1 having count(*) > 44) and dst in (select dst from e group by 1 having count(*) > 44)")
def filter_preprocessed(g):
    busy = lambda x: Graph(x.vertices.join(x.in_degrees, "id", "left"), x.edges)
    return g.filter(busy, vertex_condition="inDegree > 44").edges.select("src", "dst", "event_id")


@query(session, " select src as id, count(*)::int as n, max(event_id) as last from e group by 1")
def collect_edges(g):
    return g.collect_edges("out").select("id", F.size("edges").alias("n"), F.array_max("edges.event_id").alias("last"))


@query(session, " select e.src, e.dst, e.event_id from e join v a on a.id = e.src and a.n_events > 66 join v b on b.id = e.dst and b.n_events > 66 where event_type = 'click'")
def subgraph(g):
    return g.subgraph("n_events > 66", "event_type = 'click'").edges.select("src", "dst", "event_id")


@query(session, " select v.id, v.n_events, o.n as out_degree from v left join (select src, count(*)::int as n from e group by 1) o on o.src = v.id")
def join_vertices(g):
    return g.join_vertices(g.out_degrees.withColumnRenamed("outDegree", "out_degree")).vertices


@query(session, f" select id from v order by {draw_sql('id', chr(39) + '5' + chr(39))}, id limit 1")
def pick_random_vertex(g):
    return g.vertices.sparkSession.createDataFrame([(g.pick_random_vertex(5),)], "id long")


@query(session, " select * from (values ('v', 'id', 0), ('v', 'n_events', 1), ('e', 'src', 0), ('e', 'dst', 1), ('e', 'event_type', 2), ('e', 'event_id', 3)) t(part, name, place)")
def column_maps(g):
    maps = [(part, name, place) for part, columns in (("v", g.vertex_column_map), ("e", g.edge_column_map)) for name, place in columns.items()]
    return g.vertices.sparkSession.createDataFrame(maps, "part string, name string, place int")


@query(geo, " select 'Graph(v: [id: string, kind: string], e: [src: string, dst: string, rel: string])' as text")
def graph_text(g):
    return g.vertices.sparkSession.createDataFrame([(repr(g),)], "text string")


@query(geo, " select id, row_number() over (order by id) - 1 as new_id from v")
def long_id_index(g):
    return long_ids(g.vertices.select("id"))


@query(session, " select src, dst, event_id from e")
def partitioned_edges(g):
    return g.partition_by("edge2d", 7).partition_by("canonical", 5).edges.select("src", "dst", "event_id")


@query(session, " select e.src as a, e.event_id from e join v on v.id = e.src where e.event_type = 'click'")
def motif_anonymous_vertex(g):
    return g.find("(p)-[e]->()").where("e.event_type = 'click'").select(F.col("p.id").alias("a"), F.col("e.event_id").alias("event_id"))


@query(session, " select x.src as a, count(*) as n from e x join e y on x.dst = y.src group by 1")
def motif_bare_ids(g):
    bare = Graph(g.vertices.select("id"), g.edges.select("src", "dst"))
    return bare.find("(p)-[]->(q); (q)-[]->(s)", assume_valid=True).groupBy(F.col("p.id").alias("a")).agg(F.count("*").alias("n"))


@query(trade, " select x.src as a, y.src as b, z.dst as d from e x join e y on x.dst = y.src join e z on y.dst = z.src where x.quantity > z.quantity")
def motif_terms_out_of_order(g):
    return g.find("(p)-[x]->(q); (r)-[z]->(s); (q)-[y]->(r)").where("x.quantity > z.quantity").select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("s.id").alias("d"))


@query(trade, ", r(id, root) as (select id, id from v union select s.b, r.root from r join (select src as a, dst as b from e union select dst, src from e) s on s.a = r.id) select id, min(root) as least from r group by 1", True)
def pregel_activity(g):
    least = F.coalesce(Pregel.msg(), F.col("least"))
    p = g.pregel.setMaxIter(50).setStopIfAllNonActiveVertices(True).setSkipMessagesFromNonActiveVertices(True).setUpdateActiveVertexExpression(least < F.col("least"))
    p = p.withVertexColumn("least", F.col("id"), F.least("least", least)).sendMsgToDst(Pregel.src("least")).sendMsgToSrc(Pregel.dst("least"))
    return p.aggMsgs(F.min(Pregel.msg())).run().select("id", "least")


@query(session, " select a.id, coalesce(max(case when b.n_events > a.n_events then b.n_events end), 0) as top from v a left join e on e.src = a.id left join v b on b.id = e.dst group by 1")
def pregel_reads_destination(g):
    more = F.when(Pregel.dst("n_events") > Pregel.src("n_events"), Pregel.dst("n_events"))
    return g.pregel.setMaxIter(1).withVertexColumn("top", F.lit(0).cast("long"), F.coalesce(Pregel.msg(), F.lit(0).cast("long"))).sendMsgToSrc(more).aggMsgs(F.max(Pregel.msg())).run().select("id", "top")


@query(session, rank_sql(4, "1.0::double", "(select count(*) from v)").replace("r0 as (select id, 1.0::double as r from v)", "r0 as (select id, (id % 3 + 0.5)::double as r from v)"))
def page_rank_warm_start(g):
    initial = g.vertices.select("id", (F.col("id") % 3 + 0.5).alias("pagerank"))
    return g.page_rank(max_iter=4, initial_ranks=initial).vertices.select("id", F.round("pagerank", 4).alias("rank"))


@query(session, f" select src, dst from (select src, dst, row_number() over (partition by src order by {draw_sql('src', 'dst', chr(39) + '7' + chr(39))}, dst) as k from (select distinct src, dst from e)) where k <= 3")
def k_min_sampling(g):
    return walks.k_min(g.edges.select("src", "dst").distinct(), "src", "dst", draw(F.col("src"), F.col("dst"), 7), 3)


@query(session, WALKS.split("sz as materialized")[0].replace("k <= 50", "k <= 5").rstrip().rstrip(",") + """, f as (select id, n_events::double as a, (id % 7)::double as b from v), m as (select few.id, avg(f.a) as a, avg(f.b) as b from few join f on f.id = few.nbr group by 1)
select f.id, k.slot::int as slot, round(case k.slot when 0 then f.a when 1 then f.b when 2 then coalesce(m.a, 0) else coalesce(m.b, 0) end, 5) as x from f cross join range(4) k(slot) left join m on m.id = f.id""")
def sampling_convolution(g):
    features = g.vertices.select("id", array_to_vector(F.array(F.col("n_events").cast("double"), (F.col("id") % 7).cast("double"))).alias("embedding"))
    return slots(walks.sampling_convolution(g, features, max_nbrs=5))


def scratch(g) -> str:
    return Rounds(g.vertices.sparkSession, "query").home


@query(trade, " select src, dst, 1 as attr from e")
def edge_list_reader(g):
    home, spark = scratch(g), g.vertices.sparkSession
    lines = g.edges.select(F.concat_ws("\t", "src", "dst").alias("value"))
    lines.unionAll(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(home)
    return edge_list.read_edge_list(spark, home).edges


@query(session, " select src, dst, event_type, event_id from e")
def saved_graph(g):
    home = scratch(g)
    edge_list.write_graph(g, home, "orc")
    return edge_list.read_graph(g.vertices.sparkSession, home, "orc").edges


@query(session, " select id, n_events from v where n_events > 66 union all select id, 0 from (select src as id from e union select dst from e) x where id not in (select id from v where n_events > 66)")
def default_vertices(g):
    return edge_list.with_default_vertices(g.vertices.where("n_events > 66"), g.edges, {"n_events": 0}).vertices


@query(session, " select src, dst, count(*)::int as attr from e group by 1, 2")
def unique_edge_tuples(g):
    return edge_list.from_edge_tuples(g.edges.select("src", "dst"), unique=True).edges


@query(geo, REACH.replace("select v.id, v.kind, min", "select v.id, min").replace("group by 1, 2", "group by 1"), True)
def streamed_components(g):
    home, spark = scratch(g), g.vertices.sparkSession
    g.edges.select("src", "dst").write.parquet(f"{home}/in")
    stream = spark.readStream.schema("src string, dst string").option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    q = batches.on_each_batch(stream, f"{home}/all", Graph.connected_components, f"{home}/out", f"{home}/log")
    q.processAllAvailable()
    q.stop()
    return batches.latest_result(spark, f"{home}/out")


@query(tables.link_graph)
def link_out_degrees(g):
    return g.out_degrees.withColumnRenamed("outDegree", "n")


ORACLES["link_out_degrees"] = "select url as id, count(*)::int as n from (select url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as l from pages) group by 1"


def generated_grid(spark, sf_dir):
    return generators.grid(spark, 6, 7).edges


def generated_rmat(spark, sf_dir):
    return generators.rmat(spark, 64, 200).edges


def generated_log_normal(spark, sf_dir):
    return generators.log_normal(spark, 50, mu=1.0, sigma=0.5).edges


def generated_chain(spark, sf_dir):
    return generators.chain(spark, 9).edges


def generated_star(spark, sf_dir):
    return generators.star(spark, 9).edges


def generated_blobs(spark, sf_dir):
    return generators.two_blobs(spark, 4).edges


for f in (generated_grid, generated_rmat, generated_log_normal, generated_chain, generated_star, generated_blobs):
    QUERIES[f.__name__] = f
ORACLES["generated_chain"] = "select k as src, k + 1 as dst from range(8) t(k)"
ORACLES["generated_star"] = "select 0::bigint as src, k + 1 as dst from range(9) t(k)"
ORACLES["generated_blobs"] = "select a + o as src, b + o as dst, (a + o) || '-' || (b + o) as e_attr1 from range(4) x(a), range(4) y(b), range(0, 8, 4) z(o) union all select 0, 4, '0-4'"
BITS = "with b as (select t.id, k, {u} as u from range(240) t(id), range(6) s(k)), c as (select id, sum((u >= 0.6)::int << (5 - k))::bigint as src, sum(((u >= 0.45 and u < 0.6) or u >= 0.75)::int << (5 - k))::bigint as dst from b group by id)"
ORACLES["generated_rmat"] = BITS.format(u=draw_sql("t.id", "k", "'42'") + " / 281474976710656.0::double") + " select src, dst from (select src, dst, min(id) as k from c group by 1, 2 order by k limit 200)"
ORACLES["generated_log_normal"] = f"""with u as (select id, {draw_sql("id", "'42'", "'1'")} / 281474976710656.0::double as u1, {draw_sql("id", "'42'", "'2'")} / 281474976710656.0::double as u2 from range(50) t(id)),
d as (select id, least(50, floor(exp(1.0 + 0.5 * sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2))))::int as degree from u),
e as (select id as src, unnest(range(1, degree + 1)) as k from d where degree > 0)
select src, floor({draw_sql("src", "k", "'42'")} / 281474976710656.0::double * 50)::bigint as dst, 1 as attr from e"""
ORACLES["generated_grid"] = "select r * 7 + c as src, r * 7 + c + 1 as dst from range(6) a(r), range(6) b(c) union all select r * 7 + c, r * 7 + c + 7 from range(5) a(r), range(7) b(c)"
