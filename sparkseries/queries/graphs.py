"""Graph queries: a trade graph between nations, the supplier-part graph, the region-nation-customer tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators.graph import Graph
from ..operators.trees import PropertyGraph, Tree
from ..plans.catalog import query, table

#: Trade: edge from a supplier's nation to a customer's, weighted by the number of line items.
_TRADE = """trade AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
#: The two strongest destinations of each nation.
_SPARSE = _TRADE + ", sparse AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM trade WHERE src <> dst) WHERE k <= 2)"
_NODES = "nodes AS (SELECT n_nationkey::BIGINT AS id FROM nation)"


def trade(spark, sf) -> DataFrame:
    li, o, c, s = (table(spark, sf, n) for n in ("lineitem", "orders", "customer", "supplier"))
    d = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return d.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def nations(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def full(spark, sf) -> Graph:
    return Graph(nations(spark, sf), trade(spark, sf))


def sparse(spark, sf, directed: bool = True) -> Graph:
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    e = trade(spark, sf).filter("src <> dst").withColumn("k", F.row_number().over(w)).filter("k <= 2").drop("k")
    return Graph(nations(spark, sf), e, directed)


def dag(spark, sf) -> Graph:
    s = sparse(spark, sf)
    return Graph(s.nodes, s.edges.filter("src < dst"))


def supply(spark, sf) -> Graph:
    """Suppliers (negative ids) and the parts they sold."""
    e = table(spark, sf, "lineitem").select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return Graph.from_edges(e, directed=False)


@query("WITH e AS (SELECT DISTINCT -l_suppkey - 1 AS s, l_partkey AS p FROM lineitem), d AS (SELECT s AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT p, 0, 1 FROM e) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM d GROUP BY id")
def graph_degree(spark, sf):
    return supply(spark, sf).degrees()


@query("SELECT DISTINCT l_partkey AS id, -l_suppkey - 1 AS neighbor FROM lineitem UNION SELECT DISTINCT -l_suppkey - 1, l_partkey FROM lineitem")
def graph_neighbors(spark, sf):
    return supply(spark, sf).neighbors()


@query(f"WITH {_SPARSE} SELECT dst AS id, src AS neighbor FROM sparse")
def graph_predecessors(spark, sf):
    return sparse(spark, sf).predecessors()


@query("WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT (SELECT count(DISTINCT s) FROM e) + (SELECT count(DISTINCT p) FROM e) AS n, (SELECT count(*) FROM e) AS m) SELECT n AS node_count, m AS edge_count, round(2.0 * m / (n * (n - 1)), 8) AS density FROM n")
def graph_density(spark, sf):
    return supply(spark, sf).counts().withColumn("density", F.round("density", 8))


_PAIRS = f"{_SPARSE}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM sparse), b AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p), {_NODES}"
_CLUSTER = f"""{_PAIRS}, k AS (SELECT x, count(*) AS k FROM b GROUP BY x), t AS (SELECT b1.x, count(*) AS t FROM b b1 JOIN b b2 ON b1.x = b2.x AND b1.y < b2.y JOIN p ON p.a = b1.y AND p.b = b2.y GROUP BY 1),
c AS (SELECT id, coalesce(t, 0)::BIGINT AS triangles, round(coalesce(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) END, 0), 6)::DOUBLE AS coefficient FROM nodes LEFT JOIN k ON k.x = id LEFT JOIN t ON t.x = id)"""


@query(f"WITH {_CLUSTER} SELECT * FROM c")
def graph_clustering(spark, sf):
    return sparse(spark, sf).clustering().withColumn("coefficient", F.round("coefficient", 6))


@query(f"WITH {_CLUSTER} SELECT round(avg(coefficient), 5) AS average_clustering FROM c")
def graph_average_clustering(spark, sf):
    return sparse(spark, sf).average_clustering().select(F.round("average_clustering", 5).alias("average_clustering"))


_HOPS = """h AS (SELECT {0} AS root, {0} AS id, 0 AS d FROM nodes WHERE {1} UNION SELECT root, dst, d + 1 FROM h JOIN sparse ON src = h.id WHERE d < 25), hops AS (SELECT root, id, min(d) AS hops FROM h GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_SPARSE}, {_NODES}, {_HOPS.format('id', 'id = 0')} SELECT a.id, min(s.src) AS parent, a.hops::BIGINT AS hops FROM hops a LEFT JOIN (SELECT src, dst, b.hops FROM sparse JOIN hops b ON b.id = src) s ON s.dst = a.id AND s.hops = a.hops - 1 GROUP BY a.id, a.hops")
def graph_bfs(spark, sf):
    return sparse(spark, sf).bfs(0)


@query(f"WITH RECURSIVE {_SPARSE}, {_NODES}, {_HOPS.format('id', 'true')} SELECT max(hops)::BIGINT AS diameter FROM hops")
def graph_diameter(spark, sf):
    return sparse(spark, sf).diameter()


@query(f"WITH RECURSIVE {_SPARSE}, {_NODES}, {_HOPS.format('id', 'true')} SELECT root AS id, round(coalesce((count(*) - 1) / nullif(sum(hops), 0), 0), 6)::DOUBLE AS closeness FROM hops GROUP BY root")
def graph_closeness(spark, sf):
    s = sparse(spark, sf)
    return Graph(s.nodes, s.edges.drop("weight")).closeness_centrality().withColumn("closeness", F.round("closeness", 6))


_UNROLLED = ["d0 AS (SELECT 0::BIGINT AS id, 0::DOUBLE AS dist)"] + [f"d{k + 1} AS (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{k} UNION ALL SELECT dst, dist + weight FROM d{k} JOIN sparse ON src = id) GROUP BY id)" for k in range(12)]


@query(f"WITH {_SPARSE}, {', '.join(_UNROLLED)} SELECT * FROM d12")
def graph_sssp(spark, sf):
    return sparse(spark, sf).dijkstra(0)


@query(f"WITH {_SPARSE}, {', '.join(_UNROLLED)} SELECT max(dist) AS dist FROM d12 WHERE id = (SELECT max(id) FROM d12)")
def graph_shortest_path(spark, sf):
    """The length of the path found to the last node that can be reached."""
    s = sparse(spark, sf)
    last = s.dijkstra(0).agg(F.max("id")).first()[0]
    path = s.shortest_path(0, last)
    steps = spark.createDataFrame(list(zip(path, path[1:])) or [(-1, -1)], "src long, dst long")
    return s.edges.join(steps, ["src", "dst"]).agg(F.sum("weight").alias("dist"))


def _fw_sql() -> str:
    steps = ["f0 AS (SELECT src, dst, min(weight) AS dist FROM (SELECT src, dst, weight FROM trade UNION ALL SELECT id, id, 0 FROM nodes) GROUP BY ALL)"]
    for k in range(5):
        steps.append(f"f{k + 1} AS (SELECT a.src, b.dst, min(a.dist + b.dist) AS dist FROM f{k} a JOIN f{k} b ON a.dst = b.src GROUP BY ALL)")
    return f"WITH {_TRADE}, {_NODES}, {', '.join(steps)} SELECT * FROM f5"


@query(_fw_sql())
def graph_floyd_warshall(spark, sf):
    return full(spark, sf).floyd_warshall()


@query(f"WITH RECURSIVE {_PAIRS}, w AS (SELECT id AS a, id AS b FROM nodes UNION SELECT w.a, b.y FROM w JOIN b ON b.x = w.b) SELECT a AS id, min(b) AS component FROM w GROUP BY a")
def graph_components(spark, sf):
    return sparse(spark, sf).components()


@query(f"WITH RECURSIVE {_SPARSE}, {_NODES}, w AS (SELECT id AS a, id AS b FROM nodes UNION SELECT w.a, dst FROM w JOIN sparse ON src = w.b) SELECT w.a AS id, min(w.b) AS component FROM w JOIN w v ON v.a = w.b AND v.b = w.a GROUP BY w.a")
def graph_strong_components(spark, sf):
    return sparse(spark, sf).strong_components()


@query(f"WITH RECURSIVE {_SPARSE}, {_NODES}, e AS (SELECT src, dst FROM sparse WHERE src < dst), p AS (SELECT id, 0 AS d FROM nodes UNION SELECT dst, d + 1 FROM p JOIN e ON src = p.id), l AS (SELECT id, max(d)::BIGINT AS level FROM p GROUP BY id) SELECT id, level, row_number() OVER (ORDER BY level, id) - 1 AS position FROM l")
def graph_topological_sort(spark, sf):
    return dag(spark, sf).topological_sort()


@query(f"WITH RECURSIVE {_SPARSE}, w AS (SELECT src AS a, dst AS b FROM sparse UNION SELECT w.a, dst FROM w JOIN sparse ON src = w.b) SELECT bool_or(a = b) AS cyclic, false AS dag_cyclic FROM w")
def graph_has_cycle(spark, sf):
    return spark.createDataFrame([(sparse(spark, sf).has_cycle(), dag(spark, sf).has_cycle())], "cyclic boolean, dag_cyclic boolean")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"k AS (SELECT src, count(*) AS k FROM sparse GROUP BY 1), n AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, n)"]
    for i in range(rounds):
        steps.append(f"g{i} AS (SELECT dst, sum(rank / k) AS got FROM sparse JOIN k USING (src) JOIN r{i} ON r{i}.id = src GROUP BY 1), r{i + 1} AS (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * (1 - (SELECT sum(got) FROM g{i})) / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes LEFT JOIN g{i} ON dst = id, n)")
    return f"WITH {_SPARSE}, {_NODES}, {', '.join(steps)} SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@query(_pagerank_sql(8))
def graph_pagerank(spark, sf):
    return sparse(spark, sf).pagerank(iterations=8).withColumn("rank", F.round("rank", 8))


def _eigenvector_sql(rounds: int) -> str:
    steps = ["arcs AS MATERIALIZED (SELECT src, dst, weight FROM sparse UNION ALL SELECT dst, src, weight FROM sparse)", "x0 AS (SELECT id, 1::DOUBLE AS x FROM nodes)"]
    for i in range(rounds):
        steps.append(f"y{i} AS MATERIALIZED (SELECT id, sum(x) AS x FROM (SELECT id, x FROM x{i} UNION ALL SELECT dst, x * weight FROM x{i} JOIN arcs ON src = id) GROUP BY id)")
        steps.append(f"x{i + 1} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
    return f"WITH {_SPARSE}, {_NODES}, {', '.join(steps)} SELECT id, round(x, 5) AS centrality FROM x{rounds}"


@query(_eigenvector_sql(20))
def graph_eigenvector(spark, sf):
    return sparse(spark, sf, False).eigenvector_centrality(20).withColumn("centrality", F.round("centrality", 5))


#: Numbers of shortest paths level by level; a node between two others is on n(s, v) * n(v, t) of n(s, t).
@query(
    f"""WITH RECURSIVE {_SPARSE}, {_NODES}, {_HOPS.format('id', 'true')},
    p AS (SELECT id AS s, id AS t, 0 AS d, 1::DOUBLE AS n FROM nodes UNION ALL SELECT p.s, dst, p.d + 1, sum(n) FROM p JOIN sparse ON src = p.t JOIN hops ON hops.root = p.s AND hops.id = dst AND hops.hops = p.d + 1 GROUP BY ALL)
    SELECT nodes.id, round(coalesce(sum(a.n * b.n / c.n), 0), 6)::DOUBLE AS betweenness FROM nodes LEFT JOIN (p a JOIN p b ON b.s = a.t AND a.d > 0 AND b.d > 0 JOIN p c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d) ON a.t = nodes.id GROUP BY nodes.id"""
)
def graph_betweenness(spark, sf):
    return sparse(spark, sf).betweenness_centrality().withColumn("betweenness", F.round("betweenness", 6))


def _communities_sql(rounds: int) -> str:
    steps = ["b AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM sparse UNION ALL SELECT dst, src FROM sparse))", "l0 AS (SELECT id, id AS label FROM nodes)"]
    for i in range(rounds):
        votes = f"SELECT id, label, count(*) AS n FROM (SELECT dst AS id, label FROM b JOIN l{i} ON l{i}.id = src UNION ALL SELECT * FROM l{i}) GROUP BY ALL"
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM ({votes})) WHERE k = 1)")
    return f"WITH {_SPARSE}, {_NODES}, {', '.join(steps)} SELECT id, label AS community FROM l{rounds}"


@query(_communities_sql(20))
def graph_communities(spark, sf):
    return sparse(spark, sf, False).communities()


# -- the whole graph of suppliers and parts

_SUPPLY = "e AS MATERIALIZED (SELECT DISTINCT -l_suppkey - 1 AS s, l_partkey AS p FROM lineitem), b AS MATERIALIZED (SELECT s AS src, p AS dst FROM e UNION ALL SELECT p, s FROM e), ids AS MATERIALIZED (SELECT DISTINCT src AS id FROM b)"


def _supply_levels(rounds: int) -> str:
    steps = ["h0 AS (SELECT max(id) AS id, NULL::BIGINT AS parent, 0::BIGINT AS hops FROM ids)"]
    for k in range(rounds):
        steps.append(f"h{k + 1} AS MATERIALIZED (SELECT * FROM h{k} UNION ALL SELECT dst, min(src), {k + 1} FROM h{k} JOIN b ON src = id WHERE hops = {k} AND dst NOT IN (SELECT id FROM h{k}) GROUP BY dst)")
    return f"WITH {_SUPPLY}, {', '.join(steps)} SELECT * FROM h{rounds}"


@query(_supply_levels(8))
def graph_bfs_supply(spark, sf):
    g = supply(spark, sf)
    return g.bfs(g.nodes.agg(F.max("id")).first()[0])


def _supply_rank(rounds: int) -> str:
    steps = ["k AS MATERIALIZED (SELECT src, count(*) AS k FROM b GROUP BY 1)", "n AS (SELECT count(*) AS n FROM ids)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM ids, n)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT dst AS id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(rank / k) AS rank FROM b JOIN k USING (src) JOIN r{i} ON r{i}.id = src, n GROUP BY dst)")
    return f"WITH {_SUPPLY}, {', '.join(steps)} SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@query(_supply_rank(12))
def graph_pagerank_supply(spark, sf):
    """No node of this graph lacks neighbours, so no rank is spread."""
    return supply(spark, sf).pagerank(iterations=12).withColumn("rank", F.round("rank", 8))


@query(f"WITH RECURSIVE {_SUPPLY}, w AS (SELECT (SELECT min(id) FROM ids) AS id UNION SELECT dst FROM w JOIN b ON src = w.id) SELECT ids.id, min(w.id) OVER () AS component FROM ids JOIN w USING (id)")
def graph_components_supply(spark, sf):
    """Connected through its lines: one component in these tables, named by its least node."""
    return supply(spark, sf).components()


#: Weights as the order of (weight, ends), so that the forest is one and the same everywhere.
@query(
    f"""WITH RECURSIVE {_TRADE}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(weight) AS w FROM trade WHERE src <> dst GROUP BY ALL),
    x AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM u),
    f AS (SELECT 0::BIGINT AS k, (SELECT map_from_entries(list(row(n_nationkey::BIGINT, n_nationkey::BIGINT))) FROM nation) AS c, 0::DOUBLE AS total
      UNION ALL SELECT x.k, CASE WHEN f.c[x.a] = f.c[x.b] THEN f.c ELSE map_from_entries(list_transform(map_entries(f.c), lambda e: row(e.key, CASE WHEN e.value = f.c[x.b] THEN f.c[x.a] ELSE e.value END))) END,
      f.total + CASE WHEN f.c[x.a] = f.c[x.b] THEN 0 ELSE x.w END FROM f JOIN x ON x.k = f.k + 1)
    SELECT max(total) AS total FROM f"""
)
def graph_mst(spark, sf):
    return full(spark, sf).minimum_spanning_forest().agg(F.sum("weight").alias("total"))


#: An edge is in the least spanning tree if no way of smaller edges joins its ends.
@query(
    f"""WITH RECURSIVE {_TRADE}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(weight) AS w FROM trade WHERE src <> dst GROUP BY ALL),
    x AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM u), both_ AS (SELECT a, b, k FROM x UNION ALL SELECT b, a, k FROM x),
    r AS (SELECT k AS edge, a AS at FROM x UNION SELECT r.edge, both_.b FROM r JOIN both_ ON both_.a = r.at AND both_.k < r.edge)
    SELECT a AS src, b AS dst, w AS weight FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.edge = x.k AND r.at = x.b)"""
)
def graph_prim_mst(spark, sf):
    return full(spark, sf).prim_mst(0)


@query(
    f"""WITH RECURSIVE {_SPARSE}, adj AS (SELECT src, list(dst ORDER BY dst DESC) AS ds FROM (SELECT DISTINCT src, dst FROM sparse) GROUP BY src),
    r AS (SELECT [{{'n': 0::BIGINT, 'p': NULL::BIGINT}}] AS stack, []::BIGINT[] AS seen, NULL::BIGINT AS node, NULL::BIGINT AS parent, -1::BIGINT AS position
      UNION ALL SELECT CASE WHEN known THEN rest ELSE list_concat(rest, list_transform(list_filter(coalesce(ds, []), lambda x: NOT list_contains(seen, x) AND x <> top.n), lambda x: {{'n': x, 'p': top.n}})) END,
        CASE WHEN known THEN seen ELSE list_append(seen, top.n) END, CASE WHEN known THEN NULL ELSE top.n END, top.p, CASE WHEN known THEN position ELSE position + 1 END
      FROM (SELECT *, list_contains(seen, top.n) AS known FROM (SELECT *, stack[len(stack)] AS top, stack[1:len(stack) - 1] AS rest FROM r WHERE len(stack) > 0) LEFT JOIN adj ON adj.src = top.n))
    SELECT node AS id, parent, position FROM r WHERE node IS NOT NULL"""
)
def graph_dfs(spark, sf):
    return sparse(spark, sf).dfs(0)


@query(f"WITH {_SPARSE}, {_NODES} SELECT id, 0::BIGINT AS n_out, true AS known FROM (SELECT unnest([100, 101]) AS id) UNION ALL SELECT id, (SELECT count(*) FROM sparse WHERE src = id) + CASE WHEN id = 3 THEN 1 ELSE 0 END, true FROM nodes")
def graph_add(spark, sf):
    """Two new nodes (one listed twice, one known before) and an edge to one of them; an edge that is there stays one."""
    s = sparse(spark, sf)
    old = s.edges.filter("src = 0").select("src", "dst").limit(1)
    new = s.add_nodes(spark.createDataFrame([(100,), (101,), (101,), (3,)], "id long")).add_edges(spark.createDataFrame([(3, 100, 2.0)], "src long, dst long, weight double")).add_edges(old)
    known = F.lit(new.has_node(101) and new.has_edge(3, 100) and not new.has_edge(100, 3) and not new.has_node(102))
    return new.degrees().select("id", F.col("out_degree").alias("n_out"), known.alias("known"))


@query(f"WITH {_TRADE} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS n FROM trade WHERE src <> dst GROUP BY ALL")
def graph_from_edge_list(spark, sf):
    """A list of edges as a graph, read in both directions, each pair counted once."""
    rows = [tuple(r) for r in trade(spark, sf).filter("src <> dst").collect()]  # 600 pairs of 25 nations
    g_ = Graph.from_edge_list(spark, rows, directed=False)
    return g_.edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SPARSE} SELECT src, dst, weight FROM sparse WHERE src <> 3 AND dst <> 3 AND NOT (src = 0 AND dst = (SELECT min(dst) FROM sparse WHERE src = 0))")
def graph_edit(spark, sf):
    s = sparse(spark, sf)
    one = s.edges.filter("src = 0").groupBy("src").agg(F.min("dst").alias("dst"))
    return s.remove_nodes(spark.createDataFrame([(3,)], "id long")).remove_edges(one).edges.select("src", "dst", "weight")


@query(f"WITH {_NODES} SELECT id, round(cos((row_number() OVER (ORDER BY id) - 1) * 2 * pi() / (SELECT count(*) FROM nodes)), 6) AS x, round(sin((row_number() OVER (ORDER BY id) - 1) * 2 * pi() / (SELECT count(*) FROM nodes)), 6) AS y FROM nodes")
def graph_layout_circular(spark, sf):
    return sparse(spark, sf).layout_circular().select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """WITH n AS (SELECT unnest(range(0, 16)) AS i), p AS (SELECT a.i AS a, b.i AS b FROM n a, n b), e AS (
    SELECT 'complete' AS kind, a, b FROM p WHERE a < b AND b < 10 UNION ALL SELECT 'path', a, b FROM p WHERE b = a + 1 AND b < 10 UNION ALL SELECT 'cycle', a, b FROM p WHERE a < 10 AND b = (a + 1) % 10
    UNION ALL SELECT 'star', a, b FROM p WHERE a = 0 AND b BETWEEN 1 AND 9 UNION ALL SELECT 'wheel', a, b FROM p WHERE (a = 0 AND b BETWEEN 1 AND 9) OR (a BETWEEN 1 AND 9 AND b = a % 9 + 1)
    UNION ALL SELECT 'grid', a, b FROM p WHERE a < 15 AND b < 15 AND ((a // 5 = b // 5 AND b = a + 1) OR b = a + 5) UNION ALL SELECT 'hypercube', a, b FROM p WHERE a < b AND bit_count(xor(a, b)) = 1)
    SELECT kind, a::BIGINT AS src, b::BIGINT AS dst FROM e"""
)
def graph_generators(spark, sf):
    made = {"complete": g.complete(spark, 10), "path": g.path(spark, 10), "cycle": g.cycle(spark, 10), "star": g.star(spark, 10), "wheel": g.wheel(spark, 10), "grid": g.grid(spark, 3, 5), "hypercube": g.hypercube(spark, 4)}
    out = None
    for kind, x in made.items():
        one = x.edges.select(F.lit(kind).alias("kind"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_SPARSE}, {_NODES} SELECT 1 AS section, '  \"' || id || '\";' AS line FROM nodes UNION ALL SELECT 2, '  \"' || src || '\" -> \"' || dst || '\" [weight=' || weight::VARCHAR || '];' FROM sparse UNION ALL SELECT 0, 'digraph {{' UNION ALL SELECT 3, '}}'")
def graph_to_dot(spark, sf):
    return sparse(spark, sf).to_lines("dot")


# -- trees ------------------------------------------------------------------------------------

#: Regions below 'world', nations below their region, customers below their nation.
_TREE = """edges AS (SELECT 'world' AS parent, 'r' || r_regionkey AS child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
lv AS (SELECT 'world' AS node, 0::BIGINT AS depth, ['world'] AS path UNION ALL SELECT child, depth + 1, list_append(path, child) FROM lv JOIN edges ON parent = node)"""


def tree(spark, sf) -> Tree:
    r, n, c = (table(spark, sf, x) for x in ("region", "nation", "customer"))
    k = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    e = r.select(F.lit("world").alias("parent"), k("r", "r_regionkey").alias("child")).union(n.select(k("r", "n_regionkey"), k("n", "n_nationkey"))).union(c.select(k("n", "c_nationkey"), k("c", "c_custkey")))
    return Tree(e, "world")


@query(f"WITH RECURSIVE {_TREE} SELECT node, depth FROM lv")
def tree_depth(spark, sf):
    return tree(spark, sf).depth()


@query(f"WITH RECURSIVE {_TREE} SELECT max(depth) AS height FROM lv")
def tree_height(spark, sf):
    return tree(spark, sf).height()


@query(f"WITH RECURSIVE {_TREE} SELECT u.node, 3 - u.i AS distance FROM (SELECT unnest(path) AS node, generate_subscripts(path, 1) - 1 AS i FROM lv WHERE node = 'c7') u WHERE u.node <> 'c7'")
def tree_ancestors(spark, sf):
    return tree(spark, sf).ancestors("c7")


@query(f"WITH RECURSIVE {_TREE} SELECT node, depth - 1 AS distance FROM lv WHERE list_contains(path, 'r2') AND node <> 'r2'")
def tree_descendants(spark, sf):
    return tree(spark, sf).descendants("r2")


@query(f"WITH RECURSIVE {_TREE} SELECT DISTINCT child AS node FROM edges WHERE child NOT IN (SELECT parent FROM edges)")
def tree_leaves(spark, sf):
    return tree(spark, sf).leaves()


@query(f"WITH RECURSIVE {_TREE} SELECT node, depth, row_number() OVER (ORDER BY depth, path) - 1 AS position FROM lv")
def tree_levelorder(spark, sf):
    return tree(spark, sf).traverse("levelorder")


@query(f"WITH RECURSIVE {_TREE} SELECT node, depth, row_number() OVER (ORDER BY path) - 1 AS position FROM lv")
def tree_preorder(spark, sf):
    return tree(spark, sf).traverse("preorder")


# -- property graph -------------------------------------------------------------------------------


def shop(spark, sf) -> PropertyGraph:
    """Customers place orders, orders hold parts."""
    c, o, li, p = (table(spark, sf, x) for x in ("customer", "orders", "lineitem", "part"))
    props = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.col(v).cast("string"))])
    key = lambda x, col: F.concat(F.lit(x), F.col(col).cast("string"))
    nodes = c.select(key("c", "c_custkey").alias("id"), F.lit("customer").alias("label"), props(segment="c_mktsegment", nation="c_nationkey").alias("properties"))
    nodes = nodes.union(o.select(key("o", "o_orderkey"), F.lit("order"), props(status="o_orderstatus"))).union(p.select(key("p", "p_partkey"), F.lit("part"), props(brand="p_brand", size="p_size")))
    edges = o.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit("placed").alias("type"), props(priority="o_orderpriority").alias("properties"))
    return PropertyGraph(nodes, edges.union(li.select(key("o", "l_orderkey"), key("p", "l_partkey"), F.lit("holds"), props(flag="l_returnflag"))))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def pg_query_nodes(spark, sf):
    return shop(spark, sf).query_nodes({"segment": "BUILDING", "nation": "3"}, "customer").select("id")


@query("SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'")
def pg_query_edges(spark, sf):
    return shop(spark, sf).query_edges({"flag": "R"}, "holds").select("src", "dst")


@query("SELECT 'c' || c_custkey AS n0, 'o' || o_orderkey AS n1, 'p' || p_partkey AS n2 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND p_size = 5")
def pg_match_pattern(spark, sf):
    return shop(spark, sf).match([({"label": "customer", "segment": "BUILDING"}, "placed", {"label": "order", "status": "F"}), ({"label": "order"}, "holds", {"label": "part", "size": "5"})])


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey = 5 THEN 'VIP' ELSE c_mktsegment END AS segment FROM customer")
def pg_update_property(spark, sf):
    return shop(spark, sf).update_node_property("c5", "segment", "VIP").nodes.filter("label = 'customer'").select("id", F.col("properties")["segment"].alias("segment"))


@query("SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey = 1 THEN 'FIRST' ELSE o_orderpriority END AS priority FROM orders")
def pg_update_edge_property(spark, sf):
    shop_ = shop(spark, sf)
    src = shop_.edges.filter("dst = 'o1' AND type = 'placed'").first()["src"]
    return shop_.update_edge_property(src, "o1", "priority", "FIRST").edges.filter("type = 'placed'").select(F.col("dst").alias("id"), F.col("properties")["priority"].alias("priority"))


_DOUBLED = [s.replace("weight", "(1000.0::DOUBLE / weight)") for s in _UNROLLED]


@query(f"WITH {_SPARSE}, {', '.join(_DOUBLED)} SELECT round(max(dist), 6) AS dist FROM d12 WHERE id = (SELECT max(id) FROM d12)")
def graph_weighted_path(spark, sf):
    """The length of the path by a weight computed from the edge: heavy trade is near."""
    s = sparse(spark, sf)
    near = 1000.0 / F.col("weight")
    path = s.shortest_path(0, s.dijkstra(0).agg(F.max("id")).first()[0], weight=near)
    steps = spark.createDataFrame(list(zip(path, path[1:])) or [(-1, -1)], "src long, dst long")
    return s.edges.join(steps, ["src", "dst"]).agg(F.round(F.sum(near), 6).alias("dist"))


@query("SELECT true AS same, false AS other")
def graph_isomorphic(spark, sf):
    """The trade graph's skeleton against itself with other ids, and against a changed one."""
    s = sparse(spark, sf)
    other = Graph(s.nodes.select((99 - F.col("id")).alias("id")), s.edges.select((99 - F.col("src")).alias("src"), (99 - F.col("dst")).alias("dst")))
    changed = Graph(s.nodes, s.edges.filter("src > 0"))
    return spark.createDataFrame([(s.is_isomorphic(other), s.is_isomorphic(changed))], "same boolean, other boolean")


@query(f"WITH RECURSIVE {_SPARSE}, {_NODES}, {_HOPS.format('id', 'id = 0')} SELECT id, (row_number() OVER (PARTITION BY hops ORDER BY id) - 1)::DOUBLE AS x, (0 - hops)::DOUBLE AS y FROM hops")
def graph_layout_hierarchical(spark, sf):
    return sparse(spark, sf).layout_hierarchical(0).select("id", "x", (F.lit(0.0) + F.col("y")).alias("y"))


@query()
def graph_layout_force(spark, sf):
    """Places after 100 rounds; held against a plain loop in tests."""
    return sparse(spark, sf).layout_force().select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query()
def graph_layout_spectral(spark, sf):
    """Places; that they are eigenvectors of the Laplacian is held in tests."""
    return sparse(spark, sf).layout_spectral().select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("WITH p AS (SELECT a.i AS a, b.i AS b FROM (SELECT unnest(range(0, 60)) AS i) a, (SELECT unnest(range(0, 60)) AS i) b WHERE a.i < b.i) SELECT a AS src, b AS dst FROM p")
def graph_random(spark, sf):
    """Edges with probability 0.3 and the others, which together are all pairs; no pair is in both."""
    some = g.random_graph(spark, 60, 0.3, 7).edges.select("src", "dst")
    return some.unionAll(g.complete(spark, 60).edges.select("src", "dst").exceptAll(some))


@query("SELECT 'barabasi' AS kind, 196::BIGINT AS n UNION ALL SELECT 'watts', 200")
def graph_random_generators(spark, sf):
    made = {"barabasi": g.barabasi_albert(spark, 100, 2, 3).edges.filter("src <> dst"), "watts": g.watts_strogatz(spark, 100, 4, 0.2, 3).edges}
    out = None
    for kind, e in made.items():
        one = e.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH RECURSIVE {_TREE} SELECT node, depth, row_number() OVER (ORDER BY list_append(path, '~')) - 1 AS position FROM lv")
def tree_postorder(spark, sf):
    return tree(spark, sf).traverse("postorder")


@query(
    f"""WITH RECURSIVE {_TREE}, side AS (SELECT child, CASE WHEN k = 1 THEN 0 ELSE k END AS s FROM (SELECT child, row_number() OVER (PARTITION BY parent ORDER BY child) AS k FROM edges)),
    sides AS (SELECT 'world' AS node, 0::BIGINT AS depth, []::BIGINT[] AS k UNION ALL SELECT edges.child, depth + 1, list_append(k, s) FROM sides JOIN edges ON parent = node JOIN side ON side.child = edges.child)
    SELECT node, depth, row_number() OVER (ORDER BY list_append(k, 1)) - 1 AS position FROM sides"""
)
def tree_inorder(spark, sf):
    return tree(spark, sf).traverse("inorder")


@query("SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'n' || n_nationkey, 'r3' FROM nation WHERE n_regionkey = 3")
def tree_parent_children(spark, sf):
    t = tree(spark, sf)
    return t.parent("n7").select(F.lit("n7").alias("child"), "parent").union(t.children("r3").select("child", F.lit("r3")))
