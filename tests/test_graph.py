import random

import pytest
from pyspark.sql import functions as F

from sparkseries.operators import graph as g
from sparkseries.operators.graph import Graph
from sparkseries.operators.trees import PropertyGraph, Tree


def make(spark, seed, n=12, m=22, directed=True):
    r = random.Random(seed)
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})
    weights = {e: float(r.randint(1, 9)) for e in edges}
    nodes = spark.range(n)
    return Graph(nodes, spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src long, dst long, weight double"), directed), weights, n


def distances(weights, n, source, directed=True, hops=False):
    arcs = [(a, b, 1.0 if hops else w) for (a, b), w in weights.items()]
    arcs += [] if directed else [(b, a, w) for a, b, w in arcs]
    dist = {source: 0.0}
    for _ in range(n):
        for a, b, w in arcs:
            if a in dist and dist[a] + w < dist.get(b, float("inf")):
                dist[b] = dist[a] + w
    return dist


@pytest.mark.parametrize("seed", [1, 2])
def test_distances(spark, seed):
    graph, weights, n = make(spark, seed)
    assert {r.id: r.dist for r in graph.dijkstra(0).collect()} == distances(weights, n, 0)
    hops = distances(weights, n, 0, hops=True)
    bfs = {r.id: r for r in graph.bfs(0).collect()}
    assert {i: r.hops for i, r in bfs.items()} == hops
    for i, r in bfs.items():
        assert (r.parent is None) == (i == 0) and (i == 0 or r.parent == min(a for a, b in weights if b == i and a in hops and hops[a] == r.hops - 1))
    every = {(r.src, r.dst): r.dist for r in graph.floyd_warshall().collect()}
    assert every == {(s, d): x for s in range(n) for d, x in distances(weights, n, s).items()}
    target = max(distances(weights, n, 0))
    path = graph.shortest_path(0, target)
    assert path[0] == 0 and path[-1] == target and sum(weights[e] for e in zip(path, path[1:])) == distances(weights, n, 0)[target]
    assert graph.shortest_path(0, 99) == []


def reach(weights, n, s):
    return set(distances(weights, n, s, hops=True))


@pytest.mark.parametrize("seed", [3, 4])
def test_components_and_cycles(spark, seed):
    graph, weights, n = make(spark, seed, m=14)
    weak = {s: min(distances(weights, n, s, directed=False, hops=True)) for s in range(n)}
    assert {r.id: r.component for r in graph.components().collect()} == weak
    strong = {s: min(t for t in range(n) if t in reach(weights, n, s) and s in reach(weights, n, t)) for s in range(n)}
    assert {r.id: r.component for r in graph.strong_components().collect()} == strong
    cyclic = any(a == b for a, b in weights) or len(set(strong.values())) < n
    assert graph.has_cycle() == cyclic
    dag = Graph(graph.nodes, graph.edges.filter("src < dst"))
    order = {r.id: r.position for r in dag.topological_sort().collect()}
    assert sorted(order.values()) == list(range(n)) and all(order[a] < order[b] for a, b in weights if a < b)
    if cyclic:
        with pytest.raises(ValueError):
            graph.topological_sort()


def test_undirected_cycle(spark):
    assert g.cycle(spark, 5).has_cycle() and not g.path(spark, 5).has_cycle()


def test_spanning_forest(spark):
    graph, weights, n = make(spark, 5, directed=False)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    best = {}
    for (a, b), w in weights.items():
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = min(w, best.get(k, 99))
    total = 0.0
    for (a, b), w in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    forest = graph.kruskal_mst().collect()
    assert sum(r.weight for r in forest) == total and len(forest) == n - len({find(x) for x in range(n)})
    assert {(r.src, r.dst) for r in graph.prim_mst(0).collect()} <= {(r.src, r.dst) for r in forest}


def test_centrality_and_structure(spark):
    star = g.star(spark, 6)
    assert {r.id: r.betweenness for r in star.betweenness_centrality().collect()} == {0: 10.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    close = {r.id: r.closeness for r in star.closeness_centrality().collect()}
    assert close[0] == 1.0 and close[1] == pytest.approx(5 / 9)
    eig = {r.id: r.centrality for r in star.eigenvector_centrality().collect()}
    assert eig[0] == pytest.approx(0.5**0.5, abs=1e-6) and eig[3] == pytest.approx(0.1**0.5, abs=1e-6)
    rank = {r.id: r.rank for r in g.cycle(spark, 4).pagerank(iterations=5).collect()}
    assert all(v == pytest.approx(0.25) for v in rank.values())
    dangling = Graph.from_edge_list(spark, [(0, 1), (1, 2)])
    assert sum(r.rank for r in dangling.pagerank(iterations=30).collect()) == pytest.approx(1.0)
    k4 = g.complete(spark, 4)
    assert {(r.triangles, r.coefficient) for r in k4.clustering().collect()} == {(3, 1.0)}
    assert k4.counts().first().density == 1.0 and k4.diameter().first()[0] == 1 and g.path(spark, 5).diameter().first()[0] == 4
    two = Graph.from_edge_list(spark, [(a, b) for c in (0, 10) for a in range(c, c + 4) for b in range(a + 1, c + 4)] + [(3, 10)], False)
    labels = {r.id: r.community for r in two.communities().collect()}
    assert len({labels[i] for i in range(4)}) == 1 and labels[0] != labels[13]


def test_editing_and_lookup(spark):
    e = Graph.from_edge_list(spark, [(0, 1, 2.0), (1, 2, 3.0)])
    assert e.has_node(2) and not e.has_node(9) and e.has_edge(0, 1) and not e.has_edge(1, 0) and e.edge_weight(1, 2) == 3.0 and e.edge_weight(2, 1) is None
    bigger = e.add_nodes(spark.createDataFrame([(2,), (3,)], "id long")).add_edges(spark.createDataFrame([(0, 1, 9.0), (2, 3, 1.0)], "src long, dst long, weight double"))
    assert bigger.counts().first()[:2] == (4, 3) and bigger.edge_weight(0, 1) == 2.0
    assert bigger.remove_nodes(spark.createDataFrame([(2,)], "id long")).edges.count() == 1
    assert sorted(r.id for r in e.dfs(0).collect()) == [0, 1, 2]
    assert [r.id for r in sorted(g.grid(spark, 2, 2).dfs(0).collect(), key=lambda r: r.position)] == [0, 1, 3, 2]


def test_isomorphism(spark):
    a = Graph.from_edge_list(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    b = Graph.from_edge_list(spark, [(7, 5), (5, 6), (6, 7), (6, 9)])
    c = Graph.from_edge_list(spark, [(0, 1), (1, 2), (0, 2), (2, 3)])
    assert a.is_isomorphic(b) and not a.is_isomorphic(c)
    assert not g.cycle(spark, 6).is_isomorphic(Graph.from_edge_list(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)], False))


def test_generators_layouts_texts(spark):
    assert g.hypercube(spark, 3).edges.count() == 12 and g.wheel(spark, 6).edges.count() == 10 and g.barabasi_albert(spark, 20, 2).edges.count() == 36 and g.watts_strogatz(spark, 12, 4, 0.3).edges.count() == 24
    r = g.random_graph(spark, 60, 0.3, 1).edges.count()
    assert 400 < r < 660 and r == g.random_graph(spark, 60, 0.3, 1).edges.count()
    small = g.cycle(spark, 4)
    for layout in (small.layout_circular(), small.layout_spectral(), small.layout_force(20), small.layout_hierarchical(0)):
        assert layout.count() == 4
    assert small.to_text("dot").startswith("graph {") and small.to_text("gml").count("edge") == 4 and small.to_text("graphml").endswith("</graphml>")
    import json

    assert len(json.loads(small.to_text("cytoscape"))) == 8


def test_tree(spark):
    t = Tree(spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("c", "f"), ("c", "g")], "parent string, child string"))
    walk = lambda how: "".join(r.node for r in t.traverse(how).collect())
    assert (walk("preorder"), walk("inorder"), walk("postorder"), walk("levelorder")) == ("abdecfg", "dbeafcg", "debfgca", "abcdefg")
    assert t.root() == "a" and t.height().first()[0] == 2 and sorted(r.node for r in t.leaves().collect()) == ["d", "e", "f", "g"]
    assert [(r.node, r.distance) for r in t.ancestors("g").collect()] == [("c", 1), ("a", 2)] and t.descendants("b").count() == 2 and t.children("a").count() == 2 and t.parent("d").first()[0] == "b"


def test_property_graph(spark):
    nodes = spark.createDataFrame([(1, "p", {"n": "x"}), (2, "p", {"n": "y"}), (3, "q", {"n": "x"})], "id long, label string, properties map<string,string>")
    edges = spark.createDataFrame([(1, 2, "likes", {"s": "1"}), (2, 3, "has", {})], "src long, dst long, type string, properties map<string,string>")
    pg = PropertyGraph(nodes, edges)
    assert [r.id for r in pg.query_nodes({"n": "x"}, "p").collect()] == [1] and pg.query_edges({"s": "1"}).count() == 1 and pg.query_nodes({"zz": "x"}).count() == 0
    assert [tuple(r) for r in pg.match([({"label": "p", "n": "x"}, "likes", {}), ({}, "has", {"label": "q"})]).collect()] == [(1, 2, 3)]
    assert pg.update_node_property(2, "n", "z").query_nodes({"n": "z"}).count() == 1 and pg.update_edge_property(2, 3, "k", "v").query_edges({"k": "v"}).count() == 1
    assert pg.add_nodes(nodes.withColumn("id", F.col("id") + 2)).nodes.count() == 5


def test_shortest_path_over_weights_of_zero(spark):
    edges = spark.createDataFrame([(5, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0), (2, 3, 0.0), (3, 3, 0.0)], "src long, dst long, weight double")
    g = Graph.from_edges(edges)
    assert g.shortest_path(5, 3) == [5, 1, 2, 3] and g.shortest_path(5, 1) == [5, 1] and g.shortest_path(3, 5) == []
    assert {r.id: r.dist for r in g.dijkstra(5).collect()} == {5: 0.0, 1: 1.0, 2: 1.0, 3: 1.0}


def test_traversals_of_long_names(spark):
    a1, a2 = "a" * 20 + "1", "a" * 20 + "2"
    t = Tree(spark.createDataFrame([("root", a1), ("root", a2), (a1, "k1"), (a2, "k2"), ("root", "b")], "parent string, child string"), "root")
    order = lambda how: [r.node for r in t.traverse(how).orderBy("position").collect()]
    assert order("postorder") == ["k1", a1, "k2", a2, "b", "root"]
    assert order("preorder") == ["root", a1, "k1", a2, "k2", "b"]
    assert order("levelorder") == ["root", a1, a2, "b", "k1", "k2"]
    assert order("inorder") == ["k1", a1, "root", "k2", a2, "b"]


def test_force_and_spectral_layouts(spark):
    import numpy as np

    graph, weights, n = make(spark, 3)
    got = {r.id: (r.x, r.y) for r in graph.layout_force(12, seed=5).collect()}
    p = [list(x) for x in np.random.default_rng(5).random((n, 2))]
    k, heat = (1 / n) ** 0.5, 0.1
    for _ in range(12):
        move = [[0.0, 0.0] for _ in range(n)]
        for i in range(n):
            for j in range(n):
                gap = [p[i][c] - p[j][c] for c in (0, 1)]
                far = max((gap[0] ** 2 + gap[1] ** 2) ** 0.5, 1e-3)
                for c in (0, 1):
                    move[i][c] += gap[c] / far * (k * k / far)
        for a, b in weights:
            if a != b:
                gap = [p[a][c] - p[b][c] for c in (0, 1)]
                far = (gap[0] ** 2 + gap[1] ** 2) ** 0.5
                for c in (0, 1):
                    move[a][c] -= gap[c] * far / k
                    move[b][c] += gap[c] * far / k
        for i in range(n):
            size = max((move[i][0] ** 2 + move[i][1] ** 2) ** 0.5, 1e-9)
            for c in (0, 1):
                p[i][c] += move[i][c] / size * min(size, heat)
        heat *= 0.97
    assert all(abs(got[i][c] - p[i][c]) < 1e-6 for i in range(n) for c in (0, 1))
    # Spectral places are eigenvectors of the undirected Laplacian with its second and third least values.
    laplacian = np.zeros((n, n))
    for a, b in {(min(e), max(e)) for e in weights if e[0] != e[1]}:
        laplacian[a, a] += 1
        laplacian[b, b] += 1
        laplacian[a, b] -= 1
        laplacian[b, a] -= 1
    values = np.linalg.eigvalsh(laplacian)
    places = {r.id: (r.x, r.y) for r in graph.layout_spectral().collect()}
    for c in (0, 1):
        v = np.array([places[i][c] for i in range(n)])
        assert np.allclose(laplacian @ v, values[c + 1] * v, atol=1e-8) and abs(np.linalg.norm(v) - 1) < 1e-9
