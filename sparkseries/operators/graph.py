"""Graph operators over two tables: nodes (id, ...) and edges (src, dst, weight, ...).

Iterative operators run rounds of joins and aggregates; every round is cut with a
reliable checkpoint and converges on one number per round that comes to the driver.
Each says below what it keeps per node.  Operators that are serial by nature (depth
first search, isomorphism, spectral layout) or need all pairs (Floyd-Warshall)
check the size of their graph first and refuse larger ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import cut, ship_package
from .components import connected_components as _components

#: Nodes at most for operators that hold a whole graph in one task or all its pairs.
SMALL = 5_000
#: Arcs at most for those that come to one place.
SMALL_ARCS = 1_000_000


class Graph:
    """nodes: (id, ...); edges: (src, dst, weight, ...).  Undirected graphs are read in both directions."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, directed: bool = True):
        self.nodes = nodes
        self.edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
        self.directed = directed

    @classmethod
    def from_edge_list(cls, spark: SparkSession, edges: list[tuple], directed: bool = True) -> Graph:
        rows = [(s, d, float(w[0]) if w else 1.0) for s, d, *w in edges]
        return cls.from_edges(spark.createDataFrame(rows, "src long, dst long, weight double"), directed)

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = True) -> Graph:
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return cls(ids, edges, directed)

    # -- editing ----------------------------------------------------------------
    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Later rows of a known id are ignored."""
        new = nodes.join(self.nodes.select("id"), "id", "left_anti").dropDuplicates(["id"])
        return Graph(self.nodes.unionByName(new, allowMissingColumns=True), self.edges, self.directed)

    def add_edges(self, edges: DataFrame) -> Graph:
        edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
        new = edges.join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
        return Graph(self.nodes, self.edges.unionByName(new, allowMissingColumns=True), self.directed)

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """Without these nodes and their edges."""
        ids = ids.select("id").distinct()
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
        return Graph(self.nodes.join(ids, "id", "left_anti"), edges.select(self.edges.columns), self.directed)

    def remove_edges(self, pairs: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(self.edges.columns), self.directed)

    # -- lookups and counts -------------------------------------------------------
    def arcs(self) -> DataFrame:
        """(src, dst, weight), both ways if undirected."""
        e = self.edges.select("src", "dst", "weight")
        return e if self.directed else e.union(e.select("dst", "src", "weight").filter("src <> dst")).toDF("src", "dst", "weight")

    def has_node(self, node) -> bool:
        return not self.nodes.filter(F.col("id") == node).isEmpty()

    def has_edge(self, src, dst) -> bool:
        return not self.arcs().filter((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def edge_weight(self, src, dst) -> float | None:
        row = self.arcs().filter((F.col("src") == src) & (F.col("dst") == dst)).agg(F.min("weight")).first()
        return row[0]

    def counts(self) -> DataFrame:
        """One row: node_count, edge_count, density (m / n(n-1), doubled if undirected)."""
        n = self.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("m"))
        m = self.edges.select(F.lit(0).alias("n"), F.lit(1).alias("m"))
        c = n.union(m).agg(F.sum("n").cast("long").alias("node_count"), F.sum("m").cast("long").alias("edge_count"))
        k = 1.0 if self.directed else 2.0
        return c.withColumn("density", F.try_divide(k * F.col("edge_count"), F.col("node_count") * (F.col("node_count") - 1)))

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree, degree) for every node; 0 for those without edges."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1)))
        d = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return self.nodes.select("id").join(d, "id", "left").select("id", z("o").alias("out_degree"), z("i").alias("in_degree"), (z("o") + z("i")).alias("degree"))

    def neighbors(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, neighbor): where the node's edges lead."""
        a = self.arcs().select(F.col("src").alias("id"), F.col("dst").alias("neighbor")).distinct()
        return a if ids is None else a.join(ids.select("id"), "id", "left_semi")

    def predecessors(self, ids: DataFrame | None = None) -> DataFrame:
        a = self.arcs().select(F.col("dst").alias("id"), F.col("src").alias("neighbor")).distinct()
        return a if ids is None else a.join(ids.select("id"), "id", "left_semi")

    # -- distances and paths ------------------------------------------------------
    def _relax(self, start: DataFrame, arcs: DataFrame, rounds: int | None = None) -> DataFrame:
        """Least (dist, hops) per (root, id) from start (root, id, dist, parent), by rounds over changed nodes.

        A parent has one hop less than its child, so parents form no cycle where weights are 0.
        """
        arcs = cut(arcs.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
        best = cut(start.select("root", "id", F.struct("dist", F.lit(0).alias("hops")).alias("b")))
        front, k = best, 0
        while (rounds is None or k < rounds) and not front.isEmpty():
            step = front.join(arcs, front["id"] == arcs["src"]).select("root", F.col("dst").alias("id"), F.struct((F.col("b.dist") + F.col("weight")).alias("dist"), (F.col("b.hops") + 1).alias("hops")).alias("c"))
            step = step.groupBy("root", "id").agg(F.min("c").alias("c"))
            both = best.join(step, ["root", "id"], "full_outer").withColumn("better", F.coalesce(F.col("b").isNull() | (F.col("c") < F.col("b")), F.lit(False)))
            both = cut(both.select("root", "id", F.when(F.col("better"), F.col("c")).otherwise(F.col("b")).alias("b"), "better"))
            best, front = both.select("root", "id", "b"), both.filter("better").select("root", "id", "b")
            k += 1
        # The least parent among those on a shortest path of fewest hops, whatever the order of the rounds.
        d = best.select("root", "id", "b.dist", "b.hops")
        via = d.select("root", F.col("id").alias("src"), F.col("dist").alias("d0"), (F.col("hops") + 1).alias("hops")).join(arcs, "src").select("root", "src", F.col("dst").alias("id"), (F.col("d0") + F.col("weight")).alias("dist"), "hops")
        parents = via.join(d, ["root", "id", "dist", "hops"]).groupBy("root", "id").agg(F.min("src").alias("parent"))
        return cut(d.join(parents, ["root", "id"], "left").select("root", "id", "dist", "parent"))

    def _roots(self, ids: DataFrame) -> DataFrame:
        return ids.select(F.col("id").alias("root"), "id", F.lit(0.0).alias("dist"), F.lit(None).cast(dict(ids.dtypes)["id"]).alias("parent"))

    def dijkstra(self, source) -> DataFrame:
        """(id, dist) of the nodes that can be reached; weights must not be negative."""
        start = self.nodes.filter(F.col("id") == source).select("id")
        return self._relax(self._roots(start), self.arcs()).select("id", "dist")

    def bfs(self, source) -> DataFrame:
        """(id, parent, hops); the least parent where there are several."""
        start = self.nodes.filter(F.col("id") == source).select("id")
        out = self._relax(self._roots(start), self.arcs().withColumn("weight", F.lit(1.0)))
        return out.select("id", "parent", F.col("dist").cast("long").alias("hops"))

    def shortest_path(self, source, target, weight: Column | None = None) -> list:
        """Nodes from source to target (empty if there is no way); ``weight`` may be computed from edge columns."""
        g = self if weight is None else Graph(self.nodes, self.edges.withColumn("weight", weight.cast("double")), self.directed)
        start = g.nodes.filter(F.col("id") == source).select("id")
        tree = g._relax(self._roots(start), g.arcs()).select("id", "parent")
        path, at = [], target
        while at is not None:
            row = tree.filter(F.col("id") == at).first()
            if row is None:
                return []
            path.append(at)
            at = row["parent"]
        return path[::-1]

    def all_distances(self, hops: bool = False, sources: DataFrame | None = None) -> DataFrame:
        """(src, dst, dist) from every source (all nodes by default) to what it reaches."""
        if sources is None:
            self._small("all-pairs distances")
        arcs = self.arcs().withColumn("weight", F.lit(1.0)) if hops else self.arcs()
        ids = self.nodes.select("id") if sources is None else sources.select("id")
        return self._relax(self._roots(ids), arcs).select(F.col("root").alias("src"), F.col("id").alias("dst"), "dist")

    def floyd_warshall(self) -> DataFrame:
        return self.all_distances()

    def diameter(self) -> DataFrame:
        """One row: the longest shortest path in hops."""
        return self.all_distances(hops=True).agg(F.max("dist").cast("long").alias("diameter"))

    # -- order, cycles, components ----------------------------------------------------
    def _peel(self) -> tuple[DataFrame, DataFrame]:
        """Kahn's algorithm by levels: (id, level) of what can be ordered, and the ids left on cycles."""
        left, edges, level = cut(self.nodes.select("id").distinct()), cut(self.edges.select("src", "dst").distinct()), 0
        done = None
        while True:
            free = cut(left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"))
            if free.isEmpty():
                return done, left
            now = free.withColumn("level", F.lit(level).cast("long"))
            done = now if done is None else cut(done.union(now))
            left = cut(left.join(free, "id", "left_anti"))
            edges = cut(edges.join(free.withColumnRenamed("id", "src"), "src", "left_anti"))
            level += 1

    def topological_sort(self) -> DataFrame:
        """(id, level, position): by level, then id; raises on a cycle."""
        done, left = self._peel()
        if not left.isEmpty():
            raise ValueError("the graph has a cycle")
        from .batch import numbered

        return numbered(done, ["level", "id"], (), "position")

    def has_cycle(self) -> bool:
        if self.directed:
            return not self._peel()[1].isEmpty()
        pairs = self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        m, n = pairs.count(), self.nodes.count()
        return m >= n - self.components().select("component").distinct().count() + 1

    def components(self) -> DataFrame:
        """(id, component): weak components named by their least node."""
        found = _components(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        return self.nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))

    def strong_components(self) -> DataFrame:
        """(id, component): strong components named by their least node, by forward-backward colouring.

        Every round each node takes the largest node that reaches it as colour; a
        colour's root and what reaches back to it inside the colour is a component.
        """
        left, edges, done = cut(self.nodes.select("id").distinct()), cut(self.edges.select("src", "dst").filter("src <> dst").distinct()), None
        while not left.isEmpty():
            colour = self._spread(left.select("id", F.col("id").alias("c")), edges, F.max)
            inner = cut(edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").filter("c1 = c2").select("src", "dst"))
            back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            roots = colour.withColumn("on", (F.col("id") == F.col("c")).cast("int"))
            hit = self._spread(roots.select("id", F.col("on").alias("c")), back, F.max).filter("c = 1").select("id")
            found = colour.join(hit, "id").select("id", "c")
            names = found.groupBy("c").agg(F.min("id").alias("component"))
            found = cut(found.join(names, "c").select("id", "component"))
            done = found if done is None else cut(done.union(found))
            left = cut(left.join(found, "id", "left_anti"))
            for end in ("src", "dst"):
                edges = edges.join(left.withColumnRenamed("id", end), end, "left_semi")
            edges = cut(edges.select("src", "dst"))
        return done

    @staticmethod
    def _spread(labels: DataFrame, edges: DataFrame, pick) -> DataFrame:
        """Let (id, c) flow along edges, keeping the picked one, until nothing changes."""
        labels = cut(labels)
        while True:
            come = edges.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "c")
            new = cut(labels.union(come).groupBy("id").agg(pick("c").alias("c")))
            if new.join(labels, ["id", "c"], "left_anti").isEmpty():
                return new
            labels = new

    # -- spanning trees ------------------------------------------------------------
    def minimum_spanning_forest(self) -> DataFrame:
        """(src, dst, weight) by Boruvka rounds, ties by (weight, src, dst)."""
        e = self.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").filter("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
        e = cut(e.withColumns({"a": F.col("src"), "b": F.col("dst")}))
        tree = None
        while not e.isEmpty():
            ends = e.select(F.col("a").alias("n"), F.struct("weight", "src", "dst", "a", "b").alias("e")).union(e.select("b", F.struct("weight", "src", "dst", "a", "b")))
            best = cut(ends.groupBy("n").agg(F.min("e").alias("e")).select("e.*").distinct())
            chosen = best.select("src", "dst", "weight")
            tree = chosen if tree is None else cut(tree.union(chosen))
            names = _components(best.select("a", "b"))
            for end in ("a", "b"):
                names_ = names.select(F.col("node").alias(end), F.col("root").alias("_r"))
                e = e.join(names_, end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
            e = cut(e.filter("a <> b").select("src", "dst", "weight", "a", "b"))
        return tree if tree is not None else e.select("src", "dst", "weight")

    def kruskal_mst(self) -> DataFrame:
        return self.minimum_spanning_forest()

    def prim_mst(self, start) -> DataFrame:
        """The tree of the component that holds ``start``."""
        ours = self.components()
        name = ours.filter(F.col("id") == start).select("component")
        members = ours.join(name, "component", "left_semi").select(F.col("id").alias("src"))
        return self.minimum_spanning_forest().join(members, "src", "left_semi").select("src", "dst", "weight")

    # -- local structure -----------------------------------------------------------
    def clustering(self) -> DataFrame:
        """(id, triangles, coefficient) of the undirected simple graph; 0 below two neighbours."""
        pairs = self.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
        deg = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").count().withColumnRenamed("count", "k")
        # Edges point from the smaller degree to the larger, so no node's list of out-edges is long.
        d1, d2 = deg.select(F.col("id").alias("a"), F.col("k").alias("ka")), deg.select(F.col("id").alias("b"), F.col("k").alias("kb"))
        up = pairs.join(d1, "a").join(d2, "b")
        low = F.struct("ka", "a") < F.struct(F.col("kb").alias("ka"), F.col("b").alias("a"))
        up = cut(up.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")))
        xy, xz = up.alias("p"), up.select("x", F.col("y").alias("z")).alias("q")
        wedges = xy.join(xz, "x").filter("y < z")
        close = up.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
        tri = wedges.join(close, ["y", "z"]).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").count().withColumnRenamed("count", "t")
        out = self.nodes.select("id").join(deg, "id", "left").join(tri, "id", "left")
        t, k = F.coalesce("t", F.lit(0)), F.coalesce("k", F.lit(0))
        return out.select("id", t.cast("long").alias("triangles"), F.coalesce(F.try_divide(2.0 * t, k * (k - 1)), F.lit(0.0)).alias("coefficient"))

    def average_clustering(self) -> DataFrame:
        return self.clustering().agg(F.avg("coefficient").alias("average_clustering"))

    # -- centrality ------------------------------------------------------------------
    def pagerank(self, damping: float = 0.85, iterations: int = 100, tolerance: float = 0.0) -> DataFrame:
        """(id, rank), summing to 1; weights are ignored, the rank of nodes without out-edges is spread evenly."""
        n = self.nodes.count()
        arcs = self.arcs().select("src", "dst")
        out = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
        arcs = cut(arcs.join(out, "src"))
        ranks = cut(self.nodes.select("id", F.lit(1.0 / max(1, n)).alias("rank")))
        for i in range(iterations):
            given = arcs.join(ranks.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
            held = given.agg(F.sum("got")).first()[0] or 0.0
            base = (1.0 - damping) / n + damping * (1.0 - held) / n if n else 0.0
            new = self.nodes.select("id").join(given.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
            new = cut(new)
            if tolerance and (new.withColumnRenamed("rank", "r2").join(ranks, "id").agg(F.sum(F.abs(F.col("r2") - F.col("rank")))).first()[0] or 0.0) < tolerance:
                return new
            ranks = new
        return ranks

    def eigenvector_centrality(self, iterations: int = 100, tolerance: float = 1e-9) -> DataFrame:
        """(id, centrality) of Euclidean length 1, by power iteration on A + I (which has the same leading vector)."""
        arcs = cut(self.arcs().select("src", "dst", "weight"))
        x = cut(self.nodes.select("id", F.lit(1.0).alias("x")))
        for _ in range(iterations):
            come = arcs.join(x.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("x") * F.col("weight")).alias("x"))
            new = cut(x.union(come).groupBy("id").agg(F.sum("x").alias("x")))
            length = new.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
            new = cut(new.select("id", (F.col("x") / length).alias("x")))
            moved = new.withColumnRenamed("x", "y").join(x, "id").agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] or 0.0
            x = new
            if moved < tolerance:
                break
        return x.withColumnRenamed("x", "centrality")

    def closeness_centrality(self) -> DataFrame:
        """(id, closeness): (reached - 1) / sum of distances; 0 where nothing is reached."""
        d = self.all_distances().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("s"))
        return d.select("id", F.coalesce(F.try_divide((F.col("n") - 1).cast("double"), F.col("s")), F.lit(0.0)).alias("closeness"))

    def betweenness_centrality(self) -> DataFrame:
        """(id, betweenness) by Brandes 2001, hops; sources are spread over tasks, each with the checked-small graph."""
        self._small("betweenness")
        spark = self.nodes.sparkSession
        ship_package(spark)
        adjacency: dict = {}
        for r in self._small_arcs("betweenness").collect():
            adjacency.setdefault(r["src"], []).append(r["dst"])
        shared = spark.sparkContext.broadcast(adjacency)  # no more than SMALL nodes and SMALL_ARCS arcs, as checked
        kind = dict(self.nodes.dtypes)["id"]
        half = 1.0 if self.directed else 0.5

        def run(frames):
            for frame in frames:
                total: dict = {}
                for s in frame["id"].tolist():
                    for k, v in _brandes(shared.value, s).items():
                        total[k] = total.get(k, 0.0) + v
                yield pd.DataFrame({"id": pd.Series(list(total)), "b": pd.Series(list(total.values()), dtype=float)})

        part = self.nodes.select("id").repartition("id").mapInPandas(run, f"id {kind}, b double").groupBy("id").agg(F.sum("b").alias("b"))
        return self.nodes.select("id").join(part, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * half).alias("betweenness"))

    def communities(self, rounds: int = 20) -> DataFrame:
        """(id, community) by synchronous label propagation; the most frequent label of the neighbours and oneself, ties to the least."""
        e = self.edges.select("src", "dst").filter("src <> dst")
        both = cut(e.union(e.select("dst", "src")).toDF("src", "dst").distinct())
        labels = cut(self.nodes.select("id", F.col("id").alias("label")))
        for _ in range(rounds):
            votes = both.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label").union(labels)
            tally = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
            new = cut(tally.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("id", F.col("best.label").alias("label")))
            if new.join(labels, ["id", "label"], "left_anti").isEmpty():
                break
            labels = new
        return labels.withColumnRenamed("label", "community")

    # -- whole small graphs ------------------------------------------------------------
    def _small(self, what: str) -> int:
        n = self.nodes.count()
        if n > SMALL:
            raise ValueError(f"{what}: {n} nodes, {SMALL} at most")
        return n

    def _small_arcs(self, what: str) -> DataFrame:
        arcs = cut(self.arcs().select("src", "dst").distinct())
        m = arcs.count()
        if m > SMALL_ARCS:
            raise ValueError(f"{what}: {m} arcs, {SMALL_ARCS} at most")
        return arcs

    def _local(self) -> tuple[list, dict]:
        ids = sorted(r["id"] for r in self.nodes.select("id").collect())
        adjacency: dict = {i: [] for i in ids}
        for r in self._small_arcs("a whole graph").collect():
            adjacency[r["src"]].append(r["dst"])
        return ids, {k: sorted(v) for k, v in adjacency.items()}

    def dfs(self, source) -> DataFrame:
        """(id, parent, position) of a depth-first search that takes neighbours by id."""
        self._small("depth-first search")
        _, adjacency = self._local()
        seen, order, stack = set(), [], [(source, None)]
        while stack:
            node, parent = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            order.append((node, parent, len(order)))
            stack += [(x, node) for x in reversed(adjacency.get(node, [])) if x not in seen]
        kind = dict(self.nodes.dtypes)["id"]
        return self.nodes.sparkSession.createDataFrame(order if source in adjacency else [], f"id {kind}, parent {kind}, position long")

    def is_isomorphic(self, other: Graph) -> bool:
        """Equal after renaming nodes: refined colours first, then backtracking within equal colours."""
        self._small("isomorphism")
        other._small("isomorphism")
        return _isomorphic(self._local()[1], other._local()[1])

    # -- layouts --------------------------------------------------------------------
    def layout_circular(self) -> DataFrame:
        n = self._small("layout")
        from pyspark.sql import Window

        angle = (F.row_number().over(Window.orderBy("id")) - 1) * (2 * np.pi / max(1, n))
        return self.nodes.select("id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))

    def layout_hierarchical(self, root) -> DataFrame:
        """y = -hops from the root, x = place within the level."""
        from pyspark.sql import Window

        self._small("layout")
        return self.bfs(root).select("id", (F.row_number().over(Window.partitionBy("hops").orderBy("id")) - 1).cast("double").alias("x"), (-F.col("hops")).cast("double").alias("y"))

    def layout_spectral(self) -> DataFrame:
        """The second and third eigenvectors of the Laplacian."""
        self._small("layout")
        ids, adjacency = self._local()
        at = {x: i for i, x in enumerate(ids)}
        a = np.zeros((len(ids), len(ids)))
        for s, ds in adjacency.items():
            for d in ds:
                a[at[s], at[d]] = a[at[d], at[s]] = 1.0
        _, v = np.linalg.eigh(np.diag(a.sum(1)) - a)
        pick = lambda k: v[:, min(k, len(ids) - 1)]
        return self._placed(ids, np.column_stack([pick(1), pick(2)]))

    def layout_force(self, iterations: int = 100, seed: int = 0) -> DataFrame:
        """Spring layout (Fruchterman-Reingold) in the unit square."""
        n = self._small("layout")
        ids, adjacency = self._local()
        at = {x: i for i, x in enumerate(ids)}
        p = np.random.default_rng(seed).random((n, 2))
        k, heat = (1.0 / max(1, n)) ** 0.5, 0.1
        ends = np.array([(at[s], at[d]) for s, ds in adjacency.items() for d in ds if s != d]).reshape(-1, 2)
        for _ in range(iterations):
            gap = p[:, None] - p[None]
            far = np.maximum(np.linalg.norm(gap, axis=2), 1e-3)
            move = (gap / far[..., None] * (k * k / far)[..., None]).sum(1)
            if len(ends):
                d = p[ends[:, 0]] - p[ends[:, 1]]
                pull = d * (np.linalg.norm(d, axis=1, keepdims=True) / k)
                np.add.at(move, ends[:, 0], -pull)
                np.add.at(move, ends[:, 1], pull)
            size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
            p += move / size * np.minimum(size, heat)
            heat *= 0.97
        return self._placed(ids, p)

    def _placed(self, ids: list, xy: np.ndarray) -> DataFrame:
        kind = dict(self.nodes.dtypes)["id"]
        return self.nodes.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, xy)], f"id {kind}, x double, y double")

    # -- text formats -----------------------------------------------------------------
    def to_lines(self, format: str) -> DataFrame:
        """(section, line): the graph as DOT, GML, GraphML or Cytoscape JSON elements, one line per element."""
        n, e = self.nodes.select("id"), self.edges.select("src", "dst", "weight")
        s = lambda c: F.col(c).cast("string")
        arrow = " -> " if self.directed else " -- "
        made = {
            "dot": (F.concat(F.lit('  "'), s("id"), F.lit('";')), F.concat(F.lit('  "'), s("src"), F.lit(f'"{arrow}"'), s("dst"), F.lit('" [weight='), s("weight"), F.lit("];")), "digraph {" if self.directed else "graph {", "}"),
            "gml": (F.concat(F.lit("  node [ id "), s("id"), F.lit(" ]")), F.concat(F.lit("  edge [ source "), s("src"), F.lit(" target "), s("dst"), F.lit(" weight "), s("weight"), F.lit(" ]")), f"graph [ directed {int(self.directed)}", "]"),
            "graphml": (
                F.concat(F.lit('<node id="'), s("id"), F.lit('"/>')),
                F.concat(F.lit('<edge source="'), s("src"), F.lit('" target="'), s("dst"), F.lit('"><data key="weight">'), s("weight"), F.lit("</data></edge>")),
                f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="{"" if self.directed else "un"}directed">',
                "</graph></graphml>",
            ),
            "cytoscape": (
                F.to_json(F.struct(F.struct(s("id").alias("id")).alias("data"))),
                F.to_json(F.struct(F.struct(s("src").alias("source"), s("dst").alias("target"), "weight").alias("data"))),
                "[", "]",
            ),
        }[format]
        spark = n.sparkSession
        edge = spark.createDataFrame([(0, made[2]), (3, made[3])], "section int, line string")
        return edge.union(n.select(F.lit(1), made[0])).union(e.select(F.lit(2), made[1]))

    def to_text(self, format: str) -> str:
        """The whole text of a small graph."""
        self._small("text")
        rows = sorted(tuple(r) for r in self.to_lines(format).collect())
        lines = [x for _, x in rows]
        if format == "cytoscape":
            return "[" + ",\n".join(lines[1:-1]) + "]"
        return "\n".join(lines)


def _brandes(adjacency: dict, source) -> dict:
    """What one source adds to the betweenness of every node (Brandes 2001)."""
    order, before, paths, dist, queue = [], {}, {source: 1.0}, {source: 0}, [source]
    for v in queue:
        order.append(v)
        for x in adjacency.get(v, ()):
            if x not in dist:
                dist[x] = dist[v] + 1
                queue.append(x)
            if dist[x] == dist[v] + 1:
                paths[x] = paths.get(x, 0.0) + paths[v]
                before.setdefault(x, []).append(v)
    share: dict = {}
    for x in reversed(order):
        for v in before.get(x, ()):
            share[v] = share.get(v, 0.0) + paths[v] / paths[x] * (1.0 + share.get(x, 0.0))
    share.pop(source, None)
    return share


def _isomorphic(a: dict, b: dict) -> bool:
    def colours(g: dict) -> dict:
        back: dict = {k: [] for k in g}
        for k, vs in g.items():
            for v in vs:
                back[v].append(k)
        c = {k: hash((len(g[k]), len(back[k]), k in g[k])) for k in g}
        for _ in range(len(g)):
            new = {k: hash((c[k], tuple(sorted(c[v] for v in g[k])), tuple(sorted(c[v] for v in back[k])))) for k in g}
            if len(set(new.values())) == len(set(c.values())):
                return new
            c = new
        return c

    ca, cb = colours(a), colours(b)
    if sorted(ca.values()) != sorted(cb.values()):
        return False
    sets = {k: set(v) for k, v in b.items()}
    of: dict = {}
    for k, c in cb.items():
        of.setdefault(c, []).append(k)
    order = sorted(a, key=lambda k: (len(of[ca[k]]), k))

    def extend(i: int, to: dict, used: set) -> bool:
        if i == len(order):
            return True
        x = order[i]
        for y in of[ca[x]]:
            if y not in used and all((z in a[x]) == (to[z] in sets[y]) and (x in a[z]) == (y in sets[to[z]]) for z in order[:i]):
                to[x] = y
                if extend(i + 1, to, used | {y}):
                    return True
                del to[x]
        return False

    return extend(0, {}, set())


# -- generators ---------------------------------------------------------------------


def _graph(spark: SparkSession, n: int, edges: DataFrame, directed: bool = False) -> Graph:
    return Graph(spark.range(n), edges.select("src", "dst"), directed)


def complete(spark: SparkSession, n: int) -> Graph:
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("dst")).filter(f"dst < {n}")
    return _graph(spark, n, e)


def path(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def cycle(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")))


def star(spark: SparkSession, n: int) -> Graph:
    """Node 0 in the middle of n - 1 others."""
    return _graph(spark, n, spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))


def wheel(spark: SparkSession, n: int) -> Graph:
    rim = spark.range(1, n).select(F.col("id").alias("src"), F.when(F.col("id") == n - 1, F.lit(1)).otherwise(F.col("id") + 1).alias("dst"))
    return _graph(spark, n, star(spark, n).edges.select("src", "dst").union(rim))


def grid(spark: SparkSession, rows: int, cols: int) -> Graph:
    ids = spark.range(rows * cols)
    right = ids.filter(f"id % {cols} < {cols - 1}").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = ids.filter(f"id < {(rows - 1) * cols}").select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return _graph(spark, rows * cols, right.union(down))


def hypercube(spark: SparkSession, d: int) -> Graph:
    bits = F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("b")
    e = spark.range(1 << d).select(F.col("id").alias("src"), bits).withColumn("dst", F.expr("src ^ shiftleft(1L, b)")).filter("src < dst")
    return _graph(spark, 1 << d, e)


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Each pair with probability p, decided by a hash of the pair and the seed."""
    e = complete(spark, n).edges.select("src", "dst").filter(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1_000_000)) < int(p * 1_000_000))
    return _graph(spark, n, e)


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """Preferential attachment; sequential, so it is drawn on the driver for SMALL nodes at most."""
    if n > SMALL:
        raise ValueError(f"{SMALL} nodes at most")
    r = np.random.default_rng(seed)
    ends, edges = list(range(m)), []
    for v in range(m, n):
        to: list = []
        while len(to) < m:
            x = int(ends[r.integers(len(ends))])
            if x not in to:
                to.append(x)
        edges += [(v, x) for x in to]
        ends += to + [v] * m
    return _graph(spark, n, spark.createDataFrame(edges, "src long, dst long"))


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 0) -> Graph:
    """A ring of k nearest neighbours whose edges are rewired with probability p; drawn on the driver."""
    if n > SMALL:
        raise ValueError(f"{SMALL} nodes at most")
    r = np.random.default_rng(seed)
    edges = {(min(a, b), max(a, b)) for a in range(n) for j in range(1, k // 2 + 1) for b in [(a + j) % n] if a != b}
    for e in sorted(edges):
        if r.random() < p:
            free = [x for x in range(n) if x != e[0] and (min(e[0], x), max(e[0], x)) not in edges]
            if free:
                x = int(free[r.integers(len(free))])
                edges.remove(e)
                edges.add((min(e[0], x), max(e[0], x)))
    return _graph(spark, n, spark.createDataFrame([(int(a), int(b)) for a, b in sorted(edges)], "src long, dst long"))
