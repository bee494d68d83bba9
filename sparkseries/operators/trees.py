"""Trees (parent, child) and property graphs (labelled nodes, typed edges, property maps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .batch import numbered


class Tree:
    """A rooted tree as edges (parent, child)."""

    def __init__(self, edges: DataFrame, root=None):
        self.edges, self._root = edges.select("parent", "child"), root

    def root(self):
        """The given root, or the least parent that is no child."""
        if self._root is None:
            kids = self.edges.select(F.col("child").alias("parent"))
            self._root = self.edges.select("parent").join(kids, "parent", "left_anti").agg(F.min("parent")).first()[0]
        return self._root

    def set_root(self, root) -> Tree:
        return Tree(self.edges, root)

    def parent(self, node) -> DataFrame:
        return self.edges.filter(F.col("child") == node).select("parent")

    def children(self, node) -> DataFrame:
        return self.edges.filter(F.col("parent") == node).select("child")

    def levels(self) -> DataFrame:
        """(node, depth, path): depth 0 at the root; path holds the nodes from the root on."""
        kids = cut(self.edges)
        kind = dict(self.edges.dtypes)["child"]
        front = cut(self.edges.sparkSession.createDataFrame([(self.root(),)], f"node {kind}").select("node", F.lit(0).cast("long").alias("depth"), F.array("node").alias("path")))
        out = front
        while True:
            front = cut(front.join(kids, front["node"] == kids["parent"]).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("child")).alias("path")))
            if front.isEmpty():
                return out
            out = cut(out.union(front))

    def ancestors(self, node) -> DataFrame:
        """(node, distance) from the parent up to the root."""
        row = self.levels().filter(F.col("node") == node)
        up = row.select(F.posexplode(F.reverse("path")).alias("distance", "node"))
        return up.filter("distance > 0").select("node", F.col("distance").cast("long").alias("distance"))

    def descendants(self, node) -> DataFrame:
        """(node, distance) of all below."""
        at = F.array_position("path", F.lit(node))
        return self.levels().filter(at > 0).select("node", (F.size("path") - at).cast("long").alias("distance")).filter("distance > 0")

    def depth(self) -> DataFrame:
        return self.levels().select("node", "depth")

    def height(self) -> DataFrame:
        return self.levels().agg(F.max("depth").alias("height"))

    def leaves(self) -> DataFrame:
        return self.edges.select(F.col("child").alias("node")).join(self.edges.select(F.col("parent").alias("node")), "node", "left_anti").distinct()

    def traverse(self, how: str = "preorder") -> DataFrame:
        """(node, depth, position) in preorder, postorder, levelorder or inorder, from 0; children by id.

        Inorder has the first child's subtree before a node and those of the others behind it.
        Places are counted by ranges of the sort key, so no task holds the whole tree.
        """
        lv = self.levels()
        if how == "levelorder":
            order = ["depth", "path"]
        elif how == "preorder":
            order = ["path"]
        elif how == "postorder":  # an end mark that sorts after all children
            steps = F.transform("path", lambda x: F.struct(F.lit(0).alias("end"), x.alias("id")))
            last = F.struct(F.lit(1).alias("end"), F.col("node").alias("id"))
            lv, order = lv.withColumn("key", F.concat(steps, F.array(last))), ["key"]
        elif how == "inorder":  # 0 for the first child, 1 for the node itself, 2 and more for the other children
            rank = F.row_number().over(Window.partitionBy("parent").orderBy("child")) - 1
            side = self.edges.select(F.col("child").alias("step"), F.when(rank == 0, 0).otherwise(rank + 1).alias("side"))
            steps = lv.select("node", "depth", F.posexplode("path").alias("i", "step")).join(side, "step", "left")
            keys = F.array_sort(F.collect_list(F.when(F.col("side").isNotNull(), F.struct("i", "side"))))
            lv = steps.groupBy("node", "depth").agg(keys.alias("s")).withColumn("key", F.concat(F.transform("s", lambda x: x["side"]), F.array(F.lit(1))))
            order = ["key"]
        else:
            raise ValueError(how)
        return numbered(lv, order, (), "position").select("node", "depth", "position")


class PropertyGraph:
    """nodes (id, label, properties map<string,string>), edges (src, dst, type, properties map<string,string>)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def add_nodes(self, nodes: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.nodes.unionByName(nodes.join(self.nodes.select("id"), "id", "left_anti")), self.edges)

    def add_edges(self, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(self.nodes, self.edges.unionByName(edges))

    @staticmethod
    def _set(df: DataFrame, where, key: str, value: str) -> DataFrame:
        rest = F.map_filter("properties", lambda k, _: k != key)
        return df.withColumn("properties", F.when(where, F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col("properties")))

    def update_node_property(self, id_, key: str, value: str) -> PropertyGraph:
        return PropertyGraph(self._set(self.nodes, F.col("id") == id_, key, value), self.edges)

    def update_edge_property(self, src, dst, key: str, value: str) -> PropertyGraph:
        return PropertyGraph(self.nodes, self._set(self.edges, (F.col("src") == src) & (F.col("dst") == dst), key, value))

    @staticmethod
    def _query(df: DataFrame, criteria: dict[str, str]) -> DataFrame:
        for k, v in criteria.items():
            df = df.filter(F.try_element_at("properties", F.lit(k)) == v)
        return df

    def query_nodes(self, criteria: dict[str, str], label: str | None = None) -> DataFrame:
        return self._query(self.nodes if label is None else self.nodes.filter(F.col("label") == label), criteria)

    def query_edges(self, criteria: dict[str, str], type_: str | None = None) -> DataFrame:
        return self._query(self.edges if type_ is None else self.edges.filter(F.col("type") == type_), criteria)

    def match(self, steps: list[tuple[dict, str, dict]]) -> DataFrame:
        """Paths n0 -> n1 -> ...: each step is (node criteria, edge type, next node criteria); ``label`` is a criterion too.

        Columns n0, n1, ...; the filters go to each side before its join.
        """
        def nodes(criteria: dict, name: str) -> DataFrame:
            c = dict(criteria)
            return self.query_nodes(c, c.pop("label", None) if "label" in c else None).select(F.col("id").alias(name))

        out = None
        for i, (left, type_, right) in enumerate(steps):
            e = self.edges.filter(F.col("type") == type_).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
            e = e.join(nodes(right, f"n{i + 1}"), f"n{i + 1}", "left_semi")
            start = nodes(left, f"n{i}")
            e = e.join(start, f"n{i}", "left_semi")
            out = e if out is None else out.join(e, f"n{i}")
        return out.select(*[f"n{i}" for i in range(len(steps) + 1)])
