"""Edge tables: expansion, shortest paths and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage_observed, stage_table


def two_hop(edges: DataFrame) -> DataFrame:
    """(src, mid, dst) over edges (src, dst)."""
    a, b = edges.alias("a"), edges.alias("b")
    return a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("a.dst").alias("mid"), F.col("b.dst").alias("dst"))


#: Nodes of a frontier, or pairs, that may be sent to every task.
FEW = 500_000


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW else rows


class _Search:
    """Breadth first from many roots: rows (root, node, depth, prev), written level by level.

    ``prev`` is the least neighbour of the level before; paths are walked back along it, so no
    row holds more than one step, whatever the depth.
    """

    def __init__(self, edges: DataFrame, roots: DataFrame, name: str):
        self.edges, self.name, self.depth = edges, name, 0
        first = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["root"].dataType).alias("prev"))
        self._at(first.distinct(), f"{name}_0")
        self.reached = self.frontier

    def _at(self, rows: DataFrame, name: str) -> None:
        """``rows`` are the frontier; ``nodes`` (node, roots) its distinct nodes, with how many roots are at each."""
        self.frontier, seen = stage_observed(rows, name)
        self.size = seen["rows"]
        self.nodes, seen = stage_observed(self.frontier.groupBy("node").agg(F.count("*").alias("roots")), f"{name}_nodes")
        self.width = seen["rows"]

    def cut(self, live: DataFrame, n: int) -> None:
        """Go on from the ``n`` roots ``live`` alone."""
        self._at(self.frontier.join(_few(live, n), "root", "left_semi"), f"{self.name}_{self.depth}_live")

    def step(self) -> None:
        """One level on."""
        self.depth += 1
        from_ = self.frontier.select("root", F.col("node").alias("prev"))
        met = self.edges.join(_few(from_, self.size), self.edges["src"] == F.col("prev")).groupBy("root", F.col("dst").alias("node")).agg(F.min("prev").alias("prev"))
        new = met.join(self.reached.select("root", "node"), ["root", "node"], "left_anti")
        self._at(new.select("root", "node", F.lit(self.depth).alias("depth"), "prev"), f"{self.name}_{self.depth}")
        if self.size:
            self.reached = self.reached.unionByName(self.frontier)

    def back(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` (root, node, ...) with ``column``, the nodes from the root to each row's node."""
        rows = rows.withColumn(column, F.array("node")).withColumn("at", F.col("node"))
        for _ in range(self.depth):  # a row's nodes are no more than there were levels
            steps = self.reached.select("root", F.col("node").alias("at"), "prev")
            rows = rows.join(steps, ["root", "at"], "left").withColumn(column, F.when(F.col("prev").isNull(), F.col(column)).otherwise(F.concat(F.array("prev"), column))).withColumn("at", F.coalesce("prev", "at")).drop("prev")
        return rows.drop("at")


def distances(edges: DataFrame, source: DataFrame, hops: int) -> DataFrame:
    """(node, hops) of all nodes within ``hops`` edges (src, dst) of ``source`` (node), breadth first.
    Rounds are written down, and the frontier goes to the edges while it is small."""
    edges = stage_table(edges.select("src", "dst").distinct(), "edges")
    frontier, seen = stage_observed(source.select("node", F.lit(0).alias("hops")).where("node IS NOT NULL").distinct(), "hop_0")
    reached = frontier
    for i in range(1, hops + 1):
        if not seen["rows"]:
            break
        met = edges.join(_few(frontier.select(F.col("node").alias("src")), seen["rows"]), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier, seen = stage_observed(met.join(reached.select("node"), "node", "left_anti").select("node", F.lit(i).alias("hops")), f"hop_{i}")
        reached = reached.unionByName(frontier)
    return reached


def paths(edges: DataFrame, source: DataFrame, hops: int) -> DataFrame:
    """(node, hops, path) for all nodes within ``hops`` edges of ``source`` (node), breadth first.

    ``path`` is the least, by its nodes in order, of a node's shortest paths. What a round
    reaches is written down, so no plan holds more than one round.
    """
    frontier = stage_table(source.select("node", F.lit(0).alias("hops"), F.array("node").alias("path")).distinct(), "hop_0")
    reached = frontier
    for i in range(1, hops + 1):
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).join(reached.select("node"), "node", "left_anti")
        frontier = stage_table(step.select("node", F.lit(i).alias("hops"), "path"), f"hop_{i}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def between(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hops, path): one shortest path of up to ``hops`` edges for each pair (src, dst) of a table.

    The search goes forth from all sources and back from all targets at once, level by level,
    from the roots of pairs that have not met. Each round asks which pairs' last levels are
    joined by an edge, so the largest level, the last, is never made; then the side with
    fewer edges ahead goes on. Every pair's searches are whole levels, so the first edge is
    of the shortest way; of several the least is taken, and the path is walked from its ends
    along the least predecessors. Pairs that are not within reach, and those with a null, give
    no row; a pair that is twice there gives one. ``path`` is the array of its nodes; that of
    a node to itself is the node alone.
    """
    edges = stage_table(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "edges")
    all_ = stage_table(pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "pairs")
    same = all_.where("src = dst").select("src", "dst", F.lit(0).alias("hops"), F.array("src").alias("path"))
    open_, seen = stage_observed(all_.where("src <> dst"), "open")
    forth = _Search(edges, open_.select(F.col("src").alias("root")), "forth")
    back = _Search(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), open_.select(F.col("dst").alias("root")), "back")
    found = None
    while seen["rows"] and forth.depth + back.depth < hops and forth.size and back.size:
        met = stage_table(_joined(edges, forth, back, open_, seen["rows"]), "met")
        found = met if found is None else found.unionByName(met)
        open_, seen = stage_observed(open_.join(met, ["src", "dst"], "left_anti"), "open")
        if not seen["rows"] or forth.depth + back.depth + 1 >= hops:
            break
        for side, end in ((forth, "src"), (back, "dst")):
            side.cut(open_.select(F.col(end).alias("root")).distinct(), seen["rows"])
        ahead, behind = _ahead(edges, forth, back)
        (forth if ahead <= behind else back).step()
    if found is None:
        return same
    half = forth.back(found.select(F.col("src").alias("root"), "dst", "hops", F.col("u").alias("node"), "v"), "path").withColumnRenamed("root", "src")
    whole = back.back(half.select("src", "hops", "path", F.col("dst").alias("root"), F.col("v").alias("node")), "rest").withColumnRenamed("root", "dst")
    return whole.select("src", "dst", "hops", F.concat("path", F.reverse("rest")).alias("path")).unionByName(same)


def _joined(edges: DataFrame, forth: _Search, back: _Search, open_: DataFrame, n: int) -> DataFrame:
    """(src, dst, hops, u, v): of each of the ``n`` pairs ``open_`` whose frontiers an edge joins, the least such edge."""
    near = edges.join(_few(forth.nodes.select(F.col("node").alias("src")), forth.width), "src", "left_semi")
    near = near.join(_few(back.nodes.select(F.col("node").alias("dst")), back.width), "dst", "left_semi").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    wanted = open_.join(_few(back.frontier.select(F.col("root").alias("dst"), F.col("node").alias("v")), back.size), "dst")
    from_ = forth.frontier.select(F.col("root").alias("src"), F.col("node").alias("u"))
    met = near.join(_few(from_, forth.size), "u").join(_few(wanted, FEW + 1 if back.depth else n), ["src", "v"])  # a row a pair, at first
    met = met.groupBy("src", "dst").agg(F.min(F.struct("u", "v")).alias("m"))
    return met.select("src", "dst", F.lit(forth.depth + back.depth + 1).alias("hops"), "m.u", "m.v")


def _ahead(edges: DataFrame, forth: _Search, back: _Search) -> tuple[int, int]:
    """Edges that the next level of either side would follow; where frontiers are not few, their sizes."""
    if max(forth.width, back.width) > FEW:
        return forth.size, back.size
    a, b = forth.nodes.select(F.col("node").alias("src"), F.col("roots").alias("a")), back.nodes.select(F.col("node").alias("dst"), F.col("roots").alias("b"))
    sums = edges.join(F.broadcast(a), "src", "left").join(F.broadcast(b), "dst", "left").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return sums["a"] or 0, sums["b"] or 0


def hierarchy(categories: DataFrame) -> DataFrame:
    """(category, subcategory): every second-level row (parent_name, name) under its first-level row,
    whose parent is null; first-level rows without any have a null subcategory."""
    top, below = categories.where("parent_name IS NULL").alias("t"), categories.where("parent_name IS NOT NULL").alias("b")
    return top.join(below, F.col("t.name") == F.col("b.parent_name"), "left").select(F.col("t.name").alias("category"), F.col("b.name").alias("subcategory"))
