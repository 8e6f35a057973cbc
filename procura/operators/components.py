"""Connected components of an undirected graph given as an edge table.

Alternating star contraction: each round rewires every node to the smallest
node that it knows of, until nothing changes. Rounds grow with the logarithm
of the longest path. Only two numbers a round reach the driver. Texts are numbered
in their order first, so that the rounds move two numbers an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procura.operators.numbering import numbered
from procura.workspace import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b) -> every neighbour above a node points to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b) -> the smaller neighbours of a node, and the node, point to the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rewired = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rewired.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1))).alias("s")
    ).first()
    return row["n"], row["s"] or 0


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    Nodes without an edge are not listed. Self loops, repeated and reversed
    edges and edges with a null end are allowed; the latter are ignored. An
    empty edge table gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    plain = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    if dict(plain.dtypes)["a"] != "string":
        return _settled(materialise(plain, "edges"), max_rounds)
    plain = materialise(plain, "named-edges")
    names = materialise(numbered(plain.select(F.col("a").alias("name")).union(plain.select("b")).distinct(), [F.col("name")], "place"), "edge-names")
    for side in ("a", "b"):
        plain = plain.join(names.select(F.col("name").alias(side), F.col("place").alias(f"n{side}")), side)
    found = _settled(materialise(plain.select(F.col("na").alias("a"), F.col("nb").alias("b")), "edges"), max_rounds)
    for column in ("node", "component"):
        found = found.join(names.select(F.col("name").alias(f"{column}_name"), F.col("place").alias(column)), column)
    return found.select(F.col("node_name").alias("node"), F.col("component_name").alias("component"))


def _settled(current: DataFrame, max_rounds: int) -> DataFrame:
    """``connected_components`` of written edges (a > b), each once."""
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        current = materialise(_small_star(_large_star(current)), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def shared_sizes(rows: DataFrame, node: str, shared: str) -> DataFrame:
    """(component, n_nodes) of the graph that links each node with what it shares: how many nodes of both kinds a component has.

    What is shared goes through one shuffle, after which its least node stands for it: the others are linked with
    that one, so only nodes that share something with others take part in the rounds. Rows without one of the two are ignored.
    """
    own = Window.partitionBy(shared).orderBy(node)
    known = rows.where(F.col(node).isNotNull() & F.col(shared).isNotNull()).select(node, shared)
    stars = known.select(F.col(node).alias("node"), F.first(node).over(own).alias("least"), (F.row_number().over(own) == 1).alias("stands"))
    stars = materialise(stars, "shared-stars", "zstd")
    found = connected_components(stars.where("node <> least"), "node", "least")
    counts = stars.groupBy("node").agg((1 + F.count_if("stands")).alias("n"))
    return counts.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.sum("n").alias("n_nodes"))
