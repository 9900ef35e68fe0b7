"""Connected components and graph checks, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

# Relations that an edge may have.
EDGE_TYPES = ("is_subfield_of", "uses", "evaluated_by", "applied_to", "contrasts_with", "emerged_after", "part_of")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (a, b); a table in the shared folder.

    Alternates two steps that keep the components and never add edges: every node's larger neighbours are hung on the least
    node around it, then its smaller ones are.  Minima are combined before each shuffle, so hubs are no burden; each round is
    written to the shared folder, which ends its lineage.
    """
    graph = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _digest(graph)
    while True:
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = materialize(small.where("u <> v").distinct(), "edges")
        after = _digest(new)
        discard(graph)
        graph = new
        if after == before:
            break
        before = after
    found = graph.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(graph.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    roots = materialize(found, "roots")
    discard(graph)
    return roots


def _digest(graph: DataFrame) -> tuple:
    """Edges of a graph and a hash of their set: one row."""
    return tuple(graph.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with an id."""
    return nodes.where(F.trim("node_id") != "")


def valid_edges(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """Edges (topic, source_id, target_id, edge_type) of an allowed type whose ends are both nodes of the topic."""
    ids = valid_nodes(nodes).select("topic", "node_id").distinct()
    good = edges.where(F.col("edge_type").isin(*types))
    for end in ("source_id", "target_id"):
        good = good.join(ids.withColumnRenamed("node_id", end), ["topic", end], "left_semi")
    return good.select(*edges.columns)
