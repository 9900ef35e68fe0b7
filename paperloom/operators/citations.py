"""Walks over a citation graph: snowballing from seeds, and ranks by pushed changes.

Edges (src, dst) are dealt into chunks of a source's targets, so that a hub that a third of the edges leave is met in many tasks;
each round joins what is new with the chunks of its nodes only, and is written, so that a lost executor costs a reread.

Defined results: edges with a null end and edges from a node to itself don't count, repeated ones count once; seeds that no edge has
are found at level 0; a graph without edges gives the seeds alone, and no ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Targets of a source that are met in one go.
CHUNK = 10_000


def links(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends, as a table."""
    return materialize(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct(), "links")


def dealt(edges: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Edges with the chunk that each lies in, and src, degree and chunks of each source; both tables."""
    counts = materialize(edges.groupBy("src").agg(F.count("*").alias("degree")).withColumn("chunks", F.ceil(F.col("degree") / chunk).cast("int")), "degrees")
    return materialize(edges.join(counts, "src").select("src", F.pmod(F.xxhash64("dst"), "chunks").cast("int").alias("chunk"), "dst"), "dealt"), counts


def met(front: DataFrame, edges: DataFrame, counts: DataFrame, *columns: str) -> DataFrame:
    """dst and ``columns`` of the front's rows (node, …) for each edge that leaves them."""
    heads = front.join(counts, F.col("node") == F.col("src")).select("src", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), *columns)
    return heads.join(edges, ["src", "chunk"]).select("dst", *columns)


def snowball(edges: DataFrame, seeds: DataFrame, depth: int, forward: bool = True, backward: bool = True, chunk: int = CHUNK) -> DataFrame:
    """node, level and via of all that is reached from ``seeds`` (node) in ``depth`` steps at most, along edges (forward: what a node
    cites) and against them (backward: what cites it); ``via`` is the least node of the level before that leads there, null for seeds."""
    known = links(edges)
    ways = [dealt(known if ahead else known.select(F.col("dst").alias("src"), F.col("src").alias("dst")), chunk) for ahead, wanted in ((True, forward), (False, backward)) if wanted]
    front = materialize(seeds.where("node IS NOT NULL").select("node").distinct().select("node", F.lit(0).alias("level"), F.lit(None).cast("long").alias("via")), "visited")
    levels = [front]
    for level in range(1, depth + 1):
        found = None
        for way in ways:
            step = met(front.withColumn("from_", F.col("node")), *way, "from_")
            found = step if found is None else found.unionByName(step)
        if found is None:
            break
        new = found.groupBy(F.col("dst").alias("node")).agg(F.min("from_").alias("via"))
        for seen in levels:  # one table a level
            new = new.join(seen.select("node"), "node", "left_anti")
        front = materialize(new.select("node", F.lit(level).alias("level"), "via"), "visited")
        if front.isEmpty():
            break
        levels.append(front)
    for table in [known, *(t for way in ways for t in way)]:
        discard(table)
    out = levels[0]
    for table in levels[1:]:
        out = out.unionByName(table)
    return out


def rank(edges: DataFrame, damping: float = 0.85, least: float = 1e-9, chunk: int = CHUNK) -> DataFrame:
    """node and rank (PageRank) of each node of the edges; ranks sum to 1.

    Every node starts with a change of 1.  A round takes the changes over ``least`` into their nodes' weights and pushes them on, damped and
    shared among what the node cites; what hasn't changed isn't read.  What a node without citations would pass on would go to all
    nodes alike, which leaves the weights' proportions as they are: the ranks are the weights over their sum.
    """
    known = links(edges)
    ways = dealt(known, chunk)
    nodes = known.select(F.col("src").alias("node")).union(known.select("dst")).distinct()
    state = materialize(nodes.join(ways[1].select(F.col("src").alias("node"), "degree"), "node", "left").select("node", "degree", F.lit(0.0).alias("weight"), F.lit(1.0).alias("change")), "weights")
    while True:
        active = state.where(F.col("change") > least)
        if active.isEmpty():
            break
        share = (F.col("change") * damping / F.col("degree")).alias("share")
        came = met(active.where("degree IS NOT NULL").select("node", share), *ways, "share").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("came"))
        moves = F.col("change") > least
        new = state.join(came, "node", "left").select(
            "node", "degree", F.when(moves, F.col("weight") + F.col("change")).otherwise(F.col("weight")).alias("weight"), (F.when(moves, 0.0).otherwise(F.col("change")) + F.coalesce("came", F.lit(0.0))).alias("change")
        )
        new = materialize(new, "weights")
        discard(state)
        state = new
    whole = state.agg(F.sum(F.col("weight") + F.col("change"))).first()[0]
    for table in (known, *ways):
        discard(table)
    return state.select("node", ((F.col("weight") + F.col("change")) / F.lit(whole or 1.0)).alias("rank"))
