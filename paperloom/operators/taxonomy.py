"""Merging of the taxonomies of several surveys, and how many surveys have each element.

Level by level, labels under merged parents are merged where their words are alike, but never two that stand side by side in one survey.
Labels of equal words are one from the start.  Pairs come from an equi-join on the rarest words of both that any pair alike must
share one of.  Clusters grow around pivots in rounds: a label that comes before all labels near it (in an order of hashes, which
knows nothing of the rows' order) is a pivot; the others near a pivot follow the one most like them, of siblings the one most
like it; who can't follow stays for the next round.  Every round settles the first open label of each component at least.

Defined results: rows without a survey, and labels without words, are left out, and so is what stands under them; repeated rows count
once; a node's level is one more than its parent's; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from .terms import words_key

#: Least Dice similarity of two labels' words.
LEAST = 0.5


def alike(items: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b, sim of items (item, scope, words), both ways, of one scope whose words have a Dice similarity of ``least`` or more; exact.

    Sets of x and y words share c words with 2 c / (x + y) >= least only if c >= least / (2 - least) * x, so of the words in one order
    of rarity the first x - c + 1 of both have one in common.
    """
    each = items.select("item", "scope", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = each.groupBy("scope", "word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("item").orderBy("df", "word")
    share = least / (2 - least)
    first = each.join(counts, ["scope", "word"]).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).where("df > 1")
    one, two = (first.select("scope", "word", F.col("item").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    near = one.join(two, ["scope", "word"]).where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b") - 1e-9)).select("a", "b").distinct()
    words = lambda c: items.select(F.col("item").alias(c), F.col("words").alias(f"w_{c}"))
    rated = near.join(words("a"), "a").join(words("b"), "b").select("a", "b", (2 * F.size(F.array_intersect("w_a", "w_b")) / (F.size("w_a") + F.size("w_b"))).alias("sim")).where(F.col("sim") >= least - 1e-9)
    return rated.unionByName(rated.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def clusters(items: DataFrame, places: DataFrame, least: float = LEAST) -> DataFrame:
    """item and pivot of every item (item, scope, words); items that share one of their ``places`` (item, place) stay apart."""
    edges = materialize(alike(items, least), "taxonomy-edges")
    spots = materialize(places.select("item", "place").distinct(), "taxonomy-places")
    mine, theirs = spots.select(F.col("item").alias("a"), "place"), spots.select(F.col("item").alias("b"), "place")
    beside = edges.join(mine, "a").join(theirs, ["b", "place"]).select("a", "b").distinct()
    free = materialize(edges.join(beside, ["a", "b"], "left_anti"), "taxonomy-free")
    open_ = materialize(items.select("item", F.struct(F.xxhash64("item").alias("h"), F.col("item").alias("item")).alias("turn")), "taxonomy-open")
    found = None
    while not open_.isEmpty():
        near = free.join(open_.select(F.col("item").alias("a"), F.col("turn").alias("ta")), "a").join(open_.select(F.col("item").alias("b"), F.col("turn").alias("tb")), "b")
        near = materialize(near, "taxonomy-near")
        later = near.where("tb < ta").select(F.col("a").alias("item")).distinct()
        pivots = materialize(open_.join(later, "item", "left_anti").select("item"), "taxonomy-pivots")
        wish = near.join(pivots.select(F.col("item").alias("b")), "b", "left_semi").groupBy("a").agg(F.max_by(F.struct("b", "sim"), F.struct("sim", -F.col("tb.h"), "b")).alias("x"))
        wish = wish.select(F.col("a").alias("item"), F.col("x.b").alias("pivot"), F.col("x.sim").alias("sim"))
        # of those that stand side by side and want one pivot, the one most like it
        beside_ = wish.join(spots, "item").withColumn("n", F.row_number().over(Window.partitionBy("pivot", "place").orderBy(F.desc("sim"), F.xxhash64("item"), "item")))
        follow = wish.join(beside_.where("n > 1").select("item").distinct(), "item", "left_anti").select("item", "pivot")
        done = materialize(pivots.select("item", F.col("item").alias("pivot")).unionByName(follow), "taxonomy-done")
        found = done if found is None else found.unionByName(done)
        rest = materialize(open_.join(done, "item", "left_anti"), "taxonomy-open")
        for table in (near, pivots, open_):
            discard(table)
        open_ = rest
    for table in (edges, spots, free, open_):
        discard(table)
    return items.select("item", F.col("item").alias("pivot")).limit(0) if found is None else found


def merge(nodes: DataFrame, levels: int = 3, least: float = LEAST) -> DataFrame:
    """node, level and element, the merged label with its parents', of rows (survey, node, parent, label) down to ``levels`` levels.

    An element's name is its parents' names and its pivot's words, parted by slashes.
    """
    rows = materialize(nodes.where("survey IS NOT NULL AND node IS NOT NULL").select("survey", "node", "parent", words_key("label").alias("words")).where(F.size("words") > 0).distinct(), "taxonomy-rows")
    above, found = None, None
    for level in range(levels):
        if above is None:
            now = rows.where("parent IS NULL").select("survey", "node", F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"), "words", F.lit("").alias("scope"))
        else:
            now = rows.join(above.select(F.col("node").alias("parent"), F.col("element").alias("scope")), "parent").select("survey", "node", "parent", "words", "scope")
        now = materialize(now.withColumn("item", F.concat_ws("/", "scope", F.array_join("words", " "))), "taxonomy-level")
        if now.isEmpty():
            break
        items = materialize(now.groupBy("item").agg(F.first("scope").alias("scope"), F.first("words").alias("words")), "taxonomy-items")
        places = now.select("item", F.to_json(F.struct("survey", "parent")).alias("place"))
        merged = clusters(items, places, least)
        above = materialize(now.join(merged, "item").select("node", F.lit(level).alias("level"), F.col("pivot").alias("element")).distinct(), "taxonomy-merged")
        found = above if found is None else found.unionByName(above)
        discard(now)
        discard(items)
    return found if found is not None else rows.select("node", F.lit(0).alias("level"), F.lit("").alias("element")).limit(0)


def frequency(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """level, element, surveys (that have it) and nodes of every merged element."""
    rows = nodes.select("survey", "node").distinct().join(merged, "node")
    return rows.groupBy("level", "element").agg(F.count_distinct("survey").alias("surveys"), F.count_distinct("node").alias("nodes"))
