"""Frequent itemsets by vertical bitmaps.

An item's bitmap has one bit for each row that has it, in words of 64 rows (word, bits), so that rows are counted by machine
operations and a frequent item costs one row in 64.  Items that aren't frequent are gone before any are put together.  Pairs meet in
the words that both have; larger sets grow by the last item from sets with the same items before it, and a set is only counted if
all sets that lack one of its items are frequent.

Defined results: null ids and items don't count, a row counts once for an item however often it has it, and rows with one id are one
row; with no frequent item there is no set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def vertical(rows: DataFrame) -> DataFrame:
    """item, word, bits of rows (id, item)."""
    good = rows.where("id IS NOT NULL AND item IS NOT NULL")
    at = good.select("item", F.expr("CAST(floor(id / 64) AS BIGINT)").alias("word"), F.expr("shiftleft(1L, CAST(pmod(id, 64) AS INT))").alias("bit"))
    return at.groupBy("item", "word").agg(F.bit_or("bit").alias("bits"))


def frequent(rows: DataFrame, least: int, longest: int = 3) -> DataFrame:
    """items (sorted) and n, the rows that have them all, of every set of up to ``longest`` items that ``least`` rows or more have."""
    bits = materialize(vertical(rows), "item-bits")
    counted = lambda df, *by: df.groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("long").alias("n")).where(F.col("n") >= least)
    sets = materialize(counted(bits, F.array("item").alias("items")), "item-sets")
    found = [sets]
    own = materialize(bits.join(sets.select(F.col("items")[0].alias("item")), "item", "left_semi").select(F.array("item").alias("items"), "word", "bits"), "item-bits")
    discard(bits)
    single = own.select(F.col("items")[0].alias("last"), "word", F.col("bits").alias("others"))
    for size in range(2, longest + 1):
        if size == 2:
            both = own.join(single, "word").where((F.col("items")[0] < F.col("last")) & (F.col("bits").bitwiseAND(F.col("others")) != 0))
        else:
            both = own.join(_candidates(sets, size), "items").join(single, ["last", "word"]).where(F.col("bits").bitwiseAND(F.col("others")) != 0)
        grown = both.select(F.array_append("items", F.col("last")).alias("items"), "word", F.col("bits").bitwiseAND(F.col("others")).alias("bits"))
        sets = materialize(counted(grown, "items"), "item-sets")
        found.append(sets)
        if size == longest or sets.isEmpty():
            break
        own = materialize(grown.join(sets.select("items"), "items", "left_semi"), "item-bits")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _candidates(sets: DataFrame, size: int) -> DataFrame:
    """items and last of sets of ``size`` items all of whose parts are among ``sets``: those that end differently after the same beginning."""
    head = F.slice("items", 1, size - 2)
    one = sets.select("items", head.alias("head"))
    two = sets.select(head.alias("head"), F.element_at("items", -1).alias("last"))
    pairs = one.join(two, "head").where(F.element_at("items", -1) < F.col("last")).select("items", "last", F.array_append("items", F.col("last")).alias("whole"))
    for drop in range(1, size - 1):  # the parts without the last or the last but one are what it was made of
        part = F.concat(F.slice("whole", 1, drop - 1), F.slice("whole", drop + 1, size - drop))
        pairs = pairs.withColumn("part", part).join(sets.select(F.col("items").alias("part")), "part", "left_semi")
    return pairs.select("items", "last")


def associations(sets: DataFrame, rows: int) -> DataFrame:
    """a, b, n, lift and pmi (in bits) of the pairs among ``sets``, of ``rows`` rows in all."""
    one = lambda c: sets.where(F.size("items") == 1).select(F.col("items")[0].alias(c), F.col("n").alias(f"n_{c}"))
    pairs = sets.where(F.size("items") == 2).select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b"), "n")
    lift = F.col("n") * float(rows) / (F.col("n_a") * F.col("n_b"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
