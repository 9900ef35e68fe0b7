"""Filtering a library by attributes on a bitmap index.

For each value of each attribute the index has one bitmap of 32,768 ids a block.  Conditions are combined block by block by the
built-in bitmap aggregates, so that a filter reads the blocks of the values it names and no records.  A record has one value of each
attribute (null is a value like any other), so what a condition on an attribute leaves out is what its other values hold; NOT of
anything larger is taken inside.  Counts of all values among what was selected need one pass over the index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(rows: DataFrame, *attributes: str, id: str = "id") -> DataFrame:
    """attribute, value (as text), bucket, bits of rows with a unique number ``id``; rows without one are left out."""
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.explode(each).alias("x")).select("id", "x.*")
    at = long.select("attribute", "value", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("at"))
    return at.groupBy("attribute", "value", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


class Condition:
    """Conditions are combined by &, | and ~."""

    def __and__(self, other: Condition) -> Condition:
        return Both((self, other), True)

    def __or__(self, other: Condition) -> Condition:
        return Both((self, other), False)

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Among(Condition):
    """The attribute's value is one of ``values``; None is null."""

    attribute: str
    values: tuple

    def holds(self) -> Column:
        found = F.lit(False)
        for v in self.values:
            found = found | F.col("value").eqNullSafe(F.lit(None if v is None else str(v)))
        return found


@dataclass(frozen=True)
class Between(Condition):
    """The attribute's value, as a number, lies between ``low`` and ``high``."""

    attribute: str
    low: float
    high: float

    def holds(self) -> Column:
        return F.coalesce(F.expr("try_cast(value AS DOUBLE)").between(self.low, self.high), F.lit(False))


@dataclass(frozen=True)
class Not(Condition):
    of: Condition


@dataclass(frozen=True)
class Both(Condition):
    parts: tuple[Condition, ...]
    all: bool


def select(index: DataFrame, where: Condition) -> DataFrame:
    """bucket and bits of the ids that fulfil a condition."""
    if isinstance(where, Not):
        inner = where.of
        if isinstance(inner, Not):
            return select(index, inner.of)
        if isinstance(inner, Both):
            return select(index, Both(tuple(Not(p) for p in inner.parts), not inner.all))
        return _blocks(index, inner, False)
    if isinstance(where, Both):
        parts = reduce(DataFrame.unionByName, [select(index, p) for p in where.parts])
        if not where.all:
            return parts.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        met = parts.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        return met.where((F.col("n") == len(where.parts)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")
    return _blocks(index, where, True)


def _blocks(index: DataFrame, where: Among | Between, wanted: bool) -> DataFrame:
    rows = index.where((F.col("attribute") == where.attribute) & (where.holds() == F.lit(wanted)))
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """attribute, value and n of every value among the ``chosen`` ids (bucket, bits); values that none has are absent."""
    pairs = index.join(chosen.withColumnRenamed("bits", "others"), "bucket")
    both = pairs.select("attribute", "value", "bucket", F.explode(F.array("bits", "others")).alias("bits"))
    met = both.groupBy("attribute", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return met.groupBy("attribute", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")


def ids(chosen: DataFrame) -> DataFrame:
    """The ids that blocks stand for."""
    octets = chosen.select("bucket", F.posexplode(F.expr("regexp_extract_all(hex(bits), '(..)', 1)")).alias("place", "octet")).where("octet <> '00'")
    bits = octets.select("bucket", "place", F.conv("octet", 16, 10).cast("int").alias("octet"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    first = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1).otherwise(F.col("bucket") * 32768)
    step = F.col("place") * 8 + F.col("bit")
    return bits.where(F.expr("shiftright(octet, bit) & 1 = 1")).select(F.when(F.col("bucket") > 0, first + step).otherwise(first - step).alias("id"))
