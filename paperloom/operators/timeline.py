"""Topics over time: gap-filled series, bursts and change points.

A series has one number for each step between the first and the last of all, so its length is that of the time covered, whatever the
number of rows; rows are counted before anything is put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ratio of a burst's rate to the usual one, and cost of going up, in logarithms of the series' length.
RATIO, EFFORT = 2.0, 1.0


def series(rows: DataFrame, kind: str, at: str, unit: str = "hour") -> DataFrame:
    """kind, step (start of the unit) and n of every kind and step between the first and the last of all; null times and kinds don't count."""
    counted = rows.where(F.col(kind).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(kind).alias("kind"), F.date_trunc(unit, at).alias("step")).agg(F.count("*").alias("n"))
    steps = counted.agg(F.explode(F.sequence(F.min("step"), F.max("step"), F.expr(f"INTERVAL 1 {unit}"))).alias("step"))
    kinds = counted.select("kind").distinct()
    # one row a kind, whose steps are spread from an array: no product of two tables
    every = kinds.withColumn("one", F.lit(1)).join(F.broadcast(steps.agg(F.sort_array(F.collect_list("step")).alias("steps")).withColumn("one", F.lit(1))), "one").select("kind", F.explode("steps").alias("step"))
    return every.join(counted, ["kind", "step"], "left").select("kind", "step", F.coalesce("n", F.lit(0)).alias("n"))


def _arrays(filled: DataFrame) -> DataFrame:
    """kind, steps, and n and whole (of all kinds) as arrays in order."""
    whole = filled.withColumn("whole", F.sum("n").over(Window.partitionBy("step")))
    return whole.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("step", "n", "whole"))).alias("x"))


def bursts(filled: DataFrame, ratio: float = RATIO, effort: float = EFFORT) -> DataFrame:
    """kind, start and end (its last step) of the bursts of each series (kind, step, n).

    A kind's rows are drawn at its usual share of all or, in a burst, at ``ratio`` times as much; the cheapest course through both states
    is followed step by step (Viterbi).  Going up costs ``effort`` times the logarithm of the length, going down nothing; of equal courses the
    one that is up longer stays.  Each state holds its cost and the bursts on its way, which are few.
    """
    rows = _arrays(filled)
    total = lambda c: F.aggregate("x", F.lit(0.0), lambda a, v: a + v[c])
    usual = total("n") / F.greatest(total("whole"), F.lit(1.0))
    rows = rows.select("kind", "x", F.least(usual, F.lit(1 - 1e-9)).alias("p"), (F.log(F.size("x").cast("double")) * effort).alias("up"))
    rows = rows.withColumn("q", F.least(F.col("p") * ratio, F.lit(1 - 1e-9))).where("p > 0")
    cost = lambda v, p: -(v["n"] * F.log(p) + (v["whole"] - v["n"]) * F.log(1 - p))
    kind = "array<struct<start:timestamp,end:timestamp>>"
    none = F.array().cast(kind)
    start = F.struct(F.lit(0.0).alias("low"), none.alias("past"), F.lit(math.inf).alias("high"), none.alias("before"), F.lit(None).cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("last"))

    def step(a: Column, v: Column) -> Column:
        closed = F.concat(a["before"], F.array(F.struct(a["since"].alias("start"), a["last"].alias("end")))).cast(kind)
        down, stay = a["high"] < a["low"], a["high"] <= a["low"] + F.col("up")
        return F.struct(
            (F.least(a["low"], a["high"]) + cost(v, F.col("p"))).alias("low"),
            F.when(down, closed).otherwise(a["past"]).alias("past"),
            (F.least(a["high"], a["low"] + F.col("up")) + cost(v, F.col("q"))).alias("high"),
            F.when(stay, a["before"]).otherwise(a["past"]).alias("before"),
            F.when(stay, a["since"]).otherwise(v["step"]).alias("since"),
            v["step"].alias("last"),
        )

    def finish(a: Column) -> Column:
        closed = F.concat(a["before"], F.array(F.struct(a["since"].alias("start"), a["last"].alias("end")))).cast(kind)
        return F.when(a["high"] < a["low"], closed).otherwise(a["past"])

    return rows.select("kind", F.explode(F.aggregate("x", start, step, finish)).alias("b")).select("kind", "b.start", "b.end")


def changes(filled: DataFrame, effort: float = 2.0) -> DataFrame:
    """kind and step of the points at which the level of a series (kind, step, n) changes.

    The cheapest cut into runs, a run costing its squared deviations from its mean and ``effort`` times the variance of the series and the
    logarithm of its length.  A beginning that has become dearer than the best whole without its penalty can't become
    the best again and is dropped (pruned dynamic programming), so each step looks at few.
    """
    rows = filled.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("x"))
    n = F.size("x").cast("double")
    run = lambda c: F.aggregate("x", F.array(F.lit(0.0)), lambda a, v: F.array_append(a, F.element_at(a, -1) + c(v["n"].cast("double"))))
    rows = rows.select("kind", "x", run(lambda v: v).alias("s"), run(lambda v: v * v).alias("t"), n.alias("m"))
    spread = (F.element_at("t", -1) - F.element_at("s", -1) * F.element_at("s", -1) / F.col("m")) / F.col("m")
    rows = rows.withColumn("b", spread * F.log("m") * effort)
    head = "array<struct<f:double,at:int,path:array<int>>>"

    def cost(i: Column, j: Column) -> Column:
        """Of a run over the steps i + 1 to j."""
        total = F.element_at("s", j + 1) - F.element_at("s", i + 1)
        return F.element_at("t", j + 1) - F.element_at("t", i + 1) - total * total / (j - i)

    # a value that a lambda names is computed once
    let = lambda value, use: F.transform(F.array(value), use)[0]

    def step(a: Column, j: Column) -> Column:
        rated = F.transform(a, lambda c: F.struct((c["f"] + cost(c["at"], j) + F.col("b")).alias("f"), c["at"].alias("at"), c["path"].alias("path")))
        return let(rated, lambda r: let(F.array_min(r), lambda best: grown(a, r, best, j)))

    def grown(a: Column, rated: Column, best: Column, j: Column) -> Column:
        pairs = F.zip_with(a, rated, lambda x, y: F.struct(x.alias("old"), y["f"].alias("now")))
        kept = F.filter(pairs, lambda z: z["now"] - F.col("b") <= best["f"])
        new = F.struct(best["f"].alias("f"), j.alias("at"), F.array_append(best["path"], best["at"]).alias("path"))
        return F.array_append(F.transform(kept, lambda z: z["old"]), new).cast(head)

    start = F.array(F.struct((-F.col("b")).alias("f"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("path"))).cast(head)
    path = F.aggregate(F.sequence(F.lit(1), F.size("x")), start, step, lambda a: F.element_at(a, -1)["path"])
    cuts = rows.select("kind", "x", F.explode(path).alias("at")).where("at > 0")
    return cuts.select("kind", F.element_at("x", F.col("at") + 1)["step"].alias("step"))
