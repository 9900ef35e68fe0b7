"""Human labels: what several raters mean together, how far they agree, and how sure a precision is.

Votes are (item, rater, label).  Every step is a join and an aggregate; a rater or label that a third of the votes have is combined in
each task before the shuffle, and is the one side of a join that meets it once.

Defined results: votes with a null part don't count, repeated votes count as often as they are cast; no votes give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Rounds of expectation and maximisation, what is added to every count, replicates of a bootstrap.
ROUNDS, SMOOTHED, REPLICATES = 8, 0.01, 200


def _votes(votes: DataFrame) -> DataFrame:
    return votes.where("item IS NOT NULL AND rater IS NOT NULL AND label IS NOT NULL").select("item", "rater", "label")


def consensus(votes: DataFrame, labels: list, rounds: int = ROUNDS, smoothed: float = SMOOTHED) -> DataFrame:
    """item, label and p, its probability, of each of the ``labels`` (a few) for each item, by Dawid's and Skene's model.

    It starts from the shares of votes.  In each round the raters' errors (how often one says what where what is true) and the labels' shares
    are counted from the probabilities, ``smoothed`` added to each count, and the probabilities follow from them.
    """
    known = materialize(_votes(votes).where(F.col("label").isin(*labels)), "votes")
    given = F.array(*[F.lit(x) for x in labels])
    each = known.groupBy("item").agg(F.count("*").alias("n"))
    share = known.groupBy("item", F.col("label").alias("truth")).agg(F.count("*").alias("k"))
    truths = each.select("item", "n", F.explode(given).alias("truth")).join(share, ["item", "truth"], "left")
    state = materialize(truths.select("item", "truth", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("p")), "consensus")
    for _ in range(rounds):
        # a row for each of the labels
        prior = state.groupBy("truth").agg((F.sum("p") + smoothed).alias("prior"))
        said = known.join(state, "item").groupBy("rater", "truth", "label").agg(F.sum("p").alias("said"))
        cells = known.select("rater").distinct().select("rater", F.explode(given).alias("truth")).select("rater", "truth", F.explode(given).alias("label"))
        counts = cells.join(said, ["rater", "truth", "label"], "left").select("rater", "truth", "label", (F.coalesce("said", F.lit(0.0)) + smoothed).alias("said"))
        whole = counts.groupBy("rater", "truth").agg(F.sum("said").alias("whole"))
        errors = counts.join(whole, ["rater", "truth"]).select("rater", "label", "truth", F.log(F.col("said") / F.col("whole")).alias("fit"))
        fits = known.join(errors, ["rater", "label"]).groupBy("item", "truth").agg(F.sum("fit").alias("fit"))
        rated = fits.join(F.broadcast(prior), "truth").select("item", "truth", (F.col("fit") + F.log("prior")).alias("fit"))
        tops = rated.groupBy("item").agg(F.max("fit").alias("top"))
        odds = rated.join(tops, "item").select("item", "truth", F.exp(F.col("fit") - F.col("top")).alias("odds"))
        sums = odds.groupBy("item").agg(F.sum("odds").alias("sum"))
        new = materialize(odds.join(sums, "item").select("item", "truth", (F.col("odds") / F.col("sum")).alias("p")), "consensus")
        discard(state)
        state = new
    return state.select("item", F.col("truth").alias("label"), "p")


def agreement(votes: DataFrame) -> DataFrame:
    """n (votes on items that have two or more), observed and expected disagreement, and alpha (Krippendorff's, of names): one row.

    Only counts are needed: of each label in each item, and of each label in all.
    """
    counts = _votes(votes).groupBy("item", "label").agg(F.count("*").alias("k"))
    items = counts.groupBy("item").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("same")).where("m > 1")
    observed = items.agg(F.sum("m").alias("n"), F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("apart"))
    labels = counts.join(items.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
    both = observed.withColumn("one", F.lit(1)).join(labels.withColumn("one", F.lit(1)), "one").where("n IS NOT NULL")
    both = both.select("n", (F.col("apart") / F.col("n")).alias("observed"), ((F.col("n") * F.col("n") - F.col("pairs")) / (F.col("n") * (F.col("n") - 1))).alias("expected"))
    return both.withColumn("alpha", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).otherwise(1.0))


def precision(ranked: DataFrame, ks: tuple[int, ...], replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """k, precision, low and high of rows (id, rank, relevant): the share of the first ``k`` that is relevant, and its 2.5th and 97.5th
    percentile over bootstrap replicates.

    In one pass: a row stands in a replicate as often as a Poisson number says that is drawn from its id and the replicate.
    """
    rows = ranked.where(F.col("rank") <= max(ks)).select("id", "rank", F.coalesce(F.col("relevant").cast("int"), F.lit(0)).alias("hit"))
    drawn = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "turn", "id"), 11) * float(2.0**-53)
    upto = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(18)]
    times = F.lit(0)
    for bound in upto:
        times = times + (u > bound).cast("int")
    # turn 0 is the rows as they are
    drawn = drawn.withColumn("times", F.when(F.col("turn") == 0, 1).otherwise(times)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    shares = drawn.groupBy("k", "turn").agg((F.sum(F.col("times") * F.col("hit")) / F.nullif(F.sum("times"), F.lit(0))).alias("share"))
    spread = F.percentile(F.when(F.col("turn") > 0, F.col("share")), F.array(F.lit(0.025), F.lit(0.975)))
    found = shares.groupBy("k").agg(F.max(F.when(F.col("turn") == 0, F.col("share"))).alias("precision"), spread.alias("x"))
    return found.select("k", "precision", F.col("x")[0].alias("low"), F.col("x")[1].alias("high"))
