"""Peer-relative scores, tiers, ranks and windows.

Peers are the records of one primary topic.  Extremes and thresholds are aggregated first (combined before the shuffle, so a
topic with a third of all records is no burden) and joined back, where a window over the topic would gather it in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numbers import half_even_index, round_half_up
from ..session import materialize


def canonical_scores(df: DataFrame, year_now: int, topic: str = "topic", out: str = "canonical_score") -> DataFrame:
    """Add ``out``: 0.6 of the scaled influential share and 0.4 of the scaled citations a year, among peers."""
    rows = df.withColumns({"share_": scores.influential_ratio(), "rate_": scores.per_year(year_now)})
    ends = rows.groupBy(topic).agg(*[f(c).alias(f"{n}_{c}") for c in ("share_", "rate_") for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / F.when(hi != lo, hi - lo))

    score = round_half_up(scaled("share_") * 0.6 + scaled("rate_") * 0.4, 4)
    return rows.join(ends, topic).select(*[c for c in df.columns if c != out], score.alias(out))


def tiers(df: DataFrame, year_now: int, topic: str = "topic", out: str = "authority_tier") -> DataFrame:
    """Add ``out`` by age and citations a year: foundational (4 years or more, among the top 10 %), current_standard (1 to 4 years,
    top 25 %), emerging (2 years at most), else null.

    The thresholds are exact order statistics: equal rates are counted first, and the window runs over distinct rates only.
    """
    rows = df.withColumn("rate_", scores.per_year(year_now))
    steps = rows.groupBy(topic, "rate_").agg(F.count("*").alias("k_"))
    w = Window.partitionBy(topic).orderBy(F.desc("rate_"))
    whole = Window.partitionBy(topic)
    ranked = steps.withColumns({"upto_": F.sum("k_").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n_": F.sum("k_").over(whole)})
    reach = lambda share: F.max(F.when(F.col("upto_") > half_even_index(F.col("n_"), share), F.col("rate_")))
    bounds = ranked.groupBy(topic).agg(reach(0.10).alias("top10_"), reach(0.25).alias("top25_"))
    age = scores.age(year_now)
    tier = (
        F.when((age >= 4) & (F.col("rate_") >= F.col("top10_")), "foundational")
        .when(age.between(1, 4) & (F.col("rate_") >= F.col("top25_")), "current_standard")
        .when(age <= 2, "emerging")
    )
    return rows.join(bounds, topic).select(*[c for c in df.columns if c != out], tier.alias(out))


def tier_counts(df: DataFrame, tier: str = "authority_tier") -> DataFrame:
    return df.groupBy(F.coalesce(tier, F.lit("none")).alias("tier")).agg(F.count("*").alias("n"))


def scored(df: DataFrame, year_now: int, venues: dict[str, float]) -> DataFrame:
    """Add the six components and quality_score."""
    parts = df.withColumns(
        {
            "venue_score": scores.venue_score(venues),
            "citation_score": scores.citation_score(year_now),
            "recency_score": scores.recency_score(year_now),
            "survey_signal_score": scores.survey_signal(),
            "structure_signal_score": scores.structure_signal(),
            "canonical_score_component": scores.canonical_component(),
        }
    )
    return parts.withColumn("quality_score", scores.total(*[F.col(c) for c in scores.COMPONENTS]))


def with_rank(df: DataFrame, *order: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add the dense position in a total order, from 1, without gathering the rows in one task.

    Rows are range-partitioned and sorted, and each task numbers its own.  The numbered rows are written once, and both the
    tasks' counts (one small row each), which give the offsets, and the result are read from there: a range exchange that is
    planned twice samples other bounds the second time.  ``order`` should end in a unique column; ties without one are in any
    order, but every rank is given once.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = "paperloom_at"
    dealt = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, 33)
    counts = dealt.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    # as many rows as tasks, which the session bounds
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    joined = dealt.withColumn("part_", part).join(F.broadcast(before), "part_")
    return joined.select(*[c for c in df.columns if c != name], (F.col("before_") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def place_in_group(df: DataFrame, group: str | list[str], *order: Column, name: str = "place") -> DataFrame:
    """Add the place of each row in its group, from 1: the ranks of all rows by group and order, less those of the groups before, so that
    a group with a large share of the rows is dealt over many tasks."""
    keys = [group] if isinstance(group, str) else group
    ranked = with_rank(df.select(*[c for c in df.columns if c != name]), *[F.col(k) for k in keys], *order, name=name)
    first = ranked.groupBy(*keys).agg((F.min(name) - 1).alias("paperloom_before"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = ranked.alias("a").join(first.alias("b"), reduce(and_, same))
    return both.select(*[F.col(f"a.{c}").alias(c) for c in ranked.columns if c != name], (F.col(f"a.{name}") - F.col("b.paperloom_before")).alias(name))


def quality_rank(df: DataFrame, score: str = "quality_score", seq: str = "seq") -> DataFrame:
    """Add rank: score descending, then arrival."""
    return with_rank(df, F.desc(score), F.col(seq))


def judged_scores(df: DataFrame, score: str = "quality_score") -> DataFrame:
    """Add judge_adjusted_score: points for the recommended action and for relevance above or below 3; unchanged if not judged."""
    ok = F.col("topic_relevance").isNotNull() & ~F.coalesce(F.col("judge_failed"), F.lit(False))
    delta = F.lit(0)
    for action, points in scores.ACTION_DELTA.items():
        delta = F.when(F.col("recommended_action") == action, points).otherwise(delta)
    return df.withColumn("judge_adjusted_score", F.col(score) + F.when(ok, delta + (F.col("topic_relevance") - 3) * 10).otherwise(0))


def curated_first(df: DataFrame, rank: str = "rank", flag: str = "from_top_survey") -> DataFrame:
    """Add priority: curated records before the others, each block in its order."""
    return with_rank(df, F.desc(F.coalesce(F.col(flag), F.lit(False))), F.col(rank), name="priority")


def first(df: DataFrame, n: int, order: str = "rank") -> DataFrame:
    """The first ``n``: a top-k report."""
    return df.orderBy(order).limit(n)


def summarize_window(configured: int, count: int, most: int) -> int:
    """How many records are summarised."""
    return configured if configured > 0 else min(count, most)


def reading_order(df: DataFrame, pool: int, topic: str = "topic", seq: str = "seq") -> DataFrame:
    """Per topic the first ``pool`` by tier and recommended action, with their place."""
    tier = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("foundational", "current_standard", "emerging")]), F.col("authority_tier")), F.lit(0))
    act = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("must_read", "worth_reading", "optional")]), F.col("recommended_action")), F.lit(0))
    last = lambda c: F.when(c == 0, 4).otherwise(c)
    return top_per_group(df, topic, pool, last(tier), last(act), F.col(seq), name="place")


def top_per_group(df: DataFrame, group: str, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` of each group; ranks are cut in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)


def round_robin(df: DataFrame, k: int, topic: str = "topic", seq: str = "seq") -> DataFrame:
    """The first ``k`` rows, taken from the topics in turn, topics in the order of their first row."""
    cut = top_per_group(df, topic, k, F.col(seq), name="turn_")
    start = df.groupBy(topic).agg(F.min(seq).alias("start_"))
    return cut.join(start, topic).orderBy("turn_", "start_").limit(k).select(*df.columns)


def runner_up(df: DataFrame, query: str, score: str, *ties: Column) -> DataFrame:
    """The best row of each query with the score of the second, 0 if there is none; all but two are cut in each task."""
    two = top_per_group(df, query, 2, F.desc(score), *ties, name="n_")
    best = two.groupBy(query).agg(F.min_by(F.struct(*df.columns), "n_").alias("r_"), F.max(F.when(F.col("n_") == 2, F.col(score))).alias("second"))
    return best.select("r_.*", F.coalesce("second", F.lit(0.0)).alias("second"))


def tier_conflicts(df: DataFrame) -> DataFrame:
    """Records whose tier by citations differs from the judged one."""
    return df.where(F.col("authority_tier").isNotNull() & (F.col("authority_assessment") != "not_a_survey") & (F.col("authority_tier") != F.col("authority_assessment")))


def coverage_order(df: DataFrame, group: str, count: str = "coverage_count", pos: str = "pos") -> DataFrame:
    """Add place: most covered first, unknown counts last, ties in the given order."""
    return place_in_group(df, group, F.desc(F.coalesce(F.col(count), F.lit(-1))), F.col(pos))


def gap_order(gaps: DataFrame, score: str = "opportunity_score", pos: str = "pos", group: str = "topic") -> DataFrame:
    """Add place: per topic the greatest opportunity first, unknown ones last, ties in the given order."""
    return place_in_group(gaps, group, F.desc_nulls_last(score), F.col(pos))


def per_topic(df: DataFrame, topics: str = "topic_queries") -> DataFrame:
    """Records of each topic, by their first: topic, n_records; those without one are uncategorised."""
    first = F.coalesce(F.get(F.col(topics), F.lit(0)), F.lit("Uncategorised"))
    return df.groupBy(first.alias("topic")).agg(F.count("*").alias("n_records"))


def failures(steps: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and failed rows of each step, given with the name of its flag; unknown flags are no failure."""
    out = None
    for k, (name, (df, flag)) in enumerate(steps.items()):
        row = df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("failed")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "n", "failed")
        out = row if out is None else out.unionByName(row)
    return out


def funnel(steps: dict[str, DataFrame]) -> DataFrame:
    """Rows after each step, in one query."""
    out = None
    for k, (name, df) in enumerate(steps.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
