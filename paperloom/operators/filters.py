"""Filters over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text

# Terms of which a survey has one.
SIGNAL_TERMS = (
    "survey", "review", "systematic review", "systematic literature review", "taxonomy", "overview", "comprehensive survey",
    "literature review", "bibliometric", "meta-analysis", "scoping review", "mapping study", "systematic mapping",
)


def haystack(title: str = "title", abstract: str = "abstract") -> Column:
    return F.lower(F.concat(text.blank(title), F.lit(" "), text.blank(abstract)))


def relevance(topic: Column, hay: Column) -> Column:
    """Share of the topic's words that occur in ``hay`` as substrings; 1 for a topic without any."""
    tokens = text.topic_tokens(topic)
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(F.filter(tokens, lambda t: F.contains(hay, t))) / F.greatest(F.size(tokens), F.lit(1)))


def by_topic(df: DataFrame, least: float = 0.5, topics: str = "topic_queries", title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Records to which one of their own topics is relevant; those without topics go."""
    hay = haystack(title, abstract)
    return df.where(F.exists(F.coalesce(F.col(topics), F.array().cast("array<string>")), lambda t: relevance(t, hay) >= least))


def by_signal(df: DataFrame, terms: tuple[str, ...] = SIGNAL_TERMS, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """Records whose title or abstract has a term."""
    return df.where(text.any_term(haystack(title, abstract), terms))


def by_score(df: DataFrame, least: float, score: str = "quality_score") -> DataFrame:
    return df.where(F.col(score) >= least)


def by_score_or_rescue(df: DataFrame, least: float, score: str = "quality_score", flag: str = "from_top_survey") -> DataFrame:
    """Scored high enough, or curated."""
    return df.where((F.col(score) >= least) | F.coalesce(F.col(flag), F.lit(False)))


def by_masks(df: DataFrame, masks: DataFrame, size: int = 20, order: str = "seq") -> DataFrame:
    """Keep what recorded batch masks (batch, mask) allow; a batch without a mask of the right length is kept whole.

    ``order`` is the dense position of a record, from 0.
    """
    rows = df.withColumn("batch", F.floor(F.col(order) / size)).withColumn("place", (F.col(order) % size + 1).cast("int"))
    lengths = rows.groupBy("batch").agg(F.count("*").alias("n"))
    usable = masks.join(lengths, "batch").where(F.size("mask") == F.col("n")).select("batch", "mask")
    return rows.join(usable, "batch", "left").where(F.coalesce(F.try_element_at("mask", "place"), F.lit(True))).select(*df.columns)


def valid_queries(df: DataFrame, least: int = 5, untouched: int = 3) -> DataFrame:
    """Query strings (topic, keep) that validation kept; topics with few strings, or few survivors, keep all."""
    counts = df.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.coalesce("keep", F.lit(True))).alias("n_kept"))
    return df.join(counts, "topic").where((F.col("n") <= untouched) | (F.col("n_kept") < least) | F.coalesce("keep", F.lit(True))).select(*df.columns)


def unjudged(df: DataFrame, judgements: DataFrame, key: str = "seq") -> DataFrame:
    """Records that no judgement is of; several of one record, and those of a null one, are nothing special."""
    return df.join(judgements.select(key).distinct(), key, "left_anti")


def judge_gate(df: DataFrame, least_relevance: int = 3, least_tier: str = "useful", exclude_specific: bool = False) -> DataFrame:
    """Drop judged records that are off topic, of low tier or, if asked, domain-specific; unjudged and failed ones stay."""
    floor = {t: k for k, t in enumerate(scores.TIERS)}.get(least_tier, 2)
    judged = F.col("topic_relevance").isNotNull() & ~F.coalesce(F.col("judge_failed"), F.lit(False))
    bad = (F.col("topic_relevance") < least_relevance) | (scores.tier_rank(F.coalesce("paper_tier", F.lit(""))) < floor)
    if exclude_specific:
        bad = bad | F.coalesce(F.col("is_domain_specific"), F.lit(False))
    return df.where(~(judged & bad))


def landmarks(df: DataFrame, mentions: int, citations: int, most: int) -> DataFrame:
    """Per topic: enough mentions and citations, one for each title, the most mentioned and cited first."""
    from pyspark.sql import Window

    good = df.where((F.col("mentioned_by") >= mentions) & (F.col("citation_count") >= citations))
    first = good.withColumn("copy", F.row_number().over(Window.partitionBy("topic", F.lower("title")).orderBy("seq"))).where("copy = 1").drop("copy")
    order = Window.partitionBy("topic").orderBy(F.desc("mentioned_by"), F.desc("citation_count"), "seq")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def actionable(df: DataFrame) -> DataFrame:
    """Per topic: judged worth reading; where none is, all that were judged."""
    judged = df.where(~F.coalesce("judge_failed", F.lit(False))).withColumn("act", F.coalesce(F.col("recommended_action").isin("must_read", "worth_reading"), F.lit(False)))
    any_ = judged.groupBy("topic").agg(F.bool_or("act").alias("any_act"))
    return judged.join(any_, "topic").where(F.col("act") | ~F.col("any_act")).select(*df.columns)


def comparable_topics(df: DataFrame, least: int = 2) -> DataFrame:
    """Topics with ``least`` analyses that didn't fail."""
    return df.where(~F.coalesce("analysis_failed", F.lit(False))).groupBy("topic").agg(F.count("*").alias("n_valid")).where(F.col("n_valid") >= least)
