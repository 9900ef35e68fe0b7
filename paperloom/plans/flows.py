"""The two flows: from retrieved records to ranked ones, and from ranked ones to judged and analysed ones.

Each is one lazy plan but for the duplicate resolution, which works in rounds, and the boundaries where results are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import dedup, filters, ranking, replay
from ..schema import primary_topic, with_defaults


def fetch(records: DataFrame, settings: Settings, curated: DataFrame | None = None, masks: DataFrame | None = None) -> DataFrame:
    """Filtered, merged, scored, ranked and tiered records.

    ``curated`` records join after the filters, which they skip.  Canonical scores compare with all records in the pool; tiers only with
    those that the score lets through.
    """
    rows = filters.by_signal(filters.by_topic(with_defaults(records)))
    rows = dedup.deduplicate(rows)
    if masks is not None:
        dense = ranking.with_rank(rows, F.col("seq"), name="at_").withColumn("at_", F.col("at_") - 1)
        rows = filters.by_masks(dense, masks, order="at_").drop("at_")
    if curated is not None:
        top = rows.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top_"))
        late = with_defaults(curated).join(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("top_") + 1).drop("top_")
        rows = dedup.deduplicate(rows.unionByName(late))
    rows = rows.withColumn("topic", primary_topic())
    if settings.canonical_detector_enabled:
        rows = ranking.canonical_scores(rows, settings.as_of_year)
    rows = ranking.scored(rows, settings.as_of_year, settings.venue_scores)
    rows = filters.by_score_or_rescue(rows, settings.min_quality_score)
    return ranking.tiers(ranking.quality_rank(rows), settings.as_of_year)


def analyze(ranked: DataFrame, settings: Settings, responses: DataFrame, model: str = "recorded") -> dict[str, DataFrame]:
    """Summaries, judgements and architectures by replay, and the re-ranked, gated records; and the prompts without a reply."""
    ordered = ranking.curated_first(ranked)
    n = ranking.summarize_window(settings.top_n_to_summarize, settings.max_summarize, settings.max_summarize)
    window = ordered.where(F.col("priority") <= n).withColumns({"model": F.lit(model), "version": F.lit("1")})
    replied, wait1 = replay.replay(window, responses, replay.PASSES["summary"])
    summed = replay.summaries(replied).drop("key", "prompt", "raw", "failure_reason")
    replied, wait2 = replay.replay(summed.where(F.col("priority") <= settings.judge_top_n), responses, replay.PASSES["judge"])
    judged = replay.judgements(replied).drop("key", "prompt", "raw", "failure_reason")
    verdicts = judged.select("seq", "is_survey", "is_domain_specific", "topic_relevance", "paper_tier", "recommended_action", "judge_failed", "authority_assessment")
    all_ = ordered.join(verdicts, "seq", "left")
    kept = filters.judge_gate(ranking.judged_scores(all_), settings.min_topic_relevance, settings.min_paper_tier, settings.exclude_domain_specific)
    final = ranking.with_rank(kept, F.desc("judge_adjusted_score"), F.col("priority"), name="final_rank")
    alive = judged.join(kept.select("seq"), "seq", "left_semi").where(~F.col("summarization_failed"))
    replied, wait3 = replay.replay(alive.where(F.col("priority") <= settings.architecture_top_n), responses, replay.PASSES["architecture"])
    built = replay.architectures(replied).drop("key", "prompt", "raw", "failure_reason")
    return {"papers": final, "summaries": summed, "judgements": judged, "architectures": built, "pending": wait1.unionByName(wait2).unionByName(wait3)}
