"""Model passes by replay: prompts are keyed by content, recorded replies join them, and what has no reply yet is a table too.

Everything around the model is here: the key, the join, stripping and repairing JSON, coercion, clamping, defaults.  A reply that can't
be used gives a row that says so, never an exception.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import scores
from ..functions.text import blank, response_key, truncate
from ..schema import ARCHITECTURE_LISTS, SUMMARY_LISTS
from ..session import importable
from .prompts import prompt


@dataclass(frozen=True)
class Pass:
    """A kind of call: its name and the parts of its key, SQL expressions over the columns of its rows."""

    name: str
    key: tuple[str, ...]


_TITLES = ("topic", "array_join(array_sort(titles), ',')", "model")
#: The passes and their keys; :mod:`.prompts` has what is asked.
PASSES = {
    p.name: p
    for p in (
        Pass("summary", ("title", "abstract", "model")),
        Pass("judge", ("title", "abstract", "research_scope", "array_join(array_sort(topic_queries), ',')", "model", "version")),
        Pass("architecture", ("title", "abstract", "array_join(array_sort(slice(taxonomy, 1, 8)), ',')", "model", "version")),
        Pass("queries", ("topic",)),
        Pass("query_validation", ("topic", "array_join(queries, ',')")),
        Pass("relevance", ("topic", "array_join(titles, ',')")),
        Pass("landmarks", ("lower(topic)", "model", "version")),
        *(Pass(name, _TITLES) for name in ("comparison", "synthesis", "system_design", "reading_path", "concept_graph", "field_guide", "mind_map")),
    )
}


def keyed(df: DataFrame, kind: Pass) -> DataFrame:
    """Add the key and the prompt of a pass."""
    return df.withColumns({"key": response_key(F.lit(kind.name), *[F.expr(k) for k in kind.key]), "prompt": prompt(df, kind.name)})


def replay(df: DataFrame, responses: DataFrame, kind: Pass) -> tuple[DataFrame, DataFrame]:
    """``df`` with the recorded reply ``raw`` of each row (null without one; of repeated keys the last by ``at``), and the prompts that
    wait for one, each once."""
    rows = keyed(df, kind)
    have = responses.where(F.col("pass") == kind.name).groupBy("key").agg(F.max_by("raw", "at").alias("raw"))
    joined = rows.join(have, "key", "left")
    pending = joined.where("raw IS NULL").groupBy("key").agg(F.first("prompt").alias("prompt")).withColumn("pass", F.lit(kind.name))
    return joined, pending


def _parsed(df: DataFrame, raw: str, repair: bool = True) -> DataFrame:
    importable(df.sparkSession)
    return df.withColumn("v_", R.reply_json(raw, repair))


def _failure(flag: str) -> dict[str, Column]:
    bad = F.coalesce(F.schema_of_variant("v_").startswith("OBJECT"), F.lit(False))
    return {flag: ~bad, "failure_reason": F.when(F.col("raw").isNull(), "no reply").when(~bad, "the reply is no JSON object")}


def summaries(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies of the summary pass as summary columns."""
    out = {c: R.list_of("v_", c) for c in SUMMARY_LISTS}
    out |= {"research_scope": R.text_of("v_", "research_scope"), "core_problem": R.text_of("v_", "core_problem"), "keywords": R.map_of("v_", "keywords", "map<string,array<string>>")}
    return _parsed(df, raw).withColumns(out | {"summarization_source": F.lit("abstract")} | _failure("summarization_failed")).drop("v_")


def judgements(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies of the judge pass: relevance clamped, tier derived where it is none of the known, then only lowered, and what is of low tier
    skipped."""
    rows = _parsed(df, raw, repair=False).withColumns(
        {
            "is_survey": R.bool_of("v_", "is_survey", True),
            "is_domain_specific": R.bool_of("v_", "is_domain_specific", False),
            "topic_relevance": scores.clamp_relevance(R.int_of("v_", "topic_relevance")),
            "said_": F.lower(F.trim(R.text_of("v_", "paper_tier"))),
        }
    )
    facts = [F.col(c) for c in ("is_survey", "is_domain_specific", "topic_relevance")]
    said = F.when(F.col("said_").isin(*scores.TIERS), F.col("said_")).otherwise(scores.derive_tier(*facts))
    rows = rows.withColumn("paper_tier", scores.demote(said, *facts))
    return rows.withColumns(
        {
            "recommended_action": F.when(F.col("paper_tier").isin("marginal", "cut"), "skip").otherwise(R.text_of("v_", "recommended_action")),
            "confidence": F.coalesce(R.double_of("v_", "confidence"), F.lit(0.0)),
            "strengths": R.list_of("v_", "strengths"),
            "weaknesses": R.list_of("v_", "weaknesses"),
            **{c: R.text_of("v_", c) for c in ("authority_assessment", "scope_clarity", "coverage_depth")},
            **_failure("judge_failed"),
        }
    ).drop("v_", "said_")


def architectures(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies of the architecture pass."""
    out = {c: R.list_of("v_", c) for c in ARCHITECTURE_LISTS}
    out |= {c: R.text_of("v_", c) for c in ("orientation", "organizational_logic")}
    out |= {"second_level_taxonomy": R.map_of("v_", "second_level_taxonomy", "map<string,array<string>>"), "taxonomy_glossary": R.map_of("v_", "taxonomy_glossary")}
    return _parsed(df, raw).withColumns(out | _failure("analysis_failed")).drop("v_")


def comparisons(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies of the comparison pass."""
    out = {
        "orientation_distribution": R.map_of("v_", "orientation_distribution", "map<string,int>"),
        "shared_taxonomy_dimensions": R.list_of("v_", "shared_taxonomy_dimensions"),
        "coverage_gaps_across_all_surveys": R.list_of("v_", "coverage_gaps_across_all_surveys"),
        **{c: F.coalesce(F.try_variant_get("v_", f"$.{c}", "array<map<string,string>>"), F.from_json(F.lit("[]"), "array<map<string,string>>")) for c in ("conflicting_classifications", "complementary_coverage")},
        **{c: R.text_of("v_", c) for c in ("best_overall_structure", "best_overall_structure_reason")},
    }
    return _parsed(df, raw).withColumns(out | _failure("comparison_failed")).drop("v_")


def masks(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replies that are lists of true and false; others are null, so that nothing is dropped on their account."""
    return _parsed(df, raw, repair=False).withColumn("mask", F.try_variant_get("v_", "$", "array<boolean>")).drop("v_")


def generated_queries(df: DataFrame, raw: str = "raw", most: int = 10) -> DataFrame:
    """seq, topic, place and query of the search queries that replies (a list of strings each) give topics (seq, topic); the first ``most``
    that aren't blank, and the usual templates for a topic without a list.  Of equal queries the first counts, over all topics."""
    from ..sources.retrieval import template_queries
    from .dedup import first_by

    found = F.filter(F.transform(F.try_variant_get("v_", "$", "array<string>"), lambda q: F.trim(q)), lambda q: q.isNotNull() & (q != ""))
    rows = _parsed(df, raw, repair=False).withColumn("queries_", F.slice(F.coalesce(found, F.array().cast("array<string>")), 1, most)).drop("v_")
    given = rows.where(F.size("queries_") > 0).select("seq", "topic", F.posexplode("queries_").alias("place", "query"))
    usual = template_queries(rows.where(F.size("queries_") == 0).select("seq", "topic"))
    return first_by(given.unionByName(usual), F.col("query"), F.col("seq"), F.col("place"))


_PART = "struct<name:string,description:string>"
_PIECES = {
    "synthesis": {
        "field_summary": "string", "core_problems": f"array<{_PART}>", "datasets_and_benchmarks": f"array<{_PART}>", "evaluation_metrics": "array<string>",
        "applications": "array<string>", "future_research_directions": "array<string>",
        "open_gaps": "array<struct<gap:string,gap_type:string,evidence:string,opportunity_score:double,related_challenges:array<string>>>",
        "suggested_title_template": "string", "suggested_abstract_template": "string", "suggested_sections": "array<string>",
    },
    "system_design": {"overview": "string", "layers": f"array<struct<name:string,role:string,components:array<{_PART}>>>", "cross_cutting": f"array<{_PART}>", "data_flow": "array<string>"},
    "reading_path": {"target_audience": "string", "steps": "array<struct<step:int,paper_title:string,rationale:string,focus_sections:array<string>,prereq_concepts:array<string>,estimated_reading_time:string>>"},
    "field_guide": {
        "what_is_this_field": "string", "why_it_matters": "string", "core_problems": "array<string>", "main_approaches": "array<string>",
        "key_terms": "map<string,string>", "historical_milestones": "array<string>", "common_misconceptions": "array<string>", "how_to_get_started": "array<string>",
    },
    "concept_graph": {
        "nodes": "array<struct<node_id:string,name:string,definition:string,aliases:array<string>,representative_papers:array<string>>>",
        "edges": "array<struct<source_id:string,target_id:string,edge_type:string,evidence:string>>",
    },
}


def documents(df: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """Replies of a pass at the grain of a topic, as declared columns; a field of another shape is null."""
    out = {c: F.try_variant_get("v_", f"$.{c}", t) for c, t in _PIECES[kind].items()}
    return _parsed(df, raw).withColumns(out | _failure("failed")).drop("v_")


def sized(df: DataFrame, field: str, group: str = "topic") -> DataFrame:
    """The entries of a mapping field (name → description and count) of a synthesis in the order of the text: group, pos, name, description,
    coverage_count (null if none)."""
    rows = _parsed(df, "raw")
    keys = F.filter(F.json_object_keys(F.to_json(F.try_variant_get("v_", f"$.{field}", "variant"))), lambda k: k.isNotNull())
    each = rows.select(group, "v_", F.posexplode(F.coalesce(keys, F.array().cast("array<string>"))).alias("pos", "name"))
    entry = F.try_variant_get("v_", f"$.{field}", "map<string,variant>")[F.col("name")]
    return each.select(group, "pos", "name", R.text_of(entry, "description").alias("description"), R.int_of(entry, "coverage_count").alias("coverage_count"))


def prompt_rows(df: DataFrame, columns: dict[str, int]) -> Column:
    """A row as JSON for a prompt, texts cut to the given lengths."""
    return F.to_json(F.struct(*[truncate(blank(c), n).alias(c) for c, n in columns.items()]))
