"""Prompts of the model passes as columns: an instruction, the fields that a row has, cut to fixed limits, and the shape of the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ARCHITECTURE_LISTS, SUMMARY_LISTS

# How much of a field a prompt holds (characters of a text, entries of a list; None is all of it).
RECORD_FIELDS = (("title", "Title", None), ("year", "Year", None), ("venue", "Venue", None))
LIMITS = {
    "summary": (*RECORD_FIELDS, ("authors", "Authors", 5), ("abstract", "Abstract", None)),
    "judge": (
        ("topic_queries", "Research topics", None), *RECORD_FIELDS, ("citation_count", "Citations", None), ("influential_citation_count", "Influential citations", None),
        ("canonical_score", "Canonical score (0 to 1)", None), ("authority_tier", "Tier by age and citations", None), ("abstract_words", "Words of the abstract", None),
        ("abstract", "Abstract", 4000), ("research_scope", "Research scope", None), ("taxonomy", "Taxonomy", 5),
    ),
    "architecture": (
        *RECORD_FIELDS, ("abstract", "Abstract", 4000), ("taxonomy", "Taxonomy labels", 10), ("main_methods", "Methods", 10), ("datasets_and_benchmarks", "Datasets", 10),
        ("limitations", "Limitations", 5), ("future_directions", "Future directions", 5), ("sections", "Section headings", 20), ("conclusion_text", "Conclusion", 1000),
        ("future_work_text", "Future work", 800),
    ),
}
#: Entries of the lists that a row of a topic's records holds, by pass.
ROW_LIMITS = {
    "comparison": {"covered_tasks": 8, "covered_methods": 8, "covered_challenges": 5, "structural_strengths": None, "notable_omissions": 5},
    "synthesis": {
        "covered_tasks": 10, "covered_methods": 10, "covered_datasets": 8, "covered_applications": 6, "covered_challenges": 6, "covered_future_directions": 6, "notable_omissions": 4,
    },
}

INSTRUCTIONS = {
    "summary": "Summarise this survey from what is given here and nothing else.",
    "judge": "Judge how relevant this record is to the research topics, whether it is a survey of the field, and how much authority it has.",
    "architecture": "Describe how this survey organises its field.",
    "comparison": "Compare how these surveys of one topic organise it: what they share, where they contradict or complete one another, and what none covers.",
    "queries": "Propose ten search strings that find surveys of this topic.",
    "query_validation": "Say of each search string whether it stays on the topic.",
    "relevance": "Say of each title whether it belongs to the topic.",
    "synthesis": "Unite these surveys into one picture of the field, with gaps and their evidence.",
    "system_design": "Propose a layered system that puts the field's methods to work.",
    "reading_path": "Propose an order in which to read these surveys.",
    "landmarks": "Name the primary works that these surveys build on.",
    "concept_graph": "Extract the field's concepts and how they relate.",
    "field_guide": "Write a guide to the field for a newcomer.",
    "mind_map": "Draw the field as a Mermaid mind map.",
}
ANSWERS = {
    "summary": ("research_scope", "core_problem", *SUMMARY_LISTS, "keywords"),
    "judge": (
        "is_survey", "is_domain_specific", "topic_relevance", "paper_tier", "authority_assessment", "recommended_action", "confidence", "scope_clarity", "coverage_depth", "strengths", "weaknesses",
    ),
    "architecture": ("orientation", "organizational_logic", *ARCHITECTURE_LISTS, "second_level_taxonomy", "taxonomy_glossary"),
    "comparison": (
        "orientation_distribution", "shared_taxonomy_dimensions", "conflicting_classifications", "complementary_coverage", "coverage_gaps_across_all_surveys", "best_overall_structure",
        "best_overall_structure_reason",
    ),
    "synthesis": (
        "field_summary", "core_problems", "major_tasks", "method_families", "challenges", "datasets_and_benchmarks", "evaluation_metrics", "applications", "future_research_directions", "open_gaps",
        "suggested_title_template", "suggested_abstract_template", "suggested_sections",
    ),
    "system_design": ("overview", "layers", "cross_cutting", "data_flow"),
    "reading_path": ("target_audience", "steps"),
    "landmarks": ("landmarks",),
    "concept_graph": ("nodes", "edges"),
    "field_guide": (
        "what_is_this_field", "why_it_matters", "core_problems", "main_approaches", "key_terms", "historical_milestones", "common_misconceptions", "how_to_get_started",
    ),
}


def _value(df: DataFrame, name: str, most: int | None) -> Column:
    """A field as text, cut to its limit; null where it is absent."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    if kind == "array":
        c = F.array_join((F.slice(c, 1, most) if most else c).cast("array<string>"), ", ")
    elif kind == "double":
        c = F.format_string("%.3f", c)
    else:
        c = c.cast("string")
        c = F.substring(c, 1, most) if most else c
    return F.when(F.trim(c) != "", c)


def prompt(df: DataFrame, name: str) -> Column:
    """The prompt of the pass ``name`` for rows of ``df``: fields that the table lacks or the row leaves blank have no line."""
    fields = LIMITS.get(name) or tuple((c, c.replace("_", " ").capitalize(), None) for c in ("topic", "queries", "titles", "records") if c in df.columns)
    lines = [F.lit(INSTRUCTIONS[name])]
    for field, label, most in fields:
        if field == "abstract_words" and "abstract" in df.columns:
            lines.append(F.concat(F.lit(f"{label}: "), F.size(F.array_remove(F.split(F.coalesce("abstract", F.lit("")), r"\s+"), "")).cast("string")))
        elif field in df.columns:
            lines.append(F.concat(F.lit(f"{label}: "), _value(df, field, most)))
    if name == "summary" and "abstract" in df.columns:
        lines.append(F.when(F.trim(F.coalesce("abstract", F.lit(""))) == "", "There is no abstract: go by title and venue alone."))
    if name in ("queries", "query_validation", "relevance"):
        lines.append(F.lit("Answer with a JSON array" + (" of strings." if name == "queries" else " of true and false, in order.")))
    elif name in ANSWERS:
        lines.append(F.lit("Answer with one JSON object that has the fields " + ", ".join(ANSWERS[name]) + "."))
    return F.concat_ws("\n", *lines)


def topic_rows(df: DataFrame, name: str, pos: str = "pos", group: str = "topic") -> DataFrame:
    """topic, titles and records (a JSON array) of the analysed records of a topic in order, lists cut to the limits of the pass."""
    own = [F.col(c) for c in ("title", "year", "orientation", "top_level_taxonomy") if c in df.columns]
    own += [(F.slice(c, 1, most) if most else F.col(c)).alias(c) for c, most in ROW_LIMITS[name].items() if c in df.columns]
    each = df.select(group, F.struct(F.col(pos).alias("p"), F.to_json(F.struct(*own)).alias("j"), F.col("title").alias("t")).alias("x"))
    rows = each.groupBy(group).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select(group, F.transform("xs", lambda v: v["t"]).alias("titles"), F.concat(F.lit("["), F.array_join(F.transform("xs", lambda v: v["j"]), ","), F.lit("]")).alias("records"))
