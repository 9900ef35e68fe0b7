"""Declared schemas of records; nothing is inferred from data.

``seq`` is the position in which a record arrived: order decides which duplicate leads and how ties are broken, so it is a
column.  "Absent" means null or empty (a blank string, a zero year, an empty list), as the merge rules need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())

RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("authors", _TEXTS),
        *(T.StructField(c, T.StringType()) for c in ("venue", "abstract", "doi", "arxiv_id", "url", "pdf_url")),
        *(T.StructField(c, T.LongType()) for c in ("citation_count", "influential_citation_count", "background_citation_count")),
        T.StructField("canonical_score", T.DoubleType()),
        T.StructField("authority_tier", T.StringType()),
        T.StructField("from_top_survey", T.BooleanType()),
        *(T.StructField(c, _TEXTS) for c in ("sources", "topic_queries", "generated_queries")),
    ]
)

SUMMARY_LISTS = (
    "taxonomy", "main_methods", "representative_papers_or_models", "datasets_and_benchmarks", "evaluation_metrics",
    "main_findings", "limitations", "future_directions", "citation_use_cases",
)
SUMMARY = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("paper_title", "research_scope", "core_problem")),
        *(T.StructField(c, _TEXTS) for c in SUMMARY_LISTS),
        T.StructField("keywords", T.MapType(T.StringType(), _TEXTS)),
        T.StructField("summarization_source", T.StringType()),
        T.StructField("summarization_failed", T.BooleanType()),
        T.StructField("failure_reason", T.StringType()),
    ]
)

JUDGEMENT = T.StructType(
    [
        T.StructField("paper_title", T.StringType()),
        T.StructField("is_survey", T.BooleanType()),
        *(T.StructField(c, T.StringType()) for c in ("authority_assessment", "scope_clarity", "coverage_depth")),
        T.StructField("strengths", _TEXTS),
        T.StructField("weaknesses", _TEXTS),
        T.StructField("topic_relevance", T.IntegerType()),
        T.StructField("is_domain_specific", T.BooleanType()),
        T.StructField("paper_tier", T.StringType()),
        T.StructField("recommended_action", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("judge_failed", T.BooleanType()),
        T.StructField("failure_reason", T.StringType()),
    ]
)

ARCHITECTURE_LISTS = (
    "core_research_questions", "top_level_taxonomy", "covered_tasks", "covered_methods", "covered_datasets", "covered_applications",
    "covered_challenges", "covered_future_directions", "notable_omissions", "structural_strengths", "structural_weaknesses",
)
ARCHITECTURE = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("paper_title", "orientation", "organizational_logic")),
        *(T.StructField(c, _TEXTS) for c in ARCHITECTURE_LISTS),
        T.StructField("second_level_taxonomy", T.MapType(T.StringType(), _TEXTS)),
        T.StructField("taxonomy_glossary", T.MapType(T.StringType(), T.StringType())),
        T.StructField("analysis_failed", T.BooleanType()),
        T.StructField("failure_reason", T.StringType()),
    ]
)

#: Values of a missing field; all others are null.
DEFAULTS = {
    "citation_count": 0, "influential_citation_count": 0, "background_citation_count": 0, "canonical_score": 0.0, "from_top_survey": False,
}


def with_defaults(df: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones are added, numbers and flags get their defaults, lists are never null."""
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]).cast(f.dataType))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def present(name: str, kind: T.DataType | None = None) -> Column:
    """The column, or null where it counts as absent."""
    kind = kind or RECORD[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(c) > 0, c)
    if isinstance(kind, (T.IntegerType, T.LongType, T.DoubleType)):
        return F.when(c != 0, c)
    return c


def primary_topic(c: str = "topic_queries") -> Column:
    """The first topic, or "Uncategorised"."""
    return F.coalesce(F.get(F.col(c), F.lit(0)), F.lit("Uncategorised"))
