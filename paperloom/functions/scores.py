"""Score components as column expressions.  ``year_now`` is an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_up
from .text import blank, hits

# Terms, steps and points that results depend on.
SURVEY_TERMS = (
    "survey", "review", "systematic review", "taxonomy", "overview", "comprehensive", "literature review", "bibliometric",
    "meta-analysis", "state of the art", "state-of-the-art",
)
STRUCTURE_TERMS = (
    "taxonomy", "benchmark", "dataset", "evaluation", "future directions", "open challenges", "limitations", "comparison",
    "classification", "categorization", "future work", "open problems", "discussion",
)
PER_YEAR_STEPS = ((500, 8.0), (200, 6.4), (50, 4.8), (20, 3.2), (5, 2.0))
RATIO_STEPS = ((0.5, 12.0), (0.3, 9.0), (0.15, 6.0), (0.05, 3.0))
RECENCY_STEPS = ((1, 10.0), (2, 8.0), (3, 6.0), (4, 4.0), (5, 2.0))
UNKNOWN_VENUE = 5.0
TIERS = ("cut", "marginal", "useful", "core")
ACTION_DELTA = {"must_read": 40, "worth_reading": 20, "optional": 0, "skip": -100}


def _ladder(x: Column, steps, otherwise, reach) -> Column:
    out = None
    for bound, points in steps:
        out = (F if out is None else out).when(reach(x, bound), points)
    return out.otherwise(otherwise)


def _year(year_now: int) -> Column:
    """An absent year counts as last year."""
    return F.coalesce(F.when(F.col("year") != 0, F.col("year")), F.lit(year_now - 1))


def per_year(year_now: int) -> Column:
    """Citations for each year since publication, the first included."""
    return F.col("citation_count") / F.greatest(F.lit(year_now) - _year(year_now) + 1, F.lit(1))


def age(year_now: int) -> Column:
    return F.lit(year_now) - _year(year_now)


def influential_ratio() -> Column:
    return F.col("influential_citation_count") / F.greatest(F.col("citation_count"), F.lit(1))


def citation_score(year_now: int) -> Column:
    """0 to 20: citations a year up to 8, influential share up to 12."""
    rate = per_year(year_now)
    slow = round_half_up(F.least(F.lit(1.6), F.log1p(rate) * 0.8), 2)
    return round_half_up(_ladder(rate, PER_YEAR_STEPS, slow, lambda x, b: x >= b) + _ladder(influential_ratio(), RATIO_STEPS, 0.0, lambda x, b: x >= b), 2)


def recency_score(year_now: int) -> Column:
    """0 to 10; an unknown year gets 0."""
    return F.when(F.col("year").isNull(), 0.0).otherwise(_ladder(F.lit(year_now) - F.col("year"), RECENCY_STEPS, 0.0, lambda x, b: x <= b))


def survey_signal(terms: tuple[str, ...] = SURVEY_TERMS, title: str = "title", abstract: str = "abstract") -> Column:
    """0 to 15: 10 for each term in the title, 3 in the abstract."""
    return F.least(hits(F.lower(blank(title)), terms) * 10 + hits(F.lower(blank(abstract)), terms) * 3, F.lit(15)).cast("double")


def structure_signal(terms: tuple[str, ...] = STRUCTURE_TERMS, title: str = "title", abstract: str = "abstract") -> Column:
    """0 to 15: 2 for each term in title and abstract."""
    return F.least(hits(F.lower(F.concat(blank(title), F.lit(" "), blank(abstract))), terms) * 2, F.lit(15)).cast("double")


def venue_score(venues: dict[str, float], venue: str = "venue") -> Column:
    """0 to 20: equal name, else the first listed name that contains it or is contained; a small table as one CASE chain."""
    v = F.lower(F.col(venue))
    out = F.when(F.coalesce(F.col(venue), F.lit("")) == "", 0.0)
    listed = {k.lower(): float(p) for k, p in venues.items()}
    for name, points in listed.items():
        out = out.when(v == name, points)
    for name, points in listed.items():
        out = out.when(F.contains(v, F.lit(name)) | F.contains(F.lit(name), v), points)
    return out.otherwise(UNKNOWN_VENUE)


def canonical_component() -> Column:
    return round_half_up(F.least(F.lit(20.0), F.col("canonical_score") * 20.0), 2)


COMPONENTS = ("venue_score", "citation_score", "recency_score", "survey_signal_score", "structure_signal_score", "canonical_score_component")


def total(*components: Column) -> Column:
    """Their sum, at most 100."""
    out = components[0]
    for c in components[1:]:
        out = out + c
    return round_half_up(F.least(out, F.lit(100.0)), 2)


def clamp_relevance(x: Column) -> Column:
    """1 to 5; 3 where unknown."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(x.cast("int"), F.lit(3))))


def derive_tier(is_survey: Column, specific: Column, relevance: Column) -> Column:
    """The tier that the other judgements suggest."""
    return F.when(relevance <= 1, "cut").when(~is_survey | (relevance == 2) | specific, "marginal").when(relevance >= 4, "core").otherwise("useful")


def tier_rank(tier: Column, unknown: int = 2) -> Column:
    out = None
    for k, name in enumerate(TIERS):
        out = (F if out is None else out).when(tier == name, k)
    return out.otherwise(unknown)


def demote(tier: Column, is_survey: Column, specific: Column, relevance: Column) -> Column:
    """The tier, lowered to what the judgements allow: the least of the bounds; never raised."""
    cap = F.when(relevance <= 1, 0).when(~is_survey | (relevance == 2), 1).when(specific, 2).otherwise(3)
    return F.when(tier_rank(tier) <= cap, tier).otherwise(F.element_at(F.array(*[F.lit(t) for t in TIERS]), cap + 1))
