"""Settings: defaults, YAML files and overrides, read on the driver."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What a run needs to know; every operator takes the parts it uses as arguments."""

    topics: tuple[str, ...] = ()
    survey_terms: tuple[str, ...] = ("survey", "review")
    year_from: int = 2020
    year_to: int = 2026
    as_of_year: int = 2026
    max_results_per_query: int = 50
    top_n_to_summarize: int = 0
    max_summarize: int = 60
    min_quality_score: float = 20.0
    min_topic_relevance: int = 3
    min_paper_tier: str = "useful"
    exclude_domain_specific: bool = False
    judge_top_n: int = 100
    architecture_top_n: int = 50
    canonical_detector_enabled: bool = True
    top_surveys_enabled: bool = True
    top_surveys_per_topic: int = 12
    landmarks_enabled: bool = True
    landmark_min_mentions: int = 2
    landmark_min_citations: int = 100
    landmark_max_count: int = 8
    gap_frequency_threshold: float = 0.3
    venue_scores: dict[str, int] = field(default_factory=dict)


def load(path: str, venues: str | None = None, llm: str | None = None, **overrides) -> Settings:
    """Settings from a YAML file and, beside it unless named, ``venues.yaml`` and ``llm.yaml``; unknown keys are ignored.

    Overrides win where they are given (falsy ones count as not given).
    """
    import yaml

    names = {f.name for f in dataclasses.fields(Settings)}
    found: dict = {}
    folder = Path(path).parent
    for file in (path, llm or folder / "llm.yaml"):
        if Path(file).exists():
            found |= {k: v for k, v in (yaml.safe_load(Path(file).read_text()) or {}).items() if k in names and v is not None}
    table = Path(venues or folder / "venues.yaml")
    if table.exists():
        found["venue_scores"] = (yaml.safe_load(table.read_text()) or {}).get("venues") or {}
    found |= {k: v for k, v in overrides.items() if k in names and v}
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def parse_args(argv: list[str]) -> tuple[str, Settings]:
    """Command line: the step to run and its settings."""
    import argparse

    p = argparse.ArgumentParser(prog="paperloom")
    p.add_argument("step", choices=("fetch", "analyze", "run"))
    p.add_argument("--config", default="topics.yaml")
    p.add_argument("--venues")
    p.add_argument("--llm")
    for f in dataclasses.fields(Settings):
        flag = "--" + f.name.replace("_", "-")
        if f.type in ("int", "float", "str"):
            p.add_argument(flag, type={"int": int, "float": float, "str": str}[f.type])
        elif f.type == "bool":
            p.add_argument(flag, action="store_true")
        elif f.name in ("topics", "survey_terms"):
            p.add_argument(flag, nargs="+")
    a = vars(p.parse_args(argv))
    return a.pop("step"), load(a.pop("config"), a.pop("venues"), a.pop("llm"), **a)


def volume_bound(settings: Settings, sources: int, queries_per_topic: int = 10) -> dict[str, int | bool]:
    """Records at most, and whether the request is likely too small to be useful."""
    most = len(settings.topics) * queries_per_topic * sources * settings.max_results_per_query
    return {"upper_bound": most, "low": settings.max_results_per_query < 25 or most < 200}


def fill_environment(path: str, environment: dict[str, str]) -> dict[str, str]:
    """``environment`` with its absent and blank values filled in from a file of ``NAME=value`` lines; comments, quotes and ``export`` are
    put aside.  Secrets stay on the driver."""
    found = dict(environment)
    lines = Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []
    for line in lines:
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#") and not found.get(name.strip(), "").strip():
            found[name.strip()] = value.strip().strip("\"'")
    return found
