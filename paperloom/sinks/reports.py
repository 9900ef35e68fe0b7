"""Report documents from prepared rows.

Everything that counts, matches or ranks happens in Spark; what arrives here is a report's worth of rows (topics, a few dozen records, their
cards), read with ``toLocalIterator`` and written as Markdown or as one page with embedded data.
"""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching, relations
from . import tables


def rows(df: DataFrame, *order: str) -> list[dict]:
    """The rows of a prepared table, in order, as dictionaries."""
    return [r.asDict(recursive=True) for r in df.orderBy(*order).toLocalIterator()]


def heading(level: int, title: str) -> list[str]:
    return ["", "#" * level + " " + title, ""]


def listed(items: Iterable[str], most: int | None = None) -> list[str]:
    found = [x for x in items if x]
    return [f"- {x}" for x in (found if most is None else found[:most])]


def prose(bullets: list[str]) -> list[str]:
    """One sentence as a quotation, several as a list; ``bullets`` come from :func:`paperloom.functions.text.bullets`."""
    return [f"> {bullets[0]}"] if len(bullets) == 1 else listed(bullets)


def link(title: str, anchor: str, citations: int | None = None) -> str:
    return f"[{title}](#{anchor})" + (f" ({citations:,})" if citations else "")


# -- prepared tables ---------------------------------------------------------------------------------------------------


def cards(ranked: DataFrame, summaries: DataFrame, judgements: DataFrame) -> DataFrame:
    """One row for each record that was summarised, with what its card shows."""
    s = summaries.select("seq", "research_scope", "core_problem", "taxonomy", "main_findings", "datasets_and_benchmarks", "limitations", "future_directions", "keywords")
    j = judgements.select("seq", "paper_tier", "recommended_action", "topic_relevance", "authority_assessment", "strengths", "weaknesses")
    both = ranked.join(s, "seq").join(j, "seq", "left")
    tags = F.slice(F.flatten(F.transform(F.map_values("keywords"), lambda v: F.slice(v, 1, 3))), 1, 10)
    return both.withColumns({"anchor": text.anchor("title", "year"), "tags": tags, "scope": text.bullets("research_scope")})


def landscape(areas: DataFrame, records: DataFrame, n_records: int) -> DataFrame:
    """Areas (area_id, name, pos, coverage_count) with their key records and whether few records cover them."""
    hits = matching.records_for_areas(areas, records).join(records.select("seq", "title", "anchor"), "seq")
    grouped = hits.groupBy("area_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "anchor", "citation_count"))).alias("records"))
    flagged = relations.low_coverage(areas.withColumn("n_records", F.lit(n_records)))
    return flagged.join(grouped, "area_id", "left")


# -- sections ----------------------------------------------------------------------------------------------------------


def overview(field: dict, methods: list[dict], gaps: list[dict]) -> list[str]:
    """What the field is about: summary, core problems, methods by coverage, gaps by opportunity."""
    out = heading(2, "The field")
    out += prose(field.get("bullets") or [])
    if field.get("core_problems"):
        out += heading(3, "Core problems") + listed(f"**{p.get('name')}** — {p.get('description') or ''}" for p in field["core_problems"])
    for kind, title in (("deepest", "Best covered"), ("weakest", "Least covered")):
        own = [m for m in methods if m["kind"] == kind]
        if own:
            out += heading(3, title) + listed(f"{m['element']} ({m['coverage_count']})" for m in own)
    if gaps:
        out += heading(3, "Gaps") + listed(f"{g['gap']} — {g['gap_type']}, {g['opportunity_score']:.2f}" for g in gaps)
    return out


def landscape_section(areas: list[dict]) -> list[str]:
    out = heading(2, "Landscape")
    for a in areas:
        out += heading(3, a["name"] + (" (few surveys)" if a["low_coverage"] else ""))
        out += listed(link(r["title"], r["anchor"], r["citation_count"]) for r in a["records"] or [])
    return out


def navigator(papers: list[dict]) -> list[str]:
    """A table of the records."""
    out = heading(2, "Navigator") + ["| # | survey | year | tier | score |", "|-|-|-|-|-|"]
    return out + [f"| {p['rank']} | {link(p['title'], p['anchor'])} | {p['year'] or 'n.d.'} | {p.get('authority_tier') or '–'} | {p['quality_score']:.2f} |" for p in papers]


def card_section(papers: list[dict]) -> list[str]:
    out = heading(2, "Surveys")
    for p in papers:
        out += [f'<a id="{html.escape(p["anchor"])}"></a>'] + heading(3, f"{p['rank']}. {p['title']}")
        out += prose(p["scope"]) if p["scope"] else []
        for name, most in (("taxonomy", 5), ("main_findings", 3), ("datasets_and_benchmarks", 5), ("strengths", 3), ("weaknesses", 3)):
            if p.get(name):
                out += heading(4, name.replace("_", " ").capitalize()) + listed(p[name], most)
        if p.get("tags"):
            out += ["", "Keywords: " + ", ".join(p["tags"])]
    return out


def landmark_section(found: list[dict]) -> list[str]:
    out = heading(2, "Landmark papers")
    for x in found:
        title = f"[{x['title']}]({x['url']})" if x.get("url") else x["title"]
        out += [f"{x['rank']}. {title} ({x.get('year') or 'n.d.'}), {x['citation_count']:,} citations, named by {x['mentioned_by']} surveys. {x.get('why_seminal') or ''}".rstrip()]
    return out if found else []


def design_section(design: dict) -> list[str]:
    """A layered design with its diagram."""
    out = heading(2, "System design") + [design.get("overview") or ""]
    out += ["", "```mermaid", tables.design_diagram(design), "```"]
    for layer in design.get("layers") or []:
        out += heading(3, layer.get("name") or "") + [layer.get("role") or "", *listed(f"**{c.get('name')}** — {c.get('description') or ''}" for c in layer.get("components") or [])]
    if design.get("cross_cutting"):
        out += heading(3, "Cross-cutting") + listed(f"**{c.get('name')}** — {c.get('description') or ''}" for c in design["cross_cutting"])
    return out + (heading(3, "Data flow") + [f"{k}. {x}" for k, x in enumerate(design["data_flow"], 1)] if design.get("data_flow") else [])


def reading_section(path: dict) -> list[str]:
    out = heading(2, "Reading path") + ([f"For {path['target_audience']}"] if path.get("target_audience") else [])
    for s in sorted(path.get("steps") or [], key=lambda s: s.get("step") or 0):
        out += ["", f"{s.get('step')}. **{s.get('paper_title')}** ({s.get('estimated_reading_time') or '?'}) — {s.get('rationale') or ''}"]
        out += [f"   - {x}" for x in (s.get("focus_sections") or [])]
    return out


def guide_section(guide: dict, most_terms: int = 12) -> list[str]:
    """A newcomer's guide."""
    out = heading(2, "Field guide") + [guide.get("what_is_this_field") or "", "", guide.get("why_it_matters") or ""]
    for name in ("core_problems", "main_approaches", "historical_milestones", "common_misconceptions", "how_to_get_started"):
        if guide.get(name):
            out += heading(3, name.replace("_", " ").capitalize()) + listed(guide[name])
    terms = list((guide.get("key_terms") or {}).items())[:most_terms]
    return out + (heading(3, "Key terms") + listed(f"**{k}** — {v}" for k, v in terms) if terms else [])


def writing_section(field: dict) -> list[str]:
    """What a new survey could look like."""
    if not field.get("suggested_title_template"):
        return []
    out = heading(2, "A new survey") + [f"**{field['suggested_title_template']}**", "", field.get("suggested_abstract_template") or ""]
    return out + [f"{k}. {x}" for k, x in enumerate(field.get("suggested_sections") or [], 1)]


def bibtex(papers: list[dict]) -> str:
    """Entries for the records."""
    out = []
    for p in papers:
        fields = {"title": p["title"], "author": " and ".join(p.get("authors") or []), "year": p.get("year"), "journal": p.get("venue"), "doi": p.get("doi"), "url": p.get("url")}
        body = ",\n".join(f"  {k} = {{{v}}}" for k, v in fields.items() if v)
        out.append(f"@article{{{p['anchor']},\n{body}\n}}")
    return "\n\n".join(out)


def report(topic: str, sections: list[list[str]]) -> str:
    return "\n".join([f"# {topic}", *(line for s in sections for line in s), ""])


def page(topic: str, sections: list[list[str]], data: dict[str, DataFrame]) -> str:
    """The report as one page with its data sets, which scripts of a viewer may draw."""
    return tables.page(topic, report(topic, sections), {k: tables.payload(df) for k, df in data.items()})
