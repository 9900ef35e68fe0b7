"""Tables, files and documents that a run leaves behind."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.numbers import round_half_up
from ..functions.text import blank, diagram_label, normalized_title
from ..session import listed

# Columns of an exported record, in order.
PAPER_COLUMNS = (
    "rank", "title", "year", "venue", "authors", "topic_queries", "citation_count", "influential_citation_count",
    "background_citation_count", "influential_ratio", "canonical_score", "authority_tier", "llm_authority_assessment",
    "recommended_action", "orientation", "quality_score", "doi", "arxiv_id", "url", "pdf_url", "abstract", "sources",
)


def paper_rows(df: DataFrame) -> DataFrame:
    """Ranked records as flat rows for tables: lists joined, absent texts and years blank, scores rounded.

    The judge's and the analysis' columns are taken from ``authority_assessment``, ``recommended_action`` and ``orientation`` where
    ``df`` has them and ``judge_failed`` or ``analysis_failed`` doesn't say that they are worthless; else they are blank.
    """
    own = set(df.columns)

    def said(c: str, failed: str) -> Column:
        if c not in own:
            return F.lit("")
        fine = ~F.coalesce(F.col(failed), F.lit(False)) if failed in own else F.lit(True)
        return F.when(fine, blank(c)).otherwise("")

    cells = {
        "year": F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise(""),
        "authors": F.array_join(F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 5), "; "),
        "influential_ratio": round_half_up(scores.influential_ratio(), 4),
        "canonical_score": round_half_up(F.col("canonical_score"), 4),
        "llm_authority_assessment": said("authority_assessment", "judge_failed"),
        "recommended_action": said("recommended_action", "judge_failed"),
        "orientation": said("orientation", "analysis_failed"),
        "quality_score": round_half_up(F.col("quality_score"), 1),
        "abstract": F.replace(blank("abstract"), F.lit("\n"), F.lit(" ")),
    }
    cells |= {c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ") for c in ("topic_queries", "sources")}
    cells |= {c: blank(c) for c in ("venue", "authority_tier", "doi", "arxiv_id", "url", "pdf_url")}
    return df.select(*[cells.get(c, F.col(c)).alias(c) for c in PAPER_COLUMNS])


def summary_rows(ranked: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of ranked records in their order, ranked anew, lists as bulleted lines; of summaries of one title the last by ``pos``."""
    from ..operators.ranking import with_rank
    from ..schema import SUMMARY_LISTS

    one = summaries.groupBy("paper_title").agg(F.max_by(F.struct(*[c for c in summaries.columns if c != "paper_title"]), "pos").alias("s_")).select("paper_title", "s_.*")
    both = ranked.select(F.col("rank").alias("old_"), "title").join(one, F.col("title") == F.col("paper_title"))
    listed = [F.array_join(F.transform(c, lambda x: F.concat(F.lit("• "), x)), "\n").alias(c) for c in SUMMARY_LISTS]
    return with_rank(both.select("old_", "title", "research_scope", "core_problem", *listed), F.col("old_"), F.col("title")).drop("old_")


def write_csv(df: DataFrame, path: str, order: str = "rank") -> None:
    """A report in order, sorted by range: files whose names follow the order, one for each range of rows, the first with the first row.

    A report of a few thousand rows is one file, since small ranges are coalesced; a larger one is never gathered in a task.
    """
    df.orderBy(order).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nested(df: DataFrame, judgements: DataFrame, summaries: DataFrame) -> DataFrame:
    """Records with their judgement and summary as nested values, null where there is none."""
    j = judgements.groupBy("paper_title").agg(F.max_by(F.struct(*judgements.columns), "pos").alias("judge"))
    s = summaries.groupBy("paper_title").agg(F.max_by(F.struct(*summaries.columns), "pos").alias("summary"))
    return df.join(j, df["title"] == j["paper_title"], "left").drop("paper_title").join(s, df["title"] == s["paper_title"], "left").drop("paper_title")


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of small tables where the library for it is installed, else one CSV folder for each sheet."""
    try:
        import openpyxl
    except ImportError:
        for name, df in sheets.items():
            write_csv(df, f"{path}.{re.sub('[^a-z0-9]+', '_', name.lower())}.csv")
        return
    book = openpyxl.Workbook()
    book.remove(book.active)
    for name, df in sheets.items():
        sheet = book.create_sheet(name)
        sheet.append([c.replace("_", " ").title() for c in df.columns])
        for row in df.orderBy("rank").toLocalIterator():
            sheet.append(list(row))
    book.save(path)


def upsert_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of the table of records, matched by normalised title: the larger citation count, the new quality score,
    addresses and abstract filled in where missing, all else as it was; new titles are added.  Equal titles within ``new`` count once,
    the last by seq."""
    key = F.coalesce(normalized_title("title"), F.lit(""))
    cols = old.columns
    one = new.withColumn("k_", key).groupBy("k_").agg(F.max_by(F.struct(*cols), "seq").alias("n"))
    both = old.withColumn("k_", key).select("k_", F.struct(*cols).alias("o")).join(one, "k_", "full_outer")
    fill = ("abstract", "pdf_url", "doi", "arxiv_id")
    out = []
    for c in cols:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "citation_count":
            v = F.greatest(was, now)
        elif c == "quality_score":
            v = F.coalesce(now, was)
        elif c in fill:
            v = F.coalesce(was, now)
        else:
            v = F.when(F.col("o").isNotNull(), was).otherwise(now)
        out.append(v.alias(c))
    return both.select(*out)


def repeated_ids(df: DataFrame) -> DataFrame:
    """DOIs and arXiv ids that two records share: none in a sound table."""
    each = df.select(F.explode(F.array(F.struct(F.lit("doi").alias("kind"), F.col("doi").alias("value")), F.struct(F.lit("arxiv_id").alias("kind"), F.col("arxiv_id").alias("value")))).alias("x"))
    return each.select("x.*").where("value IS NOT NULL").groupBy("kind", "value").count().where("count > 1")


def summaries_to_add(summaries: DataFrame, records: DataFrame) -> DataFrame:
    """Summaries with the id of their record, by normalised title; those without a record are left out."""
    ids = records.groupBy(normalized_title("title").alias("k_")).agg(F.min("seq").alias("paper_id"))
    return summaries.withColumn("k_", normalized_title("paper_title")).join(ids, "k_").drop("k_")


def run_name(topics: list[str], day: str, taken: set[str]) -> str:
    """A folder name of at most three topics, the day, and a number if it is taken."""
    parts = ["-".join(re.findall(r"[a-z0-9]+", t.lower())[:4]) for t in topics[:3]]
    if len(topics) > 3:
        parts.append(f"and-{len(topics) - 3}-more")
    base = "_".join([*parts, day])
    return next(n for n in (base, *(f"{base}_{k}" for k in range(2, 10**6))) if n not in taken)


# -- documents ---------------------------------------------------------------------------------------------------------


def payload(df: DataFrame, most: int = 20_000) -> str:
    """A prepared, small table as JSON that may stand inside a script element; more than ``most`` rows are an error."""
    df = listed(df, most)
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()).replace("</", "<\\/") + "]"


def markdown_rows(ranked: DataFrame, summaries: DataFrame) -> DataFrame:
    """Ranked records by their first topic with what their section shows: rank within the topic, lists cut, at most three keywords of
    each class and ten in all.  Of summaries of one title the last by ``pos`` counts."""
    from ..operators.ranking import top_per_group

    one = summaries.groupBy("paper_title").agg(F.max_by(F.struct(*[c for c in summaries.columns if c != "paper_title"]), "pos").alias("s"))
    topic = F.coalesce(F.get("topic_queries", F.lit(0)), F.lit("Uncategorised"))
    rows = ranked.withColumn("topic", topic).join(one, F.col("title") == F.col("paper_title"), "left")
    ok = F.col("s").isNotNull() & ~F.coalesce(F.col("s.summarization_failed"), F.lit(False))
    said = lambda c: F.when(ok, F.col(f"s.{c}"))
    words = F.slice(F.flatten(F.transform(F.map_values(said("keywords")), lambda v: F.slice(v, 1, 3))), 1, 10)
    cells = {c: said(c) for c in ("research_scope", "core_problem")} | {c: F.slice(said(c), 1, n) for c, n in (("taxonomy", 5), ("main_findings", 3), ("datasets_and_benchmarks", 5))}
    cells |= {"keywords": words, "failure": F.when(F.coalesce(F.col("s.summarization_failed"), F.lit(False)), F.coalesce("s.failure_reason", F.lit("unknown")))}
    placed = top_per_group(rows.withColumns(cells), "topic", 2**31 - 1, F.col("rank"), name="place")
    return placed.select("topic", "place", *[c for c in ("title", "year", "venue", "quality_score", "citation_count", "url", "arxiv_id") if c in ranked.columns], *cells)


def markdown(rows: DataFrame) -> str:
    """:func:`markdown_rows` as one section for each topic, topics in order, with the number of its records."""
    topics: dict[str, list[dict]] = {}
    for r in rows.orderBy("topic", "place").toLocalIterator():
        topics.setdefault(r["topic"], []).append(r.asDict())
    out = ["# Survey report", "", f"*{sum(map(len, topics.values()))} records on {len(topics)} topics*", ""]
    for topic, own in topics.items():
        out += [f"## {topic.title()}", "", f"*{len(own)} records, best first*", ""]
        for r in own:
            facts = {
                "Year": r.get("year") or "unknown", "Venue": r.get("venue") or "unknown", "Quality score": r.get("quality_score"), "Citations": r.get("citation_count"), "Address": r.get("url"),
                "arXiv": r.get("arxiv_id") and f"https://arxiv.org/abs/{r['arxiv_id']}", "Scope": r.get("research_scope"), "Core problem": r.get("core_problem"),
                "Taxonomy": ", ".join(r.get("taxonomy") or []), "Findings": "".join(f"\n  - {x}" for x in r.get("main_findings") or []),
                "Benchmarks": ", ".join(r.get("datasets_and_benchmarks") or []), "Keywords": ", ".join(r.get("keywords") or []), "No summary": r.get("failure"),
            }
            out += [f"### {r['place']}. {r['title']}", "", *(f"- **{k}:** {v}".replace(":** \n", ":**\n") for k, v in facts.items() if v not in (None, "")), ""]
    return "\n".join(out)


def page(title: str, body: str, data: dict[str, str] | None = None) -> str:
    """A page with a preformatted body and embedded data sets."""
    scripts = "".join(f'<script type="application/json" id="{html.escape(k)}">{v}</script>' for k, v in (data or {}).items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><main><pre>{html.escape(body)}</pre></main>{scripts}</body></html>'


def outline(trees: DataFrame, depth: int = 2) -> str:
    """Nested values (label, children) as an indented list."""
    out = []
    for r in trees.toLocalIterator():
        out.append(f"- {r['label']}")
        for c in r["children"] or []:
            out.append(f"  - {c['label']}")
            if depth > 1:
                out += [f"    - {x}" for x in c["children"] or []]
    return "\n".join(out)


def mind_map(root: str, trees: DataFrame, most: int = 6) -> str:
    """Nested values as a mind map in Mermaid's notation."""
    clean = lambda t: re.sub(r"[\[\](){}\"`|#]", " ", t).strip() or "—"
    out = ["mindmap", f"  root(({clean(root)}))"]
    for r in trees.toLocalIterator():
        out.append(f"    {clean(r['label'])}")
        for c in (r["children"] or [])[:most]:
            out.append(f"      {clean(c['label'])}")
            out += [f"        {clean(x)}" for x in (c["children"] or [])[:most]]
    return "\n".join(out)


# How relations are read out.
EDGE_LABELS = {
    "is_subfield_of": "is a subfield of", "part_of": "is part of", "uses": "uses", "applied_to": "is applied to", "evaluated_by": "is evaluated by", "contrasts_with": "contrasts with", "emerged_after": "emerged after",
}


def labelled_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``label``, how their type is read out; a type that isn't known, with spaces for underscores."""
    known = F.create_map(*[F.lit(x) for pair in EDGE_LABELS.items() for x in pair])
    return edges.withColumn("label", F.coalesce(known[F.col("edge_type")], F.replace("edge_type", F.lit("_"), F.lit(" "))))


def graph_diagram(edges: DataFrame, most: int = 24) -> str:
    """At most ``most`` labelled edges (pos, source, target, edge_type; ``label``, if there is one, says how the type is read out) and the
    nodes they use, as a Mermaid graph."""
    rows = edges.orderBy("pos").limit(most).select(
        diagram_label("source").alias("s"), diagram_label("target").alias("t"), (diagram_label("label") if "label" in edges.columns else F.replace("edge_type", F.lit("_"), F.lit(" "))).alias("e")
    ).collect()
    ids = {n: f"n{k}" for k, n in enumerate(dict.fromkeys(x for r in rows for x in (r["s"], r["t"])))}
    return "\n".join(["graph LR", *(f'  {i}["{n}"]' for n, i in ids.items()), *(f"  {ids[r['s']]} -->|{r['e']}| {ids[r['t']]}" for r in rows)])


def design_diagram(design: dict) -> str:
    """Layers and their components, each layer flowing into the next."""
    out, before = ["graph TD"], None
    for k, layer in enumerate(design.get("layers") or []):
        out.append(f'  subgraph L{k}["{layer.get("name", "")}"]')
        out += [f'    L{k}C{j}["{c.get("name", "")}"]' for j, c in enumerate(layer.get("components") or [])]
        out.append("  end")
        if before is not None:
            out.append(f"  L{before} --> L{k}")
        before = k
    return "\n".join(out)


def to_file(text: str | dict, path: str) -> None:
    """Write a finished document; nothing for an empty one."""
    if text:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text if isinstance(text, str) else json.dumps(text, ensure_ascii=False, indent=2))


def outputs(folder: str, most: int = 40) -> dict[str, list[str]]:
    """The newest files of a run's folder by kind, on the driver."""
    from pathlib import Path

    files = sorted((p for p in Path(folder).rglob("*") if p.is_file()), key=lambda p: (-p.stat().st_mtime, str(p)))[:most]
    kinds: dict[str, list[str]] = {}
    for p in files:
        kinds.setdefault(p.suffix.lstrip(".") or "other", []).append(str(p.relative_to(folder)))
    return kinds
