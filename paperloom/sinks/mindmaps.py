"""Linked trees and mind maps of a field.

The relations are joined, resolved and ordered in Spark (:mod:`paperloom.operators.relations`); each topic's report is a few dozen
rows, which are encoded as JSON there or rendered here.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Left node of gaps that no challenge motivates.
UNTIED = "Blue-sky ideas"


# -- encodings ---------------------------------------------------------------------------------------------------------


def layer(links: DataFrame, key: str, left_label: str, right_label: str, topic: str = "topic") -> DataFrame:
    """One adjacent layer of a linked tree: topic and a struct of key, leftLabel, rightLabel and links, a mapping of each left node to
    its right nodes.  ``links`` has topic, left, left_pos, right, right_pos; repeated links count once, at their first place."""
    once = links.where("left IS NOT NULL AND right IS NOT NULL").groupBy(topic, "left", "right").agg(F.min("left_pos").alias("left_pos"), F.min("right_pos").alias("right_pos"))
    rights = once.groupBy(topic, "left").agg(F.min("left_pos").alias("left_pos"), F.sort_array(F.collect_list(F.struct("right_pos", "right"))).alias("x"))
    entry = F.struct("left_pos", "left", F.transform("x", lambda v: v["right"]).alias("rights"))
    lefts = rights.groupBy(topic).agg(F.sort_array(F.collect_list(entry)).alias("y"))
    mapping = F.map_from_entries(F.transform("y", lambda v: F.struct(v["left"], v["rights"])))
    return lefts.select(topic, F.struct(F.lit(key).alias("key"), F.lit(left_label).alias("leftLabel"), F.lit(right_label).alias("rightLabel"), mapping.alias("links")).alias("layer"))


def linked_tree(*layers: DataFrame, topic: str = "topic") -> DataFrame:
    """topic and ``data``, the JSON ``{"pairs": [...]}`` of its layers in the given order; a layer without links is left out."""
    rows = None
    for k, one in enumerate(layers):
        placed = one.withColumn("at", F.lit(k))
        rows = placed if rows is None else rows.unionByName(placed)
    pairs = rows.groupBy(topic).agg(F.sort_array(F.collect_list(F.struct("at", F.to_json("layer").alias("json")))).alias("x"))
    return pairs.select(topic, F.concat(F.lit('{"pairs":['), F.array_join(F.transform("x", lambda v: v["json"]), ","), F.lit("]}")).alias("data"))


def field_tree(problems: DataFrame, methods: DataFrame) -> DataFrame:
    """The chain of core problems, areas, methods and techniques.  ``problems``: :func:`relations.every_link`'s rows as (topic, problem,
    problem_pos, area, area_pos); ``methods``: :func:`relations.method_links`' rows (topic, task, task_pos, family, family_pos, technique,
    technique_pos)."""
    named = lambda df, left, right: df.select("topic", F.col(left).alias("left"), F.col(f"{left}_pos").alias("left_pos"), F.col(right).alias("right"), F.col(f"{right}_pos").alias("right_pos"))
    return linked_tree(
        layer(named(problems, "problem", "area"), "problem-area", "Core Problems", "Research Areas"),
        layer(named(methods, "task", "family"), "area-method", "Research Areas", "Methods"),
        layer(named(methods, "family", "technique"), "method-technique", "Methods", "Techniques"),
    )


def problem_tree(challenges: DataFrame, gaps: DataFrame, untied: DataFrame) -> DataFrame:
    """The chain of areas, challenges and gaps.  ``challenges``: topic, area, area_pos, challenge, challenge_pos; ``gaps`` and ``untied``:
    the two results of :func:`relations.gap_links`."""
    one = challenges.select("topic", F.col("area").alias("left"), F.col("area_pos").alias("left_pos"), F.col("challenge").alias("right"), F.col("challenge_pos").alias("right_pos"))
    two = gaps.select("topic", F.col("challenge").alias("left"), F.col("pos").alias("left_pos"), F.col("gap").alias("right"), F.col("pos").alias("right_pos"))
    free = untied.select("topic", F.lit(UNTIED).alias("left"), F.lit(2**31 - 1).alias("left_pos"), F.col("gap").alias("right"), F.col("pos").alias("right_pos"))
    columns = [F.col("left_pos").cast("long").alias("left_pos"), F.col("right_pos").cast("long").alias("right_pos")]
    both = two.select("topic", "left", "right", *columns).unionByName(free.select("topic", "left", "right", *columns))
    return linked_tree(layer(one, "area-challenge", "Research Areas", "Challenges"), layer(both, "challenge-gap", "Challenges", "Research Gaps"))


def chain(data: dict, most_leaves: int = 5) -> list[str]:
    """The first two layers of a linked tree (decoded ``data``) as a list: left nodes, the nodes under them, and what those lead to."""
    pairs = data.get("pairs") or []
    out: list[str] = []
    for left, rights in pairs[0]["links"].items() if pairs else ():
        out.append(f"- **{left}**")
        for x in rights:
            below = pairs[1]["links"].get(x, []) if len(pairs) > 1 else []
            out.append(f"  - {x}" + (f" — {', '.join(below[:most_leaves])}" if below else ""))
    return out


# -- mind maps ---------------------------------------------------------------------------------------------------------


def _cut(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1].rstrip() + "…"


def _badge(count: int | None, n: int) -> str:
    return f" `{count}/{n}`" if count is not None else " `—`"


def citation(record: dict) -> str:
    """One record as a linked title of at most seven words with year and citations."""
    words = record["title"].split()
    title = " ".join(words[:7]) + ("…" if len(words) > 7 else "")
    label = f"**{title}** ({record.get('year') or 'n.d.'})"
    address = record.get("url") or (f"https://arxiv.org/abs/{record['arxiv_id']}" if record.get("arxiv_id") else "")
    cites = f" `{record['citation_count']:,}✱`" if record.get("citation_count") else ""
    return (f"[{label}]({address})" if address else label) + cites


def branch(title: str, nodes: Iterable[dict], n: int, low: int | None = None) -> list[str]:
    """A section of a mind map.  Nodes have a name and, as they like, coverage_count, badges, description, techniques, lines and records;
    those that fewer than ``low`` surveys cover are marked."""
    out: list[str] = []
    for node in nodes:
        if not (node.get("name") or "").strip():
            continue
        count = node.get("coverage_count")
        few = " ⚠️" if low is not None and count is not None and count < low else ""
        badges = "".join(f" `{b}`" for b in node.get("badges") or [] if b)
        out.append(f"- **{_cut(node['name'].strip(), 60)}**{few}{badges}" + (_badge(count, n) if node.get("counted", True) else ""))
        if node.get("description"):
            out.append(f"  - *{node['description'].strip()}*")
        if node.get("techniques"):
            out.append("  - Techniques: " + " ".join(f"`{t}`" for t in node["techniques"][:6]))
        out += [f"  - {x}" for x in node.get("lines") or []]
        out += [f"  - {citation(r)}" for r in node.get("records") or []]
    return [f"## {title}", "", *out, ""] if out else []


# Sections of a mind map, in order.
SECTIONS = (
    ("core_problems", "❓ Core Problems"), ("major_tasks", "📋 Research Areas"), ("method_families", "🔧 Methods"), ("datasets_and_benchmarks", "📊 Benchmarks"),
    ("challenges", "⚡ Challenges"), ("open_gaps", "🔭 Research Gaps"), ("applications", "🌐 Applications"),
)


def mind_map_markdown(topic: str, sections: dict[str, list[dict]], n_surveys: int) -> str:
    """A field as nested Markdown: ``sections`` maps the names of :data:`SECTIONS` to their nodes (see :func:`branch`).

    Fewer than 30 % of the surveys, one at least, count as low coverage of areas, methods and benchmarks.
    """
    low = max(1, round(0.3 * n_surveys))
    out = [f"# {topic}", ""]
    for key, title in SECTIONS:
        plain = key in ("open_gaps", "applications")
        nodes = [x | {"counted": not plain} for x in sections.get(key) or []]
        out += branch(title, nodes, n_surveys, low if key in ("major_tasks", "method_families", "datasets_and_benchmarks") else None)
    return "\n".join(out)


def nested_list(markdown: str) -> str:
    """Headings and indented items as nested lists of a page; emphasis, code and links are kept."""
    out, depth = [], 0
    for line in markdown.splitlines():
        m = re.match(r"(#+) (.*)|( *)- (.*)", line)
        if not m:
            continue
        level = len(m[1]) if m[1] else 3 + len(m[3]) // 2
        text = html.escape(m[2] if m[1] else m[4], quote=False)
        text = re.sub(r"\[([^]]*)\]\(([^)\s\"]*)\)", lambda x: f'<a href="{html.escape(x[2])}" target="_blank" rel="noopener">{x[1]}</a>' if re.match("https?:|#", x[2]) else x[1], text)
        text = re.sub(r"\*\*(.+?)\*\*", r"<b>\1</b>", text)
        text = re.sub(r"(?<!\*)\*([^*]+)\*", r"<i>\1</i>", text)
        text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
        while depth < level:
            out.append("<ul>")
            depth += 1
        while depth > level:
            out.append("</ul>")
            depth -= 1
        out.append(f"<li>{text}</li>")
    return "".join([*out, "</ul>" * depth])


def mind_map_page(topic: str, markdown: str) -> str:
    """A page that needs nothing from elsewhere: the mind map as nested lists that fold at a click, and its Markdown."""
    fold = "document.querySelectorAll('li').forEach(li=>{const u=li.nextElementSibling;if(u&&u.tagName==='UL'){li.style.cursor='pointer';li.onclick=()=>{u.hidden=!u.hidden}}})"
    source = markdown.replace("</", "<\\/")
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(topic)} — Mind Map</title></head><body>'
        f'<main>{nested_list(markdown)}</main><script type="text/markdown" id="source">{source}</script><script>{fold}</script></body></html>'
    )


def fallback_graph(topic: str, branches: dict[str, list[dict]], others: Iterable[str] = (), n_surveys: int = 0, most: int = 6) -> str:
    """A plain Mermaid graph for a topic without a drawn mind map: ``branches`` (label → nodes with name and coverage_count), at most
    ``most`` nodes each, those of low coverage marked, and labels that stand by themselves."""
    low = max(1, round(0.3 * n_surveys))
    name = lambda x: re.sub(r"[^A-Za-z0-9]+", "_", x) or "_"
    label = lambda x, width: _cut(x, width).replace('"', "'")
    out = ["graph TD", f'    Field["{label(topic, 35)}"]']
    for title, nodes in branches.items():
        out.append(f'    Field --> {name(title)}["{title}"]')
        for x in nodes[:most]:
            few = " ⚠️" if (x.get("coverage_count") or 0) < low else ""
            out.append(f'    {name(title)} --> {name(x["name"])}["{label(x["name"], 28)}{few}"]')
    out += [f'    Field --> {name(x)}["{x}"]' for x in others]
    return "\n".join(out)


def drawn(reply: str | None) -> str | None:
    """The diagram of a mind-map reply: its text without fences where that is a mind map or a graph, else None (use the fallback)."""
    body = re.sub(r"^\s*```(?:mermaid)?\s*|\s*```\s*$", "", reply or "").strip()
    return body if re.match(r"(mindmap|graph|flowchart)\b", body) else None
