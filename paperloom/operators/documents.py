"""Structure of parsed documents: lines from characters, headings, sections and their text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import importable

#: Pages read; distance within which characters share a line; characters of a heading; lines and characters of collected text.
PAGES, TOLERANCE, HEADING, LINES, WIDTH = 40, 4, 120, 20, 3000
# Headings of conclusions and of future work.
CONCLUSION = r"(?i)^(conclusion|conclusions|summary and conclusion|concluding remarks?)\b"
FUTURE = r"(?i)^(future work|future directions?|limitations and future|open problems?)\b"


def lines(chars: DataFrame) -> DataFrame:
    """Lines of characters (paper, page, text, size, top, x0): paper, page, pos, line, size (the largest).

    A line ends where a character lies more than ``TOLERANCE`` from the line's *first* row, so pages are read in order, one group each.
    """
    importable(chars.sparkSession)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(row=(page["top"].fillna(0) / 2).round() * 2, x0=page["x0"].fillna(0)).sort_values(["row", "x0"], kind="stable")
        out, first = [], None
        for row, text, size in zip(page["row"], page["text"].fillna(""), page["size"].fillna(0), strict=True):
            if first is None or abs(row - first) > TOLERANCE:
                first = row
                out.append([[], 0.0])
            out[-1][0].append(text)
            out[-1][1] = max(out[-1][1], size)
        key = page[["paper", "page"]].iloc[0]
        return pd.DataFrame([(key["paper"], key["page"], k, "".join(t), s) for k, (t, s) in enumerate(out)], columns=["paper", "page", "pos", "line", "size"])

    return chars.where(F.col("page") <= PAGES).groupBy("paper", "page").applyInPandas(run, "paper string, page int, pos int, line string, size double")


def sizes_at(values: DataFrame, group: str, size: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics without interpolation: the element at floor(n * share) of each group's sorted sizes.

    Equal sizes are counted first; the window runs over distinct sizes.
    """
    steps = values.groupBy(group, size).agg(F.count("*").alias("k_"))
    upto = Window.partitionBy(group).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumns({"upto_": F.sum("k_").over(upto), "n_": F.sum("k_").over(Window.partitionBy(group))})
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("upto_") > F.floor(F.col("n_") * F.lit(s)), F.col(size))).alias(n) for n, s in shares.items()])


def classified(text: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add kind (section, subsection or body) and section (the heading above) to lines; ``sizes`` has p85 and p90 of each paper.

    Lines of one paper are a bounded group: a document's first pages.
    """
    t = text.join(sizes, "paper").withColumn("line", F.trim("line")).where(F.length("line") >= 2)
    short = F.length("line") < HEADING
    t = t.withColumn("level", F.when(short & (F.col("size") >= F.col("p90")), 1).when(short & (F.col("size") >= F.col("p85")), 2).otherwise(3))
    w = Window.partitionBy("paper").orderBy("page", "pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # a lower heading before any section is one itself
    t = t.withColumn("kind", F.when(F.col("level") == 3, "body").when((F.col("level") == 1) | (F.coalesce(F.min("level").over(before), F.lit(3)) == 3), "section").otherwise("subsection"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("line")), ignorenulls=True).over(upto))
    # what the last heading that says so has switched on
    ends, later = F.col("line").rlike(CONCLUSION), F.col("line").rlike(FUTURE)
    head = F.col("level") == 1
    t = t.withColumns(
        {
            "in_conclusion": F.coalesce(F.last(F.when(head, ends).when((F.col("level") == 2) & later, F.lit(False)), ignorenulls=True).over(upto), F.lit(False)),
            "in_future": F.coalesce(F.last(F.when(head, later).when((F.col("level") == 2) & later, F.lit(True)), ignorenulls=True).over(upto), F.lit(False)),
        }
    )
    return t.drop("p85", "p90")


def collected(t: DataFrame, flag: str, out: str) -> DataFrame:
    """Per paper the first lines of body text under a flag, joined and cut."""
    own = t.where((F.col("kind") == "body") & F.col(flag))
    first = own.withColumn("n_", F.row_number().over(Window.partitionBy("paper").orderBy("page", "pos"))).where(F.col("n_") <= LINES)
    ordered = first.groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("n_", "line"))).alias("x"))
    return ordered.select("paper", F.substring(F.array_join(F.transform("x", lambda v: v["line"]), " "), 1, WIDTH).alias(out))


def structure(chars: DataFrame) -> DataFrame:
    """paper, sections, subsections, conclusion_text and future_work_text of documents given by their characters."""
    own = chars.where(F.col("page") <= PAGES)
    t = classified(lines(own), sizes_at(own.where(F.col("size") > 4), "paper", "size", {"p85": 0.85, "p90": 0.90}))
    in_order = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("page", "pos", "section", "line")))), lambda v: v)
    heads = t.where("kind <> 'body'").groupBy("paper").agg(
        F.transform(in_order("section"), lambda v: v["line"]).alias("sections"),
        F.transform(in_order("subsection"), lambda v: F.struct(v["section"].alias("section"), v["line"].alias("line"))).alias("subsections"),
    )
    return heads.join(collected(t, "in_conclusion", "conclusion_text"), "paper", "left").join(collected(t, "in_future", "future_work_text"), "paper", "left")


def captions(tables: DataFrame, most: int = 20, width: int = 120) -> DataFrame:
    """Per paper the first rows of its tables (paper, pos, cells) as captions."""
    text = tables.select("paper", "pos", F.substring(F.trim(F.array_join(F.filter("cells", lambda c: c.isNotNull() & (c != "")), " ")), 1, width).alias("caption"))
    cut = text.where("caption <> ''").withColumn("n_", F.row_number().over(Window.partitionBy("paper").orderBy("pos"))).where(F.col("n_") <= most)
    return cut.groupBy("paper").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_", "caption"))), lambda v: v["caption"]).alias("captions"))
