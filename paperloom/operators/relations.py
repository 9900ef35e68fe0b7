"""Coverage counts, gap rules and relation trees over analysed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import resolve


def element(x: Column | str) -> Column:
    """The form in which elements are compared."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def coverage(df: DataFrame, items: str, record: str = "seq", group: str = "topic") -> DataFrame:
    """Per group and element the records that list it, counted once each, and all records of the group."""
    n = df.groupBy(group).agg(F.count_distinct(record).alias("n_records"))
    each = df.select(group, record, F.explode(items).alias("e")).select(group, record, element("e").alias("element")).where("element <> ''").distinct()
    return each.groupBy(group, "element").agg(F.count("*").alias("coverage_count")).join(n, group)


def low_coverage(counts: DataFrame, share: float = 0.3) -> DataFrame:
    """Add low_coverage: fewer records than ``share`` of the group, half-even and 1 at least."""
    return counts.withColumn("low_coverage", F.col("coverage_count") < F.greatest(F.lit(1), F.rint(F.col("n_records") * F.lit(share)).cast("long")))


def deepest(counts: DataFrame, k: int = 3, share: float = 0.3, group: str = "topic") -> DataFrame:
    """Per group the ``k`` most covered elements, and of those with low coverage the ``k`` most covered."""
    flagged = low_coverage(counts, share)
    w = lambda *by: Window.partitionBy(*by).orderBy(F.desc("coverage_count"), "element")
    ranked = flagged.withColumns({"rank": F.row_number().over(w(group)), "rank_low": F.row_number().over(w(group, "low_coverage"))})
    strong = ranked.where(F.col("rank") <= k).select(group, F.lit("deepest").alias("kind"), "rank", "element", "coverage_count")
    weak = ranked.where(F.col("low_coverage") & (F.col("rank_low") <= k)).select(group, F.lit("weakest").alias("kind"), F.col("rank_low").alias("rank"), "element", "coverage_count")
    return strong.unionByName(weak)


def matrix(df: DataFrame, items: str, columns: list[str], record: str = "seq") -> DataFrame:
    """One row for each record, one 0/1 column for each of the given elements."""
    each = df.select(record, F.explode_outer(items).alias("e")).select(record, element("e").alias("e"))
    return each.groupBy(record).agg(*[F.max(F.when(F.col("e") == c, 1).otherwise(0)).alias(c) for c in columns])


def orientations(df: DataFrame, group: str = "topic") -> DataFrame:
    """Records of each orientation."""
    return df.groupBy(group, "orientation").agg(F.count("*").alias("n"))


def frequency_gaps(counts: DataFrame, share: float = 0.3) -> DataFrame:
    """Elements that fewer than ``share`` of the records cover, with an opportunity from 0 to 1."""
    part = F.col("coverage_count") / F.col("n_records")
    return counts.where(part < share).select("topic", F.col("element").alias("gap"), F.lit("frequency").alias("gap_type"), (1 - part).alias("opportunity_score"))


def convergence_gaps(future: DataFrame, covered: DataFrame, least: int = 3) -> DataFrame:
    """Future directions that ``least`` records name and none covers."""
    named = future.where(F.col("coverage_count") >= least)
    return named.join(covered.select("topic", "element"), ["topic", "element"], "left_anti").select(
        "topic", F.col("element").alias("gap"), F.lit("convergence").alias("gap_type"), (F.col("coverage_count") / F.col("n_records")).alias("opportunity_score")
    )


def conflict_gaps(conflicts: DataFrame) -> DataFrame:
    """Conflicting classifications (topic, dimension) as gaps."""
    return conflicts.groupBy("topic", "dimension").agg(F.count("*").alias("n")).select(
        "topic", F.col("dimension").alias("gap"), F.lit("conflict").alias("gap_type"), F.least(F.col("n") / 5.0, F.lit(1.0)).alias("opportunity_score")
    )


def method_links(tasks: DataFrame, families: DataFrame, techniques: DataFrame, most: int = 6) -> DataFrame:
    """task → family → technique in order: tasks (topic, task, pos, method, method_pos) name methods, which are resolved to families
    (topic, name, pos) and repeat once; a family's first ``most`` techniques (topic, family, technique, pos) follow."""
    named = resolve(tasks, families, "method", ["topic"]).where(F.col("resolved").isNotNull())
    once = named.groupBy("topic", "task", F.col("resolved").alias("family")).agg(F.min("pos").alias("task_pos"), F.min("method_pos").alias("family_pos"))
    listed = techniques.groupBy("topic", "family", "technique").agg(F.min("pos").alias("technique_pos"))
    w = Window.partitionBy("topic", "family").orderBy("technique_pos")
    cut = listed.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= most).drop("n_")
    return once.join(cut, ["topic", "family"], "left")


def gap_links(gaps: DataFrame, challenges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gaps with their resolved challenges, and gaps without any.

    gaps: topic, gap, pos, challenges (array); challenges: topic, name, pos.
    """
    refs = gaps.select("topic", "gap", "pos", F.posexplode("challenges").alias("ref_pos", "ref"))
    tied = resolve(refs, challenges, "ref", ["topic"]).where(F.col("resolved").isNotNull())
    links = tied.groupBy("topic", "gap", F.col("resolved").alias("challenge")).agg(F.min("pos").alias("pos"), F.min("ref_pos").alias("ref_pos"))
    return links, gaps.join(links.select("topic", "gap").distinct(), ["topic", "gap"], "left_anti")


def every_link(problems: DataFrame, areas: DataFrame) -> DataFrame:
    """Each core problem of a topic with each of its areas; both are short lists of one report."""
    return problems.join(areas, "topic")


def reverse(links: DataFrame, left: str, right: str, *group: str) -> DataFrame:
    """right → sorted lefts."""
    return links.groupBy(*group, right).agg(F.sort_array(F.collect_set(left)).alias("lefts"))


def with_glossary(items: DataFrame, glossary: DataFrame, name: str = "name") -> DataFrame:
    """Add meaning, looked up by the trimmed, lower-cased term; of repeated terms the last counts."""
    table = glossary.groupBy(F.lower(F.trim("term")).alias("t_")).agg(F.max_by("meaning", "pos").alias("meaning"))
    return items.withColumn("t_", F.lower(F.trim(name))).join(table, "t_", "left").drop("t_")


def tree(links: DataFrame, root: str, child: str, leaf: str, most_children: int = 8, most_leaves: int = 6) -> DataFrame:
    """Rows (root, child, child_pos, leaf, leaf_pos) as one nested value for each root, in order and within limits."""
    leaves = links.where(F.col(leaf).isNotNull()).withColumn("n_", F.row_number().over(Window.partitionBy(root, child).orderBy("leaf_pos"))).where(F.col("n_") <= most_leaves)
    low = leaves.groupBy(root, child).agg(F.sort_array(F.collect_list(F.struct("leaf_pos", F.col(leaf).alias("label")))).alias("x"))
    mid = links.groupBy(root, child).agg(F.min("child_pos").alias("child_pos")).join(low, [root, child], "left")
    mid = mid.withColumn("n_", F.row_number().over(Window.partitionBy(root).orderBy("child_pos"))).where(F.col("n_") <= most_children)
    labels = F.transform(F.coalesce("x", F.array().cast("array<struct<leaf_pos:int,label:string>>")), lambda v: v["label"])
    node = F.struct("child_pos", F.col(child).alias("label"), labels.alias("children"))
    return mid.groupBy(root).agg(F.sort_array(F.collect_list(node)).alias("n")).select(
        F.col(root).alias("label"), F.transform("n", lambda v: F.struct(v["label"].alias("label"), v["children"].alias("children"))).alias("children")
    )
