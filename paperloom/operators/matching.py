"""Matching of names and titles that have no common key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..session import importable, materialize
from ..session import listed as few
from . import terms

# Words that tell nothing about a research area.
AREA_STOPWORDS = (
    "and", "or", "the", "a", "an", "of", "for", "in", "on", "to", "with", "based", "using", "systems", "system", "general", "other", "via",
    "approaches", "approach", "methods", "method",
)

#: Widths and numbers of neighbours of the substrings by which a text is looked for in others, and the least length of a text that has any.
TIERS = ((8, 9), (24, 17))
LONG = sum(TIERS[0]) - 1


def named_like(df: DataFrame, table: DataFrame, name: str, known: str = "name", value: str = "points", pos: str = "pos", otherwise=None) -> DataFrame:
    """Add ``value`` of the entry of ``table`` (known, value, pos) with the same name, else of the first in order that contains
    the name or is contained in it, else ``otherwise``; blank names match nothing.

    Equal names join by hash; each *distinct* remaining name is compared with the table, which is a list of settings, once.
    """
    low = F.lower(F.col(name))
    listed = table.select(F.lower(known).alias("known_"), F.col(value).alias("value_"), F.col(pos).alias("pos_"))
    exact = listed.groupBy("known_").agg(F.min_by("value_", "pos_").alias("exact_"))
    names = df.select(low.alias("low_")).where("low_ <> ''").distinct().join(exact, F.col("low_") == F.col("known_"), "left").drop("known_")
    rest = names.where("exact_ IS NULL").select("low_").join(few(listed), F.contains("low_", F.col("known_")) | F.contains(F.col("known_"), F.col("low_")))
    near = rest.groupBy("low_").agg(F.min_by("value_", "pos_").alias("near_"))
    found = names.join(near, "low_", "left").select("low_", F.coalesce("exact_", "near_", F.lit(otherwise)).alias(value))
    return df.withColumn("low_", low).join(found, "low_", "left").drop("low_")


def contained(small: DataFrame, big: DataFrame, group: list[str]) -> DataFrame:
    """Pairs (group, s, b) of distinct texts ``s`` of ``small`` and ``b`` of ``big`` of a group where ``b`` contains ``s``; exact.

    Each ``s`` is looked for by the rarest of its substrings of three characters (of its length, if it is shorter), so that no more is
    compared than shares it.
    """

    def grams(x: str, k: int) -> Column:
        last = F.greatest(F.length(x) - k + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col(x), i, F.lit(k)))

    large = big.where("b <> ''").select(*group, "b").distinct().withColumn("gram", F.explode(F.array_distinct(F.concat(grams("b", 1), grams("b", 2), grams("b", 3)))))
    usual = large.groupBy(*group, "gram").agg(F.count("*").alias("n_"))
    own = F.when(F.length("s") == 1, grams("s", 1)).when(F.length("s") == 2, grams("s", 2)).otherwise(grams("s", 3))
    each = small.where("s <> ''").select(*group, "s").distinct().withColumn("gram", F.explode(F.array_distinct(own)))
    rarest = each.join(usual, [*group, "gram"], "left").groupBy(*group, "s").agg(F.min_by("gram", F.struct(F.coalesce("n_", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(large, [*group, "gram"]).where(F.contains("b", F.col("s"))).select(*group, "s", "b")


def least_hashes(texts: list[str | None], width: int, window: int) -> list[np.ndarray | None]:
    """Of each text the least hash of each ``window`` neighbouring substrings of ``width`` characters, once, or None if it is shorter than that."""
    wide = width + window - 1
    n = np.array([len(t or "") for t in texts], "i8")
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    low = np.zeros(max(len(codes) - width + 1, 0), "u8")
    for j in range(width):
        low = low * np.uint64(0x9E3779B97F4A7C15) + (codes[j : j + len(low)] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    low ^= low >> np.uint64(31)
    low *= np.uint64(0x94D049BB133111EB)
    low = (low ^ low >> np.uint64(29)).view("i8")
    reach = 1  # neighbours of which the least is known
    while reach < window:
        step = min(reach, window - reach)
        low = np.minimum(low[: max(len(low) - step, 0)], low[step:])
        reach += step
    start = np.cumsum(n) - n
    return [np.unique(low[a : a + k - wide + 1]) if k >= wide else None for a, k in zip(start, n, strict=True)]


def selected(name: str, width: int, window: int) -> Column:
    """:func:`least_hashes` of a column: in one pass over each text, where built-in substrings begin at a long text's start each time."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x for at in range(0, len(texts), 500) for x in least_hashes(list(texts[at : at + 500]), width, window)], dtype="object")

    return run(F.col(name))


def contained_long(small: DataFrame, big: DataFrame, group: list[str]) -> DataFrame:
    """:func:`contained` for texts ``s`` of ``LONG`` characters or more, by ids and hashes; the texts join the candidates only.

    Of each few neighbouring substrings of a text the one with the least hash is selected.  What is selected in ``s`` is so in every text
    that contains it, since the neighbours are the same; so ``s`` is looked for by the rarest of its own.  Longer texts have longer
    substrings to be looked for by, which few others share.
    """
    ids = lambda df, x: df.where(F.length(x) >= LONG).select(*group, x).distinct().withColumn(f"{x}_id", F.unhex(F.md5(x)))
    one, two = ids(small, "s"), ids(big, "b")
    pairs = None
    for k, (width, window) in enumerate(TIERS):
        least, beyond = width + window - 1, sum(TIERS[k + 1]) - 1 if k + 1 < len(TIERS) else None
        own = one.where(F.length("s") >= least) if beyond is None else one.where((F.length("s") >= least) & (F.length("s") < beyond))
        large = two.select(*group, "b_id", F.explode(selected("b", width, window)).alias("gram"))
        usual = large.groupBy(*group, "gram").agg(F.count("*").alias("n_"))
        each = own.select(*group, "s_id", F.explode(selected("s", width, window)).alias("gram"))
        # a text with a selected substring that no other has is in none
        rarest = each.join(usual, [*group, "gram"], "left").groupBy(*group, "s_id").agg(F.min_by("gram", F.struct(F.coalesce("n_", F.lit(0)), "gram")).alias("gram"))
        met = rarest.join(large, [*group, "gram"]).select(*group, "s_id", "b_id")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.join(one, [*group, "s_id"]).join(two, [*group, "b_id"]).where(F.contains("b", F.col("s"))).select(*group, "s", "b")


def resolve(links: DataFrame, names: DataFrame, ref: str, group: list[str] | None = None) -> DataFrame:
    """Add ``resolved``: the name of ``names`` (group, name, pos) that ``ref`` equals up to case, else the first that contains it or
    is contained in it within the group, else null; blank references match by equality only.  Equal texts meet by hash, the others by
    :func:`contained`."""
    group = group or []
    own = names.select(*group, F.col("name").alias("name_"), F.col("pos").alias("pos_"), F.lower(F.trim("name")).alias("low_"))
    refs = links.select(*group, F.col(ref).alias("ref_")).distinct().withColumn("key_", F.lower(F.trim("ref_")))
    first = own.groupBy(*group, "low_").agg(F.min_by("name_", "pos_").alias("name_"), F.min("pos_").alias("pos_"))
    one, two = refs.select(*group, F.col("key_").alias("s")), first.select(*group, F.col("low_").alias("b"))
    inner = contained(one, two, group).select(*group, F.col("s").alias("key_"), F.col("b").alias("low_"))
    outer = contained(two.withColumnRenamed("b", "s"), one.withColumnRenamed("s", "b"), group).select(*group, F.col("b").alias("key_"), F.col("s").alias("low_"))
    same = refs.select(*group, "key_", F.col("key_").alias("low_"))
    pairs = inner.unionByName(outer).unionByName(same).distinct().join(first, [*group, "low_"])
    order = F.struct(F.when(F.col("low_") == F.col("key_"), 0).otherwise(1), "pos_")
    best = pairs.groupBy(*group, "key_").agg(F.min_by("name_", order).alias("resolved"))
    keyed = links.withColumn("key_", F.lower(F.trim(F.col(ref))))
    return keyed.join(best, [*group, "key_"], "left").select(*links.columns, "resolved")


def best_match(queries: DataFrame, candidates: DataFrame, least_set: float = 85, least_sort: float = 70, margin: float = 5) -> DataFrame:
    """For each query (qid, query) the candidate (qid, cid, title, cites) whose words include the query's and that is, among the
    closest titles (within ``margin`` of the best), the most cited; ties go to the lower cid; queries without a match are absent."""
    importable(queries.sparkSession)
    score = fuzzy.columns()
    both = candidates.where(F.trim("title") != "").join(queries, "qid")
    both = both.withColumns({"q_": text.alphanumeric("query"), "t_": text.alphanumeric("title")})
    rated = both.withColumns({"set_": score["token_set_ratio"]("q_", "t_"), "sort_": score["token_sort_ratio"]("q_", "t_")}).where(F.col("set_") >= least_set)
    top = rated.withColumn("top_", F.max("sort_").over(Window.partitionBy("qid"))).where((F.col("top_") >= least_sort) & (F.col("sort_") >= F.col("top_") - margin))
    order = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("cites", F.lit(0))), "cid")
    return top.withColumn("n_", F.row_number().over(order)).where("n_ = 1").select("qid", "query", "cid", "title", "cites")


def alike(fragments: DataFrame, titles: DataFrame, over: float) -> DataFrame:
    """Pairs (topic, f_, seq, n, score) of distinct texts of words of fragments (topic, f_) and titles (topic, t_, seq, n) whose token set
    ratio is more than ``over``; exact.

    Texts of words of nearly the same length meet by length, and an Arrow UDF rates them.  Of others the ratio of all words is at most
    ``over``, so that common words decide: pairs meet by these, and their number and length is all that the score takes.
    """
    size = lambda x: F.length(F.array_join(x, " "))
    one = fragments.withColumn("words", F.array_distinct(F.split("f_", " "))).withColumns({"fn": size(F.col("words")), "fk": F.size("words")})
    two = titles.withColumn("words", F.array_distinct(F.split("t_", " "))).withColumns({"tn": size(F.col("words")), "tk": F.size("words")})
    shorter = 200 * F.least("fn", "tn") > over * (F.col("fn") + F.col("tn"))
    short = one.select("topic", "f_", "fn")
    if over > 0:
        sizes = F.sequence(F.floor(F.col("fn") * (over / (200 - over))), F.ceil(F.col("fn") * ((200 - over) / over)))
        met = short.withColumn("tn", F.explode(sizes.cast("array<int>"))).join(two.select("topic", "t_", "seq", "n", "tn"), ["topic", "tn"])
    else:
        met = short.join(two.select("topic", "t_", "seq", "n", "tn"), "topic")
    near = met.where(shorter).withColumn("score", fuzzy.columns()["token_set_ratio"]("f_", "t_")).select("topic", "f_", "seq", "n", "score")
    asked = one.select("topic", "f_", "fn", "fk", F.explode("words").alias("word"))
    held = two.select("topic", "seq", "n", "tn", "tk", F.explode("words").alias("word"))
    held = held.join(terms.few(asked.select("topic", "word").distinct()), ["topic", "word"], "left_semi")
    shared = asked.join(held, ["topic", "word"]).where(~shorter).groupBy("topic", "f_", "seq", "n", "fn", "fk", "tn", "tk").agg(F.count("*").alias("k"), F.sum(F.length("word") + 1).alias("c"))
    part = lambda x: 200.0 * (F.col("c") - 1) / (F.col("c") - 1 + F.col(x))  # noqa: E731  the common words begin the text
    score = F.when((F.col("k") == F.col("fk")) | (F.col("k") == F.col("tk")), 100.0).otherwise(F.greatest(part("fn"), part("tn")))
    return near.unionByName(shared.select("topic", "f_", "seq", "n", score.alias("score"))).where(F.col("score") > over)


def find_records(fragments: DataFrame, records: DataFrame, least: float = 70, margin: float = 15, long: int = 15) -> DataFrame:
    """For each title fragment (topic, fid, fragment) the record (topic, seq, title) it means, if that is clear.

    A title that equals, or contains or is contained in, the fragment (the contained one over ``long`` characters) wins, first in
    order; these meet by :func:`contained_long`.  For the rest it is the record whose telling words are most alike, if it is ``margin`` ahead of
    the second, by :func:`alike`.
    """
    importable(fragments.sparkSession)
    asked = fragments.where(F.trim("fragment") != "").withColumn("f_", F.lower(F.trim("fragment")))
    known = records.select("topic", "seq", "title", F.lower("title").alias("t_"))
    texts, titles = asked.select("topic", F.col("f_").alias("s")), known.select("topic", F.col("t_").alias("b"))
    within = contained_long if long + 1 >= LONG else contained
    inside = within(texts.where(F.length("s") > long), titles, ["topic"]).select("topic", F.col("s").alias("f_"), F.col("b").alias("t_"))
    around = within(titles.where(F.length("b") > long).withColumnRenamed("b", "s"), texts.withColumnRenamed("s", "b"), ["topic"]).select("topic", F.col("b").alias("f_"), F.col("s").alias("t_"))
    same = texts.select("topic", F.col("s").alias("f_"), F.col("s").alias("t_"))
    first = known.groupBy("topic", "t_").agg(F.min("seq").alias("seq"))
    sure = inside.unionByName(around).unionByName(same).join(first, ["topic", "t_"]).groupBy("topic", "f_").agg(F.min("seq").alias("seq"))
    found = materialize(asked.select("topic", "fid", "f_").join(sure, ["topic", "f_"]).select("topic", "fid", "seq"), "found")
    rest = asked.join(found, ["topic", "fid"], "left_anti").select("topic", "fid", text.title_signature("fragment").alias("f_")).where("f_ <> ''")
    rest = materialize(rest, "rest")
    titled = known.select("topic", "seq", text.title_signature("title").alias("t_")).where("t_ <> ''").groupBy("topic", "t_").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    rated = materialize(alike(materialize(rest.select("topic", "f_").distinct(), "fragments"), materialize(titled, "signatures"), least - margin), "rated")
    w = Window.partitionBy("topic", "f_").orderBy(F.desc("score"), "seq")
    second = F.when(F.col("n") > 1, F.col("score")).otherwise(F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    clear = rated.withColumns({"n_": F.row_number().over(w), "second": second})
    likely = clear.where((F.col("n_") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("second") >= margin)).join(rest, ["topic", "f_"])
    return found.unionByName(likely.select("topic", "fid", "seq"))


def area_tokens(name: Column | str) -> Column:
    """The distinct telling words of an area's name."""
    return F.array_distinct(F.filter(text.words(name), lambda w: (F.length(w) > 2) & ~w.isin(*AREA_STOPWORDS)))


def records_for_areas(areas: DataFrame, records: DataFrame, most: int = 6) -> DataFrame:
    """Per area (area_id, name) the records (seq, citation_count, hay) that share most of its words, then most cited, by
    :func:`terms.most_shared`."""
    wanted = areas.select(F.col("area_id").alias("key"), area_tokens("name").alias("tokens"))
    have = records.select("seq", "citation_count", text.words("hay").alias("tokens"))
    found = terms.most_shared(wanted, have, most)
    return found.select(F.col("key").alias("area_id"), "seq", "overlap", "citation_count", "rank")


def containing(records: DataFrame, wanted: DataFrame, hay: str, most: int | None = None) -> DataFrame:
    """Pairs of terms (term_id, term), a list of settings, and records (seq, hay) that contain them, case aside; per term the first
    ``most`` in order."""
    pairs = records.join(few(wanted), F.contains(F.lower(hay), F.lower("term"))).select("term_id", "term", "seq")
    if most is None:
        return pairs
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("term_id").orderBy("seq"))).where(F.col("rank") <= most)


def mutual(records: DataFrame, wanted: DataFrame, items: str) -> DataFrame:
    """Pairs of terms and records one of whose ``items`` contains the term or is contained in it."""
    low = F.lower("term")
    some = F.exists(F.col(items), lambda x: F.contains(F.lower(x), low) | F.contains(low, F.lower(x)))
    return records.join(few(wanted), some).select("term_id", "term", "seq")


def survey_titles(df: DataFrame, per_topic: int = 12, most_topics: int = 500) -> DataFrame:
    """Of candidates (topic_no, variant_no, rank, title, …) per topic the first ``per_topic`` survey titles by variant and rank.

    A title kept for an earlier topic is not available to a later one, but one that an earlier topic's limit cut off is.  Earlier topics
    keep ``per_topic`` titles each, so of the k-th topic only the first k * ``per_topic`` can matter: ranks are cut there first, in each
    task, and the few rows left are gone through in order in one.  Topics are settings; more than ``most_topics`` are an error.
    """
    key = text.alphanumeric("title")
    good = df.where(text.any_term(F.lower("title"), ("survey", "review", "overview", "taxonomy")) & (key != "")).withColumn("key_", key)
    topics = good.select("topic_no").distinct()
    order = [r[0] for r in topics.orderBy("topic_no").limit(most_topics + 1).collect()]
    if len(order) > most_topics:
        raise ValueError(f"more than {most_topics} topics")
    if not order:
        return good.drop("key_").limit(0)
    first = good.groupBy("topic_no", "key_").agg(F.min_by(F.struct(*df.columns), F.struct("variant_no", "rank")).alias("r")).select("topic_no", "key_", "r.variant_no", "r.rank", "r")
    turn = F.array_position(F.lit(order), F.col("topic_no"))
    place = F.row_number().over(Window.partitionBy("topic_no").orderBy("variant_no", "rank", "key_"))
    short = first.withColumns({"turn": turn, "place": place}).where(F.col("place") <= F.col("turn") * per_topic)
    importable(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for turn, own in rows.sort_values(["turn", "place"]).groupby("turn"):
            kept = [(turn, k) for k in own["key_"] if k not in taken][:per_topic]
            taken |= {k for _, k in kept}
            out += kept
        return pd.DataFrame(out, columns=["turn", "key_"])

    chosen = short.select("turn", "place", "key_").groupBy().applyInPandas(run, "turn long, key_ string")
    return short.join(F.broadcast(chosen), ["turn", "key_"]).select("r.*")


def look_up(queries: DataFrame, *candidates: DataFrame) -> DataFrame:
    """For each query (qid, query) the :func:`best_match` of the first source (candidates) that has one."""
    found = None
    for source in candidates:
        rest = queries if found is None else queries.join(found.select("qid"), "qid", "left_anti")
        one = best_match(rest, source)
        found = one if found is None else found.unionByName(one)
    return found
