"""Duplicate resolution in order of arrival, and merging.

A record joins the earliest-matching leader by DOI, else by arXiv id, else by title, else by fuzzy title (the first leader that
is similar enough), or becomes a leader; only leaders' own keys are ever matched.  So a record leads exactly if none before it
leads and has a key in common with it, which is settled in rounds of joins and aggregates: who is first in all of its keys
leads, whoever shares a key with a new leader follows, and the rest goes on without them.  A key's holders are only ever
reduced to their first, in each task before the shuffle, so that a key (or the empty title) that a large share of the rows has
in common is no burden.  What is open after ``ROUNDS`` rounds are chains of records that each depend on the one before; they
are replayed in order, component by component.  Followers then look up their leader by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy
from ..functions.text import normalized_title
from ..schema import RECORD, present
from ..session import discard, importable, listed, materialize
from .graph import components

#: Least fuzzy ratio, in percent; rounds before chains are replayed.
PERCENT, ROUNDS = 95, 3
#: Groups of characters that are counted.
GROUPS = 16


def counts_of(name: str) -> list[Column]:
    """How often a text has the characters of each of ``GROUPS`` groups, up to 255, eight in a word: count0, count1, …"""

    known, names = "".join(map(chr, range(1, 128))), [chr(ord("a") + k) for k in range(GROUPS)]
    named = F.translate(name, known, "".join(names[ord(c) % GROUPS] for c in known))

    def count(k: int) -> Column:
        return F.least(F.length(named) - F.length(F.replace(named, F.lit(names[k]), F.lit(""))), F.lit(255)).cast("long")

    return [sum((F.shiftleft(count(8 * m + k), 8 * k) for k in range(1, 8)), count(8 * m)).alias(f"count{m}") for m in range(GROUPS // 8)]


@cache
def unspoiled(first: int, last: int, percent: int) -> int:
    """Characters that a title of ``first`` to ``last`` characters, the shorter of a pair of this ratio, has in a row at least that no
    insertion or deletion touches: d of them leave one of d + 1 equal parts as it is.  They are in the other title, too."""
    edits = lambda x: int((200 - 2 * percent) * x / percent + 1e-6)  # noqa: E731  of the shorter's length x, at most
    return min(x // (edits(x) + 1) for x in range(first, min(last, first + 4000) + 1))


def blocked(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Rows (key, n, id, …) of titles (id, title, …): two titles of this ratio have a key in common; n is the length.

    A range of lengths of the shorter one sets how many characters a pair has in common in a row, and so the width of substrings of
    which the least hash of each few neighbours is selected: within these characters both have the same neighbours.  A title is in the
    ranges of its own length and of those that it may be the longer one of.
    """
    titles = batch.column("title").to_pylist()
    n = np.array([len(t) for t in titles], "i8")
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    start = np.cumsum(n) - n
    # a range spans twice the factor between the lengths of a pair, so that a title is in two at most
    bounds = [1]
    while len(n) and bounds[-1] <= n.max():
        bounds.append(bounds[-1] * (200 - percent) ** 2 // percent**2 + 1)
    place = np.searchsorted(bounds, n, "right")
    least = np.searchsorted(bounds, -(-n * percent // (200 - percent)), "right")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        letters = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        letters ^= letters >> np.uint64(31)
        for k in range(1, len(bounds)):
            own = np.flatnonzero((least <= k) & (place >= k) & (n > 0))
            wide = unspoiled(bounds[k - 1], bounds[k] - 1, percent)
            if not len(own) or not wide:  # nothing in a row is certain: all meet
                found.append((own, np.full(len(own), np.uint64(k) * factor)))
                continue
            window = 3 if wide > 6 else 2 if wide > 3 else 1
            width = wide - window + 1
            at = np.concatenate([np.arange(start[i], start[i] + n[i]) for i in own])
            row, own_letters = np.repeat(own, n[own]), letters[at]
            hashes = np.zeros(max(len(at) - width + 1, 0), "u8")
            for j in range(width):
                hashes = hashes * factor + own_letters[j : j + len(hashes)]
            hashes ^= hashes >> np.uint64(29)
            hashes *= np.uint64(0x94D049BB133111EB)
            hashes ^= (hashes >> np.uint64(32)) + np.uint64(k) * factor
            low = hashes[: len(hashes) - window + 1]
            for j in range(1, window):
                low = np.minimum(low, hashes[j : j + len(low)])
            whole = row[: len(low)] == row[wide - 1 : wide - 1 + len(low)]  # windows within a title
            new = whole.copy()
            new[1:] &= (low[1:] != low[:-1]) | ~whole[:-1] | (row[1 : len(low)] != row[: len(low) - 1])
            pick, by = low[new], row[: len(low)][new]
            order = np.lexsort((pick, by))
            pick, by = pick[order], by[order]
            once = np.ones(len(pick), bool)
            once[1:] = (pick[1:] != pick[:-1]) | (by[1:] != by[:-1])
            found.append((by[once], pick[once]))
    rows = np.concatenate([x for x, _ in found]) if found else np.zeros(0, "i8")
    keys = np.concatenate([x for _, x in found]) if found else np.zeros(0, "u8")
    kept = batch.select([c for c in batch.schema.names if c != "title"]).take(pa.array(rows))
    return pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(n[rows]), *kept.columns], ["key", "n", *kept.schema.names])


def triples(titles: list[str], width: int = 1024) -> np.ndarray:
    """How often each title has substrings of three characters, by hash, a row each: an edit takes two at most and adds three, or the reverse."""
    n = np.array([len(t) for t in titles], "i8")
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    row = np.repeat(np.arange(len(n)), n)
    three = (codes[:-2] * np.uint64(961) + codes[1:-1] * np.uint64(31) + codes[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    inside = row[:-2] == row[2:]
    at = row[:-2][inside] * width + (three[inside] % np.uint64(width)).astype("i8")
    return np.bincount(at, minlength=len(n) * width).reshape(len(n), width).astype("i4")


def fuzzy_pairs(titles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, ta, tb), a < b, of rows (id, title) with distinct titles whose ratio is ``percent`` or more; exact.

    Titles of lengths x <= y with ratio r lie within (1 - r)(x + y) insertions and deletions, and y <= x (2 - r) / r.  They meet by
    the keys of :func:`blocked`.  Lengths and counts of characters thin the candidates in the join itself; the ratio is an Arrow UDF
    that compares counts of substrings first and leaves a pair as soon as it can't be reached.
    """
    gap = (100 - percent) / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield blocked(batch.slice(at, 500), percent)

    marks = [f"count{k}" for k in range(GROUPS // 8)]
    rows = titles.select("id", "title", *counts_of("title")).mapInArrow(run, f"key long, n long, id long, {', '.join(f'{m} long' for m in marks)}")
    one, two = rows.toDF("key", "la", "a", *(f"a_{m}" for m in marks)), rows.toDF("key", "lb", "b", *(f"b_{m}" for m in marks))
    budget = F.floor((F.col("la") + F.col("lb")) * gap + 1e-6).cast("int")
    # an edit changes one count of characters by one
    byte = lambda x, k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))
    apart = sum((F.abs(byte(F.col(f"a_{m}"), k) - byte(F.col(f"b_{m}"), k)) for m in marks for k in range(8)), F.lit(0))
    # keys, lengths and counts only: the titles join the candidates, not each of their keys
    pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= budget) & (apart <= budget)).select("a", "b", budget.alias("budget")).distinct()
    near = pairs.join(titles.select(F.col("id").alias("a"), F.col("title").alias("ta")), "a").join(titles.select(F.col("id").alias("b"), F.col("title").alias("tb")), "b")

    @F.pandas_udf(T.BooleanType())
    def close(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = np.zeros(len(a), bool)
            for at in range(0, len(a), 500):
                own, other = list(a[at : at + 500]), list(b[at : at + 500])
                edits = np.array([(100 - percent) * (len(x) + len(y)) // 100 for x, y in zip(own, other, strict=True)], "i8")
                near = np.abs(triples(own) - triples(other)).sum(1) <= 5 * edits
                out[at : at + 500] = [bool(n) and fuzzy.close(x, y, percent) for n, x, y in zip(near, own, other, strict=True)]
            yield pd.Series(out, dtype="bool")

    return near.where(close("ta", "tb")).select("a", "b", "ta", "tb")


def leaders(df: DataFrame, percent: int | None = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """seq and leader (the leading record's seq) of each record; ``percent`` None leaves the fuzzy step out.  ``seq`` is unique.

    Null and empty DOIs and arXiv ids match nothing; a null title counts as the empty one, which is a title like any other.
    """
    importable(df.sparkSession)
    keyed = df.select("seq", present("doi").alias("doi"), present("arxiv_id").alias("arxiv"), F.coalesce(normalized_title("title"), F.lit("")).alias("title"))
    keyed = materialize(keyed, "records")
    # of records with the same three keys none but the first can lead
    firsts = materialize(keyed.groupBy("doi", "arxiv", "title").agg(F.min("seq").alias("seq")), "firsts")
    keys = _keys(firsts, ("doi", "arxiv", "title"))
    near = None
    if percent is not None:
        titles = materialize(keyed.groupBy("title").agg(F.min("seq").alias("id")), "titles")
        pairs = fuzzy_pairs(titles, percent)
        near = materialize(pairs.select(F.concat_ws("-", "a", "b").alias("key"), F.explode(F.array("ta", "tb")).alias("title")), "near")
        keys = keys.unionByName(firsts.join(near, "title").select("seq", F.lit("near").alias("kind"), "key"))
    open_ = materialize(keys, "keys")
    following = None
    for turn in range(rounds + 1):
        held = open_.groupBy("kind", "key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
        if turn == rounds or held.isEmpty():
            break
        ranked = materialize(open_.join(held.drop("n"), ["kind", "key"]), "held")
        leading = ranked.groupBy("seq").agg(F.bool_and(F.col("first") == F.col("seq")).alias("leads")).where("leads").select(F.col("seq").alias("first"))
        found = materialize(ranked.where("seq > first").join(leading, "first", "left_semi").select("seq").distinct(), "following")
        following = found if following is None else following.unionByName(found)
        # leaders and keys without company have nothing left to decide
        rest = ranked.join(leading.withColumnRenamed("first", "seq"), "seq", "left_anti").join(found, "seq", "left_anti").select("seq", "kind", "key")
        rest = materialize(rest, "keys")
        discard(ranked)
        discard(open_)
        open_ = rest
    if not held.isEmpty():
        links = open_.join(held.select("kind", "key", "first"), ["kind", "key"])
        roots = components(links.where("seq <> first").select(F.col("first").alias("a"), F.col("seq").alias("b")))
        chained = open_.join(roots.withColumnRenamed("node", "seq"), "seq").groupBy("root").applyInPandas(_followers, "seq long")
        following = chained if following is None else following.unionByName(chained)
    leading = firsts if following is None else firsts.join(following, "seq", "left_anti")
    leading = materialize(leading, "leading")
    # the first of DOI, arXiv id and title by which an earlier leader is found
    known = _keys(leading, ("doi", "arxiv", "title")).withColumnRenamed("seq", "by")
    own = _keys(keyed, ("doi", "arxiv", "title")).join(known, ["kind", "key"]).where("by <= seq")
    place = F.when(F.col("kind") == "doi", 0).when(F.col("kind") == "arxiv", 1).otherwise(2)
    joined = own.groupBy("seq").agg(F.min_by("by", place).alias("leader"))
    if near is None:
        return joined
    joined = materialize(joined, "joined")
    alike = near.select("key", "title").join(leading.select("title", F.col("seq").alias("by")), "title").select("key", "by", F.col("title").alias("theirs"))
    rest = keyed.select("seq", "title").join(joined, "seq", "left_anti").join(near, "title").join(alike, "key").where("theirs <> title AND by < seq")
    return joined.unionByName(rest.groupBy("seq").agg(F.min("by").alias("leader")))


def _keys(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """seq, kind and key of the keys that records have."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds])
    return rows.select("seq", F.explode(each).alias("x")).select("seq", "x.*").where("key IS NOT NULL")


def _followers(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a component's (seq, kind, key) the records that share a key with an earlier leader."""
    taken: set[tuple[str, str]] = set()
    out = []
    for seq, group in rows.sort_values("seq").groupby("seq"):
        own = set(zip(group["kind"], group["key"], strict=True))
        if taken & own:
            out.append(seq)
        else:
            taken |= own
    return pd.DataFrame({"seq": out}, dtype="int64")


def first_present(name: str, seq: str = "seq") -> Column:
    """Of a group, the value of the first record that has one."""
    return F.min_by(F.col(name), F.when(present(name).isNotNull(), F.col(seq))).alias(name)


def longest(name: str, seq: str = "seq") -> Column:
    """Of a group, the longest text, the first among equals."""
    return F.max_by(F.col(name), F.when(present(name).isNotNull(), F.struct(F.length(name), -F.col(seq)))).alias(name)


def union_of(name: str) -> Column:
    """Of a group, the sorted union of a list column."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col(name))))).alias(name)


def merge(df: DataFrame, by: DataFrame) -> DataFrame:
    """One record for each leader of ``by`` (seq, leader): the first title, first present values, longest abstract, largest counts,
    united lists.  Records that lead alone pass through untouched; merged ones lose what is to be computed anew."""
    rows = df.join(by, "seq")
    sizes = by.groupBy("leader").agg(F.count("*").alias("n"))
    rows = rows.join(sizes, "leader")
    single = rows.where("n = 1").select(*df.columns)
    many = rows.where("n > 1").groupBy("leader").agg(
        F.min_by("title", "seq").alias("title"),
        *[first_present(c) for c in ("year", "venue", "doi", "arxiv_id", "url", "pdf_url", "authors")],
        longest("abstract"),
        *[F.max(c).alias(c) for c in ("citation_count", "influential_citation_count")],
        F.bool_or(F.coalesce("from_top_survey", F.lit(False))).alias("from_top_survey"),
        *[union_of(c) for c in ("sources", "topic_queries", "generated_queries")],
    )
    many = many.withColumns(
        {
            "seq": F.col("leader"),
            "background_citation_count": F.lit(0).cast("long"),
            "canonical_score": F.lit(0.0),
            "authority_tier": F.lit(None).cast("string"),
            "authors": F.coalesce("authors", F.array().cast("array<string>")),
        }
    )
    return single.unionByName(many.select(*df.columns))


def deduplicate(df: DataFrame, percent: int | None = PERCENT) -> DataFrame:
    """Merged records of :data:`RECORD`'s columns, one for each work."""
    assert set(RECORD.names) <= set(df.columns), "records need all columns; see schema.with_defaults"
    return merge(df.select(*RECORD.names), leaders(df, percent))


def first_by(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key: combined before the shuffle, so frequent keys are no burden."""
    row = F.struct(*df.columns)
    return df.groupBy(key.alias("key_")).agg(F.min_by(row, F.struct(*order)).alias("row_")).select("row_.*")


def group_topics(topics: list[str], percent: int = 90) -> list[dict]:
    """Near-equal topic labels as groups of a label and its aliases, on the driver: there are tens.

    A topic joins the first group whose current label it resembles, and takes its place as label if it is longer.
    """
    import re

    from ..functions.text import ABBREVIATIONS

    def spelled(t: str) -> str:
        t = t.lower()
        for short, full in ABBREVIATIONS.items():
            t = re.sub(rf"\b{short}\b", full, t)
        return t

    groups: list[dict] = []
    for topic in topics:
        near = next((g for g in groups if fuzzy.token_sort_ratio(spelled(topic), spelled(g["label"])) >= percent), None)
        if near is None:
            groups.append({"label": topic, "aliases": []})
        elif len(topic) > len(near["label"]):
            near["aliases"].append(near["label"])
            near["label"] = topic
        else:
            near["aliases"].append(topic)
    return groups


def cross_queries(topics: DataFrame, terms: DataFrame) -> DataFrame:
    """Query strings of all topics (seq, topic) and terms (seq, term), both lists of settings; of equal strings the first."""
    both = topics.select(F.col("seq").alias("i_"), "topic").join(listed(terms.select(F.col("seq").alias("j_"), "term")))
    strings = both.withColumn("query_string", F.concat(F.lit('"'), "topic", F.lit('" "'), "term", F.lit('"')))
    return first_by(strings, F.col("query_string"), F.col("i_"), F.col("j_")).select("topic", "query_string", F.col("i_").alias("topic_seq"), F.col("j_").alias("term_seq"))
