"""Retrieval plans over recorded replies: fan-out, caches, and a data source that other services can extend."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import cache_key
from ..operators.ranking import round_robin
from ..schema import RECORD
from ..session import listed


def request_key() -> Column:
    """The key of a search: source, query, years and limit; the topic is no part of it."""
    return cache_key(*[F.col(c) for c in ("source", "query", "year_from", "year_to", "limit")])


def fan_out(queries: DataFrame, sources: list[str], slow: str = "arxiv", slow_queries: int = 5) -> DataFrame:
    """Every query (seq, topic, query) at every source (a short list); the slow source gets few queries, topics in turn."""
    spark = queries.sparkSession
    fast = queries.join(listed(spark.createDataFrame([(s,) for s in sources if s != slow] or [("",)], "source string"))).where("source <> ''")
    if slow not in sources:
        return fast
    return fast.unionByName(round_robin(queries, slow_queries).withColumn("source", F.lit(slow)).select(*fast.columns))


def fresh(cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Entries (key, …, cached_at) not older than ``days``; without a time they are expired; of repeated keys the latest."""
    ok = cache.where(F.col("cached_at") >= now - F.make_dt_interval(F.lit(days)))
    return ok.groupBy("key").agg(F.max_by(F.struct(*[c for c in cache.columns if c != "key"]), "cached_at").alias("r_")).select("key", "r_.*")


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers, with its columns, and those it doesn't."""
    keyed = requests.withColumn("key", request_key())
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def cache_statistics(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits, misses and entries."""
    hit = requests.withColumn("key", request_key()).join(cache.select("key", F.lit(True).alias("hit_")).distinct(), "key", "left")
    return hit.agg(F.count_if(F.col("hit_")).alias("hits"), F.count_if(F.col("hit_").isNull()).alias("misses")).join(cache.agg(F.count("*").alias("entries")))


def gather(*sources: DataFrame) -> DataFrame:
    """Records of several services for one topic (topic_no, variant_no, title, citation_count, …) with a survey's title, the most cited
    first within each variant: rank, ties by source and title."""
    from ..functions.text import any_term
    from ..operators.ranking import place_in_group

    rows = None
    for k, df in enumerate(sources):
        one = df.withColumn("source_", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    good = rows.where(any_term(F.lower("title"), ("survey", "review", "overview", "taxonomy")))
    return place_in_group(good, ["topic_no", "variant_no"], F.desc("citation_count"), F.col("source_"), F.col("title"), name="rank").drop("source_")


def template_queries(topics: DataFrame, terms: tuple[str, ...] = ("survey", "review", "systematic review", "overview", "taxonomy")) -> DataFrame:
    """The queries of topics (seq, topic) for which none were generated."""
    return topics.select("seq", "topic", F.posexplode(F.array(*[F.concat("topic", F.lit(f" {t}")) for t in terms])).alias("place", "query"))


def numbered(*parts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The union of sources with ``seq``: sources in turn, each in a stated order."""
    from ..operators.ranking import with_rank

    order = order or ["title", "url"]
    rows = None
    for k, df in enumerate(parts):
        one = df.withColumn("part_", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    ranked = with_rank(rows, F.col("part_"), *[F.col(c).asc_nulls_last() for c in order], F.xxhash64(*[F.col(c) for c in rows.columns]), name="seq")
    return ranked.select("seq", *[c for c in RECORD.names if c != "seq"])


class SearchPartition(InputPartition):
    def __init__(self, source: str, query: str):
        self.source, self.query = source, query


class SearchReader(DataSourceReader):
    """One partition for each query; a failing query gives no row.  Subclasses say how to ``fetch``."""

    def __init__(self, options):
        self.queries = [q for q in options.get("queries", "").split("\n") if q]
        self.source = options.get("source", "")

    def partitions(self):
        return [SearchPartition(self.source, q) for q in self.queries] or [SearchPartition(self.source, "")]

    def fetch(self, query: str) -> Iterator[str]:
        """Raw items of one query."""
        raise NotImplementedError

    def read(self, partition):
        if not partition.query:
            return
        for raw in attempted(lambda: list(self.fetch(partition.query))) or []:
            yield partition.source, partition.query, raw


# Attempts at a request, and the least and greatest seconds between them.
ATTEMPTS, LEAST_WAIT, MOST_WAIT = 3, 2.0, 15.0


def attempted(call, attempts: int = ATTEMPTS, sleep=time.sleep):
    """What ``call`` returns, tried again after waits that double; None if it fails to the end: a service that fails contributes nothing."""
    for k in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if k + 1 < attempts:
                sleep(min(MOST_WAIT, LEAST_WAIT * 2**k))
    return None


class RecordedReader(SearchReader):
    """Recorded replies: under ``path``, a folder that all executors see, one file for each query, named by its key, with an item a line."""

    def __init__(self, options):
        super().__init__(options)
        self.path = options.get("path", "")

    @staticmethod
    def file(query: str) -> str:
        return hashlib.sha256(query.encode()).hexdigest()[:16] + ".jsonl"

    def fetch(self, query: str) -> Iterator[str]:
        path = Path(self.path) / self.file(query)
        if path.exists():
            with path.open(encoding="utf-8") as lines:
                yield from (x for x in map(str.strip, lines) if x)


class SearchSource(DataSource):
    """``spark.read.format(name)`` over a service; register a subclass with ``reader_class`` set."""

    reader_class: type[SearchReader] = SearchReader

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "source string, query string, raw string"

    def reader(self, schema):
        return self.reader_class(self.options)


class RecordedSource(SearchSource):
    """``spark.read.format("recorded")`` with the options path, source and queries (one a line)."""

    reader_class = RecordedReader

    @classmethod
    def name(cls) -> str:
        return "recorded"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Scored records as JSON lines; blank and malformed lines are dropped, missing fields get their defaults."""
    from pyspark.sql import types as T

    from ..functions.scores import COMPONENTS
    from ..schema import with_defaults

    numbers = [T.StructField(c, T.DoubleType()) for c in ("quality_score", *COMPONENTS, "judge_adjusted_score")]
    schema = T.StructType([*RECORD, *numbers])
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return with_defaults(raw.where(F.col("title").isNotNull()), schema)


# -- searches, files and caches ------------------------------------------------------------------------------------------


def title_search(raw: DataFrame, year_from: int, year_to: int, most: int = 25) -> DataFrame:
    """Replies of a title search (topic, query, raw item): per query the most cited of the wanted years, ties by title."""
    from ..operators.ranking import top_per_group
    from . import items

    found = items.openalex(raw).where(F.col("year").between(year_from, year_to)).withColumn("query_", F.get("generated_queries", F.lit(0)))
    return top_per_group(found, "query_", most, F.desc("citation_count"), F.col("title"), name="rank_").drop("query_", "rank_")


def pages_of(raw: DataFrame, field: str = "results", cursor: str = "$.meta.next_cursor") -> DataFrame:
    """Recorded pages of a service (topic, query, page, raw) as their items (topic, query, raw) and whether a further page follows."""
    each = F.from_json(F.get_json_object("raw", f"$.{field}"), "array<string>")
    rows = raw.withColumns({"more": F.get_json_object("raw", cursor).isNotNull(), "items_": each})
    return rows.select("topic", "query", "page", "more", F.posexplode("items_").alias("place", "raw"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded files: path, length, and whether the content is a PDF by its first bytes; only those are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.coalesce(F.substring("content", 1, 4) == F.lit("%PDF").cast("binary"), F.lit(False)).alias("valid"))


def store(entries: DataFrame, path: str, now: Column | None = None) -> None:
    """Append entries (key, …) to a cache; a later entry of a key replaces an earlier one when they are read."""
    at = F.current_timestamp() if now is None else now
    entries.withColumn("cached_at", at).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest entry of each key; ``schema`` names the columns but cached_at."""
    rows = spark.read.schema(f"{schema}, cached_at timestamp").parquet(path)
    columns = F.struct(*[c for c in rows.columns if c != "key"])
    return rows.groupBy("key").agg(F.max_by(columns, "cached_at").alias("r_")).select("key", "r_.*")


def with_parsed(records: DataFrame, parsed: DataFrame) -> DataFrame:
    """Records with the structure of their parsed file (paper_id, …), null without one; of several the latest by parsed_at."""
    last = parsed.groupBy(F.col("paper_id").alias("seq")).agg(F.max_by(F.struct(*[c for c in parsed.columns if c != "paper_id"]), "parsed_at").alias("parsed"))
    return records.join(last, "seq", "left")


def landmark_candidates(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """Landmarks that a model named for a topic: topic, pos, title, year, why_seminal, mentioned_by; replies that can't be read name none."""
    from ..functions.replies import reply_json

    found = F.try_variant_get(reply_json(raw), "$.landmarks", "array<struct<title:string,year:int,why_seminal:string,mentioned_by:int>>")
    rows = replies.select("topic", F.posexplode(found).alias("pos", "x")).select("topic", "pos", "x.*")
    return rows.where(F.trim(F.coalesce("title", F.lit(""))) != "")
