import pytest
from pyspark.sql import functions as F

from paperloom.operators import filters, matching
from paperloom.sinks import tables
from paperloom.sources import retrieval


class Echo(retrieval.SearchReader):
    def fetch(self, query):
        if query == "bad":
            raise OSError("no network")
        yield f'{{"title": "{query}"}}'


class EchoSource(retrieval.SearchSource):
    reader_class = Echo

    @classmethod
    def name(cls):
        return "echo"


def test_a_failing_query_contributes_nothing(spark):
    spark.dataSource.register(EchoSource)
    df = spark.read.format("echo").option("source", "s").option("queries", "one\nbad\ntwo").load()
    assert sorted((r["source"], r["query"], r["raw"]) for r in df.collect()) == [("s", "one", '{"title": "one"}'), ("s", "two", '{"title": "two"}')]
    assert df.rdd.getNumPartitions() == 3


def test_cache(spark):
    cols = "source string, query string, year_from int, year_to int, limit int"
    req = spark.createDataFrame([("a", "q1", 1, 2, 3), ("a", "q2", 1, 2, 3)], cols)
    cache = req.where("query = 'q1'").withColumn("key", retrieval.request_key()).select("key", F.lit("raw").alias("raw"), F.lit("2026-01-02").cast("timestamp").alias("cached_at"))
    old = cache.withColumns({"raw": F.lit("older"), "cached_at": F.lit("2026-01-01").cast("timestamp")})
    fresh = retrieval.fresh(cache.unionByName(old), F.lit("2026-01-05").cast("timestamp"), 7)
    hit, miss = retrieval.split_by_cache(req, fresh)
    assert [(r["query"], r["raw"]) for r in hit.collect()] == [("q1", "raw")]
    assert [r["query"] for r in miss.collect()] == ["q2"]
    assert retrieval.fresh(cache, F.lit("2026-03-05").cast("timestamp"), 7).count() == 0


def test_gather_and_templates(spark):
    a = spark.createDataFrame([(0, 0, "A survey", 5), (0, 0, "A paper", 50)], "topic_no int, variant_no int, title string, citation_count int")
    b = spark.createDataFrame([(0, 0, "A review", 5), (0, 0, "Overview", 9)], "topic_no int, variant_no int, title string, citation_count int")
    got = retrieval.gather(a, b).orderBy("rank").collect()
    assert [r["title"] for r in got] == ["Overview", "A survey", "A review"]
    q = retrieval.template_queries(spark.createDataFrame([(0, "RAG")], "seq int, topic string")).collect()
    assert [r["query"] for r in q] == ["RAG survey", "RAG review", "RAG systematic review", "RAG overview", "RAG taxonomy"]


def test_look_up_takes_the_first_source_that_knows(spark):
    q = spark.createDataFrame([("a", "graph networks"), ("b", "tree models")], "qid string, query string")
    one = spark.createDataFrame([("a", 1, "Graph networks", 3)], "qid string, cid int, title string, cites int")
    two = spark.createDataFrame([("a", 7, "Graph networks", 99), ("b", 8, "Tree models", 1)], "qid string, cid int, title string, cites int")
    assert sorted((r["qid"], r["cid"]) for r in matching.look_up(q, one, two).collect()) == [("a", 1), ("b", 8)]


def test_masks_of_the_wrong_length_keep_their_batch(spark):
    df = spark.range(50).withColumnRenamed("id", "seq")
    masks = spark.createDataFrame([(0, [k % 2 == 0 for k in range(20)]), (1, [False] * 19), (2, None)], "batch long, mask array<boolean>")
    kept = sorted(r["seq"] for r in filters.by_masks(df, masks).collect())
    assert kept == [*range(0, 20, 2), *range(20, 50)]


@pytest.mark.parametrize("batch", [True, False])
def test_upsert(spark, batch):
    cols = "seq long, title string, citation_count long, quality_score double, doi string, abstract string, pdf_url string, arxiv_id string"
    old = spark.createDataFrame([(1, "A Title", 5, 1.0, None, "old", None, None)], cols)
    new = spark.createDataFrame([(2, "a  title", 3, 2.0, "d", "new", None, None), (3, "b", 1, 3.0, None, None, None, None)], cols)
    got = {r["seq"]: r for r in tables.upsert_records(old, new if batch else new.where("seq = 2")).collect()}
    assert (got[1]["title"], got[1]["citation_count"], got[1]["quality_score"], got[1]["doi"], got[1]["abstract"]) == ("A Title", 5, 2.0, "d", "old")
    assert (3 in got) == batch
    assert tables.repeated_ids(old.unionByName(old.withColumn("doi", F.lit("d"))).withColumn("doi", F.lit("d"))).count() == 1


def test_outputs(tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.json").write_text("{}")
    assert tables.outputs(str(tmp_path)) == {"md": ["a.md"], "json": ["b/c.json"]}
