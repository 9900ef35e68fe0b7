import json

import pytest
from pyspark.sql import functions as F

from paperloom.config import Settings, load, volume_bound
from paperloom.functions import replies, text
from paperloom.operators import documents, graph, matching, replay
from paperloom.plans import flows
from paperloom.schema import RECORD, with_defaults
from paperloom.sinks import tables
from paperloom.sources import items


@pytest.mark.parametrize(
    ("raw", "fixed"),
    [
        ('{"a": [1, 2], "b": ["ok"], "c": "cut', {"a": [1, 2], "b": ["ok"]}),
        ('{"a": "x, y", "b": [1, 2', {"a": "x, y"}),
        ('{"a": "q\\", {", "b": 1, "c": {"d": [1', {"a": 'q", {', "b": 1}),
        ("no json", None),
        ('{"a": 1', None),
        ("", None),
    ],
)
def test_close_truncated(raw, fixed):
    out = replies.close_truncated(raw)
    assert (None if out is None else json.loads(out)) == fixed


def test_replies_are_coerced(spark):
    rows = [(0, '```json\n{"topic_relevance": 9, "is_survey": true}\n```'), (1, '{"topic_relevance": "x", "paper_tier": " CORE "}'), (2, '{"topic_relevance": null, "strengths": "one"}'), (3, "nothing"), (4, None), (5, '{"topic_relevance": 1, "paper_tier": "core", "recommended_action": "must_read"}')]
    out = {r["k"]: r for r in replay.judgements(spark.createDataFrame(rows, "k int, raw string")).collect()}
    assert [out[k]["topic_relevance"] for k in range(6)] == [5, 3, 3, 3, 3, 1]
    assert (out[0]["paper_tier"], out[1]["paper_tier"], out[5]["paper_tier"], out[5]["recommended_action"]) == ("core", "core", "cut", "skip")
    assert out[2]["strengths"] == ["one"]
    assert [out[k]["judge_failed"] for k in range(6)] == [False, False, False, True, True, False]
    got = replay.summaries(spark.createDataFrame([(0, '{"taxonomy": ["a", "b"], "research_scope": "s", "keywords": {"k": ["v"]}, "limits": "cu')], "k int, raw string")).first()
    assert (got["taxonomy"], got["research_scope"], got["keywords"], got["summarization_failed"]) == (["a", "b"], "s", {"k": ["v"]}, False)


def test_masks_of_the_wrong_shape_are_null(spark):
    df = spark.createDataFrame([(0, "[true, false]"), (1, '{"a": 1}'), (2, "x")], "k int, raw string")
    assert [r["mask"] for r in replay.masks(df).orderBy("k").collect()] == [[True, False], None, None]


def test_items(spark):
    work = {
        "id": "https://openalex.org/W1", "title": " A Survey ", "publication_year": 2021, "doi": "https://doi.org/10.1/x", "cited_by_count": 7,
        "ids": {"arxiv": "https://arxiv.org/abs/2303.12345v2"}, "authorships": [{"author": {"display_name": " Ann "}}, {"author": {"display_name": " "}}],
        "primary_location": None, "best_oa_location": {"pdf_url": "u"}, "abstract_inverted_index": {"b": [1, 4], "a": [0], "c": [1]},
    }
    rows = [("t", "q", json.dumps(work)), ("t", "q", json.dumps({"title": "  "}))]
    (r,) = items.openalex(spark.createDataFrame(rows, "topic string, query string, raw string")).collect()
    assert (r["title"], r["doi"], r["arxiv_id"], r["authors"], r["venue"], r["abstract"], r["citation_count"], r["sources"]) == ("A Survey", "10.1/x", "2303.12345", ["Ann"], None, "a c b", 7, ["openalex"])
    core = [{"title": "C", "yearPublished": y, "authors": [{"name": "A"}, {"name": "A"}], "journals": [{"title": ""}], "publisher": " P ", "arxivId": "1v3", "id": 5} for y in (2020, None, 1999)]
    got = items.core(spark.createDataFrame([("t", "q", json.dumps(c)) for c in core], "topic string, query string, raw string"), 2019, 2021).collect()
    assert sorted((r["year"] or 0) for r in got) == [0, 2020]
    assert (got[0]["authors"], got[0]["venue"], got[0]["arxiv_id"], got[0]["url"]) == (["A"], "P", "1", "https://core.ac.uk/works/5")
    page = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.1v2</id><published>2024-01-01T00:00:00Z</published><title>Two
lines</title><summary>S</summary><author><name>N</name></author><link href="p" title="pdf"/></entry><entry><id>y</id><published>soon</published><title>U</title></entry><entry><id>z</id><published>1990</published><title>Old</title></entry></feed>"""
    entries = items.atom_entries(spark.createDataFrame([("t", "q", page)], "topic string, query string, page string"))
    got = {r["title"]: r for r in items.arxiv(entries, 2020, 2025).collect()}
    assert set(got) == {"Two lines", "U"}
    assert (got["Two lines"]["arxiv_id"], got["Two lines"]["pdf_url"], got["Two lines"]["authors"], got["U"]["year"]) == ("2401.1", "p", ["N"], None)
    s2 = [{"title": "a", "externalIds": {"DOI": "d", "ArXiv": "x"}}, {"title": "b", "externalIds": {"ArXiv": "x"}}, {"title": "c", "url": "u"}]
    got = items.semantic_scholar(spark.createDataFrame([("t", "q", json.dumps(s)) for s in s2], "topic string, query string, raw string")).orderBy("title").collect()
    assert [r["url"] for r in got] == ["https://doi.org/d", "https://arxiv.org/abs/x", "u"]


def test_text(spark):
    df = spark.createDataFrame([("RAG for AIGC: A Survey", "First, e.g. this. Second 2. Third! Fourth? Five. Six. Seven. Eight.")], "t string, p string")
    r = df.select(text.title_signature("t").alias("s"), text.bullets("p", 3).alias("b"), text.expand_abbreviations("t").alias("e"), text.query_variants("t").alias("v"), text.diagram_label(F.lit('a "b" [c] | #1')).alias("l")).first()
    assert (r["s"], r["e"]) == ("ai generated content", "retrieval augmented generation for aigc: a survey")
    assert len(r["b"]) == 3 and r["b"][0] == "First, e.g. this." and r["b"][2].endswith("Eight.")
    assert r["v"][0].startswith("retrieval augmented generation aigc")
    assert r["l"] == "a 'b' (c) / no.1"


def test_document_structure(spark):
    rows = []
    lines = [("Introduction", 20.0), ("body one", 10.0), ("Conclusion", 20.0), ("we end", 10.0), ("Future work", 16.0), ("we go on", 10.0)] + [("filler text", 10.0)] * 12
    for k, (line, size) in enumerate(lines):
        rows += [("p", 1, c, size, 10.0 * k, float(x)) for x, c in enumerate(line)]
    chars = spark.createDataFrame(rows, "paper string, page int, text string, size double, top double, x0 double")
    r = documents.structure(chars).first()
    assert r["sections"] == ["Introduction", "Conclusion"]
    assert [tuple(x) for x in r["subsections"]] in ([("Conclusion", "Future work")], [])
    assert "we end" in r["conclusion_text"]


def test_matching(spark):
    cands = spark.createDataFrame([("q", 1, "Dense Passage Retrieval", 10), ("q", 2, "dense passage retrieval", 90), ("q", 3, "RocketQA improved Dense Passage Retrieval training by many means", 999), ("q", 4, "", 5)], "qid string, cid int, title string, cites int")
    got = matching.best_match(spark.createDataFrame([("q", "Dense passage retrieval"), ("z", "none")], "qid string, query string"), cands).collect()
    assert [(r["qid"], r["cid"]) for r in got] == [("q", 2)]
    recs = spark.createDataFrame([("t", 1, "A Survey of Graph Learning"), ("t", 2, "Vision transformers for medical imaging")], "topic string, seq long, title string")
    frags = spark.createDataFrame([("t", 1, "survey of graph learning"), ("t", 2, "Medical imaging vision transformer"), ("t", 3, "unrelated words entirely"), ("t", 4, " ")], "topic string, fid int, fragment string")
    assert {(r["fid"], r["seq"]) for r in matching.find_records(frags, recs).collect()} >= {(1, 1), (2, 2)}


def test_survey_titles_keep_what_a_limit_cut(spark):
    rows = [(0, 0, k, f"Survey {k}") for k in range(3)] + [(1, 0, k, f"Survey {k}") for k in range(3)]
    got = matching.survey_titles(spark.createDataFrame(rows, "topic_no int, variant_no int, rank int, title string"), 2).collect()
    assert sorted((r["topic_no"], r["title"]) for r in got) == [(0, "Survey 0"), (0, "Survey 1"), (1, "Survey 2")]


def test_components_and_edges(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)] + [(200, k) for k in range(201, 260)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100 and got[259] == 200
    assert graph.components(df.limit(0)).count() == 0


def test_flows(spark, tmp_path):
    rows = [(k, f"A survey of {'abcdefghijklmnopq'[k % 17] * 20}", 2020 + k % 5, "We review retrieval and give a taxonomy.", 10 * k, k, ["retrieval review"]) for k in range(40)]
    df = with_defaults(spark.createDataFrame(rows, "seq long, title string, year int, abstract string, citation_count long, influential_citation_count long, topic_queries array<string>"))
    settings = Settings(min_quality_score=5, venue_scores={"arXiv": 8})
    ranked = flows.fetch(df, settings)
    assert ranked.count() == 17
    none = spark.createDataFrame([], "pass string, key string, raw string, at long")
    out = flows.analyze(ranked, settings, none)
    assert out["papers"].count() == 17
    assert out["pending"].where("pass = 'summary'").count() == 17
    tables.write_jsonl(ranked.drop("topic"), str(tmp_path / "r"))
    tables.write_csv(tables.paper_rows(ranked), str(tmp_path / "c"))
    from paperloom.sources.retrieval import read_records

    again = read_records(spark, str(tmp_path / "r"))
    assert again.count() == 17 and set(RECORD.names) <= set(again.columns)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == list(tables.PAPER_COLUMNS)


def test_sinks(spark):
    links = spark.createDataFrame([("r", "c", 0, "l1", 0), ("r", "c", 0, "l2", 1), ("r", "d", 1, None, None)], "root string, child string, child_pos int, leaf string, leaf_pos int")
    from paperloom.operators import relations

    t = relations.tree(links, "root", "child", "leaf")
    assert tables.outline(t) == "- r\n  - c\n    - l1\n    - l2\n  - d"
    assert tables.mind_map("x", t).splitlines()[:4] == ["mindmap", "  root((x))", "    r", "      c"]
    assert "<\\/script>" in tables.payload(spark.createDataFrame([("</script>",)], "a string"))
    edges = spark.createDataFrame([(0, "a", "b", "is_subfield_of")], "pos int, source string, target string, edge_type string")
    assert "is subfield of" in tables.graph_diagram(edges)
    assert tables.run_name(["A b", "C", "D", "E"], "2026-01-01", {"a-b_c_d_and-1-more_2026-01-01"}) == "a-b_c_d_and-1-more_2026-01-01_2"
    assert tables.design_diagram({"layers": [{"name": "L", "components": [{"name": "C"}]}, {"name": "M"}]}).count("-->") == 1


def test_settings(tmp_path):
    (tmp_path / "topics.yaml").write_text("topics: [a, b]\nyear_from: 2021\nunknown: 1\n")
    (tmp_path / "venues.yaml").write_text("venues:\n  arXiv: 8\n")
    s = load(str(tmp_path / "topics.yaml"), year_to=2025, min_quality_score=0)
    assert (s.topics, s.year_from, s.year_to, s.venue_scores, s.min_quality_score) == (("a", "b"), 2021, 2025, {"arXiv": 8}, 20.0)
    assert volume_bound(s, 3)["upper_bound"] == 3000


def test_long_texts_contained_in_others_meet_by_few_ids(spark):
    """All lengths around the tiers', at all places, in groups, with texts of one letter; against plain containment."""
    import random

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("ab \u00e9") for _ in range(n))
    big = [(g, text(rng.randint(1, 120))) for g in ("x", "y") for _ in range(60)] + [("x", "a" * 200), ("y", "\U0001f600b" * 50)]
    small = []
    for g, b in big:
        for n in (15, 16, 17, 24, 39, 40, 41, 60):
            at = rng.randint(0, max(len(b) - n, 0))
            small.append((rng.choice("xy") if rng.random() < 0.2 else g, b[at : at + n]))
    one, two = spark.createDataFrame(small, "g string, s string"), spark.createDataFrame(big, "g string, b string")
    want = {(g, s, b) for g, s in small for h, b in big if g == h and len(s) >= matching.LONG and s in b}
    got = [tuple(r) for r in matching.contained_long(one, two, ["g"]).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
