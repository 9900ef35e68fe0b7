from paperloom.sinks import reports


def test_report(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 1, "A survey of graphs", 2020, 12.5, "emerging", 7), (2, 2, "A review of trees", None, 9.0, None, 0)], "seq long, rank long, title string, year int, quality_score double, authority_tier string, citation_count long")
    s = spark.createDataFrame([(1, "Scope one. Scope 2 follows.", "p", ["t1"], ["f"], ["d"], [], [], {"k": ["v1", "v2", "v3", "v4"]})], "seq long, research_scope string, core_problem string, taxonomy array<string>, main_findings array<string>, datasets_and_benchmarks array<string>, limitations array<string>, future_directions array<string>, keywords map<string,array<string>>")
    j = spark.createDataFrame([(1, "core", "must_read", 5, "foundational", ["s"], ["w"])], "seq long, paper_tier string, recommended_action string, topic_relevance int, authority_assessment string, strengths array<string>, weaknesses array<string>")
    cards = reports.rows(reports.cards(ranked, s, j), "rank")
    assert [c["anchor"] for c in cards] == ["a-survey-of-graphs-2020"] and cards[0]["tags"] == ["v1", "v2", "v3"]
    areas = spark.createDataFrame([(0, "Graph learning", 0, 1), (1, "Soup", 1, 9)], "area_id int, name string, pos int, coverage_count int")
    recs = ranked.selectExpr("seq", "title", "citation_count", "title AS hay", "concat('a', seq) AS anchor").replace("A survey of graphs", "A survey of graph", ["hay"])
    land = reports.rows(reports.landscape(areas, recs, 10), "pos")
    assert [(a["low_coverage"], len(a["records"] or [])) for a in land] == [(True, 1), (False, 0)]
    sections = [
        reports.overview({"bullets": ["One."], "core_problems": [{"name": "P", "description": "d"}]}, [{"kind": "deepest", "element": "m", "coverage_count": 3}], [{"gap": "g", "gap_type": "frequency", "opportunity_score": 0.5}]),
        reports.landscape_section(land), reports.navigator(cards), reports.card_section(cards),
        reports.landmark_section([{"rank": 1, "title": "L", "url": None, "year": 2001, "citation_count": 1000, "mentioned_by": 3, "why_seminal": "first"}]),
        reports.design_section({"overview": "o", "layers": [{"name": "L", "role": "r", "components": [{"name": "c", "description": "x"}]}], "data_flow": ["a"]}),
        reports.reading_section({"steps": [{"step": 2, "paper_title": "B"}, {"step": 1, "paper_title": "A"}]}),
        reports.guide_section({"what_is_this_field": "w", "key_terms": {"k": "v"}}), reports.writing_section({"suggested_title_template": "T", "suggested_sections": ["s"]}),
    ]
    text = reports.report("Graphs", sections)
    for part in ("# Graphs", "> One.", "[A survey of graphs](#a-survey-of-graphs-2020)", "### Graph learning (few surveys)", "1. L (2001), 1,000 citations", "subgraph L0", "- **k** — v", "1. s"):
        assert part in text
    assert text.index("**A**") < text.index("**B**")
    html = reports.page("Graphs", sections, {"papers": ranked})
    assert '<script type="application/json" id="papers">[{"seq":1' in html
    assert "title = {A survey of graphs}" in reports.bibtex(cards)
