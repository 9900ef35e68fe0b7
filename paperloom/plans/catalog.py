"""Named queries: every operator family over the driver's tables, with the same thing as DuckDB SQL where SQL can express it.

Stand-ins for records: customers (orders are citations, nations topics), parts (line items are citations, brands topics) and documents
(first line is the title, text the abstract, source the venue, language the topic).  The reference year is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import replies, scores, text
from ..functions.numbers import round_half_up
from ..operators import dedup, documents, filters, graph, matching, ranking, relations, replay
from ..schema import with_defaults
from ..session import importable
from ..sinks import mindmaps, tables
from ..sources import items, retrieval
from ..streaming import ingest

YEAR = 2001
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf}/{name}.parquet")


# -- stand-ins -----------------------------------------------------------------------------------------------------------


def customers(spark, sf) -> DataFrame:
    counts = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("citation_count"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("influential_citation_count"))
    c = read(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("seq"), F.col("n_name").alias("topic"), (1995 + F.col("c_custkey") % 7).cast("int").alias("year"), "citation_count", "influential_citation_count", (F.col("c_custkey") % 10 == 0).alias("from_top_survey"))


CUSTOMERS = """
cust AS (SELECT c_custkey AS seq, n_name AS topic, (1995 + c_custkey % 7)::INT AS year, count(*) AS citation_count,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS influential_citation_count, c_custkey % 10 = 0 AS from_top_survey
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""


def parts(spark, sf) -> DataFrame:
    counts = read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("citation_count"), F.count_if(F.col("l_returnflag") == "R").alias("influential_citation_count"))
    p = read(spark, sf, "part").join(counts, F.col("p_partkey") == F.col("l_partkey"))
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("topic"), (1995 + F.col("p_partkey") % 7).cast("int").alias("year"), "citation_count", "influential_citation_count")


PARTS = """
parts AS (SELECT p_partkey AS seq, p_brand AS topic, (1995 + p_partkey % 7)::INT AS year, count(*) AS citation_count,
  count(*) FILTER (WHERE l_returnflag = 'R') AS influential_citation_count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"""


def papers(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"),
        F.col("lang").alias("topic"), F.array("lang").alias("topic_queries"), F.array("source").alias("sources"), F.col("n_chars").alias("citation_count"),
    )


PAPERS = """
papers AS (SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, text AS abstract, source AS venue, lang AS topic, n_chars AS citation_count
  FROM documents)"""


def half_up(x: str, places: int) -> str:
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


RATE = f"citation_count / greatest({YEAR} - coalesce(nullif(year, 0), {YEAR - 1}) + 1, 1)"
SHARE = "influential_citation_count / greatest(citation_count, 1)"
CITATION = half_up(
    f"CASE WHEN {RATE} >= 500 THEN 8.0 WHEN {RATE} >= 200 THEN 6.4 WHEN {RATE} >= 50 THEN 4.8 WHEN {RATE} >= 20 THEN 3.2 WHEN {RATE} >= 5 THEN 2.0 ELSE {half_up(f'least(1.6, ln(1 + {RATE}) * 0.8)', 2)} END::DOUBLE"
    f" + CASE WHEN {SHARE} >= 0.5 THEN 12.0 WHEN {SHARE} >= 0.3 THEN 9.0 WHEN {SHARE} >= 0.15 THEN 6.0 WHEN {SHARE} >= 0.05 THEN 3.0 ELSE 0.0 END::DOUBLE",
    2,
)
RECENCY = f"CASE WHEN year IS NULL THEN 0 WHEN {YEAR} - year <= 1 THEN 10 WHEN {YEAR} - year = 2 THEN 8 WHEN {YEAR} - year = 3 THEN 6 WHEN {YEAR} - year = 4 THEN 4 WHEN {YEAR} - year = 5 THEN 2 ELSE 0 END::DOUBLE"


def canonical_sql(name: str) -> str:
    scaled = lambda c: f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 0.5::DOUBLE ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
    return f"""
{name}_rates AS (SELECT *, ({SHARE})::DOUBLE AS share_, ({RATE})::DOUBLE AS rate_ FROM {name}),
{name}_canonical AS (SELECT * EXCLUDE (share_, rate_), {half_up(f"{scaled('share_')} * 0.6::DOUBLE + {scaled('rate_')} * 0.4::DOUBLE", 4)} AS canonical_score
  FROM {name}_rates WINDOW w AS (PARTITION BY topic))"""


SCORED_CUSTOMERS = f"""{CUSTOMERS},{canonical_sql('cust')},
s1 AS (SELECT *, {CITATION} AS citation_score, {RECENCY} AS recency_score, {half_up('least(20.0::DOUBLE, canonical_score * 20)', 2)} AS canonical_score_component FROM cust_canonical),
scored AS (SELECT *, {half_up('least(citation_score + recency_score + canonical_score_component, 100.0::DOUBLE)', 2)} AS quality_score FROM s1)"""


def scored_customers(spark, sf) -> DataFrame:
    c = ranking.canonical_scores(customers(spark, sf), YEAR)
    c = c.withColumns({"citation_score": scores.citation_score(YEAR), "recency_score": scores.recency_score(YEAR), "canonical_score_component": scores.canonical_component()})
    return c.withColumn("quality_score", scores.total(F.col("citation_score"), F.col("recency_score"), F.col("canonical_score_component")))


def tiers_sql(name: str) -> str:
    return f"""
{name}_r AS (SELECT *, ({RATE})::DOUBLE AS rate_, ({YEAR} - coalesce(nullif(year, 0), {YEAR - 1})) AS age_ FROM {name}),
{name}_t AS (SELECT topic, list_sort(list(rate_), 'DESC') AS l, count(*) AS n FROM {name}_r GROUP BY topic),
{name}_b AS (SELECT topic, l[greatest(0, round_even(n * 0.10, 0)::INT - 1) + 1] AS t10, l[greatest(0, round_even(n * 0.25, 0)::INT - 1) + 1] AS t25 FROM {name}_t),
{name}_tiers AS (SELECT {name}_r.* EXCLUDE (rate_, age_), CASE WHEN age_ >= 4 AND rate_ >= t10 THEN 'foundational' WHEN age_ BETWEEN 1 AND 4 AND rate_ >= t25 THEN 'current_standard'
  WHEN age_ <= 2 THEN 'emerging' END AS authority_tier FROM {name}_r JOIN {name}_b USING (topic))"""


# -- scores, tiers, ranks ------------------------------------------------------------------------------------------------


@query(f"WITH {SCORED_CUSTOMERS} SELECT seq, topic, canonical_score, citation_score, recency_score, canonical_score_component, quality_score, row_number() OVER (ORDER BY quality_score DESC, seq) AS rank FROM scored")
def q_quality_rank(spark, sf):
    c = ranking.quality_rank(scored_customers(spark, sf))
    return c.select("seq", "topic", "canonical_score", "citation_score", "recency_score", "canonical_score_component", "quality_score", "rank")


@query(f"WITH {PARTS},{canonical_sql('parts')} SELECT seq, topic, canonical_score FROM parts_canonical")
def q_canonical_score(spark, sf):
    return ranking.canonical_scores(parts(spark, sf), YEAR).select("seq", "topic", "canonical_score")


@query(f"WITH {PARTS},{tiers_sql('parts')} SELECT seq, topic, authority_tier FROM parts_tiers")
def q_tiers(spark, sf):
    return ranking.tiers(parts(spark, sf), YEAR).select("seq", "topic", "authority_tier")


@query(f"WITH {PARTS},{tiers_sql('parts')} SELECT coalesce(authority_tier, 'none') AS tier, count(*) AS n FROM parts_tiers GROUP BY 1")
def q_tier_counts(spark, sf):
    return ranking.tier_counts(ranking.tiers(parts(spark, sf), YEAR))


@query(f"WITH {PARTS} SELECT seq, {CITATION} AS citation_score, {half_up(SHARE, 4)} AS influential_ratio FROM parts")
def q_citation_score(spark, sf):
    return parts(spark, sf).select("seq", scores.citation_score(YEAR).alias("citation_score"), round_half_up(scores.influential_ratio(), 4).alias("influential_ratio"))


@query(f"WITH {CUSTOMERS} SELECT seq, {RECENCY} AS recency_score FROM cust")
def q_recency_score(spark, sf):
    return customers(spark, sf).select("seq", scores.recency_score(YEAR).alias("recency_score"))


TERMS = ("the", "tion", "ent", "which", "eau", "tation the", "ung")


def _hits(c: str) -> str:
    return " + ".join(f"contains({c}, '{t}')::INT" for t in TERMS)


@query(
    f"WITH {PAPERS} SELECT seq, least(({_hits('lower(title)')}) * 10 + ({_hits('lower(abstract)')}) * 3, 15)::DOUBLE AS survey_signal_score,"
    f" least(({_hits('''lower(title || ' ' || abstract)''')}) * 2, 15)::DOUBLE AS structure_signal_score FROM papers"
)
def q_signal_scores(spark, sf):
    return papers(spark, sf).select("seq", scores.survey_signal(TERMS).alias("survey_signal_score"), scores.structure_signal(TERMS).alias("structure_signal_score"))


VENUES = {"src12": 20, "SRC1": 18, "rc7": 15, "archive src3 of records": 13}


@query(
    f"""WITH {PAPERS} SELECT seq, CASE WHEN coalesce(venue, '') = '' THEN 0 WHEN lower(venue) = 'src12' THEN 20 WHEN lower(venue) = 'src1' THEN 18
    WHEN contains(lower(venue), 'src12') OR contains('src12', lower(venue)) THEN 20 WHEN contains(lower(venue), 'src1') OR contains('src1', lower(venue)) THEN 18
    WHEN contains(lower(venue), 'rc7') OR contains('rc7', lower(venue)) THEN 15
    WHEN contains(lower(venue), 'archive src3 of records') OR contains('archive src3 of records', lower(venue)) THEN 13 ELSE 5 END::DOUBLE AS venue_score FROM papers"""
)
def q_venue_score(spark, sf):
    return papers(spark, sf).select("seq", scores.venue_score(VENUES).alias("venue_score"))


@query(
    """WITH v(name, points, pos) AS (VALUES ('src12', 20.0::DOUBLE, 0), ('SRC1', 18.0, 1), ('rc7', 15.0, 2), ('archive src3 of records', 13.0, 3)),
    m AS (SELECT doc_id, min_by(points, struct_pack(k := CASE WHEN lower(source) = lower(name) THEN 0 ELSE 1 END, pos := pos)) AS points
      FROM documents JOIN v ON source <> '' AND (lower(source) = lower(name) OR contains(lower(source), lower(name)) OR contains(lower(name), lower(source))) GROUP BY doc_id)
    SELECT doc_id AS seq, coalesce(points, 5.0::DOUBLE) AS points FROM documents LEFT JOIN m USING (doc_id)"""
)
def q_venue_join(spark, sf):
    table = spark.createDataFrame([(n, float(p), k) for k, (n, p) in enumerate(VENUES.items())], "name string, points double, pos int")
    return matching.named_like(papers(spark, sf), table, "venue", otherwise=5.0).select("seq", F.coalesce("points", F.lit(5.0)).alias("points"))


@query(f"WITH {SCORED_CUSTOMERS} SELECT seq, quality_score FROM scored WHERE quality_score >= 14 OR from_top_survey")
def q_min_score_rescue(spark, sf):
    return filters.by_score_or_rescue(scored_customers(spark, sf), 14).select("seq", "quality_score")


@query(f"WITH {SCORED_CUSTOMERS} SELECT seq, row_number() OVER (ORDER BY from_top_survey DESC, quality_score DESC, seq) AS priority FROM scored QUALIFY priority <= 60")
def q_priority_window(spark, sf):
    c = ranking.curated_first(ranking.quality_rank(scored_customers(spark, sf)))
    return c.where(F.col("priority") <= ranking.summarize_window(0, 10**9, 60)).select("seq", "priority")


@query(
    f"""WITH {CUSTOMERS},{tiers_sql('cust')}, a AS (SELECT *, (['must_read', 'worth_reading', 'optional', 'skip'])[(seq % 4)::INT + 1] AS act FROM cust_tiers)
    SELECT topic, seq, row_number() OVER (PARTITION BY topic ORDER BY CASE authority_tier WHEN 'foundational' THEN 1 WHEN 'current_standard' THEN 2 WHEN 'emerging' THEN 3 ELSE 4 END,
      CASE act WHEN 'must_read' THEN 1 WHEN 'worth_reading' THEN 2 WHEN 'optional' THEN 3 ELSE 4 END, seq) AS place FROM a QUALIFY place <= 10"""
)
def q_reading_order(spark, sf):
    acts = F.array(*[F.lit(a) for a in ("must_read", "worth_reading", "optional", "skip")])
    c = ranking.tiers(customers(spark, sf), YEAR).withColumn("recommended_action", F.element_at(acts, (F.col("seq") % 4 + 1).cast("int")))
    return ranking.reading_order(c, 10).select("topic", "seq", "place")


@query(f"WITH {PARTS} SELECT topic, seq, citation_count, row_number() OVER (PARTITION BY topic ORDER BY citation_count DESC, seq) AS rank FROM parts QUALIFY rank <= 5")
def q_topk_per_group(spark, sf):
    return ranking.top_per_group(parts(spark, sf), "topic", 5, F.desc("citation_count"), F.col("seq")).select("topic", "seq", "citation_count", "rank")


@query(
    """WITH t AS (SELECT o_orderpriority AS topic, o_orderkey AS seq, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn,
      min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS s FROM orders) SELECT topic, seq FROM t ORDER BY rn, s LIMIT 12"""
)
def q_round_robin(spark, sf):
    return ranking.round_robin(read(spark, sf, "orders").select(F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("seq")), 12)


@query(
    f"""WITH {PARTS}, r AS (SELECT topic, seq, citation_count, row_number() OVER w AS n, coalesce(lead(citation_count) OVER w, 0) AS second FROM parts
      WINDOW w AS (PARTITION BY topic ORDER BY citation_count DESC, seq)) SELECT topic, seq, citation_count, second::DOUBLE AS second FROM r WHERE n = 1"""
)
def q_runner_up(spark, sf):
    return ranking.runner_up(parts(spark, sf), "topic", "citation_count", F.col("seq")).select("topic", "seq", "citation_count", F.col("second").cast("double").alias("second"))


@query(
    f"""WITH {CUSTOMERS},{tiers_sql('cust')}, a AS (SELECT *, (['foundational', 'current_standard', 'emerging', 'not_a_survey'])[(seq % 4)::INT + 1] AS assessment FROM cust_tiers)
    SELECT seq, authority_tier, assessment AS authority_assessment FROM a WHERE authority_tier IS NOT NULL AND assessment <> 'not_a_survey' AND assessment <> authority_tier"""
)
def q_tier_conflicts(spark, sf):
    said = F.array(*[F.lit(a) for a in ("foundational", "current_standard", "emerging", "not_a_survey")])
    c = ranking.tiers(customers(spark, sf), YEAR).withColumn("authority_assessment", F.element_at(said, (F.col("seq") % 4 + 1).cast("int")))
    return ranking.tier_conflicts(c).select("seq", "authority_tier", "authority_assessment")


@query("SELECT * FROM (SELECT p_brand AS topic, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size END DESC, p_partkey) AS place FROM part)")
def q_coverage_order(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("coverage_count"))
    return ranking.coverage_order(p, "topic", pos="seq").select("topic", "seq", "place")


@query("SELECT p_brand AS topic, p_partkey AS seq, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 7 <> 0 THEN p_retailprice END DESC NULLS LAST, p_partkey) AS place FROM part")
def q_gap_order(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("opportunity_score"))
    return ranking.gap_order(p, pos="seq").select("topic", "seq", "place")


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'Uncategorised' ELSE lang END AS topic, count(*) AS n_records FROM documents GROUP BY 1")
def q_records_per_topic(spark, sf):
    none = F.array().cast("array<string>")
    d = read(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 == 0, none).otherwise(F.array(F.col("lang"), F.lit("other"))).alias("topic_queries"))
    return ranking.per_topic(d)


@query(
    """SELECT 0 AS step, 'judge' AS name, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS failed FROM labels
    UNION ALL SELECT 1, 'summary', count(*), count(*) FILTER (WHERE toxic = 1 AND doc_id % 2 = 0) FROM labels"""
)
def q_failure_counts(spark, sf):
    rows = read(spark, sf, "labels")
    unknown = F.when(F.col("doc_id") % 2 == 0, F.col("toxic") == 1)
    return ranking.failures({"judge": (rows.withColumn("judge_failed", F.col("quality") == 0), "judge_failed"), "summary": (rows.withColumn("summarization_failed", unknown), "summarization_failed")})


# -- filters -------------------------------------------------------------------------------------------------------------

TOPICS = ("the Tion of ent", "AI for umlauts: zu ver", "eau qui zzzz yyyy", "of the a", "xxqq wwzz")


def _relevance_sql(topic: str) -> str:
    import re

    tokens = [t for t in re.findall("[a-z0-9]+", topic.lower()) if t not in text.STOPWORDS and len(t) > 1]
    return " + ".join(f"contains(h, '{t}')::INT" for t in tokens) + f" >= 0.5 * {len(tokens)}" if tokens else "true"


@query(
    f"WITH {PAPERS}, h AS (SELECT seq, lower(title || ' ' || abstract) AS h FROM papers) SELECT seq FROM h WHERE CASE seq % 5 "
    + " ".join(f"WHEN {k} THEN {_relevance_sql(t)}" for k, t in enumerate(TOPICS))
    + " END"
)
def q_topic_filter(spark, sf):
    topics = F.array(*[F.lit(t) for t in TOPICS])
    p = papers(spark, sf).withColumn("topic_queries", F.array(F.element_at(topics, (F.col("seq") % 5 + 1).cast("int"))))
    return filters.by_topic(p).select("seq")


@query(f"WITH {PAPERS} SELECT seq FROM papers WHERE contains(lower(title || ' ' || abstract), 'zug') OR contains(lower(title || ' ' || abstract), 'mente.') OR contains(lower(title || ' ' || abstract), '(xy)')")
def q_signal_filter(spark, sf):
    return filters.by_signal(papers(spark, sf), ("zug", "mente.", "(xy)")).select("seq")


JUDGED = """
j AS (SELECT d.doc_id AS seq, 50.0::DOUBLE AS quality_score, l.quality = 1 AS is_survey, l.toxic = 1 AS is_domain_specific,
  CASE WHEN l.doc_id IS NOT NULL THEN 1 + d.doc_id % 5 END AS rel, d.doc_id % 11 = 0 AS failed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
k AS (SELECT *, CASE WHEN rel IS NULL THEN NULL WHEN rel <= 1 THEN 'cut' WHEN NOT is_survey OR rel = 2 OR is_domain_specific THEN 'marginal' WHEN rel >= 4 THEN 'core' ELSE 'useful' END AS tier FROM j)"""


def judged(spark, sf) -> DataFrame:
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("lid"), (F.col("quality") == 1).alias("is_survey"), (F.col("toxic") == 1).alias("is_domain_specific"))
    d = read(spark, sf, "documents").join(labels, F.col("doc_id") == F.col("lid"), "left")
    rel = F.when(F.col("lid").isNotNull(), (1 + F.col("doc_id") % 5).cast("int"))
    facts = [F.col("is_survey"), F.col("is_domain_specific"), F.col("topic_relevance")]
    d = d.select(F.col("doc_id").alias("seq"), F.lit(50.0).alias("quality_score"), "is_survey", "is_domain_specific", rel.alias("topic_relevance"), (F.col("doc_id") % 11 == 0).alias("judge_failed"))
    return d.withColumn("paper_tier", F.when(F.col("topic_relevance").isNotNull(), scores.demote(scores.derive_tier(*facts), *facts)))


@query(f"WITH {JUDGED} SELECT seq, tier AS paper_tier FROM k WHERE rel IS NULL OR failed OR (rel >= 3 AND tier IN ('core', 'useful') AND NOT is_domain_specific)")
def q_judge_gate(spark, sf):
    return filters.judge_gate(judged(spark, sf), 3, "useful", True).select("seq", "paper_tier")


@query(
    f"""WITH {JUDGED}, a AS (SELECT *, (['must_read', 'worth_reading', 'optional', 'skip', 'other'])[(seq % 5)::INT + 1] AS act FROM k)
    SELECT seq, quality_score + CASE WHEN rel IS NULL OR failed THEN 0 ELSE CASE act WHEN 'must_read' THEN 40 WHEN 'worth_reading' THEN 20 WHEN 'skip' THEN -100 ELSE 0 END + (rel - 3) * 10 END AS judge_adjusted_score,
      row_number() OVER (ORDER BY judge_adjusted_score DESC, seq) AS rank FROM a"""
)
def q_judge_rerank(spark, sf):
    acts = F.array(*[F.lit(a) for a in ("must_read", "worth_reading", "optional", "skip", "other")])
    j = judged(spark, sf).withColumn("recommended_action", F.element_at(acts, (F.col("seq") % 5 + 1).cast("int")))
    return ranking.quality_rank(ranking.judged_scores(j), "judge_adjusted_score").select("seq", "judge_adjusted_score", "rank")


@query("SELECT d.doc_id AS seq FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_unjudged_kept(spark, sf):
    return filters.unjudged(papers(spark, sf), read(spark, sf, "labels").select(F.col("doc_id").alias("seq"))).select("seq")


@query(
    """WITH r AS (SELECT doc_id AS seq, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents), n AS (SELECT floor(p / 20) AS batch, count(*) AS n FROM r GROUP BY 1)
    SELECT seq FROM r JOIN n ON batch = floor(p / 20) WHERE batch % 3 = 1 OR n.n <> 20 OR (p % 20) % 2 = 0"""
)
def q_batch_mask(spark, sf):
    # batches 0, 3, … have a mask of the right length, 1, 4, … one that is too short, 2, 5, … again a right one
    d = ranking.with_rank(read(spark, sf, "documents").select(F.col("doc_id").alias("seq")), F.col("seq"), name="at").withColumn("at", F.col("at") - 1)
    mask = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 2 == 0)
    masks = d.select(F.floor(F.col("at") / 20).alias("batch")).distinct().withColumn("mask", F.when(F.col("batch") % 3 == 1, mask(7)).otherwise(mask(20)))
    return filters.by_masks(d, masks, 20, "at").select("seq")


@query(
    """WITH q AS (SELECT o_custkey AS topic, o_orderkey AS seq, o_orderstatus = 'F' AS keep FROM orders), c AS (SELECT topic, count(*) AS n, count(*) FILTER (WHERE keep) AS k FROM q GROUP BY 1)
    SELECT q.topic, seq FROM q JOIN c USING (topic) WHERE n <= 3 OR k < 5 OR keep"""
)
def q_valid_queries(spark, sf):
    q = read(spark, sf, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("keep"))
    return filters.valid_queries(q).select("topic", "seq")


@query(
    """WITH c AS (SELECT o_orderpriority AS topic, o_orderkey AS seq, 'T' || (o_custkey % 40) AS title, (o_custkey % 5)::INT AS mentioned_by, floor(o_totalprice + 0.5)::BIGINT AS cites FROM orders),
    g AS (SELECT *, row_number() OVER (PARTITION BY topic, lower(title) ORDER BY seq) AS copy FROM c WHERE mentioned_by >= 2 AND cites >= 100000)
    SELECT topic, title, mentioned_by, cites AS citation_count, row_number() OVER (PARTITION BY topic ORDER BY mentioned_by DESC, cites DESC, seq) AS rank FROM g WHERE copy = 1 QUALIFY rank <= 8"""
)
def q_landmarks(spark, sf):
    whole = F.floor(F.col("o_totalprice") + 0.5).cast("long")
    c = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("T"), F.col("o_custkey") % 40).alias("title"), (F.col("o_custkey") % 5).cast("int").alias("mentioned_by"), whole.alias("citation_count"))
    return filters.landmarks(c, 2, 100000, 8).select("topic", "title", "mentioned_by", "citation_count", "rank")


@query(
    f"""WITH {JUDGED}, a AS (SELECT seq, seq % 40 AS topic, CASE WHEN seq % 40 < 20 THEN (['must_read', 'optional', 'worth_reading'])[(seq % 3)::INT + 1] ELSE 'optional' END AS act FROM k WHERE NOT failed),
    b AS (SELECT *, bool_or(act <> 'optional') OVER (PARTITION BY topic) AS any_act FROM a) SELECT topic, seq FROM b WHERE act <> 'optional' OR NOT any_act"""
)
def q_actionable(spark, sf):
    acts = F.array(*[F.lit(a) for a in ("must_read", "optional", "worth_reading")])
    topic = F.col("seq") % 40
    j = judged(spark, sf).withColumns({"topic": topic, "recommended_action": F.when(topic < 20, F.element_at(acts, (F.col("seq") % 3 + 1).cast("int"))).otherwise("optional")})
    return filters.actionable(j).select("topic", "seq")


@query("SELECT c_nationkey AS topic, count(*) AS n_valid FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1 HAVING count(*) >= 38")
def q_comparable_topics(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("topic"), (F.col("c_custkey") % 3 == 0).alias("analysis_failed"))
    return filters.comparable_topics(c, 38)


@query(
    f"""WITH {PAPERS}, a AS (SELECT * FROM papers WHERE contains(lower(title || ' ' || abstract), 'tion')), b AS (SELECT * FROM a WHERE contains(lower(title || ' ' || abstract), 'the '))
    SELECT 0 AS step, 'retrieved' AS name, count(*) AS n FROM papers UNION ALL SELECT 1, 'on topic', count(*) FROM a UNION ALL SELECT 2, 'with signal', count(*) FROM b UNION ALL SELECT 3, 'unique', count(DISTINCT abstract) FROM b"""
)
def q_funnel(spark, sf):
    p = papers(spark, sf)
    a = filters.by_signal(p, ("tion",))
    b = filters.by_signal(a, ("the ",))
    return ranking.funnel({"retrieved": p, "on topic": a, "with signal": b, "unique": dedup.first_by(b, F.col("abstract"), F.col("seq"))})


# -- text ----------------------------------------------------------------------------------------------------------------

ASCII = "regexp_replace(title, '[^\\x20-\\x7e]', ' ', 'g')"


def ascii_title(spark, sf) -> DataFrame:
    return papers(spark, sf).withColumn("title", F.regexp_replace("title", r"[^\x20-\x7e]", " "))


@query(
    f"""WITH {PAPERS}, a AS (SELECT seq, {ASCII} AS title FROM papers) SELECT seq, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS normalized_title,
    array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS alphanumeric FROM a"""
)
def q_norm_title(spark, sf):
    return ascii_title(spark, sf).select("seq", text.normalized_title("title").alias("normalized_title"), text.alphanumeric("title").alias("alphanumeric"))


def _drop_sql(tokens: str, stop: tuple[str, ...]) -> str:
    return f"list_filter({tokens}, lambda t: length(t) > 1 AND t NOT IN ({', '.join(repr(s) for s in stop)}))"


@query(
    f"""WITH {PAPERS}, a AS (SELECT seq, regexp_extract_all(lower({ASCII}), '[a-z0-9]+') AS w FROM papers)
    SELECT seq, array_to_string({_drop_sql('w', text.TITLE_STOPWORDS)}, ' ') AS signature, array_to_string({_drop_sql('w', text.STOPWORDS)}, ' ') AS tokens FROM a"""
)
def q_title_signature(spark, sf):
    return ascii_title(spark, sf).select("seq", text.title_signature("title").alias("signature"), F.array_join(text.topic_tokens("title"), " ").alias("tokens"))


@query(
    f"""WITH {PAPERS}, a AS (SELECT seq, {ASCII} AS title FROM papers), w AS (SELECT seq, title, regexp_split_to_array(trim(title), '\\s+') AS w, regexp_extract_all(lower(title), '[a-z0-9]+') AS t FROM a)
    SELECT seq, CASE WHEN length(title) > 40 THEN substr(title, 1, 39) || '…' ELSE title END AS cut, CASE WHEN len(w) > 4 THEN array_to_string(w[1:4], ' ') || '…' ELSE title END AS short,
    concat_ws('-', array_to_string(t[1:6], '-'), 'nd') AS anchor, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM w"""
)
def q_slugs(spark, sf):
    return ascii_title(spark, sf).select(
        "seq", text.truncate("title", 40).alias("cut"), text.short_title("title", 4).alias("short"), text.anchor("title", F.lit(None).cast("int")).alias("anchor"), text.paper_slug("title").alias("slug")
    )


def _guarded_sql(x: str) -> str:
    for a in text.NO_STOP:
        x = f"replace({x}, '{a}', '{a}')".replace(f", '{a}')", ", '" + a.replace(".", "' || chr(1) || '") + "')")
    return x


@query(
    f"""WITH g AS (SELECT conv_id, turn, {_guarded_sql("trim(regexp_replace(text, '\\s+', ' ', 'g'))")} AS t FROM conversations),
    s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]) ([A-Z0-9])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') AS s FROM g)
    SELECT conv_id, turn, CASE WHEN s IS NULL THEN NULL WHEN len(s) <= 6 THEN array_to_string(s, chr(10)) ELSE array_to_string(list_append(s[1:5], array_to_string(s[6:], ' ')), chr(10)) END AS bullets FROM s"""
)
def q_sentence_bullets(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.bullets("text"), "\n").alias("bullets"))


@query("SELECT doc_id AS seq, sha256(concat_ws('|', source, coalesce(text, ''), n_chars::VARCHAR)) AS key, substr(sha256(coalesce(text, '')), 1, 16) AS response_key FROM documents")
def q_cache_key(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("seq"), text.cache_key(F.col("source"), F.col("text"), F.col("n_chars")).alias("key"), text.response_key(F.col("text")).alias("response_key"))


@query(
    """WITH w AS (SELECT doc_id AS seq, string_split(substr(regexp_replace(text, '[^\\x20-\\x7e]', ' ', 'g'), 1), ' ') AS ws FROM documents)
    SELECT seq, array_to_string(list_filter(ws, lambda x: x <> ''), ' ') AS abstract FROM w WHERE len(list_filter(ws, lambda x: x <> '')) > 0"""
)
def q_inverted_index(spark, sf):
    """Texts as inverted indexes, built within the row from the sorted words, and read back."""
    words = F.array_remove(F.split(F.regexp_replace("text", r"[^\x20-\x7e]", " "), " "), "")
    placed = F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("seq"), placed.alias("s")).where(F.size("s") > 0)
    rows = rows.select("seq", "s", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 OR get(s, i).w <> get(s, i - 1).w)").alias("r"))
    entry = "struct(get(s, a).w, transform(slice(s, a + 1, coalesce(get(r, j + 1), size(s)) - a), x -> x.p))"
    return rows.select("seq", F.expr(f"map_from_entries(transform(r, (a, j) -> {entry}))").alias("index")).select("seq", items.abstract_of(F.col("index")).alias("abstract"))


@query("SELECT event_id, (regexp_extract(props, '\"k\": *([0-9]+)', 1))::INT AS k FROM events")
def q_json_parse(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages"""
)
def q_page_fields(spark, sf):
    return read(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")
    )


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (regexp_extract(props, '([0-9]+)', 1))::INT WHEN 1 THEN (regexp_extract(props, '([0-9]+)', 1))::INT WHEN 2 THEN 1 END AS k FROM events"""
)
def q_reply_repair(spark, sf):
    """Replies that are plain, fenced, cut off, or no JSON at all."""
    p = F.col("props")
    raw = F.when(F.col("event_id") % 4 == 0, p).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"k": 1, "text": "cut, of'), F.lit(""))).otherwise("sorry, no")
    return read(spark, sf, "events").select("event_id", replies.int_of(replies.reply_json(raw), "k").alias("k"))


#: Beginnings that, before the names of parts, make topics with acronyms, fillers and abbreviations.
VARIANT_TOPICS = ("Agentic RAG Systems ", "LLM ", "the systems ", "", "AI and ML for ")


def _variants_sql() -> str:
    """Word by word in DuckDB: spelled out, with acronyms, and without the leading word if over three remain."""
    table = lambda acronyms: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in acronyms.items()) + "}"
    spelled = "lower(topic)"
    for short, full in text.ABBREVIATIONS.items():
        spelled = f"regexp_replace({spelled}, '\\b{short}\\b', '{full}', 'g')"
    drop = lambda x: _drop_sql(x, text.QUERY_FILLER)
    return f"""WITH t AS (SELECT DISTINCT ([{', '.join(f"'{t}'" for t in VARIANT_TOPICS)}])[(p_partkey % 5)::INT + 1] || p_name AS topic FROM part), w AS (SELECT topic, regexp_extract_all(lower(topic), '[a-z0-9]+') AS w FROM t),
    x AS (SELECT topic, {drop("flatten(list_transform(w, lambda a: string_split(coalesce(" + table(text.QUERY_ACRONYMS) + "[a], a), ' ')))")} AS full_, {drop("w")} AS short FROM w),
    v AS (SELECT topic, [CASE WHEN len(full_) > 0 THEN array_to_string(full_, ' ') || ' survey' END, CASE WHEN len(short) > 0 THEN array_to_string(short, ' ') || ' survey' END,
      CASE WHEN len(full_) > 3 THEN array_to_string(full_[2:], ' ') || ' survey' END] AS v FROM x),
    u AS (SELECT topic, [v[1], CASE WHEN v[2] <> coalesce(v[1], '') THEN v[2] END, CASE WHEN v[3] <> coalesce(v[1], '') AND v[3] <> coalesce(v[2], '') THEN v[3] END] AS u FROM v)
    SELECT topic, array_to_string(list_filter(u, lambda x: x IS NOT NULL), '|') AS variants, {spelled} AS expanded FROM u"""


@query(_variants_sql())
def q_query_variants(spark, sf):
    begin = F.element_at(F.array(*[F.lit(t) for t in VARIANT_TOPICS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    topics = read(spark, sf, "part").select(F.concat(begin, "p_name").alias("topic")).distinct()
    return topics.select("topic", F.array_join(text.query_variants("topic"), "|").alias("variants"), text.expand_abbreviations("topic").alias("expanded"))


# -- joins and matching --------------------------------------------------------------------------------------------------


@query(
    """WITH areas AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, unnest(list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: length(w) > 2))) AS token FROM areas),
    h AS (SELECT p_partkey AS seq, p_size AS citation_count, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'))) AS token FROM part),
    o AS (SELECT name AS area_id, seq, citation_count, count(*) AS overlap FROM t JOIN h USING (token) GROUP BY ALL)
    SELECT area_id, seq, overlap, row_number() OVER (PARTITION BY area_id ORDER BY overlap DESC, citation_count DESC, seq) AS rank FROM o QUALIFY rank <= 6"""
)
def q_token_overlap(spark, sf):
    p = read(spark, sf, "part")
    areas = p.select(F.col("p_name").alias("area_id"), F.col("p_name").alias("name")).distinct()
    records = p.select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("citation_count"), F.concat_ws(" ", "p_name", "p_type").alias("hay"))
    return matching.records_for_areas(areas, records).select("area_id", "seq", "overlap", "rank")


CONTAINED = ((0, "Thing"), (1, "eau"), (2, "mente "), (3, "zzzz"), (4, "ung."))


@query(
    f"""WITH terms(term_id, term) AS (VALUES {', '.join(f"({k}, '{t}')" for k, t in CONTAINED)}), {PAPERS}
    SELECT term_id, seq, row_number() OVER (PARTITION BY term_id ORDER BY seq) AS rank FROM papers JOIN terms ON contains(lower(abstract), lower(term)) QUALIFY rank <= 6"""
)
def q_contains_join(spark, sf):
    terms = importable(spark).createDataFrame(list(CONTAINED), "term_id int, term string")
    return matching.containing(papers(spark, sf), terms, "abstract", 6).select("term_id", "seq", "rank")


@query(
    """WITH terms(term_id, term) AS (VALUES (0, 'Red Bolt and more'), (1, 'ring'), (2, 'OLD'), (3, 'none')) SELECT term_id, p_partkey AS seq FROM part JOIN terms
    ON contains(lower(p_name), lower(term)) OR contains(lower(term), lower(p_name)) OR contains(lower(p_type), lower(term)) OR contains(lower(term), lower(p_type))"""
)
def q_mutual_join(spark, sf):
    terms = importable(spark).createDataFrame([(0, "Red Bolt and more"), (1, "ring"), (2, "OLD"), (3, "none")], "term_id int, term string")
    return matching.mutual(read(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.array("p_name", "p_type").alias("items")), terms, "items").select("term_id", "seq")


@query(
    """WITH names AS (SELECT p_brand AS topic, p_name AS name, min(p_partkey) AS pos FROM part GROUP BY ALL),
    links AS (SELECT p_brand AS topic, p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN '' ELSE 'no such name' END AS ref FROM part),
    b AS (SELECT topic, ref, min_by(name, struct_pack(k := CASE WHEN lower(name) = lower(ref) THEN 0 ELSE 1 END, pos := pos)) AS resolved FROM (SELECT DISTINCT topic, ref FROM links) JOIN names USING (topic)
      WHERE ref <> '' AND (contains(lower(name), lower(ref)) OR contains(lower(ref), lower(name))) GROUP BY ALL)
    SELECT seq, topic, ref, resolved FROM links LEFT JOIN b USING (topic, ref)"""
)
def q_name_resolution(spark, sf):
    p = read(spark, sf, "part")
    names = p.groupBy(F.col("p_brand").alias("topic"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    k = F.col("p_partkey") % 4
    ref = F.when(k == 0, F.upper("p_name")).when(k == 1, F.split_part("p_name", F.lit(" "), F.lit(1))).when(k == 2, "").otherwise("no such name")
    links = p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("topic"), ref.alias("ref"))
    return matching.resolve(links, names, "ref", ["topic"]).select("seq", "topic", "ref", "resolved")


@query()
def q_best_match(spark, sf):
    """Parts whose names answer the types' queries best."""
    p = read(spark, sf, "part")
    queries = p.select(F.col("p_brand").alias("qid")).distinct().withColumn("query", F.lit("red bolt"))
    candidates = p.select(F.col("p_brand").alias("qid"), F.col("p_partkey").alias("cid"), F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "survey")).alias("title"), F.col("p_size").alias("cites"))
    return matching.best_match(queries, candidates)


@query()
def q_find_records(spark, sf):
    """Title fragments of documents, looked for among documents of the same source."""
    p = papers(spark, sf).select(F.col("venue").alias("topic"), "seq", "title")
    fragments = p.select("topic", F.col("seq").alias("fid"), F.substring("title", 10, 60).alias("fragment"))
    return matching.find_records(fragments, p)


@query(
    """WITH t(i, topic) AS (SELECT r_regionkey, r_name FROM region), s(j, term) AS (VALUES (0, 'survey'), (1, 'review'), (2, 'survey'))
    SELECT topic, '"' || topic || '" "' || term || '"' AS query_string, min_by(j, j) AS term_seq FROM t, s GROUP BY topic, query_string"""
)
def q_cross_product(spark, sf):
    topics = read(spark, sf, "region").select(F.col("r_regionkey").alias("seq"), F.col("r_name").alias("topic"))
    terms = spark.createDataFrame([(0, "survey"), (1, "review"), (2, "survey")], "seq int, term string")
    return dedup.cross_queries(topics, terms).select("topic", "query_string", "term_seq")


@query(
    """WITH q AS (SELECT o_orderkey AS seq, o_orderpriority AS topic, 'q' || o_custkey AS query FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seq) AS n, min(seq) OVER (PARTITION BY topic) AS s FROM q)
    SELECT seq, source FROM q, (VALUES ('openalex'), ('core')) v(source) UNION ALL (SELECT seq, 'arxiv' FROM r ORDER BY n, s LIMIT 5)"""
)
def q_fan_out(spark, sf):
    q = read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("topic"), F.concat(F.lit("q"), "o_custkey").alias("query"))
    return retrieval.fan_out(q, ["openalex", "core", "arxiv"]).select("seq", "source")


def _survey_titles_sql(topics: int, most: int) -> str:
    """Topic by topic: what is kept for one is not available to those after it."""
    parts = ["c AS (SELECT (p_size % 4)::INT AS topic_no, (p_partkey % 3)::INT AS variant_no, p_partkey AS rank, 'A survey of ' || p_name AS title, array_to_string(regexp_extract_all(lower('A survey of ' || p_name), '[a-z0-9]+'), ' ') AS k FROM part)"]
    for t in range(topics):
        taken = "".join(f" AND k NOT IN (SELECT k FROM t{u})" for u in range(t))
        parts.append(f"f{t} AS (SELECT * FROM c WHERE topic_no = {t}{taken} QUALIFY row_number() OVER (PARTITION BY k ORDER BY variant_no, rank) = 1), t{t} AS (SELECT * FROM f{t} ORDER BY variant_no, rank LIMIT {most})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT topic_no, variant_no, rank, title FROM t{t}" for t in range(topics))


@query(_survey_titles_sql(4, 12))
def q_survey_titles(spark, sf):
    """Candidates of topics that share titles: what one topic keeps, the next cannot have."""
    p = read(spark, sf, "part")
    c = p.select((F.col("p_size") % 4).alias("topic_no"), (F.col("p_partkey") % 3).cast("int").alias("variant_no"), F.col("p_partkey").alias("rank"), F.concat(F.lit("A survey of "), "p_name").alias("title"))
    return matching.survey_titles(c, 12)


# -- duplicates ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS seq, min(doc_id) OVER (PARTITION BY text) AS leader FROM documents")
def q_dedup_exact(spark, sf):
    p = with_defaults(papers(spark, sf)).withColumn("doi", F.md5("abstract")).withColumn("title", F.col("seq").cast("string"))
    return dedup.leaders(p, None)


@query()
def q_dedup_multikey(spark, sf):
    """Three keys that contradict each other."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("seq"), F.when(k % 3 == 0, F.concat(F.lit("d"), F.col("o_custkey") % 900)).alias("doi"), F.when(k % 4 == 0, F.concat(F.lit("a"), (k * 7) % 4001)).alias("arxiv_id"), F.concat(F.lit("t"), (k * 13) % 9001).alias("title")
    )
    return dedup.leaders(with_defaults(rows), None)


@query()
def q_dedup_fuzzy(spark, sf):
    """Leaders of documents by fuzzy title."""
    return dedup.leaders(with_defaults(papers(spark, sf)), 95)


@query(
    f"""WITH {PAPERS}, g AS (SELECT *, min(seq) OVER (PARTITION BY abstract) AS leader, count(*) OVER (PARTITION BY abstract) AS n FROM papers)
    SELECT leader AS seq, min_by(title, seq) AS title, min_by(venue, seq) FILTER (WHERE venue <> '') AS venue, max(citation_count) AS citation_count, array_to_string(list_sort(list(DISTINCT venue)), ',') AS sources,
    array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics FROM g GROUP BY leader"""
)
def q_merge_metadata(spark, sf):
    p = with_defaults(papers(spark, sf))
    by = p.select("seq", "abstract").join(p.groupBy("abstract").agg(F.min("seq").alias("leader")), "abstract").select("seq", "leader")
    return dedup.merge(p, by).select("seq", "title", "venue", "citation_count", F.array_join("sources", ",").alias("sources"), F.array_join("topic_queries", ",").alias("topics"))


@query(
    """WITH o AS (SELECT o_custkey AS id, min(o_orderkey) AS k, max(o_totalprice) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS id, max(o_totalprice) AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT 'title ' || id AS title, greatest(floor(o.p)::BIGINT, floor(n.p)::BIGINT) AS citation_count, coalesce(n.p, o.p) AS quality_score, CASE WHEN o.p IS NOT NULL AND id % 3 = 0 THEN 'old' WHEN n.p IS NOT NULL THEN 'new' END AS doi
    FROM o FULL JOIN n USING (id)"""
)
def q_upsert(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("half")).agg(F.min("o_orderkey").alias("seq"), F.max("o_totalprice").alias("quality_score"))
    rows = o.select("half", "seq", F.concat(F.lit("title "), "o_custkey").alias("title"), F.floor("quality_score").cast("long").alias("citation_count"), "quality_score",
                    F.when(F.col("half") == 1, "new").when(F.col("o_custkey") % 3 == 0, "old").alias("doi"), *[F.lit(None).cast("string").alias(c) for c in ("abstract", "pdf_url", "arxiv_id")])
    old, new = rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half").withColumn("title", F.upper(F.concat("title", F.lit(" "))))
    return tables.upsert_records(old, new).select(text.normalized_title("title").alias("title"), "citation_count", "quality_score", "doi")


@query("SELECT source AS topic, doc_id AS seq FROM documents QUALIFY row_number() OVER (PARTITION BY source, n_chars % 50 ORDER BY doc_id) = 1")
def q_first_by(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("seq"), (F.col("n_chars") % 50).alias("k"))
    return dedup.first_by(d, F.concat_ws("|", "topic", "k"), F.col("seq")).select("topic", "seq")


# -- coverage, gaps, relations -------------------------------------------------------------------------------------------

ELEMENTS = "list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' '), lambda x: length(x) BETWEEN 3 AND 5))"
COVER = f"""
c0 AS (SELECT DISTINCT source AS topic, doc_id, unnest({ELEMENTS}) AS element FROM documents),
n0 AS (SELECT source AS topic, count(*) AS n_records FROM documents GROUP BY 1),
cover AS (SELECT topic, element, count(*) AS coverage_count, n_records FROM c0 JOIN n0 USING (topic) GROUP BY ALL)"""


def analysed(spark, sf) -> DataFrame:
    """All documents with the short words they cover."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " "), lambda x: F.length(x).between(3, 5))
    return read(spark, sf, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("seq"), words.alias("covered"), F.col("lang").alias("orientation"))


@query(f"WITH {COVER} SELECT topic, element, coverage_count, n_records, coverage_count < greatest(1, round_even(0.3 * n_records, 0)::BIGINT) AS low_coverage FROM cover")
def q_low_coverage(spark, sf):
    return relations.low_coverage(relations.coverage(analysed(spark, sf), "covered")).select("topic", "element", "coverage_count", "n_records", "low_coverage")


@query(
    f"""WITH {COVER}, f AS (SELECT *, coverage_count < greatest(1, round_even(0.3 * n_records, 0)::BIGINT) AS low FROM cover),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY coverage_count DESC, element) AS n, row_number() OVER (PARTITION BY topic, low ORDER BY coverage_count DESC, element) AS m FROM f)
    SELECT topic, 'deepest' AS kind, n AS rank, element, coverage_count FROM r WHERE n <= 3 UNION ALL SELECT topic, 'weakest', m, element, coverage_count FROM r WHERE low AND m <= 3"""
)
def q_deepest_weakest(spark, sf):
    return relations.deepest(relations.coverage(analysed(spark, sf), "covered"))


MATRIX = ("the", "eau", "und", "que")


@query("SELECT doc_id AS seq, " + ", ".join(f"list_contains({ELEMENTS}, '{c}')::INT AS {c}" for c in MATRIX) + " FROM documents")
def q_coverage_matrix(spark, sf):
    return relations.matrix(analysed(spark, sf), "covered", list(MATRIX))


@query("SELECT source AS topic, lang AS orientation, count(*) AS n FROM documents GROUP BY ALL")
def q_orientation(spark, sf):
    return relations.orientations(analysed(spark, sf))


@query(
    f"""WITH {COVER}, own AS (SELECT * FROM cover WHERE element LIKE 't%'), fut AS (SELECT * FROM cover WHERE element LIKE '%n')
    SELECT topic, element AS gap, 'frequency' AS gap_type, {half_up('1 - coverage_count / n_records', 4)} AS opportunity_score FROM own WHERE coverage_count / n_records < 0.3
    UNION ALL SELECT topic, element, 'convergence', {half_up('coverage_count / n_records', 4)} FROM fut WHERE coverage_count >= 3 AND NOT EXISTS (SELECT 1 FROM own WHERE own.topic = fut.topic AND own.element = fut.element)"""
)
def q_gap_rules(spark, sf):
    c = relations.coverage(analysed(spark, sf), "covered")
    own, future = c.where(F.col("element").startswith("t")), c.where(F.col("element").endswith("n"))
    gaps = relations.frequency_gaps(own).unionByName(relations.convergence_gaps(future, own))
    return gaps.withColumn("opportunity_score", round_half_up(F.col("opportunity_score"), 4))


@query("SELECT c_mktsegment AS segment, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def q_bipartite_reverse(spark, sf):
    links = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return relations.reverse(links, "nation", "segment").select("segment", F.array_join("lefts", ",").alias("nations"))


@query(
    """WITH g AS (SELECT p_brand AS topic, p_partkey AS gap, CASE p_partkey % 3 WHEN 0 THEN [p_name, 'zzz'] WHEN 1 THEN ['zzz'] ELSE [] END AS refs FROM part), n AS (SELECT DISTINCT p_brand AS topic, p_name AS name FROM part WHERE p_size > 25)
    SELECT topic, gap FROM g WHERE NOT EXISTS (SELECT 1 FROM n, unnest(g.refs) u(ref) WHERE n.topic = g.topic AND (contains(lower(n.name), lower(u.ref)) OR contains(lower(u.ref), lower(n.name))))"""
)
def q_blue_sky(spark, sf):
    p = read(spark, sf, "part")
    k = F.col("p_partkey") % 3
    refs = F.when(k == 0, F.array(F.col("p_name"), F.lit("zzz"))).when(k == 1, F.array(F.lit("zzz"))).otherwise(F.array().cast("array<string>"))
    gaps = p.select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("gap"), F.col("p_partkey").alias("pos"), refs.alias("challenges"))
    challenges = p.where("p_size > 25").groupBy(F.col("p_brand").alias("topic"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return relations.gap_links(gaps, challenges)[1].select("topic", "gap")


@query(
    """WITH fam AS (SELECT p_brand AS topic, p_name AS name, min(p_partkey) AS pos FROM part GROUP BY ALL), t AS (SELECT p_brand AS topic, p_type AS task, p_name AS method, min(p_partkey) AS pos FROM part GROUP BY ALL),
    tech AS (SELECT p_brand AS topic, p_name AS family, 'size ' || p_size AS technique, min(p_partkey) AS pos FROM part GROUP BY ALL), cut AS (SELECT *, row_number() OVER (PARTITION BY topic, family ORDER BY pos) AS n FROM tech QUALIFY n <= 6)
    SELECT t.topic, task, t.method AS family, technique FROM t LEFT JOIN cut ON cut.topic = t.topic AND cut.family = t.method"""
)
def q_method_tree(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_brand").alias("topic"), "p_type", "p_name", "p_size", "p_partkey")
    tasks = p.groupBy("topic", F.col("p_type").alias("task"), F.col("p_name").alias("method")).agg(F.min("p_partkey").alias("pos")).withColumn("method_pos", F.col("pos"))
    families = p.groupBy("topic", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    techniques = p.select("topic", F.col("p_name").alias("family"), F.concat(F.lit("size "), "p_size").alias("technique"), F.col("p_partkey").alias("pos"))
    return relations.method_links(tasks, families, techniques).select("topic", "task", "family", "technique")


@query(
    """WITH l AS (SELECT p_brand, p_type, p_name, min(p_partkey) AS pos FROM part GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY pos) AS n FROM l),
    k AS (SELECT p_brand, p_type, min(pos) AS pos, list(p_name ORDER BY pos) FILTER (WHERE n <= 6) AS leaves FROM c GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS n FROM k)
    SELECT p_brand AS label, '[' || string_agg('{"label":"' || p_type || '","children":["' || array_to_string(leaves, '","') || '"]}', ',' ORDER BY pos) || ']' AS children FROM t WHERE n <= 8 GROUP BY 1"""
)
def q_tree(spark, sf):
    p = read(spark, sf, "part")
    links = p.groupBy("p_brand", "p_type", "p_name").agg(F.min("p_partkey").cast("int").alias("leaf_pos")).withColumn("child_pos", F.min("leaf_pos").over(Window.partitionBy("p_brand", "p_type")))
    return relations.tree(links, "p_brand", "p_type", "p_name").select("label", F.to_json("children").alias("children"))


@query(
    """WITH l AS (SELECT p_brand AS topic, p_type AS a, p_name AS b, min(p_partkey) AS pos FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL),
    r AS (SELECT topic, a, min(pos) AS least_pos, string_agg(b, '","' ORDER BY pos) AS bs FROM l GROUP BY topic, a),
    j AS (SELECT topic, string_agg('"' || a || '":["' || bs || '"]', ',' ORDER BY least_pos) AS js FROM r GROUP BY topic)
    SELECT topic, '{"pairs":[{"key":"area-method","leftLabel":"Research Areas","rightLabel":"Methods","links":{' || js || '}}]}' AS data FROM j"""
)
def q_linked_tree(spark, sf):
    p = read(spark, sf, "part").withColumn("b", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")))
    links = p.select(F.col("p_brand").alias("topic"), F.col("p_type").alias("left"), F.col("p_partkey").alias("left_pos"), F.col("b").alias("right"), F.col("p_partkey").alias("right_pos"))
    none = mindmaps.layer(links.where("left IS NULL"), "problem-area", "Core Problems", "Research Areas")
    return mindmaps.linked_tree(none, mindmaps.layer(links, "area-method", "Research Areas", "Methods"))


@query("SELECT source AS query, doc_id AS seq FROM documents WHERE 2000 + doc_id % 10 BETWEEN 2003 AND 2007 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, 'T' || doc_id) <= 25")
def q_title_search(spark, sf):
    k = F.col("doc_id")
    raw = F.to_json(F.struct(F.concat(F.lit("T"), k).alias("title"), (2000 + k % 10).cast("int").alias("publication_year"), F.col("n_chars").alias("cited_by_count")))
    replies_ = read(spark, sf, "documents").select(F.lit("t").alias("topic"), F.col("source").alias("query"), raw.alias("raw"))
    found = retrieval.title_search(replies_, 2003, 2007)
    return found.select(F.get("generated_queries", F.lit(0)).alias("query"), F.substring("title", 2, 20).cast("long").alias("seq"))


@query(
    """WITH e AS (SELECT n_regionkey AS topic, 'n' || n_nationkey AS source_id, CASE WHEN n_nationkey % 4 = 0 THEN 'gone' ELSE 'n' || n_nationkey END AS target_id, CASE WHEN n_nationkey % 5 = 0 THEN 'likes' ELSE 'uses' END AS edge_type FROM nation)
    SELECT topic, source_id, target_id, edge_type FROM e WHERE target_id <> 'gone' AND edge_type = 'uses' AND source_id <> 'n7'"""
)
def q_concept_edges(spark, sf):
    n = read(spark, sf, "nation")
    me, k = F.concat(F.lit("n"), "n_nationkey"), F.col("n_nationkey")
    nodes = n.select(F.col("n_regionkey").alias("topic"), F.when(k == 7, " ").otherwise(me).alias("node_id"))
    edges = n.select(F.col("n_regionkey").alias("topic"), me.alias("source_id"), F.when(k % 4 == 0, "gone").otherwise(me).alias("target_id"), F.when(k % 5 == 0, "likes").otherwise("uses").alias("edge_type"))
    return graph.valid_edges(edges, nodes)


@query()
def q_components(spark, sf):
    """Components of all links of parts and suppliers; SQL would have to walk them, so the test compares with a union-find."""
    li = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()
    return graph.components(li)


# -- caches, sources, documents, streams ---------------------------------------------------------------------------------

NOW = "2024-01-20 00:00:00"


@query(
    f"""WITH e AS (SELECT user_id AS key, CASE WHEN event_id % 17 <> 0 THEN ts END AS cached_at, value FROM events) SELECT key, max(cached_at) AS cached_at, max_by(value, cached_at) AS value
    FROM e WHERE cached_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY key"""
)
def q_cache_ttl(spark, sf):
    cache = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("cached_at"), "value")
    return retrieval.fresh(cache, F.lit(NOW).cast("timestamp"), 7).select("key", "cached_at", "value")


@query(
    """WITH c AS (SELECT DISTINCT sha256('openalex|q' || (c_custkey % 500) || '|2020|2024|50') AS key FROM customer WHERE c_custkey % 3 = 0), r AS (SELECT sha256('openalex|q' || (o_custkey) || '|2020|2024|50') AS key FROM orders)
    SELECT count(*) FILTER (WHERE key IN (SELECT key FROM c)) AS hits, count(*) FILTER (WHERE key NOT IN (SELECT key FROM c)) AS misses, (SELECT count(*) FROM c) AS entries FROM r"""
)
def q_cache_statistics(spark, sf):
    request = lambda q: [F.lit("openalex").alias("source"), q.alias("query"), F.lit(2020).alias("year_from"), F.lit(2024).alias("year_to"), F.lit(50).alias("limit")]
    cached = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(*request(F.concat(F.lit("q"), F.col("c_custkey") % 500))).withColumn("key", retrieval.request_key()).select("key").distinct()
    return retrieval.cache_statistics(read(spark, sf, "orders").select(*request(F.concat(F.lit("q"), "o_custkey"))), cached)


@query("SELECT doc_id % 2 AS part, 'T' || doc_id AS title, [] AS authors, lang AS venue, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id END AS doi, n_chars AS citation_count FROM documents".replace("[] AS authors, ", ""))
def q_parse_items(spark, sf):
    """Documents as recorded replies of two services, parsed."""
    d = read(spark, sf, "documents")
    k = F.col("doc_id")
    address = F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), k))
    one = d.where(k % 2 == 0).select(F.lit("t").alias("topic"), F.lit("q").alias("query"), F.to_json(F.struct(
        F.concat(F.lit(" T"), k).alias("title"), F.col("n_chars").alias("cited_by_count"), address.alias("doi"),
        F.struct(F.struct(F.col("lang").alias("display_name")).alias("source")).alias("primary_location"))).alias("raw"))
    two = d.where(k % 2 == 1).select(F.lit("t").alias("topic"), F.lit("q").alias("query"), F.to_json(F.struct(
        F.concat(F.lit("T"), k).alias("title"), F.col("n_chars").alias("citationCount"), address.alias("doi"), F.lit(2020).alias("yearPublished"), F.col("lang").alias("publisher"))).alias("raw"))
    both = items.openalex(one).withColumn("part", F.lit(0).cast("long")).unionByName(items.core(two, 2019, 2021).withColumn("part", F.lit(1).cast("long")))
    return both.select("part", "title", "venue", "doi", "citation_count")


@query(
    """SELECT l_returnflag AS paper, list_sort(list(l_extendedprice))[floor(count(*) * 0.85)::INT + 1] AS p85, list_sort(list(l_extendedprice))[floor(count(*) * 0.9)::INT + 1] AS p90 FROM lineitem GROUP BY 1"""
)
def q_order_statistics(spark, sf):
    return documents.sizes_at(read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("paper"), "l_extendedprice"), "paper", "l_extendedprice", {"p85": 0.85, "p90": 0.90})


@query(
    """WITH t AS (SELECT conv_id AS paper, turn, CASE WHEN turn % 3 = 1 THEN 'heading ' || turn END AS h FROM conversations)
    SELECT paper, turn, last_value(h IGNORE NULLS) OVER (PARTITION BY paper ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM t"""
)
def q_section_fill(spark, sf):
    c = read(spark, sf, "conversations")
    size = F.when(F.col("turn") % 3 == 1, 20.0).otherwise(10.0)
    line = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("heading "), "turn")).otherwise("body")
    rows = c.select(F.col("conv_id").alias("paper"), F.lit(0).alias("page"), F.col("turn").alias("pos"), line.alias("line"), size.alias("size"))
    bounds = rows.select("paper").distinct().withColumns({"p85": F.lit(15.0), "p90": F.lit(18.0)})
    return documents.classified(rows, bounds).select("paper", F.col("pos").alias("turn"), "section")


@query()
def q_document_structure(spark, sf):
    """Parts' names as characters of a page, brand by brand."""
    p = read(spark, sf, "part")
    at = F.posexplode(F.split("p_name", "")).alias("i", "text")
    chars = p.select(F.col("p_brand").alias("paper"), (F.col("p_size") % 3).alias("page"), F.when(F.col("p_partkey") % 9 == 0, 14.0).otherwise(10.0).alias("size"), (F.col("p_partkey") * 12.0).alias("top"), at)
    out = documents.structure(chars.select("paper", "page", "text", "size", "top", F.col("i").cast("double").alias("x0")))
    return out.select("paper", "sections", F.size("subsections").alias("n_subsections"), "conclusion_text", "future_work_text")


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def q_distinct_users(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))


@query(
    """WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL)
    SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def q_stream_dedup(spark, sf):
    """Events as a stream: hourly counts, windows closed by the watermark."""
    import uuid

    from ..session import shared_dir

    importable(spark)
    events = spark.read.parquet(f"{sf}/events.parquet")
    name = "stream_" + uuid.uuid4().hex
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.run_once(ingest.windowed_counts(ingest.without_repeats(stream, "event_id"), "event_type", late=None), name, f"{shared_dir(spark)}/{name}")
    return spark.table(name)


@query(
    f"""WITH {SCORED_CUSTOMERS} SELECT row_number() OVER (ORDER BY quality_score DESC, seq) AS rank, 'Customer ' || seq AS title, CASE WHEN seq % 7 = 0 THEN '' ELSE year::VARCHAR END AS year,
    CASE WHEN seq % 3 = 0 THEN 'V' ELSE '' END AS venue, 'A; B; C; D; E' AS authors, topic || '; more' AS topic_queries, citation_count, influential_citation_count, 3 AS background_citation_count,
    {half_up(SHARE, 4)} AS influential_ratio, {half_up('canonical_score', 4)} AS canonical_score, '' AS authority_tier, CASE WHEN seq % 5 = 0 THEN '' ELSE 'emerging' END AS llm_authority_assessment,
    CASE WHEN seq % 5 = 0 THEN '' ELSE 'skip' END AS recommended_action, 'applied' AS orientation, {half_up('quality_score', 1)} AS quality_score, CASE WHEN seq % 2 = 0 THEN '10.1/' || seq ELSE '' END AS doi,
    '' AS arxiv_id, 'u' AS url, '' AS pdf_url, 'two lines' AS abstract, 'x; y' AS sources FROM scored"""
)
def q_paper_rows(spark, sf):
    k = F.col("seq")
    c = ranking.quality_rank(scored_customers(spark, sf)).drop("from_top_survey")
    cells = {
        "title": F.concat(F.lit("Customer "), k), "year": F.when(k % 7 == 0, 0).otherwise(F.col("year")), "venue": F.when(k % 3 == 0, "V"), "authors": F.array(*[F.lit(x) for x in "ABCDEFG"]),
        "topic_queries": F.array(F.col("topic"), F.lit("more")), "background_citation_count": F.lit(3), "authority_assessment": F.lit("emerging"), "recommended_action": F.lit("skip"),
        "judge_failed": k % 5 == 0, "orientation": F.lit("applied"), "doi": F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k)), "url": F.lit("u"), "abstract": F.lit("two\nlines"),
        "sources": F.array(F.lit("x"), F.lit("y")), **{c: F.lit(None).cast("string") for c in ("authority_tier", "arxiv_id", "pdf_url")},
    }
    return tables.paper_rows(c.withColumns(cells))


@query(
    f"""WITH {PAPERS}, r AS (SELECT title, abstract, topic, max(seq) AS last_seq FROM papers WHERE seq % 2 = 0 GROUP BY ALL), j AS (SELECT seq, last_seq, last_seq IS NULL OR last_seq % 4 <> 0 AS bad FROM papers LEFT JOIN r USING (title, abstract, topic))
    SELECT seq, CASE WHEN bad THEN 3 WHEN last_seq % 8 = 0 THEN 1 ELSE 4 END AS topic_relevance, CASE WHEN bad THEN 'useful' WHEN last_seq % 8 = 0 THEN 'cut' ELSE 'core' END AS paper_tier,
    CASE WHEN NOT bad AND last_seq % 8 = 0 THEN 'skip' ELSE '' END AS recommended_action, bad AS judge_failed, CASE WHEN last_seq IS NULL THEN 'no reply' WHEN bad THEN 'the reply is no JSON object' END AS failure_reason FROM j"""
)
def q_replay(spark, sf):
    """Judge replies for documents: some recorded, some not."""
    p = papers(spark, sf).withColumns({"research_scope": F.lit(""), "model": F.lit("m"), "version": F.lit("1")})
    kind = replay.PASSES["judge"]
    replies_ = replay.keyed(p.where(F.col("seq") % 2 == 0), kind)
    raw = F.when(F.col("seq") % 4 == 0, F.concat(F.lit('```json\n{"topic_relevance": '), F.col("seq") % 8, F.lit(', "is_survey": true, "paper_tier": "core"}\n```'))).otherwise("not json")
    recorded = replies_.select(F.lit("judge").alias("pass"), "key", raw.alias("raw"), F.col("seq").alias("at"))
    joined, _ = replay.replay(p, recorded, kind)
    return replay.judgements(joined).select("seq", "topic_relevance", "paper_tier", "recommended_action", "judge_failed", "failure_reason")
