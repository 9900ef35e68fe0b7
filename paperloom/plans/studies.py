"""Named queries of the studies of a library: references, vectors, citations, words, attributes and time."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import citations, facets, graph, itemsets, raters, replay, standing, taxonomy, terms, timeline, vectors
from ..session import shared_dir
from ..sinks import tables, versions
from ..streaming import digest
from .catalog import PAPERS, papers, query, read

__all__ = ["read"]


# -- references ----------------------------------------------------------------------------------------------------------

REFERENCES = rf"""{PAPERS},
t AS (SELECT seq, list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'))) AS ws FROM papers),
n AS (SELECT count(*) AS n FROM t WHERE len(ws) > 0), df AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM t) GROUP BY w),
ww AS (SELECT w, floor(ln(1 + n / df) * 1000 + 0.5)::BIGINT AS x FROM df, n), top AS (SELECT floor(ln(1 + greatest(n, 1) / 1) * 1000 + 0.5)::BIGINT AS x FROM n),
tt AS (SELECT seq, w, x FROM (SELECT seq, unnest(ws) AS w FROM t) JOIN ww USING (w)), tw AS (SELECT seq, sum(x)::BIGINT AS total FROM tt GROUP BY seq),
lines AS (SELECT seq AS doc, unnest(range(2, len(l) + 1)) AS line, unnest(l[2:]) AS text FROM (SELECT seq, string_split(abstract, chr(10)) AS l FROM papers WHERE abstract IS NOT NULL)),
r AS (SELECT text, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM (SELECT DISTINCT text FROM lines)),
rr AS (SELECT text, w, coalesce(ww.x, top.x) AS x FROM r LEFT JOIN ww USING (w), top), rw AS (SELECT text, sum(x)::BIGINT AS total FROM rr GROUP BY text),
c AS (SELECT text, seq, sum(tt.x)::BIGINT AS common FROM rr JOIN tt USING (w) GROUP BY ALL),
s AS (SELECT text, seq, common, rw.total + tw.total AS sum FROM c JOIN rw USING (text) JOIN tw USING (seq)),
best AS (SELECT * FROM s WHERE 2 * common / sum >= 0.6 - 1e-12 QUALIFY row_number() OVER (PARTITION BY text ORDER BY 2 * common / sum DESC, seq) = 1)"""


def references(spark, sf):
    """Every line of a document but the first, as a reference: doc, line, text."""
    lines = papers(spark, sf).select(F.col("seq").alias("doc"), F.posexplode(F.split("abstract", "\n")).alias("at", "text"))
    return lines.where("at > 0").select("doc", (F.col("at") + 1).alias("line"), "text")


@query(f"WITH {REFERENCES} SELECT doc, line, seq, common, sum FROM lines JOIN best USING (text)")
def q_reference_matches(spark, sf):
    """The title that each reference means."""
    asked = references(spark, sf)
    return terms.resolved(terms.build(papers(spark, sf).select("seq", "title")), asked).select("doc", "line", "seq", "common", "sum")


@query(
    f"""WITH {REFERENCES}, m AS (SELECT seq, count(DISTINCT doc) AS n FROM lines JOIN best USING (text) WHERE doc <> seq GROUP BY seq HAVING n >= 2)
    SELECT seq, n, round(n / max(n) OVER (), 4) AS canonical_score FROM m ORDER BY n DESC, seq LIMIT 50"""
)
def q_reference_seeds(spark, sf):
    """The titles that most other documents refer to."""
    asked = references(spark, sf)
    return terms.most_named(terms.resolved(terms.build(papers(spark, sf).select("seq", "title")), asked.select("doc", "text")))


# -- vectors -------------------------------------------------------------------------------------------------------------


def embeddings(spark, sf):
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, rows.where("id % 100 = 0")


@query(
    """WITH d AS (SELECT q.vec_id, x.vec_id AS neighbour, list_sum(list_transform(list_zip(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2)) AS away
      FROM embeddings q JOIN embeddings x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id)
    SELECT vec_id, neighbour, row_number() OVER (PARTITION BY vec_id ORDER BY away, neighbour) AS rank FROM d QUALIFY rank <= 10"""
)
def q_nearest_vectors(spark, sf):
    """The ten nearest rows of every hundredth one, exactly."""
    rows, asked = embeddings(spark, sf)
    return vectors.exact(vectors.build(rows), asked).select(F.col("id").alias("vec_id"), "neighbour", "rank")


@query()
def q_vector_codes(spark, sf):
    """About the same by codes; tests measure the share that is found."""
    rows, asked = embeddings(spark, sf)
    return vectors.by_codes(vectors.build(rows), asked).select(F.col("id").alias("vec_id"), "neighbour", "rank")


# -- citations -----------------------------------------------------------------------------------------------------------

LINKS = "links AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem)"


def part_links(spark, sf):
    """Parts cite their suppliers."""
    return read(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


@query(
    f"""WITH {LINKS}, both_ AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), s AS (SELECT p_partkey * 2 AS node FROM part WHERE p_size = 1),
    l1 AS (SELECT dst AS node, min(src) AS via FROM both_ JOIN s ON src = node WHERE dst NOT IN (FROM s) GROUP BY dst),
    l2 AS (SELECT dst AS node, min(src) AS via FROM both_ JOIN l1 ON src = node WHERE dst NOT IN (FROM s) AND dst NOT IN (SELECT node FROM l1) GROUP BY dst)
    SELECT node, 0 AS level, NULL::BIGINT AS via FROM s UNION ALL SELECT node, 1, via FROM l1 UNION ALL SELECT node, 2, via FROM l2"""
)
def q_snowball(spark, sf):
    """What two steps from the smallest parts reach, along links and against them."""
    seeds = read(spark, sf, "part").where("p_size = 1").select((F.col("p_partkey") * 2).alias("node"))
    return citations.snowball(part_links(spark, sf), seeds, 2)


@query(
    f"""WITH {LINKS}, d AS (SELECT src, count(*) AS n FROM links GROUP BY src), w AS (SELECT src AS node, 1.0::DOUBLE AS x FROM d
      UNION ALL SELECT dst, 1 + sum(0.85::DOUBLE / n) FROM links JOIN d USING (src) GROUP BY dst)
    SELECT node, round(x / sum(x) OVER () * 1e6, 4) AS rank FROM w"""
)
def q_citation_rank(spark, sf):
    """PageRank of parts and suppliers, in millionths."""
    return citations.rank(part_links(spark, sf)).select("node", F.round(F.col("rank") * 1e6, 4).alias("rank"))


# -- words that go together ----------------------------------------------------------------------------------------------

COMMON = 0.2
WORDS = rf"""w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
one AS (SELECT w, count(*) AS n FROM w GROUP BY w HAVING count(*) >= ceil({COMMON} * (SELECT n FROM n))), f AS (SELECT doc_id, w FROM w SEMI JOIN one USING (w)),
two AS (SELECT a.w AS a, b.w AS b, count(*) AS n FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.w < b.w GROUP BY ALL HAVING count(*) >= ceil({COMMON} * (SELECT n FROM n)))"""


def word_sets(spark, sf, longest):
    docs = read(spark, sf, "documents").where("doc_id IS NOT NULL")
    rows = docs.agg(F.count_distinct("doc_id")).first()[0]
    words = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("item"))
    return itemsets.frequent(words, max(1, math.ceil(COMMON * rows)), longest), rows


@query(
    f"""WITH {WORDS} SELECT two.a, two.b, two.n, round(two.n * (SELECT n FROM n)::DOUBLE / (x.n * y.n), 9) AS lift, round(log2(two.n * (SELECT n FROM n)::DOUBLE / (x.n * y.n)), 9) AS pmi
    FROM two JOIN one x ON x.w = a JOIN one y ON y.w = b"""
)
def q_word_pairs(spark, sf):
    """Pairs of words that a fifth of the documents have, and how much more often than by chance."""
    found = itemsets.associations(*word_sets(spark, sf, 2))
    return found.select("a", "b", "n", F.round("lift", 9).alias("lift"), F.round("pmi", 9).alias("pmi"))


@query(
    f"""WITH {WORDS} SELECT a.w || ' ' || b.w || ' ' || c.w AS items, count(*) AS n FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.w < b.w JOIN f c ON a.doc_id = c.doc_id AND b.w < c.w
    GROUP BY a.w, b.w, c.w HAVING count(*) >= ceil({COMMON} * (SELECT n FROM n))"""
)
def q_word_triples(spark, sf):
    """Three words that a fifth of the documents have."""
    found, _ = word_sets(spark, sf, 3)
    return found.where(F.size("items") == 3).select(F.array_join("items", " ").alias("items"), "n")


# -- attributes ----------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT * FROM part WHERE (p_brand IN ('Brand#11', 'Brand#23', 'Brand#34') OR p_size BETWEEN 5 AND 20) AND NOT (p_type LIKE 'ECONOMY%' AND p_size BETWEEN 1 AND 10))
    SELECT 'p_brand' AS attribute, p_brand AS value, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM p GROUP BY ALL UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM p GROUP BY ALL"""
)
def q_part_facets(spark, sf):
    """Counts of all values among the parts that a filter leaves."""
    parts = read(spark, sf, "part")
    index = facets.build(parts, "p_brand", "p_type", "p_size", id="p_partkey")
    economy = facets.Among("p_type", tuple(r[0] for r in parts.select("p_type").where("p_type LIKE 'ECONOMY%'").distinct().limit(1000).collect()))
    where = (facets.Among("p_brand", ("Brand#11", "Brand#23", "Brand#34")) | facets.Between("p_size", 5, 20)) & ~(economy & facets.Between("p_size", 1, 10))
    return facets.counts(index, facets.select(index, where))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'O') AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR year(o_orderdate) = 1996)")
def q_order_filter(spark, sf):
    """Orders that fulfil a filter, read from blocks alone."""
    rows = read(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    index = facets.build(rows, "o_orderstatus", "o_orderpriority", "year", id="o_orderkey")
    where = ~facets.Among("o_orderstatus", ("O",)) & (facets.Among("o_orderpriority", ("1-URGENT", "2-HIGH")) | facets.Between("year", 1996, 1996))
    return facets.ids(facets.select(index, where))


# -- time ----------------------------------------------------------------------------------------------------------------

HOURS = """c AS (SELECT event_type AS kind, date_trunc('hour', ts) AS step, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT min(step) AS lo, max(step) AS hi FROM c),
s AS (SELECT kind, step, coalesce(n, 0) AS n FROM (SELECT kind, step FROM (SELECT DISTINCT kind FROM c), (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS step FROM b)) LEFT JOIN c USING (kind, step))"""


def hours(spark, sf):
    return timeline.series(read(spark, sf, "events"), "event_type", "ts")


@query(f"WITH {HOURS} SELECT kind, step, n FROM s")
def q_timeline(spark, sf):
    """Events of each type in each hour, hours without any too."""
    return hours(spark, sf)


@query(
    f"""WITH RECURSIVE {HOURS}, w AS (SELECT *, sum(n) OVER (PARTITION BY step) AS whole, row_number() OVER (PARTITION BY kind ORDER BY step) AS i, count(*) OVER (PARTITION BY kind) AS m FROM s),
    r AS (SELECT kind, sum(n) / sum(whole) AS p, least(1.5 * sum(n) / sum(whole), 1 - 1e-9) AS q, 0.5 * ln(max(m)) AS up FROM w GROUP BY kind),
    x AS (SELECT w.*, up, -(n * ln(p) + (whole - n) * ln(1 - p)) AS c0, -(n * ln(q) + (whole - n) * ln(1 - q)) AS c1 FROM w JOIN r USING (kind)),
    v(kind, i, low, past, high, before, since, last) AS (SELECT DISTINCT kind, 0::BIGINT, 0::DOUBLE, ''::VARCHAR, 'inf'::DOUBLE, ''::VARCHAR, NULL::TIMESTAMP, NULL::TIMESTAMP FROM x
      UNION ALL SELECT v.kind, x.i, least(low, high) + c0, CASE WHEN high < low THEN before || since || '~' || last || ';' ELSE past END, least(high, low + up) + c1,
        CASE WHEN high <= low + up THEN before ELSE past END, CASE WHEN high <= low + up THEN since ELSE x.step END, x.step FROM v JOIN x ON x.kind = v.kind AND x.i = v.i + 1),
    e AS (SELECT kind, unnest(string_split(rtrim(CASE WHEN high < low THEN before || since || '~' || last || ';' ELSE past END, ';'), ';')) AS b FROM v JOIN (SELECT kind, max(i) AS i FROM x GROUP BY kind) USING (kind, i))
    SELECT kind, split_part(b, '~', 1)::TIMESTAMP AS start, split_part(b, '~', 2)::TIMESTAMP AS "end" FROM e WHERE b <> ''"""
)
def q_bursts(spark, sf):
    """Hours in which a type of event is unusually frequent."""
    return timeline.bursts(hours(spark, sf), 1.5, 0.5)


@query()
def q_change_points(spark, sf):
    """Hours at which the level of a type's events changes; tests compare with a plain search."""
    return timeline.changes(hours(spark, sf), 0.7)


# -- versions of a library, generated queries, edges ---------------------------------------------------------------------


def editions(spark, sf):
    """Parts as records that come in three turns, with DOIs and arXiv ids that recur."""
    p = read(spark, sf, "part")
    key = lambda c, n: F.concat(F.lit(c), (F.col("p_partkey") % n).cast("string"))
    return p.select(
        (F.col("p_partkey") % 3).alias("turn"), F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 97).cast("string")).alias("title"), F.col("p_size").cast("long").alias("citation_count"),
        F.col("p_retailprice").alias("quality_score"), F.when(F.col("p_partkey") % 4 == 0, key("d", 211)).alias("doi"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("abstract"), F.lit(None).cast("string").alias("pdf_url"),
        F.when(F.col("p_partkey") % 5 == 0, key("x", 307)).alias("arxiv_id"),
    )


@query()
def q_library_upserts(spark, sf):
    """The library after three turns of upserts by title, DOI and arXiv id; tests compare with one record at a time."""
    return versions.upsert_seeded(editions(spark, sf), "turn")


@query(
    """WITH t AS (SELECT DISTINCT p_name AS topic, min(p_partkey) AS seq FROM part GROUP BY p_name),
    g AS (SELECT seq, topic, unnest(range(0, 2)) AS place, unnest([topic || ' survey', 'review of ' || topic]) AS query FROM t WHERE seq % 3 <> 0
      UNION ALL SELECT seq, topic, unnest(range(0, 5)), unnest([topic || ' survey', topic || ' review', topic || ' systematic review', topic || ' overview', topic || ' taxonomy']) FROM t WHERE seq % 3 = 0)
    SELECT seq, topic, place, query FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY seq, place) = 1"""
)
def q_generated_queries(spark, sf):
    """Queries from replies that are lists, fenced or not, and templates where a reply is none."""
    t = read(spark, sf, "part").groupBy(F.col("p_name").alias("topic")).agg(F.min("p_partkey").alias("seq"))
    found = F.concat(F.lit('[" '), "topic", F.lit(' survey", "", "review of '), "topic", F.lit('"]'))
    raw = F.when(F.col("seq") % 3 == 1, found).when(F.col("seq") % 3 == 2, F.concat(F.lit("```json\n"), found, F.lit("\n```"))).otherwise("sorry")
    return replay.generated_queries(t.withColumn("raw", raw)).select("seq", "topic", "place", "query")


@query(
    """WITH e AS (SELECT p_partkey AS pos, (['is_subfield_of', 'uses', 'evaluated_by', 'applied_to', 'contrasts_with', 'emerged_after', 'part_of', 'made_of_many'])[(p_partkey % 8)::INT + 1] AS edge_type FROM part)
    SELECT pos, (['is a subfield of', 'uses', 'is evaluated by', 'is applied to', 'contrasts with', 'emerged after', 'is part of', 'made of many'])[(pos % 8)::INT + 1] AS label FROM e"""
)
def q_edge_labels(spark, sf):
    kinds = F.array(*[F.lit(x) for x in (*graph.EDGE_TYPES, "made_of_many")])
    edges = read(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.element_at(kinds, (F.col("p_partkey") % 8 + 1).cast("int")).alias("edge_type"))
    return tables.labelled_edges(edges).select("pos", "label")


# -- raters and standing -------------------------------------------------------------------------------------------------


def votes(spark, sf):
    """Five raters of different care say what the labels of quality are."""
    rows = read(spark, sf, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("item"), F.col("quality").cast("int").alias("truth"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rater"))
    wrong = F.crc32(F.concat_ws("-", "item", "rater").cast("binary")) % 10 < F.col("rater")
    return rows.select("item", "rater", F.when(wrong, 1 - F.col("truth")).otherwise(F.col("truth")).alias("label"))


@query()
def q_consensus(spark, sf):
    """What five raters mean together, to millionths; tests compare with a plain run."""
    return raters.consensus(votes(spark, sf), [0, 1], 3).select("item", "label", F.round("p", 6).alias("p"))


@query(
    """WITH v AS (SELECT l_orderkey AS item, l_returnflag AS label, count(*) AS k FROM lineitem GROUP BY ALL), i AS (SELECT item, sum(k) AS m, sum(k * k) AS same FROM v GROUP BY item HAVING m > 1),
    o AS (SELECT sum(m) AS n, sum((m * m - same) / (m - 1)) AS apart FROM i), e AS (SELECT sum(k * k) AS pairs FROM (SELECT label, sum(k) AS k FROM v SEMI JOIN i USING (item) GROUP BY label))
    SELECT n::BIGINT AS n, round(apart / n, 9) AS observed, round((n * n - pairs) / (n * (n - 1)), 9) AS expected, round(1 - (apart / n) / ((n * n - pairs) / (n * (n - 1))), 9) AS alpha FROM o, e"""
)
def q_agreement(spark, sf):
    """How far the lines of an order agree on what was returned."""
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater"), F.col("l_returnflag").alias("label"))
    found = raters.agreement(rows)
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")])


@query(
    """WITH w AS (SELECT l_suppkey, l_partkey, count(*) AS c FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC) AS i FROM w)
    SELECT l_suppkey, count(*) AS works, sum(c)::BIGINT AS citations, count(*) FILTER (WHERE c >= i) AS h FROM r GROUP BY l_suppkey"""
)
def q_h_index(spark, sf):
    """Suppliers as authors, their parts as works, line items as citations."""
    works = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("citations"))
    return standing.h_index(works, "l_suppkey")


@query()
def q_distinct_readers(spark, sf):
    """About how many customers ordered, by status, priority and in all, from sketches; tests compare with exact counts."""
    orders = read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    return standing.rollup(standing.sketches(orders, "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")


# -- taxonomies ----------------------------------------------------------------------------------------------------------


def brand_taxonomies(spark, sf):
    """Brands as surveys, whose types hold parts: survey, node, parent, label."""
    p = read(spark, sf, "part").select("p_brand", "p_type", "p_name").distinct()
    kind = F.concat_ws(" ", F.lower("p_type"), F.when(F.length("p_brand") % 2 == 0, "goods"))
    tops = p.select(F.col("p_brand").alias("survey"), F.concat_ws("|", "p_brand", "p_type").alias("node"), F.lit(None).cast("string").alias("parent"), kind.alias("label"))
    return tops.unionByName(p.select("p_brand", F.concat_ws("|", "p_brand", "p_type", "p_name"), F.concat_ws("|", "p_brand", "p_type"), "p_name").toDF("survey", "node", "parent", "label")).distinct()


@query()
def q_taxonomy_merge(spark, sf):
    """Elements of the merged taxonomy and the brands that have them; tests compare with a plain run."""
    nodes = brand_taxonomies(spark, sf)
    return taxonomy.frequency(nodes, taxonomy.merge(nodes, 2))


# -- digest --------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS seq, min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')))) AS leader FROM documents")
def q_stream_leaders(spark, sf):
    """Leaders of documents by their titles, as they arrive in a stream of the table's files."""
    whole = read(spark, sf, "documents")
    stream = spark.readStream.schema(whole.schema).parquet(f"{sf}/documents.parquet*")
    rows = stream.select(F.col("doc_id").alias("seq"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("doi", "arxiv_id")], F.lit(None).cast("timestamp").alias("at"))
    at = f"{shared_dir(spark)}/digest-{uuid.uuid4().hex}"
    digest.follow(rows, f"{at}/library", f"{at}/state").awaitTermination()
    return digest.assigned(spark, f"{at}/library")
