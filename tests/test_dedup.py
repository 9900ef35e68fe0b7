import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import fuzzy
from paperloom.operators import dedup
from paperloom.schema import RECORD, with_defaults


def records(spark, rows):
    names = sorted({k for r in rows for k in r} | {"seq", "title"})
    schema = T.StructType([f for f in RECORD if f.name in names])
    return with_defaults(spark.createDataFrame([tuple(r.get(f.name, k if f.name == "seq" else "A title") for f in schema) for k, r in enumerate(rows)], schema))


def merged(spark, *rows):
    return sorted(dedup.deduplicate(records(spark, list(rows))).collect(), key=lambda r: r["seq"])


BASE = {"doi": None, "arxiv_id": None, "citation_count": 100, "sources": ["s2"], "abstract": None}


@pytest.mark.parametrize(
    ("a", "b", "n"),
    [
        ({"title": "One title", "doi": "10.1234/abc"}, {"title": "Quite another", "doi": "10.1234/abc"}, 1),
        ({"title": "One title", "arxiv_id": "2303.12345"}, {"title": "Quite another", "arxiv_id": "2303.12345"}, 1),
        ({"title": "Large Language Models: A Survey"}, {"title": "large language models:  a survey"}, 1),
        ({"title": "Survey of large language models"}, {"title": "Survey of retrieval augmented generation"}, 2),
        ({"title": "x", "doi": ""}, {"title": "y", "doi": ""}, 2),
        ({"title": "A comprehensive survey of large language models and agents"}, {"title": "A comprehensive survey of large language models and agent"}, 1),
    ],
)
def test_pairs(spark, a, b, n):
    assert len(merged(spark, BASE | a, BASE | b)) == n


def test_merge(spark):
    a = BASE | {"title": "T", "doi": "d", "year": 0, "abstract": "ab", "sources": ["b"], "venue": "", "authors": []}
    b = BASE | {"title": "t", "arxiv_id": "x", "citation_count": 200, "year": 2020, "abstract": "abc", "sources": ["a", "b"], "venue": "V", "authors": ["Q"]}
    (r,) = merged(spark, a, b)
    assert (r["title"], r["doi"], r["arxiv_id"], r["citation_count"], r["abstract"], r["year"], r["venue"], r["sources"], r["authors"]) == ("T", "d", "x", 200, "abc", 2020, "V", ["a", "b"], ["Q"])


def brute(rows, percent):
    leaders, out = [], {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        hit = None
        for key in ("doi", "arxiv_id"):
            if hit is None and r.get(key):
                hit = next((x for x in leaders if x.get(key) == r[key]), None)
        hit = hit or next((x for x in leaders if x["title"] == r["title"]), None)
        hit = hit or next((x for x in leaders if fuzzy.close(x["title"], r["title"], percent)), None)
        if hit is None:
            leaders.append(r)
        out[r["seq"]] = (hit or r)["seq"]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_brute_force(spark, seed):
    """Dense keys and titles that chain: a is near b, b near c, a not near c."""
    rng = random.Random(seed)
    stems = ["a long title about retrieval and ranking of records", "another title on graphs and trees for search engines"]
    rows = []
    for k in range(60):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        rows.append({"seq": k, "title": " ".join("".join(t).split()), "doi": f"d{rng.randint(0, 30)}" if rng.random() < 0.3 else None, "arxiv_id": f"x{rng.randint(0, 30)}" if rng.random() < 0.3 else None})
    got = {r["seq"]: r["leader"] for r in dedup.leaders(records(spark, rows)).collect()}
    assert got == brute(rows, 95)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_chains_beyond_the_rounds_are_replayed(spark, rounds):
    """Each record shares its DOI with the one before and its arXiv id with the one after."""
    rows = [{"seq": k, "title": f"t{k}", "doi": f"d{k // 2}", "arxiv_id": f"x{(k + 1) // 2}"} for k in range(40)]
    got = {r["seq"]: r["leader"] for r in dedup.leaders(records(spark, rows), None, rounds).collect()}
    assert got == brute(rows, 101)


def test_a_copy_may_follow_another_than_its_first(spark):
    """The first of two equal records joins a leader by title; then a leader with their DOI arrives."""
    rows = [{"seq": 0, "title": "t"}, {"seq": 1, "title": "t", "doi": "d"}, {"seq": 2, "title": "u", "doi": "d"}, {"seq": 3, "title": "t", "doi": "d"}]
    got = {r["seq"]: r["leader"] for r in dedup.leaders(records(spark, rows), None).collect()}
    assert got == brute(rows, 101) == {0: 0, 1: 0, 2: 2, 3: 2}


def test_keys_that_many_records_share(spark):
    """50,000 records: a third has one title, a third none, many one DOI."""
    k = F.col("id")
    title = F.when(k % 3 == 0, "The same title").when(k % 3 == 1, F.when(k % 2 == 0, "")).otherwise(F.concat(F.lit("t"), k % 997))
    df = spark.range(50_000).select(k.alias("seq"), F.when(k % 5 == 0, "d").when(k % 7 == 0, F.concat(F.lit("e"), k % 1000)).alias("doi"), F.when(k % 11 == 0, F.concat(F.lit("a"), k % 313)).alias("arxiv_id"), title.alias("title"))
    rows = [r.asDict() for r in df.collect()]
    leaders, want = {}, {}
    for r in rows:
        own = [(c, r[c]) for c in ("doi", "arxiv_id") if r[c]] + [("title", (r["title"] or "").lower())]
        hit = next((leaders[x] for x in own if x in leaders), None)
        if hit is None:
            hit = r["seq"]
            leaders |= dict.fromkeys(own, hit)
        want[r["seq"]] = hit
    got = {r["seq"]: r["leader"] for r in dedup.leaders(with_defaults(df), None).collect()}
    assert got == want


def test_fuzzy_join_is_exact(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcde ") for _ in range(rng.randint(8, 90))) for _ in range(12)]
    titles = []
    for s in stems:
        for _ in range(6):
            t = list(s)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(t))
                if rng.random() < 0.5 and len(t) > 2:
                    del t[at]
                else:
                    t.insert(at, rng.choice("abcde"))
            titles.append("".join(t))
    titles = sorted(set(titles))
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {(r["a"], r["b"]) for r in dedup.fuzzy_pairs(df).collect()}
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if fuzzy.close(titles[i], titles[j], 95)}
    assert got == want
    assert want


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert fuzzy.lcs(a, b) == slow(a, b)
    assert fuzzy.token_set_ratio("red bolt", "red bolt survey") == 100.0
    assert fuzzy.token_sort_ratio("b a", "a b") == 100.0


def test_topics_keep_the_longer_label():
    g = dedup.group_topics(["AI for education", "artificial intelligence for education", "graph networks"])
    assert [x["label"] for x in g] == ["artificial intelligence for education", "graph networks"]
    assert g[0]["aliases"] == ["AI for education"]


def test_cross_queries(spark):
    topics = spark.createDataFrame([(0, "RAG"), (1, "LLM")], "seq int, topic string")
    terms = spark.createDataFrame([(0, "survey"), (1, "survey"), (2, "review")], "seq int, term string")
    got = {r["query_string"] for r in dedup.cross_queries(topics, terms).collect()}
    assert got == {f'"{t}" "{s}"' for t in ("RAG", "LLM") for s in ("survey", "review")}
    assert dedup.cross_queries(topics.limit(0), terms).count() == 0


def test_fuzzy_candidates_are_few(spark, monkeypatch):
    """Titles of one length and of the same substrings: counts of characters part most, before any pair is written."""
    import random

    rng = random.Random(3)
    parts = ["tion", "ring", "ment", "able", "ness", "port", "land", "ship"]
    titles = [(k, "".join(rng.choice(parts) for _ in range(12))) for k in range(200)] + [(500, "tion" * 12), (501, "tion" * 11 + "tiox")]
    df = spark.createDataFrame(titles, "id long, title string")
    text = dedup.fuzzy_pairs(df)
    got = {(r.a, r.b) for r in text.collect()}
    from paperloom.functions import fuzzy

    want = {(a, b) for a, x in titles for b, y in titles if a < b and x != y and fuzzy.close(x, y, dedup.PERCENT)}
    assert got == want and (500, 501) in got
    counts = {r.id: [(w >> 8 * k) & 255 for w in (r.count0, r.count1) for k in range(8)] for r in df.select("id", *dedup.counts_of("title")).collect()}
    apart = lambda a, b: sum(abs(x - y) for x, y in zip(counts[a], counts[b], strict=True))
    assert all(sum(counts[k]) == len(t) for k, t in titles)
    assert sum(apart(a, b) <= 4 for a in range(200) for b in range(a)) < 200 * 199 / 2 / 10


def test_fuzzy_titles_meet_by_few_keys():
    """Titles of any ratio have a key in common, and those of common short substrings alone have none."""
    import pyarrow as pa

    def keys(titles, percent):
        out = dedup.blocked(pa.RecordBatch.from_pydict({"id": list(range(len(titles))), "title": titles}), percent)
        found = {}
        for key, k, n in zip(out["key"].to_pylist(), out["id"].to_pylist(), out["n"].to_pylist(), strict=True):
            assert n == len(titles[k])
            found.setdefault(k, set()).add(key)
        return [found.get(k, set()) for k in range(len(titles))]

    rng = random.Random(5)
    for percent in (95, 80, 50):
        first = ["".join(rng.choice("abcdéα ") for _ in range(rng.choice((rng.randint(1, 30), rng.randint(30, 400))))) for _ in range(150)]
        other = []
        for t in first:
            t = list(t)
            for _ in range(rng.randint(0, (100 - percent) * 2 * len(t) // 100 + 1)):
                if t and rng.random() < 0.4:
                    del t[rng.randrange(len(t))]
                else:
                    t.insert(rng.randint(0, len(t)), rng.choice("abcd"))
            other.append("".join(t))
        own = keys(first + other, percent)
        near = [k for k in range(150) if first[k] and first[k] != other[k] and fuzzy.close(first[k], other[k], percent)]
        assert len(near) > 30
        assert all(own[k] & own[150 + k] for k in near)
        bags = abs(dedup.triples([first[k] for k in near]) - dedup.triples([other[k] for k in near])).sum(1)
        assert all(d <= 5 * ((100 - percent) * (len(first[k]) + len(other[k])) // 100) for d, k in zip(bags, near, strict=True))
    parts = ["tion", "ring", "ment", "able", "ness", "port", "land", "ship"]
    far = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(100)]
    own = keys(far, 95)
    fours = [{t[k : k + 4] for k in range(237)} for t in far]
    met = lambda sets: sum(len(sets[a] & sets[b]) for a in range(100) for b in range(a))
    assert max(map(len, own)) < 0.7 * 240 and met(own) < met(fours) / 2
