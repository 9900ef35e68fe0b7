import itertools
import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import citations, facets, itemsets, raters, standing, taxonomy, terms, timeline, vectors

SF = "/root/testdata/sf0.1"


# -- vectors -------------------------------------------------------------------------------------------------------------


def nearest(rows, asked, k):
    """All distances, one pair at a time."""
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in asked:
        if q in good:
            near = sorted((float(((v - good[q]) ** 2).sum()), i) for i, v in good.items() if i != q)
            out |= {(q, i, n + 1) for n, (_, i) in enumerate(near[:k])}
    return out


def vector_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.standard_normal(8) * 0.4).astype(np.float32)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 2)]  # one vector that a third of the rows have
    rows += [(5001, None), (5002, []), (5003, [1.0] * 7), (5004, [math.nan] * 8), (5005, [math.inf] * 8), (None, rows[0][1]), (5006, [None] * 8)]
    return rows


@pytest.mark.parametrize("sizes", [(4096, 256), (16, 3)])
def test_exact_search_equals_all_distances(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "CHUNK", sizes[0])
    monkeypatch.setattr(vectors, "BATCH", sizes[1])
    rows = vector_rows(sizes[0])
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    index = vectors.build(df, 5)
    asked = [i for i, _ in rows if i is not None and (i % 7 == 0 or i > 5000)]
    found = vectors.exact(index, df.where("id % 7 = 0 OR id > 5000"), 5)
    assert {(r.id, r.neighbour, r.rank) for r in found.collect()} == nearest(rows, asked, 5)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0])], "id long, vector array<float>")
    index = vectors.build(df, 3)
    assert {tuple(r)[:2] for r in vectors.exact(index, df, 3).collect()} == {tuple(r)[:2] for r in vectors.by_codes(index, df, 3).collect()} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError):
        vectors.exact(index, df, 4)
    empty = vectors.build(df.limit(0), 3)
    assert empty.width == 0 and vectors.exact(empty, df, 3).count() == vectors.by_codes(empty, df, 3).count() == 0


def test_codes_find_nine_of_ten(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    index = vectors.build(rows)
    pairs = lambda df: {(r.id, r.neighbour) for r in df.collect()}
    want = pairs(vectors.exact(index, rows.where("id % 100 = 0")))
    got = pairs(vectors.by_codes(index, rows.where("id % 100 = 0")))
    assert len(want) == 200 and len(want & got) >= 0.9 * len(want)


# -- references ----------------------------------------------------------------------------------------------------------


def words(x):
    import re

    return set(re.findall("[a-z0-9]+", (x or "").lower()))


def test_titles_found_equal_all_scores(spark):
    """Every text against every title, with a title and a word that a third of the rows have."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    title = lambda: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 60])]) for _ in range(rng.randint(1, 6)))
    titles = [(i, title() + rng.choice(["", " the"])) for i in range(150)] + [(150 + i, "the same title") for i in range(80)] + [(900, None), (901, "!?")]
    texts = [rng.choice(titles)[1] or "x" for _ in range(80)] + [title() for _ in range(120)] + ["the", "unknown words only", "", "w1 w2 zzz"]
    index = terms.build(spark.createDataFrame(titles, "seq long, title string"))
    found = {r.text: r.seq for r in terms.best_titles(index, spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    sets = [(s, words(t)) for s, t in titles if words(t)]
    count, n = Counter(w for _, ws in sets for w in ws), len(sets)
    weigh = lambda ws: sum(math.floor(math.log(1 + n / count.get(w, 1)) * 1000 + 0.5) for w in ws)
    want = {}
    for t in set(texts):
        rated = [(2 * weigh(words(t) & ws) / (weigh(words(t)) + weigh(ws)), -s) for s, ws in sets] if words(t) else []
        if rated and max(rated)[0] >= terms.LEAST:
            want[t] = -max(rated)[1]
    assert found == want
    index.discard()
    empty = terms.build(spark.createDataFrame([], "seq long, title string"))
    assert terms.best_titles(empty, spark.createDataFrame([("a",)], "text string")).count() == 0


def test_lookups_compare_few_pairs_and_carry_no_words(spark):
    """Texts that share half of their words with titles of the same length: bounds leave few pairs, of which only ids are written."""
    rng = random.Random(9)
    usual, rare = [f"u{k}" for k in range(150)], [f"r{k}" for k in range(4000)]
    title = lambda: " ".join(rng.sample(usual, 12) + rng.sample(rare, 6))
    titles = [(i, title()) for i in range(600)]
    texts = [title() for _ in range(570)] + [t + " more" for _, t in titles[:30]]
    index = terms.build(spark.createDataFrame(titles, "seq long, title string"))
    sets = spark.createDataFrame([(t,) for t in texts], "text string").select(terms.words_key("text").alias("words"))
    sets = sets.withColumn("key", terms.hashed(terms.F.array_join("words", " ")))
    sets = terms.term_sets(sets, index.words, index.rarest).withColumn("total", terms.total("terms")).withColumn("id", terms.F.xxhash64("key"))
    pairs = terms.candidates(sets, index.postings, index.least)
    assert dict(pairs.dtypes) == {"id": "bigint", "seq": "bigint"}
    assert 30 <= pairs.count() <= 60
    assert terms.resolved(index, spark.createDataFrame([(t,) for t in texts], "text string")).count() >= 30
    index.discard()


def test_most_shared_equals_all_counts(spark):
    rng = random.Random(8)
    vocabulary = [f"t{k}" for k in range(25)]
    pick = lambda n: [rng.choice(vocabulary[: rng.choice([4, 25])]) for _ in range(n)]
    records = [(i, rng.choice([None, 1, 5, 9]), pick(rng.randint(0, 5)) + ["all"] * (i % 3 == 0)) for i in range(300)]
    asked = [(f"a{k}", pick(rng.randint(1, 5)) + ["all"] * (k % 2)) for k in range(40)] + [("none", ["zzz"]), ("empty", [])]
    found = terms.most_shared(spark.createDataFrame(asked, "key string, tokens array<string>"), spark.createDataFrame(records, "seq long, citation_count long, tokens array<string>"), 4)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.key, r.rank)):
        got[r.key].append((r.seq, r.overlap))
    want = {}
    for key, tokens in asked:
        rated = sorted((-len(set(tokens) & set(ws)), -(c if c is not None else -1), s) for s, c, ws in records if set(tokens) & set(ws))
        if rated:
            want[key] = [(s, -o) for o, _, s in rated[:4]]
    assert dict(got) == want


# -- citations -----------------------------------------------------------------------------------------------------------


def graph(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(120)] + [(7, k) for k in range(60, 120)] + [(3, 3), (None, 1), (1, None), (5, 6), (5, 6), (200, 201)]
    return edges, sorted({(a, b) for a, b in edges if a is not None and b is not None and a != b})


@pytest.mark.parametrize(("forward", "backward"), [(True, True), (True, False), (False, True), (False, False)])
def test_snowball_equals_a_plain_walk(spark, forward, backward):
    given, edges = graph(1)
    seeds, around = [3, 11, 999, None, 3], defaultdict(set)
    for a, b in edges:
        if forward:
            around[a].add(b)
        if backward:
            around[b].add(a)
    want = {x: (0, None) for x in seeds if x is not None}
    front = set(want)
    for level in (1, 2, 3):
        new = {y: min(x for x in front if y in around[x]) for x in front for y in around[x] if y not in want}
        want |= {y: (level, via) for y, via in new.items()}
        front = set(new)
    df, start = spark.createDataFrame(given, "src long, dst long"), spark.createDataFrame([(x,) for x in seeds], "node long")
    found = citations.snowball(df, start, 3, forward, backward, chunk=8)
    assert {r.node: (r.level, r.via) for r in found.collect()} == want
    assert citations.snowball(df.limit(0), start, 2).count() == 3


def test_ranks_equal_power_iteration(spark):
    given, edges = graph(2)
    nodes = sorted({x for e in edges for x in e})
    degree, p, d = Counter(a for a, _ in edges), {x: 1 / len(nodes) for x in nodes}, 0.5
    for _ in range(80):
        idle = sum(p[x] for x in nodes if not degree[x])
        new = {x: (1 - d) / len(nodes) + d * idle / len(nodes) for x in nodes}
        for a, b in edges:
            new[b] += d * p[a] / degree[a]
        p = new
    df = spark.createDataFrame(given, "src long, dst long")
    found = {r.node: r["rank"] for r in citations.rank(df, damping=d, least=1e-5, chunk=8).collect()}
    assert found.keys() == p.keys() and all(abs(found[x] - p[x]) < 1e-6 for x in p)
    assert citations.rank(df.limit(0)).count() == 0


# -- itemsets ------------------------------------------------------------------------------------------------------------


def test_itemsets_equal_all_combinations(spark):
    rng = random.Random(6)
    rows = [(i, f"w{min(int(rng.expovariate(0.25)), 14)}") for i in [*range(-70, 200), 10**12] for _ in range(rng.randint(0, 7))]
    rows += [(i, "all") for i in range(200)] + [(None, "all"), (5, None)] + rows[:20]
    have = defaultdict(set)
    for i, x in rows:
        if i is not None and x is not None:
            have[i].add(x)
    count = Counter(c for items in have.values() for n in (1, 2, 3, 4) for c in itertools.combinations(sorted(items), n))
    df = spark.createDataFrame(rows, "id long, item string")
    found = itemsets.frequent(df, 12, 4)
    got = {tuple(r["items"]): r["n"] for r in found.collect()}
    assert got == {c: n for c, n in count.items() if n >= 12} and max(map(len, got)) == 4
    for r in itemsets.associations(found, len(have)).collect():
        assert r.lift == pytest.approx(count[r.a, r.b] * len(have) / count[(r.a,)] / count[(r.b,)]) and r.pmi == pytest.approx(math.log2(r.lift))
    assert itemsets.frequent(df.limit(0), 1).count() == itemsets.frequent(df, 10**6).count() == 0


# -- attributes ----------------------------------------------------------------------------------------------------------


def test_conditions_equal_filters(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 30, None]), "one") for i in [*range(0, 300), *range(32760, 32780), 10**7, 10**9]] + [(None, "x", 1, "one")]
    df = spark.createDataFrame(rows, "id long, a string, b int, c string").cache()
    index = facets.build(df, "a", "b", "c").cache()
    a, b = facets.Among("a", ("x", None)), facets.Between("b", 2, 30)
    cases = {
        "a = 'x' OR a IS NULL": a, "NOT (a = 'x' OR a IS NULL)": ~a, "coalesce(b BETWEEN 2 AND 30, false)": b, "NOT coalesce(b BETWEEN 2 AND 30, false)": ~b,
        "(a = 'x' OR a IS NULL) AND NOT coalesce(b BETWEEN 2 AND 30, false)": a & ~b, "NOT ((a = 'x' OR a IS NULL) OR coalesce(b BETWEEN 2 AND 30, false))": ~(a | b),
        "NOT ((a = 'x' OR a IS NULL) AND NOT coalesce(b BETWEEN 2 AND 30, false))": ~(a & ~b), "false": facets.Among("a", ("none",)), "true": ~facets.Among("nothing", ()) | facets.Among("c", ("one",)), "NOT NOT (b = 1)": ~~facets.Among("b", (1,)),
    }
    for sql, where in cases.items():
        chosen = facets.select(index, where)
        kept = df.where("id IS NOT NULL").where(sql).collect()
        assert sorted(r.id for r in facets.ids(chosen).collect()) == sorted(r.id for r in kept), sql
        want = Counter((k, None if r[k] is None else str(r[k])) for r in kept for k in "abc")
        assert {(r.attribute, r.value): r.n for r in facets.counts(index, chosen).collect()} == dict(want), sql


# -- time ----------------------------------------------------------------------------------------------------------------


def plain_bursts(n, whole, ratio, effort):
    """Both states at every step, with whole courses."""
    p = sum(n) / sum(whole)
    cost = lambda k, q: -(n[k] * math.log(q) + (whole[k] - n[k]) * math.log(1 - q))
    rates, up = (min(p, 1 - 1e-9), min(p * ratio, 1 - 1e-9)), effort * math.log(len(n))
    low, high = (0.0, []), (math.inf, [])
    for k in range(len(n)):
        new_low = (high[0], high[1]) if high[0] < low[0] else low
        new_high = high if high[0] <= low[0] + up else (low[0] + up, low[1])
        low, high = (new_low[0] + cost(k, rates[0]), new_low[1] + [0]), (new_high[0] + cost(k, rates[1]), new_high[1] + [1])
    course = [0, *(high if high[0] < low[0] else low)[1], 0]
    return [(k, next(j for j in range(k, len(n)) if not course[j + 2])) for k in range(len(n)) if course[k + 1] and not course[k]]


def plain_changes(n, effort):
    """Every beginning at every step."""
    m, mean = len(n), sum(n) / len(n)
    b = sum((x - mean) ** 2 for x in n) / m * math.log(m) * effort
    best, path = [-b], [[]]
    for j in range(1, m + 1):
        run = lambda i: sum(x * x for x in n[i:j]) - sum(n[i:j]) ** 2 / (j - i)  # noqa: E731, B023
        value, i = min((best[i] + run(i) + b, i) for i in range(j))
        best.append(value)
        path.append([*path[i], i])
    return [i for i in path[m] if i]


def test_bursts_and_changes_equal_plain_searches(spark):
    rng, start = np.random.default_rng(5), datetime(2024, 3, 1)
    levels = {"calm": [20] * 70, "burst": [8] * 30 + [40] * 6 + [8] * 34, "step": [5] * 25 + [15] * 20 + [3] * 25, "rare": [0] * 35 + [1] * 35}
    counts = {k: [int(x) for x in rng.poisson(v)] for k, v in levels.items()}
    rows = [(k, start + timedelta(hours=h, minutes=i % 60)) for k, v in counts.items() for h, n in enumerate(v) for i in range(n)] + [(None, start), ("calm", None)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp")
    filled = timeline.series(df, "kind", "ts").cache()
    got = defaultdict(dict)
    for r in filled.collect():
        got[r.kind][int((r.step - start) / timedelta(hours=1))] = r.n
    assert {k: [v[h] for h in sorted(v)] for k, v in got.items()} == counts
    whole = [sum(v[h] for v in counts.values()) for h in range(70)]
    at = lambda x: int((x - start) / timedelta(hours=1))
    found = defaultdict(list)
    for r in timeline.bursts(filled, 2.0, 1.0).orderBy("start").collect():
        found[r.kind].append((at(r.start), at(r.end)))
    assert dict(found) == {k: x for k, v in counts.items() if (x := plain_bursts(v, whole, 2.0, 1.0))} and any(b - a >= 4 for a, b in found["burst"])
    for effort in (0.1, 2.0):
        cuts = defaultdict(list)
        for r in timeline.changes(filled, effort).orderBy("step").collect():
            cuts[r.kind].append(at(r.step))
        assert dict(cuts) == {k: x for k, v in counts.items() if (x := plain_changes(v, effort))}
    assert len(cuts["step"]) == 2
    none = timeline.series(df.where(F.lit(False)), "kind", "ts")
    assert none.count() == timeline.bursts(none).count() == timeline.changes(none).count() == 0


# -- raters and standing -------------------------------------------------------------------------------------------------


def plain_consensus(votes, labels, rounds, smoothed):
    items, people = sorted({v[0] for v in votes}), sorted({v[1] for v in votes})
    p = {i: {t: sum(v == (i, v[1], t) for v in votes if v[0] == i) / sum(v[0] == i for v in votes) for t in labels} for i in items}
    for _ in range(rounds):
        prior = {t: sum(p[i][t] for i in items) + smoothed for t in labels}
        said = {(r, t, x): smoothed + sum(p[i][t] for i, q, y in votes if q == r and y == x) for r in people for t in labels for x in labels}
        new = {}
        for i in items:
            odds = {t: prior[t] for t in labels}
            for _, r, x in (v for v in votes if v[0] == i):
                for t in labels:
                    odds[t] *= said[r, t, x] / sum(said[r, t, y] for y in labels)
            new[i] = {t: odds[t] / sum(odds.values()) for t in labels}
        p = new
    return p


def test_consensus_and_agreement_equal_plain_runs(spark):
    rng = random.Random(3)
    votes = [(i, r, rng.choice("abc") if rng.random() < 0.15 * r else "abc"[i % 3]) for i in range(40) for r in range(5) if rng.random() < 0.8]
    votes += [(99, 0, "a"), (0, 1, "b"), (0, 1, "b")]
    df = spark.createDataFrame([*votes, (None, 1, "a"), (1, None, "a"), (1, 1, None)], "item int, rater int, label string")
    found = defaultdict(dict)
    for r in raters.consensus(df, list("abc"), 4).collect():
        found[r["item"]][r.label] = r.p
    want = plain_consensus(votes, list("abc"), 4, raters.SMOOTHED)
    assert found.keys() == want.keys() and all(abs(found[i][t] - want[i][t]) < 1e-9 for i in want for t in "abc")
    # alpha from all ordered pairs of votes within items and over all
    by = defaultdict(list)
    for i, _, x in votes:
        by[i].append(x)
    by = {i: v for i, v in by.items() if len(v) > 1}
    every = [x for v in by.values() for x in v]
    apart = sum(a != b for v in by.values() for k, a in enumerate(v) for j, b in enumerate(v) if k != j)
    observed = sum(sum(a != b for k, a in enumerate(v) for j, b in enumerate(v) if k != j) / (len(v) - 1) for v in by.values()) / len(every)
    expected = sum(a != b for k, a in enumerate(every) for j, b in enumerate(every) if k != j) / (len(every) * (len(every) - 1))
    (row,) = raters.agreement(df).collect()
    assert apart and row.n == len(every) and row.observed == pytest.approx(observed) and row.expected == pytest.approx(expected) and row.alpha == pytest.approx(1 - observed / expected)
    assert raters.agreement(df.limit(0)).count() == raters.consensus(df.limit(0), ["a"], 1).count() == 0


def test_precision_and_its_spread(spark):
    rows = spark.range(1, 401).selectExpr("id", "int(id) AS rank", "id % 4 <> 0 AS relevant")
    found = {r.k: r for r in raters.precision(rows, (40, 400)).collect()}
    for k in (40, 400):
        error = math.sqrt(0.75 * 0.25 / k)
        assert found[k].precision == 0.75 and abs(0.75 - found[k].low - 1.96 * error) < 0.6 * error and abs(found[k].high - 0.75 - 1.96 * error) < 0.6 * error
    assert raters.precision(rows.limit(0), (5,)).count() == 0


def test_sketches_stay_within_their_error(spark):
    found = standing.rollup(standing.sketches(spark.range(60_000).selectExpr("id % 20000 AS x", "id % 3 AS a", "id % 7 AS b"), "x", "a", "b"), "a", "b").collect()
    exact = defaultdict(set)
    for i in range(60_000):
        for key in ((i % 3, i % 7), (i % 3, None), (None, None)):
            exact[key].add(i % 20000)
    assert len(found) == len(exact) == 25 and all(abs(r.n / len(exact[r.a, r.b]) - 1) < 4 * 1.04 / 64 for r in found)


# -- taxonomies ----------------------------------------------------------------------------------------------------------


def plain_merge(nodes, levels, least, hashed):
    """The same rounds with every pair rated; nodes are (survey, node, parent, label)."""
    rows = {(s, n, p, tuple(sorted(words(t)))) for s, n, p, t in nodes if s is not None and n is not None and words(t)}
    element, out = {None: ""}, {}
    for level in range(levels):
        now = [(s, n, p, w, element[p] + "/" + " ".join(w)) for s, n, p, w in rows if (p is None) == (level == 0) and p in element]
        scope = {i: element[p] for _, _, p, _, i in now}
        spots = defaultdict(set)
        for s, _, p, _, i in now:
            spots[i].add((s, p))
        sim = lambda a, b: 2 * len(own[a] & own[b]) / (len(own[a]) + len(own[b]))  # noqa: E731, B023
        own = {i: set(w) for *_, w, i in now}
        near = {a: {b for b in own if b != a and scope[a] == scope[b] and sim(a, b) >= least - 1e-9 and not spots[a] & spots[b]} for a in own}
        turn = lambda i: (hashed[i], i)
        left, pivot = set(own), {}
        while left:
            first = {i for i in left if all(turn(i) < turn(j) for j in near[i] & left)}
            wish = {i: max(near[i] & first, key=lambda b: (sim(i, b), -hashed[b], b)) for i in left - first if near[i] & first}  # noqa: B023
            for i, b in wish.items():
                rivals = [j for j, c in wish.items() if c == b and j != i and spots[i] & spots[j]]
                if all((-sim(i, b), hashed[i], i) < (-sim(j, b), hashed[j], j) for j in rivals):
                    pivot[i] = b
            pivot |= {i: i for i in first}
            left -= set(pivot)
        element = {n: pivot[i] for _, n, _, _, i in now} | ({None: ""} if level < 0 else {})
        out |= {n: (level, e) for n, e in element.items()}
    return out


def test_taxonomies_merge_in_any_order(spark):
    rng = random.Random(12)
    vocabulary = "graph neural network deep model tree learning data survey text".split()
    nodes = []
    for s in range(6):
        for k in range(5):
            nodes.append((f"s{s}", f"{s}.{k}", None, " ".join(rng.sample(vocabulary, rng.randint(1, 3)))))
            nodes += [(f"s{s}", f"{s}.{k}.{j}", f"{s}.{k}", " ".join(rng.sample(vocabulary, rng.randint(1, 4)))) for j in range(4)]
    nodes += [("s0", "bare", None, "?!"), ("s0", "under", "bare", "graph"), (None, "lost", None, "graph"), nodes[0]]
    kind = "survey string, node string, parent string, label string"
    results = []
    for _ in range(2):
        rng.shuffle(nodes)
        found = taxonomy.merge(spark.createDataFrame(nodes, kind), 2)
        results.append({r.node: (r.level, r.element) for r in found.collect()})
    names = {e for _, e in results[0].values()} | {i for i in _items(nodes, results[0])}
    hashed = {r.i: r.h for r in spark.createDataFrame([(n,) for n in names], "i string").select("i", F.xxhash64("i").alias("h")).collect()}
    assert results[0] == results[1] == plain_merge(nodes, 2, taxonomy.LEAST, hashed)
    counts = {(r.level, r.element): (r.surveys, r.nodes) for r in taxonomy.frequency(spark.createDataFrame(nodes, kind), found).collect()}
    of = {n: s for s, n, _, _ in nodes}
    want = defaultdict(set)
    for n, x in results[0].items():
        want[x].add(n)
    assert counts == {x: (len({of[n] for n in ns}), len(ns)) for x, ns in want.items()} and max(s for s, _ in counts.values()) > 2
    assert taxonomy.merge(spark.createDataFrame([], kind)).count() == 0


def _items(nodes, merged):
    """Names of all labels below the merged parents."""
    for _, _, p, t in nodes:
        if words(t) and (p is None or p in merged):
            yield (merged[p][1] if p is not None else "") + "/" + " ".join(sorted(words(t)))
