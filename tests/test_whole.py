"""Queries over every row of their tables, against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from paperloom.functions import fuzzy, text
from paperloom.plans import catalog

TEXTS = ["the tan cat ran", "The TAN dog, then an owl", "eau und que the", "ten thin men", "a to", "tin can; the pan", "und the sun", "que sera ran", "can ban ran the", "tan ten tin", "the van ran", "", "thin can eau"]


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    """A folder with documents, and the same as (topic, doc_id, lang, elements)."""
    sf = str(tmp_path_factory.mktemp("analysed"))
    rows = [(k, t, "en" if k % 3 else "de", "web" if k % 4 else "wiki", len(t)) for k, t in enumerate(TEXTS, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    return sf, [(source, k, lang, {w for w in re.sub("[^a-z ]", " ", t.lower()).split(" ") if 3 <= len(w) <= 5}) for k, t, lang, source, _ in rows]


def covered(docs):
    """(topic, element) → records, and topic → all records."""
    return Counter((t, e) for t, _, _, own in docs for e in own), Counter(t for t, *_ in docs)


def low(n, total):
    return n < max(1, round(0.3 * total))


def test_coverage_counts_every_document(spark, analysed):
    sf, docs = analysed
    c, n = covered(docs)
    got = {tuple(r) for r in catalog.q_low_coverage(spark, sf).collect()}
    assert got == {(t, e, k, n[t], low(k, n[t])) for (t, e), k in c.items()}


def test_deepest_ranks_every_document(spark, analysed):
    sf, docs = analysed
    c, n = covered(docs)
    want = set()
    for t in n:
        order = sorted(((-k, e) for (u, e), k in c.items() if u == t))
        for kind, chosen in (("deepest", order), ("weakest", [x for x in order if low(-x[0], n[t])])):
            want |= {(t, kind, i, e, -k) for i, (k, e) in enumerate(chosen[:3], 1)}
    assert {tuple(r) for r in catalog.q_deepest_weakest(spark, sf).collect()} == want


def test_matrix_and_orientations_have_every_document(spark, analysed):
    sf, docs = analysed
    got = {(r["seq"], *(r[m] for m in catalog.MATRIX)) for r in catalog.q_coverage_matrix(spark, sf).collect()}
    assert got == {(k, *(int(m in own) for m in catalog.MATRIX)) for _, k, _, own in docs}
    assert {tuple(r) for r in catalog.q_orientation(spark, sf).collect()} == {(*key, k) for key, k in Counter((t, lang) for t, _, lang, _ in docs).items()}


def test_gaps_of_every_document(spark, analysed):
    sf, docs = analysed
    c, n = covered(docs)
    want = set()
    for (t, e), k in c.items():
        if e.startswith("t") and k / n[t] < 0.3:
            want.add((t, e, "frequency", round(1 - k / n[t], 4)))
        if e.endswith("n") and not e.startswith("t") and k >= 3:
            want.add((t, e, "convergence", round(k / n[t], 4)))
    assert {tuple(r) for r in catalog.q_gap_rules(spark, sf).collect()} == want


def test_components_take_every_link(spark, tmp_path):
    rows = [(1, 1, 50.0), (2, 1, 3.0), (2, 2, 49.0), (3, 3, 50.0), (4, 4, 1.0), (5, 3, 20.0), (5, 3, 50.0), (6, 5, 49.0), (7, 5, 50.0)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for part, supplier, _ in rows:
        a, b = find(part), find(supplier + 1000000)
        up[max(a, b)] = min(a, b)
    assert {tuple(r) for r in catalog.q_components(spark, str(tmp_path)).collect()} == {(x, find(x)) for x in list(up)}


def test_find_records_looks_every_title_up(spark, tmp_path):
    shared = "a corpus of river sediment measurements gathered over many decades by volunteers along the northern coast "
    firsts = [shared * 2 + "with copper", shared * 2 + "with copper and tin", "zinc", "Copper smelting of early towns", "zinc", "", "early smelting: copper towns", "unrelated lighthouse keepers", shared.strip(), "Glacier melt in the western ranges", "glacier melts in the western range"]
    rows = [(k, f"{t}\nbody", "en", "web" if k % 5 else "wiki", 9) for k, t in enumerate(firsts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sides = spark.createDataFrame([(k, t, t[9:69], s) for (k, _, _, s, _), t in zip(rows, firsts, strict=True)], "k long, t string, f string, s string")
    own = sides.select("k", "s", "t", "f", text.title_signature("t").alias("t_"), text.title_signature("f").alias("f_")).collect()
    want = set()
    for a in own:
        f, peers = a["f"].strip().lower(), [b for b in own if b["s"] == a["s"]]
        sure = [b["k"] for b in peers for t in [b["t"].lower()] if f and (f == t or len(f) > 15 and f in t or len(t) > 15 and t in f)]
        if sure:
            want.add((a["s"], a["k"], min(sure)))
        elif f and a["f_"]:
            best, second = sorted(((-fuzzy.token_set_ratio(a["f_"], b["t_"]), b["k"]) for b in peers if b["t_"]))[:2] if sum(bool(b["t_"]) for b in peers) > 1 else ((0, 0), (0, 0))
            if -best[0] >= 70 and second[0] - best[0] >= 15:
                want.add((a["s"], a["k"], best[1]))
    assert len(want) > 5
    assert {(r["topic"], r["fid"], r["seq"]) for r in catalog.q_find_records(spark, str(tmp_path)).collect()} == want


def test_alike_rates_as_all_pairs_do(spark):
    """Texts that meet by length or by common words get the scores that rating all pairs gives, and only a few are rated by characters."""
    import random

    from paperloom.operators import matching

    rng = random.Random(4)
    words = ["copper", "tin", "zinc", "towns", "early", "smelting", "glacier", "melt", "melts", "range", "ranges", "western", "keepers"]
    fragments = sorted({(t, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for t in "ab" for _ in range(25)})
    titles = sorted({(t, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 12))))) for t in "ab" for _ in range(40)})
    one = spark.createDataFrame(fragments, "topic string, f_ string")
    two = spark.createDataFrame([(t, x, k, 1 + k % 2) for k, (t, x) in enumerate(titles)], "topic string, t_ string, seq long, n long")
    for over in (55, 30):
        want = {(t, f, k, 1 + k % 2, s) for t, f in fragments for k, (u, x) in enumerate(titles) if t == u for s in [fuzzy.token_set_ratio(f, x)] if s > over}
        rows = matching.alike(one, two, over).collect()
        got = {(r["topic"], r["f_"], r["seq"], r["n"], r["score"]) for r in rows}
        assert got == want and len(rows) == len(want) > 50


def test_least_hashes_of_long_texts():
    """What a text has of hashes, every text that contains it has; long ones take one pass."""
    import random
    import time

    from paperloom.operators import matching

    rng = random.Random(2)
    long = "".join(rng.choice("abcdeé ") for _ in range(2_000_000))
    for width, window in matching.TIERS:
        wide = width + window - 1
        parts = [long[k : k + wide + 9 * m] for m, k in enumerate((0, 7, 500, 63_000, 1_999_000))]
        began = time.process_time()
        whole, *own, short, none = matching.least_hashes([long, *parts, long[: wide - 1], None], width, window)
        assert time.process_time() - began < 20
        assert short is None and none is None
        assert all(len(x) and set(x) <= set(whole) for x in own) and len(whole) < len(long) * 3 / window
