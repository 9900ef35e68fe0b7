import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import minhash as M


@pytest.mark.parametrize(("n", "j"), [(1, 1.0), (4, 0.6), (50, 0.8), (500, 0.8), (5000, 0.5)])
def test_sketch_estimates_jaccard(n, j):
    u = np.random.default_rng(0).integers(0, 2**63, size=2 * n, dtype=np.uint64)
    c = round(n * 2 * j / (1 + j))
    a, b = u[:n], u[n - c : 2 * n - c]
    assert abs((M.sketch(a, k=1000) == M.sketch(b, k=1000)).mean() - c / (2 * n - c)) < 0.06


def test_weights_matter():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, size=200, dtype=np.uint64)
    w = rng.random(200) * 3
    v = w * rng.random(200)
    assert abs((M.sketch(e, w, 1500) == M.sketch(e, v, 1500)).mean() - v.sum() / w.sum()) < 0.06
    ones = np.ones(200)
    assert (M.sketch(e, ones) == M.sketch(e)).all()


@pytest.mark.parametrize("scale", [0.01, 1.0, 40.0, 3000.0])
def test_large_and_small_weights(scale):
    """Similarity doesn't depend on the scale, and neither does the cost: large weights are few regions."""
    rng = np.random.default_rng(3)
    e = rng.integers(0, 2**63, size=60, dtype=np.uint64)
    w, v = rng.random(60) * scale + 1e-3, rng.random(60) * scale + 1e-3
    j = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((M.sketch(e, w, 1500) == M.sketch(e, v, 1500)).mean() - j) < 0.06


def test_differences_keep_what_near_texts_must_share():
    """Whatever the pivot, two near texts that it doesn't account for have one of the kept shingles in common."""
    rng = np.random.default_rng(4)
    of = lambda e, n: (e[n > 0].astype(np.uint64), n[n > 0])
    tried = 0
    for _ in range(3000):
        e = np.arange(1, 25)
        n = rng.integers(0, 4, 24)
        p, x, y = (np.maximum(n + rng.integers(-2, 3, 24) * (rng.random(24) < r), 0) for r in (0.5, 0.15, 0.15))
        for weighted in (True, False):
            a, b, c = (v if weighted else (v > 0).astype(int) for v in (p, x, y))
            if not a.any() or not b.any() or not c.any() or np.minimum(b, c).sum() < 0.8 * np.maximum(b, c).sum():
                continue
            inside = min(np.minimum(a, b).sum(), np.minimum(a, c).sum())
            if np.minimum(b, c).sum() > inside:
                tried += 1
                assert set(M.differences(of(e, p), of(e, x), weighted)) & set(M.differences(of(e, p), of(e, y), weighted))
    assert tried > 100


def plain_shingles(text):
    import re
    from collections import Counter

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def test_shingles():
    rng = random.Random(2)
    for text in ["", " \n", "a", "a b c d", "a b c d e", "x" * 5000 + " y", "é ß 日 本 \x0b t"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(50)]:
        values, counts = M.shingles(text)
        assert len(values) == len(plain_shingles(text))
        if len(values):
            assert counts.sum() == max(len(text.split()) - 4, 1) or " " in text


def classes_of(texts, weighted=True):
    """Brute force: components of pairs with similarity of 0.8 or more, equal texts included."""
    sets = [plain_shingles(t) if weighted else Counter(set(plain_shingles(t))) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = (sets[i] & sets[j]).total()
            if (texts[i] or "") == (texts[j] or "") or both and both >= 0.8 * (sets[i] | sets[j]).total() - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def noisy(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("passage", "weighted", "chunk"), [(0, False, 256), (120, True, 2)])
def test_classes_equal_brute_force(spark, passage, weighted, chunk, monkeypatch):
    """Copies, chains of copies that drift apart, and texts that share a long passage."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng = random.Random(passage)
    common = [f"p{k}" for k in range(passage)]
    texts = [None, "", "", " ", "one", "one"]
    for _ in range(12):
        base = common + [f"b{rng.randrange(5000)}" for _ in range(rng.randint(30, 150))]
        base += base[:20] * rng.randint(0, 3)  # repeated, so that weights count
        copy = " ".join(base)
        texts += [copy, copy]
        for _ in range(6):
            copy = noisy(rng, copy.split(), rng.randint(0, 3))
            texts.append(copy)
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, node string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df, weighted).collect()}
    want = classes_of(texts, weighted)
    first = {}
    for k, c in enumerate(want):
        first.setdefault(c, k)
    assert [got[k] for k in range(len(texts))] == [first[c] for c in want]
    kept = M.keep_one(df, weighted)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())


def test_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"b{k}" for k in range(200)]
    texts = [noisy(rng, base, 2) for _ in range(300)] + [noisy(rng, base, 60) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()}
    assert {got[k] for k in range(300)} == {0}
    assert [got[k] for k in range(300, 320)] == list(range(300, 320))


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 2), (5, "a b c d e f", 3), (5, "q", 4), (5, "q", 5), (6, None, 6)], "doc_id long, text string, class_id int")
    rows = M.near_duplicates(df).collect()
    assert len(rows) == 6
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in rows) == sorted([("None", "5"), ("None", "5"), ("5", "5"), ("5", "5"), ("5", "5"), ("6", "6")])
    kept = sorted((r["doc_id"], r["text"] or "") for r in M.keep_one(df).collect())
    assert kept == [(5, "a b c d e f"), (5, "q"), (6, "")]
    assert M.near_duplicates(df.limit(0)).count() == 0
    assert M.keep_one(df.limit(0)).count() == 0
    weighted = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(spark.createDataFrame([(1, "a b c d e " * 20), (2, "a b c d e " * 2)], "doc_id long, text string"), weighted=True).collect()}
    assert weighted == {1: 1, 2: 2}


@pytest.mark.parametrize("weighted", [True, False])
def test_bitmaps_bound_what_two_texts_share(weighted, spark):
    """Never less than what two sets have in common, and with itself a set has all of its weight."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for k in range(200):
        e = np.unique(M.mix(rng.integers(0, 2**63, size=rng.integers(1, 900), dtype=np.uint64)))
        n, m = rng.integers(0, 4, (2, len(e))) * (rng.random((2, len(e))) < rng.random())
        if not weighted:
            n, m = np.minimum(n, 1), np.minimum(m, 1)
        rows.append((k, M.bitmap(e, n).tolist(), M.bitmap(e, m).tolist()))
        want.append((int(np.minimum(n, m).sum()), int(n.sum())))
    df = spark.createDataFrame(rows, "k long, x array<bigint>, y array<bigint>").select("k", M.shared_most("x", "y").alias("both"), M.shared_most("x", "x").alias("own"))
    for r in df.collect():
        assert r["both"] >= want[r["k"]][0]
        assert r["own"] == want[r["k"]][1]


def test_copies_that_share_a_little_are_not_all_compared(spark, monkeypatch):
    """Texts that go beyond their pivot alike in one sentence only aren't compared in pairs: too little is left for that by the bits of their differences."""
    compared, old = [], M.verify

    def verify(pairs, *args, detail=False, **kwargs):
        if not detail:
            compared.append(pairs.count())
        return old(pairs, *args, detail=detail, **kwargs)

    monkeypatch.setattr(M, "verify", verify)
    rng = random.Random(9)
    base, more = [f"b{k}" for k in range(300)], [f"s{k}" for k in range(10)]
    texts = [" ".join(base)] + [" ".join(more + noisy(rng, base[:20], 0).split() + noisy(rng, base[20:], 12).split()) for _ in range(80)]
    near = noisy(rng, texts[1].split(), 2)
    df = spark.createDataFrame(list(enumerate([*texts, near])), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()}
    want = classes_of([*texts, near])
    assert want == [*range(81), 1]
    assert [got[k] for k in range(82)] == want
    assert sum(compared) < 300


def test_differences_of_one_copy_alone_are_not_joined(spark, monkeypatch):
    """Of what copies have beyond their pivot, only what another of them has too goes on to the join; the copies that it brings together are found."""
    marks, old = [], M.materialize

    def materialize(df, name):
        out = old(df, name)
        if name == "left":
            marks.append(sum(len(r["beyond"] or []) for r in out.select("beyond").collect()))
        return out

    monkeypatch.setattr(M, "materialize", materialize)
    rng = random.Random(10)
    base = [f"b{k}" for k in range(300)]
    texts = [" ".join(base)] + [noisy(rng, base, 12) for _ in range(60)]
    texts += [noisy(rng, t.split(), 3) for t in texts[1:4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(df).collect()}
    want = classes_of(texts)
    assert want == [*range(61), 1, 2, 3]
    assert [got[k] for k in range(64)] == want
    assert 0 < marks[-1] < marks[0] / 3


def test_shared_differences_stay(spark):
    """Two of one pivot's members, one of them outside at least, keep whatever both have, in order and with what is left from there on."""
    rng = random.Random(11)
    rows = []
    for a in (b"p", b"q"):
        for k in range(30):
            beyond = sorted(rng.sample(range(400), rng.randint(0, 25)))
            rows.append((a, bytes([k]), beyond, [rng.randint(1, 99) for _ in beyond], rng.random() < 0.3))
    left = spark.createDataFrame(rows, "a binary, node binary, beyond array<bigint>, rest array<bigint>, outside boolean")
    got = {(bytes(r["a"]), bytes(r["node"])): list(zip(r["beyond"] or [], r["rest"] or [], strict=True)) for r in M.met_marks(left).collect()}
    assert len(got) == len(rows)
    for a, node, beyond, rest, outside in rows:
        of = [x for x in rows if x[0] == a]
        held = lambda m: [x for x in of if m in x[2]]  # noqa: B023, E731
        assert got[a, node] == [(m, r) for m, r in zip(beyond, rest, strict=True) if len(held(m)) > 1 and any(x[4] for x in held(m))]
