import math
import random
import re
import zlib

import pytest

from paperloom.llm import quality, toxicity

CLEAN, BAD = [f"word{k}" for k in range(200)], ["vile", "rotten", "viler", "vilest"]


def bag(rng, bad):
    sentences = [" ".join(rng.choice(CLEAN) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 8))]
    if bad:
        k = rng.randrange(len(sentences))
        sentences[k] += " " + rng.choice(BAD[:3])
    return ". ".join(sentences) + "."


def test_toxicity_learns_sentences_from_documents():
    rng = random.Random(1)
    rows = [(bag(rng, y), y) for y in [0, 1] * 250]
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    test = [(bag(rng, y), y) for y in [0, 1] * 100]
    assert sum((model.score(t) >= 0.7) == bool(y) for t, y in test) >= 195
    text = "word1 word2 word3. word4 vile word5! word6"
    ((a, b, p),) = model.locate(text)
    assert text[a:b].strip() == "word4 vile word5" and p > 0.5
    # unseen inflections share character n-grams
    assert model.score("word1 word2 vilest.") > model.score("word1 word2 word3.")


def test_noisy_or():
    m = toxicity.Model(toxicity.np.zeros(toxicity.FEATURES, "f4"), -1.0)
    p = 1 / (1 + math.exp(1))
    assert m.score("a. b! c") == pytest.approx(1 - (1 - p) ** 3)
    assert m.score("") == m.score(None) == m.score("...!\n") == 0.0


def plain_toxicity(model, text):
    """Score and offending sentences, one sentence and one word at a time."""
    found = []
    for m in re.finditer(r"[^.!?\n]+", text or ""):
        if words := set(re.findall(r"\w+", m[0].lower())):
            z = model.bias
            for w in words:
                edged = f"^{w}$"
                z += sum(float(model.weights[zlib.crc32(g.encode()) % toxicity.FEATURES]) for g in ["=" + w, *{edged[i : i + 4] for i in range(len(edged) - 3)}])
            found.append((m.start(), m.end(), z))
    level = -math.inf
    if found:
        highest, share = sorted(map(float, model.background.highest), reverse=True), toxicity.SHARE / len(found)
        tail = max(10, model.background.count // 500)
        start, rank = highest[tail], share * model.background.count
        mean = sum(highest[:tail]) / tail - start
        level = highest[int(rank)] if rank >= tail else start + max(0.5, mean) * math.log(tail / rank)
    left = 1.0
    for _, _, z in found:
        if z > level:
            left *= (1 + math.exp(level)) / (1 + math.exp(z))
    return 1 - left, [(a, b) for a, b, z in found if z > max(level, 0)]


@pytest.fixture(scope="module")
def labelled(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = docs.join(labels, "doc_id").where("toxic IS NOT NULL").orderBy("doc_id").collect()
    return toxicity.fit(spark, docs, labels), [r.text for r in rows if r.toxic == 0], [r.text for r in rows if r.toxic == 1]


def test_scores_and_places_equal_plain_ones(labelled):
    model, clean, toxic = labelled
    for text in [*clean[:150], *toxic[:150], "\n".join(clean[:200]), None, "", "...", "x" * 5000]:
        score, places = plain_toxicity(model, text)
        assert model.score(text) == pytest.approx(score, abs=1e-6)
        assert [(a, b) for a, b, _ in model.locate(text)] == places


def test_a_clean_text_may_be_of_any_length(labelled):
    """Up to more than a million words; one bad sentence is still found among them."""
    model, clean, toxic = labelled
    worst = max((s for t in toxic for s in re.findall(r"[^.!?\n]+", t)), key=lambda s: model.logit(s.lower()) or -99)
    for n in (1, 10, 100, 1000, len(clean)):
        text = "\n".join(clean[:n])
        assert model.score(text) < 0.3
        assert model.score(f"{text}\n{worst}.\n{text}") > 0.7
        ((a, b, _),) = model.locate(f"{text}\n{worst}.\n{text}")
        assert a <= len(text) + 1 and b >= len(text) + 1
    assert len(text.split()) > 1_000_000


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_without_both_labels(labels):
    texts = ["some text"] * len(labels)
    assert toxicity.train(texts, labels).score("some text") < 1e-9
    assert quality.train(texts, labels, 0.1).scores(["x", None]) == pytest.approx([0.5, 0.5])


def test_quality_ranks_pairs():
    rng = random.Random(2)
    good = [". ".join(" ".join(rng.choice(CLEAN) for _ in range(8)).capitalize() for _ in range(rng.randint(2, 9))) for _ in range(200)]
    bad = [" ".join(f"{rng.choice(CLEAN)}{rng.choice(['***', '$$$', '###'])}" for _ in range(rng.randint(20, 80))) for _ in range(40)] + ["SAME " * rng.randint(10, 60) for _ in range(40)]
    model = quality.train(good + bad, [1] * 200 + [0] * 80, 80 / 280)
    assert min(model.scores(good)) > max(model.scores(bad))
    assert sum(s >= quality.THRESHOLD for s in model.scores(good)) >= 198
    assert sum(s < quality.THRESHOLD for s in model.scores(bad)) >= 78
    assert all(0 <= s <= 1 for s in model.scores(["", None, " ", "x" * 100000]))


def test_weighted_quantile():
    v, w = toxicity.np.array([1.0, 2, 3, 4]), toxicity.np.ones(4)
    assert quality.weighted_quantile(v, w, 0.25) == 1.5
    assert quality.weighted_quantile(v, w, 0.0) == 1.0
    assert quality.weighted_quantile(v, w, 1.0) == 4.0


@pytest.mark.parametrize(("query", "label", "modulus", "left_out"), [(toxicity.op5_toxicity, "toxic", 3, 1), (quality.op8_quality_classifier, "quality", 5, 0)])
def test_queries_on_held_out_labels(spark, query, label, modulus, left_out):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == docs and len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == left_out) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_training_rows_exclude_held_out_ones(spark):
    docs = spark.createDataFrame([(k, f"text {k}", 1) for k in range(60)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, ys = toxicity.labelled_sample(docs, labels, "toxic", 3, 1, 8)
    assert len(texts) == 16 and sum(ys) == 8
    assert all(zlib.crc32(t.split()[1].encode()) % 3 != 1 for t in texts)


def test_filters_keep_columns(spark):
    model = toxicity.Model(toxicity.np.zeros(toxicity.FEATURES, "f4"), -60.0)
    df = spark.createDataFrame([(None, None, 1.5), (1, "a", 2.5), (1, "a", 2.5)], "doc_id long, text string, score double")
    out = toxicity.keep_clean(df, model)
    assert out.schema == df.schema and out.count() == 3
    assert toxicity.score(df, model).count() == 3 and toxicity.score(df.limit(0), model).count() == 0
    width = len(quality.features(""))
    q = quality.Model(toxicity.np.zeros(width), toxicity.np.ones(width), toxicity.np.zeros(width), toxicity.np.zeros(quality.HASHED), 0.0)
    assert quality.keep_good(df, q).schema == df.schema and quality.keep_good(df, q).count() == 3
    assert quality.score(df, q).count() == 3


def test_content_tells_what_form_does_not():
    """Texts of one form: only the words tell good from bad."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    text = lambda own: " ".join(rng.choice(own) for _ in range(40))
    good, bad = [text(words[:40]) for _ in range(200)], [text(words[20:]) for _ in range(200)]
    model = quality.train(good[:100] + bad[:100], [1] * 100 + [0] * 100, 0.5)
    s, t = model.scores(good[100:]), model.scores(bad[100:])
    assert sum(a > b for a, b in zip(s, t, strict=True)) >= 97
    assert sum(x >= quality.THRESHOLD for x in s) >= 90 and sum(x < quality.THRESHOLD for x in t) >= 90


def plain_score(model, text):
    """The same sum, word by word."""
    import math
    from collections import Counter

    words = (text or "").lower().split()
    h = [zlib.crc32(w.encode()) for w in words]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    counts = Counter(x % quality.HASHED for x in h) + Counter((wrap(a * 0x9E3779B1 + b * 0x85EBCA6B + 1) >> 7) % quality.HASHED for a, b in zip(h, h[1:]))
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    own = sum(model.hashed[k] * math.log1p(c) / norm for k, c in counts.items())
    form = sum(w * max(-6.0, min(6.0, (f - c) / s)) for w, f, c, s in zip(model.weights, quality.features(text), model.centre, model.scale))
    z = form + own - model.cut + math.log(quality.THRESHOLD / (1 - quality.THRESHOLD))
    return 1 / (1 + math.exp(-max(-500, min(500, z))))


def test_quality_query_equals_plain_score(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(spark, docs, labels)
    long = spark.createDataFrame([(-1, "word next " * 200_000, ""), (-2, None, ""), (-3, "", "")], "doc_id long, text string, score string")
    rows = docs.select("doc_id", "text", docs["source"].alias("score")).unionByName(long)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, model).collect()}
    assert set(got) == set(texts)
    assert all(got[k] == pytest.approx(plain_score(model, t), abs=1e-9) for k, t in texts.items())


def test_ties_at_the_quantile_fall_on_one_side():
    model = quality.train(["same words here"] * 6 + ["other bad words !!"] * 2, [1] * 5 + [0] * 3, 3 / 8)
    a, b = set(model.scores(["same words here"] * 4)), set(model.scores(["other bad words !!"] * 3))
    assert len(a) == len(b) == 1 and a > b or min(a) > max(b)


def test_toxicity_of_very_long_texts(spark):
    rows = [(k, " ".join(["fine words stand here."] * 20) + (" vile slur here." if k % 2 else "")) for k in range(40)]
    model = toxicity.train([t for _, t in rows], [k % 2 for k, _ in rows])
    long = "fine words stand here. " * 100_000
    df = spark.createDataFrame([(1, long + "vile slur here."), (2, long), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    # every sentence adds to a noisy-or, but only the last one is an offence
    assert 1 >= got[1]["score"] >= got[2]["score"] and got[1]["score"] > 0.5 and got[3]["score"] == got[4]["score"] == 0
    assert [e["start"] >= len(long) - 1 for e in got[1]["offending"]] == [True]


def test_every_training_row_teaches_quality(spark, monkeypatch):
    """Blocks hold all training rows, rare labels reach each, and the cut is that of all rows' scores."""
    np, F = quality.np, quality.F
    rng = random.Random(12)
    rows = [(k, f"fine words number {k} and more of them" if k % 40 else f"bad !! bad !! {k}", int(k % 40 > 0)) for k in range(4000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(7, "a copy")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    training = {k: y for k, _, y in rows if zlib.crc32(str(k).encode()) % 5}
    found = quality.training_rows(docs, labels)
    assert {r.k: r.y for r in found.collect()} == training and found.count() == len(training)
    counts = {y: list(training.values()).count(y) for y in (0, 1)}
    own, blocks = quality.dealt(found, counts, 100)
    held = {}
    for r in own.select("block", "k", "y").collect():
        held.setdefault(r.block, []).append((r.k, r.y))
    assert len(held) == blocks == round(len(training) / 100) and {k for x in held.values() for k, _ in x} == set(training)
    assert all({y for _, y in x} == {0, 1} for x in held.values())
    model = quality.fit(spark, docs, labels, 800)
    texts = {r.k: r.t for r in found.collect()}
    scores = np.sort(model.raw([texts[k] for k in training]))
    assert model.cut == pytest.approx(quality.weighted_quantile(scores, np.ones(len(scores)), counts[0] / len(scores)))
    # a place of a word that one row alone has, whichever it is, has a weight of its own
    for k in rng.sample(sorted(training), 50):
        assert model.hashed[zlib.crc32(str(k).encode()) % quality.HASHED] != 0
    values = np.array([0.5, -3.0, 0.0, 2.25, -3.0, 1e300, -1e-300])
    ranks = spark.createDataFrame([(int(x),) for x in quality.ordered(values)], "rank long")
    assert [quality.value(quality.nth(ranks, n)) for n in range(len(values))] == sorted(values.tolist())
