import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import fingerprints as fp
from paperloom.llm import rules

from ..oracle import connect, same


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \nx", "# $ %|<>&*", "é ß q 日本 \x0b\x0c\r z", "w " * 500, "y" * 20000]


def test_ledger_equals_plain(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 80))) for _ in range(40)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = {r["doc_id"]: r for r in rules.ledger(df).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t), t
    assert rules.ledger(df.limit(0)).count() == 0


def test_rules_query_equals_its_sql(spark, sf):
    got, expected = same(rules.op7_quality_rules(spark, sf), connect(sf), rules.OP7_SQL)
    assert got == expected


def test_policies_and_ablation(spark, sf):
    led = rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    policy = rules.POLICIES[-1]
    rows = [r["failures"] for r in led.collect()]
    got = {r["rule"]: r for r in rules.ablation(led, policy).collect()}
    for rule in rules.RULES:
        bit = 1 << rule.bit
        assert got[rule.name]["failing"] == sum(bool(f & bit) for f in rows)
        assert got[rule.name]["failing_only_this"] == sum(f == bit for f in rows)
        assert got[rule.name]["kept_without_it"] == sum(f & ~bit == 0 for f in rows)
    kept = rules.apply_policy(led, rules.POLICIES[0]).where("kept").count()
    assert kept == sum(f & 3 == 0 for f in rows)


def test_rules_need_no_python(spark, sf):
    plans = [q(spark, sf)._jdf.queryExecution().toString() for q in (rules.op7_quality_rules, fp.op6_document_fingerprints)]
    assert not any(re.search("Python|Pandas|Arrow", p) for p in plans)


# -- fingerprints ------------------------------------------------------------------------------------------------------


def test_fingerprint_query(spark, sf):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    rows = {r["doc_id"]: r for r in fp.op6_document_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(docs):
        h = len(text) // 2
        edited = text[: len(text) - h] + docs[(k + 1) % len(docs)][1][:h]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 5 * mean("near_next")


def near(spark, a, b):
    rows = {r["doc_id"]: r for r in fp.fingerprint(spark.createDataFrame([(0, a), (1, b)], "doc_id int, text string")).collect()}
    df = spark.createDataFrame([(rows[0]["signature"], rows[1]["signature"])], "a array<long>, b array<long>")
    return df.select(fp.likeness("a", "b").alias("x")).first()["x"]


def test_likeness_follows_edits_and_order(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    text = " ".join(words)
    some = list(words)
    for k in range(0, 400, 40):
        some[k] = "new"
    moved = words[200:] + words[:200]
    assert near(spark, text, text) == 1.0
    few, many = near(spark, text, " ".join(some)), near(spark, text, " ".join(words[:200] + ["z%d" % k for k in range(200)]))
    assert 1 > few > many > 0
    # the same k-mers in another order: a set would hardly see it
    assert near(spark, text, " ".join(moved)) < 0.75
    assert near(spark, "a b c", "c b a") == 0.0


def plain_signature(spark, text):
    """Slots from the hashes of all occurrence-numbered k-mers, selected and ordered plainly."""
    pieces = [p for w in re.findall(r"[^\x20\x09-\x0D]+", text) for p in ([w] if len(w.encode()) <= fp.PIECE else re.findall(f"(?s).{{1,{fp.PIECE}}}", w))]
    if not pieces:
        return []
    h = lambda *xs: [r[0] for r in spark.createDataFrame([x if isinstance(x, tuple) else (x,) for x in xs], ["x%d" % k for k in range(len(xs[0]) if isinstance(xs[0], tuple) else 1)]).select(F.xxhash64("*")).collect()]
    bits = len(bin(len(pieces))) - 2
    words = h(*pieces)
    n = max(len(words) - fp.K + 1, 1)
    grams = h(*[tuple(words[i : i + fp.K]) for i in range(n)])
    cut = [g >> bits for g in grams]
    seen, numbered = {}, []
    for g in cut:
        numbered.append((g, seen.get(g, 0)))
        seen[g] = numbered[-1][1] + 1
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType())])
    v = [r[0] >> bits for r in spark.createDataFrame(numbered, schema).select(F.xxhash64("a", "b")).collect()]
    circle = [(x << bits | k) for x, k in zip(v, range(n), strict=True)]
    starts = [p << (64 - fp.SLOT_BITS) for p in range(-fp.SLOTS // 2, fp.SLOTS // 2)]
    least = [tuple(x >> bits for x in sorted(sorted(circle, key=lambda x: (x - at) % 2**64)[:2], key=lambda x: x % 2**bits)) for at in starts]
    return [at | (t & ((1 << (64 - fp.SLOT_BITS)) - 1)) for at, t in zip(starts, h(*least), strict=True)]


@pytest.mark.parametrize("n", [20, 40, 100])
def test_short_texts_with_swapped_halves(spark, n):
    """Half of the pairs of k-mers have one in either half, and stand the other way round."""
    rng = random.Random(n)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(99999)}" for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[n // 2 :] + words[: n // 2]))]
    sigs = {r["doc_id"]: r["signature"] for r in fp.fingerprint(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    mean = sum(len(set(sigs[2 * k]) & set(sigs[2 * k + 1])) / fp.SLOTS for k in range(60)) / 60
    assert 0.35 < mean < 0.6


@pytest.mark.parametrize("text", ["", "one", "one two", "a b a b a b a", "x" * 50, "日本語の長い文章です。とても長いので切られます" * 3, " ".join(f"w{k % 37}" for k in range(300))])
def test_signature_equals_plain(spark, text):
    got = fp.fingerprint(spark.createDataFrame([(0, text)], "doc_id int, text string")).first()
    assert got["signature"] == plain_signature(spark, text)
    assert got["fingerprint"] == "".join(f"{x & (2**64 - 1):016X}" for x in got["signature"])


def test_fingerprint_edge_cases(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (3, "a b")], "doc_id long, text string")
    rows = fp.fingerprint(df).collect()
    assert [r["fingerprint"] for r in rows[:3]] == ["", "", ""]
    assert fp.fingerprint(df.limit(0)).count() == 0
    assert near(spark, "", None) == 1.0
    nxt = fp.with_next(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("part")).drop("part"), {"text": "next_text"}).collect()
    assert {(r["doc_id"], r["next_text"]) for r in nxt} == {(3, ""), (1, ""), (None, "a b")}
    assert fp.with_next(df.limit(0), {"text": "next_text"}).count() == 0


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    ids = [k * k % 1009 for k in range(1, 300)]
    ids = sorted(set(ids))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["next_text"] for r in fp.with_next(df, {"text": "next_text"}).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_next_document_where_many_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rows = [(5, f"t{k}") for k in range(80)] + [(None, f"n{k}") for k in range(60)] + [(k, f"u{k}") for k in range(6, 90)] + [(5, "t0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("paperloom", F.lit(1)).withColumn("part", F.lit("kept")).repartition(6)
    got = fp.with_next(df, {"text": "next_text"}).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted((i or -1, t) for i, t in rows)
    assert {r["part"] for r in got} == {"kept"}
    # each row follows one other, and the ids fall along the way, but for the one step from the last to the first
    assert sorted(r["next_text"] for r in got) == sorted(t for _, t in rows)
    kind = lambda t: {"u": 2, "t": 1, "n": 0}[t[0]]
    rises = [(r["text"], r["next_text"]) for r in got if kind(r["next_text"]) > kind(r["text"])]
    assert len(rises) == 1 and rises[0][1] == "u89"
    assert all(r["next_text"] == f"u{r['doc_id'] - 1}" for r in got if (r["doc_id"] or 0) > 6)


def test_range_lookup(spark):
    for n in (0, 1, 63, 64, 65, 4095, 4096, 9000):
        cuts = sorted(random.Random(n).randrange(50_000) for _ in range(n))
        df = fp._before(spark.range(0, 50_000, 97), "id", cuts, "a")
        df = fp._before(df, "id", cuts, "b", equal=True)
        import bisect

        assert all((r["a"], r["b"]) == (bisect.bisect_left(cuts, r["id"]), bisect.bisect_right(cuts, r["id"])) for r in df.collect())


def test_windows_whose_hashes_share_their_upper_bits(spark):
    """Word hashes are given here, and so few bits are left of a window's that most windows seem equal."""
    rng = random.Random(8)
    rows = [(k, [rng.randrange(6) for _ in range(rng.randint(0, 60))], bits) for k in range(60) for bits in (6, 60, 62)]
    rows = [(n, h, b) for n, (_, h, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, hashes array<long>, bits int")
    got = {r["id"]: r["n"] for r in rules._repeated(df, "hashes", 3, "n").collect()}
    for n, h, _ in rows:
        grams = {}
        for i in range(len(h) - 2):
            grams.setdefault(tuple(h[i : i + 3]), []).append(i)
        assert got[n] == len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)})
