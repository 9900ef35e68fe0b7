import math
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import counts, packing

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["It's", " ", "don't", "É", "ß", "é", "…", "12", "\n", "a.b", "<|endoftext|>", "İ", "Σ", "\xa0", "'ll", "日本", "\x1c", "''s"]), max_size=12).map("".join)))
def test_word_coder_equals_library(text):
    own = packing.coder(PATH)
    want = np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert own.encode(text) == want
    assert own.encode(text) == want


def test_new_words_are_not_cut_again(monkeypatch):
    """Pre-tokens of plain texts are merged without the tokenizer's own normaliser and pattern, and forgetting them changes no id."""
    text = "It's a.b 12 l'été, İstanbul ǅ (naïve)\xa0''s don't Zxqwv zxqwv-zxqwv \x7e ȿ… 3½ ª"
    texts = [text.replace("…", ""), "Again zxqwv, " + text[:20], "other words 7 zxqwv"]
    want = [np.array(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    own = packing.WordCoder(PATH)
    monkeypatch.setattr(own, "tokenizer", None)
    assert [own.encode(t) for t in texts] == want
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    own.encode("fresh")
    assert set(own.known) == {"fresh"}
    assert [own.encode(t) for t in texts] == want  # of the last, one run is known when the memory is emptied
    assert "zxqwv" not in own.known


def pieces_are_sound(pieces, lengths, window):
    """Each id lies in one piece; sequences have no gap, and are full or as long as a power of two."""
    at, fill = defaultdict(list), defaultdict(list)
    for d, start, n, seq, offset in pieces:
        assert n > 0
        at[d].append((start, n))
        fill[seq].append((offset, n))
    for d, total in enumerate(lengths):
        pos = 0
        for start, n in sorted(at[d]):
            assert start == pos
            pos += n
        assert pos == total
    for spans in fill.values():
        pos = 0
        for offset, n in sorted(spans):
            assert offset == pos
            pos += n
        assert pos == window or pos & (pos - 1) == 0 and pos < window
    return len(fill)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=40), st.sampled_from([16, 64, 128]), st.integers(0, 5))
def test_shards(lengths, window, seed):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.integers(2, 40, n - 1), 1).astype("<u4") for n in lengths]
    n = pieces_are_sound(list(packing.pack_shard(docs, window)), lengths, window)
    assert n <= sum(lengths) // window + window.bit_length()


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(2, 60, rng.integers(5, 40)).astype("<u4") for _ in range(30)]
    index = packing.Index(docs)
    average = np.mean([len(d) for d in docs])

    def bm25(query, d):
        out = 0.0
        for t in query:
            df = sum(t in x for x in docs)
            tf = int((docs[d] == t).sum())
            if df > 1:
                out += np.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / average))
        return out

    for seed in range(30):
        index.used[:] = False
        index.used[seed] = True
        terms = set(docs[seed].tolist())
        want = sorted((d for d in range(30) if d != seed and bm25(terms, d) > 1e-9), key=lambda d: (-round(bm25(terms, d), 6), d))[:10]
        assert index.neighbours(seed, 10).tolist() == want


def test_related_documents_share_windows():
    docs = [np.array([10 + k % 3] * 6 + [100 + 7 * (k % 3) + j for j in range(9)] + [1], "<u4") for k in range(30)]
    group = defaultdict(set)
    for d, _, _, seq, _ in packing.pack_shard(docs, 64):
        group[seq].add(d % 3)
    assert sum(len(g) == 1 for g in group.values()) >= len(group) - 3


def test_queries_take_all_terms():
    rng = np.random.default_rng(1)
    docs = [rng.choice(np.arange(2, 200), 60, replace=False).astype("<u4") for _ in range(40)]
    index = packing.Index(docs)
    index.used[0] = True
    df = {t: sum(t in d for d in docs) for t in docs[0].tolist()}
    score = {k: sum(np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) for t in set(docs[0].tolist()) & set(docs[k].tolist())) for k in range(1, 40)}
    assert index.neighbours(0, 40).tolist() == sorted((k for k in score if score[k] > 0), key=lambda k: (-round(score[k], 4), k))


def test_windows_take_all_related_documents():
    topics = [[10, 11], [20, 21]]
    docs = [np.array(topics[k % 2] + [100 + k], "<u4") for k in range(80)]
    group = defaultdict(set)
    for d, _, _, seq, _ in packing.pack_shard(docs, 120):
        group[seq].add(d % 2)
    assert all(len(g) == 1 for g in group.values())


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t = Tokenizer.from_file(PATH)
    ids = {k: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for k, x in texts.items()}
    rows = packing.op2_packing(spark, sf).collect()
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(piece.tobytes()), len(ids[r["doc_id"]]))
    number = {k: n for n, k in enumerate(texts)}
    assert pieces_are_sound([(number[r["doc_id"]], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows], [len(ids[k]) for k in texts], 2048) > 0


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (None, "", "c"), (2, "word " * 5000, "d")], "doc_id long, text string, length string").coalesce(1)
    rows = packing.pack(df, PATH).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 5001
    assert [bytes(r["ids"]) for r in rows if r["doc_id"] == 1] == [b"\1\0\0\0"] * 2
    assert packing.pack(df.limit(0), PATH).count() == 0


# -- counts ------------------------------------------------------------------------------------------------------------


def plain_count(pieces, byte, word):
    """Forward scores over all segmentations, for one pre-token alone."""
    text = counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        s, n = best[end - 1][0] + width * byte, best[end - 1][1] + width
        for start in range(end - 1, -1, -1):
            p = pieces.get(text[start:end])
            if p is not None and best[start][0] + p >= s:
                s, n = best[start][0] + p, best[start][1] + 1
        best.append((s, n))
    return best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé日", min_size=1, max_size=9), max_size=12))
def test_trie_equals_plain_forward(words):
    pieces = counts.zipf(["▁", "a", "b", "ab", "aba", "▁ab", "bb", "é", "▁a", "bab"])
    trie = counts.Trie(pieces)
    want = sum(plain_count(pieces, trie.byte, w) for w in words)
    assert trie.counts(" ".join(words)) == (len(words), want)
    assert trie.counts(" ".join(words)) == (len(words), want)


def test_real_vocabulary(spark, sf, monkeypatch):
    path = P.path("piece_bpe_32k.model")
    trie = counts.trie(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    plain = lru_cache(None)(lambda w: plain_count(trie.pieces, trie.byte, w))
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in counts.op3_token_counts(spark, sf).collect()}
    for d in docs:
        words = counts._words(d["text"] or "")
        assert got[d["doc_id"]] == (len(words), sum(map(plain, words)))
    monkeypatch.setattr(counts, "NODES", 50)
    small = counts.Trie(trie.pieces)
    assert all(small.counts(d["text"]) == got[d["doc_id"]] for d in docs[:40])


def test_scores_of_a_unigram_model_are_its_probabilities():
    assert counts.probabilities([("a", -1.5), ("b", -2.0)]) == {"a": -1.5, "b": -2.0}
    ranked = counts.probabilities([("b", -1.0), ("a", -0.0)])
    assert ranked["a"] > ranked["b"] and math.isclose(sum(map(math.exp, ranked.values())), 1.0)


@pytest.mark.parametrize("text", [None, "", " \n", "x" * 3000, "a\x1cb \xa0c"])
def test_count_edge_cases(spark, text):
    df = spark.createDataFrame([(None, text, 1), (1, text, 1)], "doc_id long, text string, n_tokens int")
    rows = counts.count_tokens(df, P.path("piece_bpe_32k.model")).collect()
    assert len(rows) == 2 and rows[0]["n_tokens"] == rows[1]["n_tokens"]
    assert rows[0]["n_pretokens"] == len(counts._words(text or ""))
