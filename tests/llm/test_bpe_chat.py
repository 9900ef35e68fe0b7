import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import bpe, chat

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
#: Leaves so small that every text is a tree.
SMALL = bpe.ByteCoder(RANKS, P.PATTERN, 4, 3)

PIECES = ["a", "b", " ", "  ", "\n", "'", "r", "e", "ll", "'ve", "é", "ß", "日本", "!", "1", "\t", "the", "ing", "😀", "́", "aaaa", "²", "​", "\xa0", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=60).map("".join)))
def test_tree_equals_library(text):
    expected = REFERENCE.encode_ordinary(text)
    assert SMALL.encode(text) == expected
    assert SMALL.decode(expected) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, " " * 7777, "the" * 4000 + "  x", "é" * 3001, "".join(random.Random(1).choice("abcdefghij") for _ in range(9000))])
def test_long_runs(text):
    expected = REFERENCE.encode_ordinary(text)
    assert bpe.coder(PATH, P.PATTERN).encode(text) == expected
    assert SMALL.encode(text) == expected


def test_join_is_associative():
    rng = random.Random(5)
    for _ in range(100):
        parts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 8))) for _ in range(3)]
        a, b, c = map(SMALL.find, parts)
        left, right = SMALL.join(SMALL.join(a, b), c), SMALL.join(a, SMALL.join(b, c))
        assert left == right == SMALL.find("".join(parts))


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op10_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = REFERENCE.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_operator_and_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (None, "", "z"), (2, "one two", "ids")], "doc_id long, text string, ids string")
    rows = bpe.encode(df, PATH, P.PATTERN)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in rows.collect()), key=str)
    assert got == sorted([(1, []), (1, []), (None, []), (2, REFERENCE.encode_ordinary("one two"))], key=str)
    assert {bytes(r["bytes"]) for r in bpe.decode(rows, PATH, P.PATTERN).collect()} == {b"", b"one two"}
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


# -- chat --------------------------------------------------------------------------------------------------------------

CHAT = P.path("byte_bpe_50k.tiktoken")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<\\|im_sep|>", "<\\\\|im_end|>", "<|", "|>", "\\", "im_end", "a ", "<"]), max_size=12).map("".join))
def test_escaping_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


def expected(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    convs = {}
    for r in rows:
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    awkward = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [("user", awkward), ("assistant", awkward)]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op9_chat_formatting(spark, sf).collect()}
    assert got == {k: expected(v) for k, v in convs.items()}


def test_chat_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "b"), (1, None, None, "first"), (None, 0, "assistant", "é😀"), (2, 0, "assistant", "x" * 20000), (2, 1, "assistant", "y"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, mask int")
    own = chat.template(CHAT, P.PATTERN)
    out = {r["conv_id"]: r for r in chat.format_conversations(df, CHAT, P.PATTERN).collect()}
    assert own.turns(out[1]["ids"]) == [("", "first"), ("user", ""), ("assistant", ""), ("assistant", "b"), ("assistant", "b")]
    assert own.learned(out[1]["ids"], out[1]["mask"]) == "bb"
    assert own.learned(out[None]["ids"], out[None]["mask"]) == "é😀"
    assert own.learned(out[2]["ids"], out[2]["mask"]) == "x" * 20000 + "y"
    assert out[None]["formatted"] == "<|im_start|>assistant<|im_sep|>é😀<|im_end|>"
    for r in out.values():
        assert len(r["ids"]) == len(r["mask"]) and own.text(r["ids"]) == r["formatted"]
    assert chat.format_conversations(df.limit(0), CHAT, P.PATTERN).count() == 0
