import hashlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from pyspark.sql import types as T

from paperloom.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
AWKWARD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n\n  x\t y ", "a▁b", "a\x00b", "x<|endoftext|>y</s><unk> <0x41>", "naïve 漢字 😀👩‍👩‍👧 नमस्ते",
    "a  b", "a᠎ b", "a\x1c b \x85 c", "l'été   dans\r\n", "na" * 3000, " " * 999 + "x", "🙂" * 700, "same words here", "same words here", "don't 12345 $%&*",
]


def plain(docs):
    """Whole texts through both libraries, one byte at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    written = alignment.byte_level()
    names = {k: bytes(map(written.get, t)) for t, k in a.get_vocab().items() if all(c in written for c in t)}
    piece = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    rows, held = [], Counter()
    for key, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [names[k] for k in ids_a], [piece(k) for k in ids_b]
        groups, links = [], Counter()
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends_a, ends_b, n = {}, {}, 0
            for ends, parts in ((ends_a, bytes_a), (ends_b, bytes_b)):
                n = 0
                for k, x in enumerate(parts):
                    ends[n := n + len(x)] = k + 1
            i = j = 0
            for e in sorted(set(ends_a) & set(ends_b)):
                groups.append((ids_a[i : ends_a[e]], ids_b[j : ends_b[e]]))
                i, j = ends_a[e], ends_b[e]
            for x, y in groups:
                links.update({(p, q): m * n for p, m in Counter(x).items() for q, n in Counter(y).items()})
        else:
            ids_a = ids_b = []
        held.update(set(links))
        rows.append((key, ids_a, ids_b, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for key, ids_a, ids_b, groups, links in rows:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sums = sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items())
        out.append((key, len(ids_a), len(ids_b), len(groups), sum(links.values()), *sums, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def rows(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [50, alignment.BLOCK])
def test_alignment_equals_whole_texts(spark, size, monkeypatch):
    monkeypatch.setattr(alignment, "LISTED", 4)
    docs = [*enumerate(AWKWARD), (3, "a  b"), (None, "no id")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("count", T.StringType())])
    found = alignment.align(spark.createDataFrame([(*d, "clash") for d in docs], schema).repartition(3), *PATHS, size)
    assert rows(found) == plain(docs)


def test_query_equals_whole_texts(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(alignment.op11_tokenizer_alignment(spark, sf)) == plain(docs)


def test_large_groups_list_each_pair_once(monkeypatch):
    own = alignment.Aligner(*PATHS)
    text = "漢字かな交じり文" * 40 + " 😀😀 plain"
    whole = list(own.documents([text]))[0]
    monkeypatch.setattr(alignment, "LISTED", 1)
    own.forget()
    large = list(own.documents([text]))[0]
    assert whole[:5] == large[:5] and (whole[5] == large[5]).all() and (whole[6] == large[6]).all()


def test_no_documents(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
