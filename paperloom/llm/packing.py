"""Lexical retrieval packing.

The documents of a task are taken in shards of bounded size, in the order of the table.  Each shard has its own BM25
inverted index over token ids.  A seed document opens a window; its query, all of its terms, ranks the unused documents
that share one, and these fill the window greedily, best first, whole where they fit, down to the last of them.  What is
then left of the window takes the beginning of the best one that did not fit; the rest of that document seeds the next
window.  Documents of different shards never meet.  So each window but a shard's last is full, and the last is cut at the powers of two of its length, where no
padding is needed.

Nothing is shuffled and memory is bounded by the shard, whatever keys are frequent; a lost task is repeated from its part
of the table alone, with the same result.  That asks for a source whose partitions keep their rows and order, such as
files.

Defined results: a null text counts as empty and is packed as its end id alone; documents longer than a window span
several; repeated rows are packed each for itself; an empty table gives no piece; extra columns are not returned.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, table

#: Tokens of a sequence, id that ends a document, documents and tokens of a shard.
WINDOW, END, SHARD_DOCS, SHARD_TOKENS = 2048, 1, 2048, 2_000_000
#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: Runs and pre-tokens whose ids a worker remembers; as many where other stages need its memory.
REMEMBERED, FEWER = 850_000, 200_000


class WordCoder:
    """Ids by the tokenizer file.  White space always parts pre-tokens, so the ids of each run between it are looked up and
    remembered, and so are those of each pre-token in it.

    The tokenizer itself encodes texts with code points on which the cut into pre-tokens might differ from its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)  # for pre-tokens, which are normalised and cut already
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.odd = re.compile("[^\t-\r -~\xa0-ɏ]").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.most = REMEMBERED
        self.known: dict[str, bytes] = {}  # of runs and of pre-tokens: a pre-token by itself is a run with the same ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Ids of new pre-tokens, encoded together and parted after each token that ends a word."""
        ids = np.array(self.merger.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            raw, at = ids.tobytes(), 0
            for w, to in zip(words, cuts.tolist(), strict=True):
                self.known[w] = raw[4 * at : 4 * to]
                at = to
        else:
            self.known.update((w, self.whole(w).tobytes()) for w in words)

    def parts(self, run: str) -> list[str]:
        """The pre-tokens of a run that isn't all letters; most are letters and a stop."""
        if run[-1] in ".," and run[:-1].isalpha():
            return [run[:-1], run[-1]]
        return self.find(run)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text.isascii() or not text.isprintable():
            if self.odd(text):
                return self.whole(text).tobytes()
            text = unicodedata.normalize("NFC", text)
        if "<|" in text and any(s in text for s in self.special):
            return self.whole(text).tobytes()
        runs, known = text.lower().split(), self.known
        found = list(map(known.get, runs))
        if gaps := [i for i, ids in enumerate(found) if ids is None]:
            if len(known) > self.most:
                known.clear()
            unknown = {runs[i] for i in gaps}
            words = {r for r in unknown if r.isalpha()}
            several = {r: self.parts(r) for r in unknown - words}
            words.update(w for parts in several.values() for w in parts if w not in known)
            if words:
                self.learn(list(words))
            for r, parts in several.items():
                if len(parts) != 1:
                    known[r] = b"".join(map(known.__getitem__, parts))
            for i in gaps:
                found[i] = known[runs[i]]
        return b"".join(found)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


class Index:
    """A BM25 inverted index over the token ids of a shard's documents."""

    def __init__(self, documents: list[np.ndarray]):
        self.n = len(documents)
        uniques = [np.unique(d, return_counts=True) for d in documents]
        sizes = np.array([len(u) for u, _ in uniques])
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        terms = np.concatenate([u for u, _ in uniques]).astype(np.int64)
        tf = np.concatenate([c for _, c in uniques]).astype(np.float32)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        lengths = np.array([len(d) for d in documents], np.float32)
        order = np.argsort(terms, kind="stable")
        _, compact, df = np.unique(terms, return_inverse=True, return_counts=True)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        impact = idf[compact] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (lengths / max(lengths.mean(), 1))[owner]))
        self.terms, self.impact = compact, np.where(df[compact] > 1, impact, 0)
        self.begin = np.concatenate([[0], np.cumsum(df)])
        self.posted, self.weight = owner[order], impact[order].astype(np.float64)
        self.used = np.zeros(self.n, bool)
        common = np.flatnonzero(df > self.n // 8)  # terms of many documents have their weights in rows
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        for row, t in zip(self.rows, common.tolist(), strict=True):
            x, y = self.begin[t], self.begin[t + 1]
            row[self.posted[x:y]] = self.weight[x:y]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of ``seed``; 0 for used ones and those that share no term."""
        a, b = self.at[seed], self.at[seed + 1]
        terms = self.terms[a:b][self.impact[a:b] > 0]
        row = self.row[terms]
        scores, rare = np.zeros(self.n), terms[row < 0]
        if len(rare):
            spans = [slice(x, y) for x, y in zip(self.begin[rare].tolist(), self.begin[rare + 1].tolist(), strict=True)]
            scores = np.bincount(np.concatenate([self.posted[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        for r in row[row >= 0].tolist():
            scores += self.rows[r]
        scores[self.used] = 0
        return scores

    def neighbours(self, seed: int, most: int | None = None) -> np.ndarray:
        """The unused documents that share a term with ``seed``, or the first ``most``, best first; ties by place."""
        scores = self.scores(seed)
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")][:most]


def pack_shard(documents: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard; sequences are numbered from 0."""
    index = Index(documents)
    total = [len(d) for d in documents]
    lengths = np.array(total)
    left, sequence, offset, next_seed = sum(total), 0, 0, 0
    room = window if left >= window else 1 << max(left.bit_length() - 1, 0)

    def place(d: int, start: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Lay all of document ``d`` from ``start`` on down, opening sequences as they fill."""
        nonlocal left, sequence, offset, room
        while start < total[d]:
            n = min(room - offset, total[d] - start)
            yield d, start, n, sequence, offset
            start, offset, left = start + n, offset + n, left - n
            if offset == room:
                sequence, offset = sequence + 1, 0
                room = window if left >= window else 1 << max(left.bit_length() - 1, 0)

    while next_seed < index.n:
        if index.used[next_seed]:
            next_seed += 1
            continue
        seed = next_seed
        index.used[seed] = True
        while seed is not None:
            yield from place(seed, 0)
            if offset == 0:
                break  # the seed's window is full
            scores, seed = index.scores(seed), None
            while offset:  # the best of those that fit, as long as there is one
                d = int(np.where(lengths <= room - offset, scores, 0).argmax())
                if scores[d] <= 0 or total[d] > room - offset:
                    break
                index.used[d], scores[d] = True, 0
                yield from place(d, 0)
            best = int(scores.argmax())
            if offset and scores[best] > 0:  # its beginning fills this window, and its rest seeds the next
                seed = best
                index.used[seed] = True


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, forget: bool = False) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id and offset of each piece; one narrow pass.

    With ``forget``, workers remember ``FEWER`` ids, drop them after each task and give its memory back, which takes time and leaves
    memory to other stages.
    """

    def shards(source: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        own, last = coder(path), np.array([end], "<u4").tobytes()
        own.most = FEWER if forget else REMEMBERED
        ids, documents, size = [], [], 0
        for batch in source:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                documents.append(np.frombuffer(own.encode(text.as_py() or "") + last, "<u4"))
                ids.append(k)
                size += len(documents[-1])
                if len(documents) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    yield ids, documents
                    ids, documents, size = [], [], 0
        if documents:
            yield ids, documents
        if forget:
            own.known.clear()

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for ids, documents in shards(source):
            pieces = np.array(list(pack_shard(documents, window)), np.int64)
            d, start, length, sequence, offset = pieces.T
            raw = [documents[i][s : s + n].tobytes() for i, s, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
            tokens = np.array([len(x) for x in documents])
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in d.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(raw, pa.binary()), pa.array(tokens[d]), pa.array(base + sequence), pa.array(offset)], names
            )
            base += int(sequence.max()) + 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(batches) if forget else batches, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark, sf_dir):
    """All documents packed, with the checksum of each piece's ids."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
