"""Alignment of two tokenizers by their bytes.

Every byte of a text gets a label: 0 where no token ends, 1 where one of A ends, 2 where one of B ends, 3 where both do.  A
regular expression scans the labels for spans up to each 3; the labels counted in a span say how many tokens of A and of B
form that group, and every token of A in it is linked with every token of B.

A token of either vocabulary never spans a place where a space follows a character that is none: neither the pattern that
splits for A nor any piece of B crosses it (checked for the given vocabulary).  So a text is cut there into words, each word of
a worker is labelled once, and a document's groups are those of its words in order.

How many documents hold a pair of ids is counted over blocks of documents: a block's distinct pairs with their numbers of
documents are summed by pair, and the sums come back to the block, whose documents hold them by their place among its pairs.
So what is shuffled follows the distinct pairs of blocks, a pair that all documents hold is one row a block, and texts never move.

Defined results: null and empty texts, and texts that a tokenizer doesn't give back (such as one with U+2581), have no tokens:
zeros and an empty digest; repeated rows are documents of their own, also in the counts; null ids are kept; extra columns are not
returned; an empty table has no rows; texts of any length are aligned whole.  A task holds one block, which is 16 MB of texts
or one text, and the distinct pairs of ids in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Bytes of the texts of a block; words and their bytes that a worker remembers; links of a group that are listed one by one.
BLOCK, REMEMBERED, REMEMBERED_BYTES, LISTED = 16_000_000, 300_000, 48_000_000, 1 << 14
_SPAN = re.compile(rb"[^\x03]*\x03")
_CUT = re.compile(r"(?<=[^\s\u180e]) ")
_UNEVEN = re.compile(r"[\s\u180e] ")


def spans(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of A and of B in each group of a label string, which ends with a 3."""
    shapes = _Shapes()
    found = np.array(list(map(shapes.__getitem__, _SPAN.findall(labels))), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


class _Shapes(dict):
    def __missing__(self, span: bytes) -> tuple[int, int]:
        self[span] = found = (span.count(1) + 1, span.count(2) + 1)
        return found


class _Words(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Aligns the tokens of a byte-level vocabulary file of ``tokenizers`` (A) and a ``sentencepiece`` model (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        written = byte_level()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(written[c] for c in token) if all(c in written for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)  # then words aren't independent
        self.lead = self.b.encode("x")
        if len(self.lead) != 1:
            raise ValueError("the second vocabulary has no piece for a word x")
        self.base = len(pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.words, self.learned, self.held = _Words(), 0, 0
        self.texts: list[str] = []
        self.table = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, whether both give the word back
        self.starts, self.codes, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """Words of a space and the text, each without its first space."""
        if self.whole:
            return [text]
        return _CUT.split(text) if text[:1] == " " or _UNEVEN.search(text) else text.split(" ")

    def learn(self) -> None:
        """Align the words that were met since the last call."""
        fresh = list(islice(self.words, self.learned, None))
        if not fresh:
            return
        self.learned += len(fresh)
        chunks = [" " + w for w in fresh]
        raw = [c.encode() for c in chunks]
        self.held += sum(map(len, raw))
        ids_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # A word before it keeps the leading spaces as they are inside a text.
        ids_b = self.b.encode(fresh, num_threads=1) if self.whole else [x[1:] for x in self.b.encode(["x" + c for c in chunks], num_threads=1)]
        back = [all(b"".join(map(v.__getitem__, x)) == r for v, x in ((self.bytes_a, p), (self.bytes_b, q))) for p, q, r in zip(ids_a, ids_b, raw, strict=True)]
        for k, fine in enumerate(back):
            if not fine:
                ids_a[k], ids_b[k] = [], []
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in (ids_a, ids_b))
        labels = np.zeros(int(self.size_a[a].sum()), np.uint8)
        labels[np.cumsum(self.size_a[a]) - 1] |= 1
        labels[np.cumsum(self.size_b[b]) - 1] |= 2
        in_a, in_b = spans(labels.tobytes())
        links = in_a * in_b
        # A word ends where its tokens of A do, and so do its groups.
        last = np.cumsum(in_a)
        upto = np.searchsorted(last, np.cumsum(n_a), side="right")
        groups = np.diff(upto, prepend=0)
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        text, i, j = [], 0, 0
        for x, y in zip(in_a.tolist(), in_b.tolist(), strict=True):
            text.append(f"{names_a[i]}|{names_b[j]}" if x == 1 == y else ",".join(names_a[i : i + x]) + "|" + ",".join(names_b[j : j + y]))
            i, j = i + x, j + y
        at = 0
        for n in groups.tolist():
            self.texts.append(text[at] if n == 1 else ";".join(text[at : at + n]))
            at += n
        code, times, per_group = self.pairs(a, b, in_a, in_b)
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[upto], prepend=0)
        self.table = np.concatenate([self.table, np.stack([n_a, n_b, groups, sums(links), np.array(back, np.int64)], 1)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sums(per_group))])
        self.codes, self.times = np.concatenate([self.codes, code]), np.concatenate([self.times, times])

    def pairs(self, a, b, in_a, in_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids linked in each group, how often, and their number by group; a large group's pairs are different ones."""
        from_a, from_b, links = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, in_a * in_b
        large = np.flatnonzero(links > LISTED)
        small = links.copy()
        small[large] = 0
        group = np.repeat(np.arange(len(links)), small)
        place = np.arange(len(group)) - np.repeat(np.cumsum(small) - small, small)
        code = a[from_a[group] + place // in_b[group]] * self.base + b[from_b[group] + place % in_b[group]]
        if not len(large):
            return code, np.ones(len(code), np.int64), small
        parts, counts, sizes = [], [], small.copy()
        offsets = np.concatenate([[0], np.cumsum(small)])
        done = 0
        for g in large:
            x, nx = np.unique(a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
            before = code[offsets[done] : offsets[g]]
            parts += [before, (x[:, None] * self.base + y).ravel()]
            counts += [np.ones(len(before), np.int64), (nx[:, None] * ny).ravel()]
            sizes[g], done = len(x) * len(y), g
        rest = code[offsets[done] :]
        return np.concatenate([*parts, rest]), np.concatenate([*counts, np.ones(len(rest), np.int64)]), sizes

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs in order and their links, for each text."""
        if len(self.words) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        met = []
        for text in texts:
            parts = self.cut(text) if text else ()
            met.append(np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts)))
        self.learn()
        none = np.zeros(0, np.int64)
        for words in met:
            if not len(words) or not self.table[words, 4].all():
                yield 0, 0, 0, 0, "", none, none
                continue
            own, times = np.unique(words, return_counts=True)
            totals = times @ self.table[own, :4]
            lengths = self.starts[own + 1] - self.starts[own]
            at = np.repeat(self.starts[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            pairs, where = np.unique(self.codes[at], return_inverse=True)
            links = np.zeros(len(pairs), np.int64)
            np.add.at(links, where, self.times[at] * np.repeat(times, lengths))
            groups = ";".join(map(self.texts.__getitem__, words.tolist()))
            yield *totals.tolist(), hashlib.sha256(groups.encode()).hexdigest(), pairs, links


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of columns of one length, compressed by planes of bytes."""
    whole = np.stack([c.astype("<i8") for c in columns])
    return zstandard.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(columns, -1)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, held array<int>, packed binary, pairs array<long>, docs array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def blocks_of(docs: DataFrame, path_a: str, path_b: str, size: int = BLOCK) -> DataFrame:
    """One row for each block of documents: its documents' figures, their pairs by place, and its distinct pairs with their documents."""

    def aligned(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, task = aligner(path_a, path_b), 0, TaskContext.get().partitionId()
        ids, rows, held = [], [], 0

        def block():
            pairs, place, docs = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
            sizes = np.array([len(r[5]) for r in rows], np.int32)
            steps, links = np.diff(place, prepend=0), np.concatenate([r[6] for r in rows])
            columns = [pa.array([ids], pa.list_(pa.int64()))]
            columns += [pa.array([[r[k] for r in rows]], pa.list_(pa.int64())) for k in range(4)]
            columns += [pa.array([[r[4] for r in rows]], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(steps, links)], pa.binary())]
            columns += [pa.array([v], pa.list_(pa.int64())) for v in (pairs, docs)]
            names = ["block", "doc_id", *_NUMBERS, "groups_sha256", "held", "packed", "pairs", "docs"]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), *columns], names)

        for batch in source:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, more = at, 0
                while end < len(texts) and more < 1_000_000:
                    more += len(texts[end] or "")
                    end += 1
                rows.extend(own.documents(texts[at:end]))
                ids.extend(keys[at:end])
                held, at = held + more, end
                if held >= size:
                    yield block()
                    ids, rows, held, number = [], [], 0, number + 1
        if rows:
            yield block()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found.mapInArrow(aligned, _BLOCKS)


def align(docs: DataFrame, path_a: str, path_b: str, size: int = BLOCK) -> DataFrame:
    """Figures of each document's alignment, with the links that fall on a pair as frequent as any of its first id."""
    base = aligner(path_a, path_b).base
    blocks = materialize(blocks_of(docs, path_a, path_b, size), "alignment-blocks")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.floor(F.col("pair") / base))
    counts = materialize(counts, "alignment-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # at most one row for each id of the first vocabulary
    known = counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("best"))
    back = held.select(F.col("block").alias("of"), "place", "pair").join(known, "pair").select("of", "place", "count", "best")

    def summed(key, left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        one = {c: left.column(c).combine_chunks().flatten() for c in ("doc_id", *_NUMBERS, "groups_sha256", "held")}
        steps, links = unpack(left.column("packed")[0].as_py(), 2)
        ends = np.concatenate([[0], np.cumsum(one["held"].to_numpy())])
        where = np.cumsum(steps)
        by_doc = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
        sums = [by_doc(links * best[where]), by_doc(links * count[where])]
        columns = [one["doc_id"], *(one[c] for c in _NUMBERS), *(pa.array(v, pa.int64()) for v in sums), one["groups_sha256"]]
        return pa.Table.from_arrays(columns, names=["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    return blocks.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(summed, _RESULT)


def op11_tokenizer_alignment(spark, sf_dir):
    """All documents, aligned between a byte-level vocabulary and one of pieces."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
