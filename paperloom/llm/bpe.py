"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until its parts are short, the parts are encoded on their own, and neighbours are joined on the way up.
A join keeps what provably cannot change and re-encodes a window around the seam that grows until both of its ends do:

* matches of the pattern: a match that ends two code points or more before the end of the left part was chosen without
  looking at that end, so it stands.  Matching has no memory, so as soon as the window and the right part have a boundary
  at the same place, everything from there on is the right part's own.
* tokens within one long match: a sequence of tokens is the encoding of its bytes exactly if each two neighbours are the
  encoding of their own bytes.  So a window may stop where its outermost tokens form such pairs with the tokens outside.

The join is associative, so parts may be combined in any tree.  Decoding joins the bytes of halves up the tree.

Defined results: a null text counts as empty and has no tokens; repeated rows stay repeated; extra columns are not
returned; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Code points of a text and bytes of a match up to which no tree is built, bytes up to which merges are looked for one by one;
#: remembered matches of a worker, and bytes of one.
TEXT_LEAF, PIECE_LEAF, PLAIN, REMEMBERED, REMEMBERED_BYTES = 256, 8, 96, 800_000, 192


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteCoder:
    """Encodes and decodes with given ranks; ``pattern`` cuts a text into matches that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, text_leaf: int = TEXT_LEAF, piece_leaf: int = PIECE_LEAF):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.text_leaf, self.piece_leaf = max(4, text_leaf), max(2, piece_leaf)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.merged: dict[bytes, list[bytes]] = {}

    # -- one match -------------------------------------------------------------------------------------------------

    def merge(self, piece: bytes) -> list[bytes]:
        """The merges applied to the bytes of ``piece``, lowest rank first and leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > PLAIN:
            return self._merge_long(parts)
        get, none = self.ranks.get, 1 << 60
        costs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) != none:
            i = costs.index(least)
            parts[i : i + 2] = [whole := parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = get(parts[i - 1] + whole, none)
            if i < len(costs):
                costs[i] = get(whole + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        live, end = list(parts), len(parts)
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(end - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= end or live[i] + live[j] != whole:
                continue
            live[i], live[j], after[i] = whole, b"", after[j]
            if after[j] < end:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (r := self.ranks.get(live[a] + live[b])) is not None:
                    heapq.heappush(heap, (r, a, live[a] + live[b]))
        return [x for x in live if x]

    def short(self, piece: bytes) -> list[bytes]:
        """:func:`merge`, remembered for leaves and the windows between them."""
        if len(piece) > 2 * self.piece_leaf:
            return self.merge(piece)
        if (found := self.merged.get(piece)) is None:
            if len(self.merged) > REMEMBERED // 2:
                self.merged.clear()
            found = self.merged[piece] = self.merge(piece)
        return found

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens ``a`` and ``b`` are the encoding of their own bytes."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return found

    def join_tokens(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not a or not b:
            return a + b
        i = j = 1
        while True:
            window = self.short(b"".join(a[len(a) - i :] + b[:j]))
            left = i == len(a) or self.stands(a[-i - 1], window[0])
            right = j == len(b) or self.stands(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = (i if left else min(2 * i, len(a))), (j if right else min(2 * j, len(b)))

    def tokens(self, piece: bytes) -> list[bytes]:
        """The encoding of one match: halves recursively, then joined."""
        if len(piece) <= self.piece_leaf:
            return self.short(piece)
        half = len(piece) // 2
        return self.join_tokens(self.tokens(piece[:half]), self.tokens(piece[half:]))

    def code(self, piece: str) -> tuple[int, ...]:
        """Ids of one match."""
        if (found := self.known.get(piece)) is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            found = (whole,) if whole is not None else tuple(self.ranks[t] for t in self.tokens(raw))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(raw) <= REMEMBERED_BYTES:
                self.known[piece] = found
        return found

    # -- a text ----------------------------------------------------------------------------------------------------

    def join(self, a: list[str], b: list[str]) -> list[str]:
        """Matches of two neighbouring texts as of one text."""
        if not a or not b:
            return a + b
        i = len(a) - 1
        while i and sum(map(len, a[i:])) < 2:
            i -= 1
        tail, j = "".join(a[i:]), 2
        while True:
            window = tail + "".join(b[:j])
            whole = j >= len(b)
            found = self.find(window)
            there, at = {len(tail): 0}, len(tail)
            for k, p in enumerate(b[:j], 1):
                at += len(p)
                there[at] = k
            at, last = 0, len(window) if whole else len(window) - 2
            for k, p in enumerate(found, 1):
                at += len(p)
                if at in there and at <= last:
                    return a[:i] + found[:k] + b[there[at] :]
            j *= 2

    def tree(self, text: str) -> list[str]:
        """The matches of a text: halves recursively, then joined."""
        if len(text) <= self.text_leaf:
            return self.find(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def codes(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each match; new ones are encoded as trees of their own."""
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            return list(map(self.code, pieces))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.codes(self.tree(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.text_leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteCoder:
    """This worker's coder; the file is read on each executor once."""
    return ByteCoder(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the token ids of each whole text; one narrow pass."""

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in source:
            ids = pa.array([own.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``bytes``, the bytes that the ids stand for."""

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(batches, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def op10_byte_bpe(spark, sf_dir):
    """Every whole text encoded, its ids decoded, and digests of both; encoder and decoder share one pass over the texts."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        words = [str(i) for i in range(len(own.bytes_of))]
        sha = hashlib.sha256
        for batch in source:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                n.append(len(ids))
                of_ids.append(sha(",".join(map(words.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(sha(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
