"""Token counts under a unigram model, by dynamic programming over a trie.

The count of a pre-token is the number of pieces on its best path: forward[i] = max over pieces ending at i of
forward[i - length] + log p(piece).  forward[i] depends on the first i code points only, so all pre-tokens that begin alike
share it.  Distinct pre-tokens are inserted in a trie whose nodes hold the forward score and the count of the prefix they
stand for, computed once when the node is made; a pre-token's count is stored at its terminal node.

p is the piece's score where the file is a unigram model.  The registered query's file is not, since no public vocabulary here
has unigram probabilities: there p falls with the piece's rank as Zipf's law has it, so its counts are those of the best path
under that law and not those that the file's own merges would give.  A code point that no piece covers costs its UTF-8 bytes.  Pre-tokens are runs of `[^\\x20\\x09-\\x0D]`, each marked with "▁" as its beginning; white space
is not counted.

Defined results: null and empty texts have no pre-token and no token; pre-tokens of any length are counted whole; repeated
rows stay repeated; extra columns are not returned.  Tries are the workers' own and of bounded size: one that has
grown to ``NODES`` nodes is begun anew, which changes no count.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Nodes of a trie, pre-tokens with stored counts, and code points of a pre-token that is put into the trie.
NODES, TERMINALS, LONG = 1_200_000, 500_000, 64
#: Zipf's shift.
SHIFT = 2.7

MARK = "▁"
#: White space to Python that does not part words here.
_other_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_CODES = 0x110000


def zipf(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces in the order of their ranks."""
    total = math.log(math.fsum(1 / (k + SHIFT) for k in range(len(pieces))))
    return {p: -math.log(k + SHIFT) - total for k, p in reversed(list(enumerate(pieces)))}


class Trie:
    """Forward scores and counts of prefixes under a unigram model."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - 1.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.forward, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def step(self, text: str, end: int, forward: list[float], count: list[int]) -> tuple[float, int]:
        """Forward score and count at ``end`` from those before it; ties go to the longest last piece."""
        width = len(text[end - 1].encode("utf-8", "surrogatepass"))
        best, n, piece = forward[-1] + width * self.byte, count[-1] + width, self.pieces.get
        for start in range(end - 1, max(end - self.longest, 0) - 1, -1):
            if (p := piece(text[start:end])) is not None and forward[start] + p >= best:
                best, n = forward[start] + p, count[start] + 1
        return best, n

    def insert(self, word: str) -> int:
        """The count of a pre-token, from its terminal node."""
        text = MARK + word
        if len(self.forward) > NODES or len(self.terminal) > TERMINALS:
            self.clear()
        shared = len(text) <= LONG
        node, forward, count = 0, [0.0], [0]  # along the path from the root
        for end, c in enumerate(text, 1):
            key = node * _CODES + ord(c)
            if not shared or (node := self.child.get(key)) is None:
                s, n = self.step(text, end, forward, count)
                if shared:
                    node = self.child[key] = len(self.forward)
                    self.forward.append(s)
                    self.count.append(n)
                else:
                    node = 0
            else:
                s, n = self.forward[node], self.count[node]
            forward.append(s)
            count.append(n)
        if shared:
            self.terminal[word] = n
        return n

    def counts(self, text: str | None) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        text = text or ""
        words = _words(text) if _other_space(text) else text.split()
        try:
            return len(words), sum(map(self.terminal.__getitem__, words))
        except KeyError:
            got = self.terminal.get
            return len(words), sum(n if (n := got(w)) is not None else self._again(w) for w in words)

    def _again(self, word: str) -> int:
        found = self.terminal.get(word)  # clear() replaces the table
        return self.insert(word) if found is None else found


def probabilities(scored: list[tuple[str, float]]) -> dict[str, float]:
    """Log-probabilities of pieces: their scores, or Zipf's law over their order where scores are ranks, that is, whole numbers."""
    if any(score != int(score) for _, score in scored):
        return dict(scored)
    return zipf([piece for piece, _ in sorted(scored, key=lambda x: -x[1])])


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    """This worker's trie over the pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Trie(probabilities([(model.id_to_piece(i), model.get_score(i)) for i in own]))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_pretokens and n_tokens of every whole text; one narrow pass."""

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(path)
        for batch in source:
            found = [own.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["id", "n_pretokens", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(batches, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)


def op3_token_counts(spark, sf_dir):
    """Pre-tokens of every document, and pieces on their best paths under Zipf's law over the ranks of a public vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
