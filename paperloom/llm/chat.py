"""Chat formatting by assembly of tokens.

Roles and texts are encoded separately, so that no token spans two segments; reserved ids, which lie beyond the
vocabulary, are spliced between them:

    <|im_start|> role <|im_sep|> text <|im_end|>

The loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends.  A control string that occurs
in a role or a text is ordinary text there; it gets a backslash after its "<", and a control string with backslashes gets
one more, so that the formatted text has control strings at turns only and escaping can be undone.

Defined results: null roles and texts count as empty; rows with a null conversation id form one conversation with a null
id; turns are ordered by number, null first, ties by role and then by the encoded text; repeated rows are repeated turns;
an empty table has no conversations; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import table

#: The control strings, whose ids follow the vocabulary in this order.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_PLAIN = regex.compile(r"<(\\*)\|(im_start|im_sep|im_end)\|>")
_ESCAPED = regex.compile(r"<\\(\\*)\|(im_start|im_sep|im_end)\|>")


def escape(text: str) -> str:
    """Make every control string of ``text`` ordinary."""
    return _PLAIN.sub(r"<\\\1|\2|>", text) if "|>" in text else text


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return _ESCAPED.sub(r"<\1|\2|>", text) if "|>" in text else text


class Template:
    """A tokenizer with reserved ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = read_ranks(path)
        self.first = max(ranks.values()) + 1
        self.plain = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start, self.sep, self.end = range(self.first, self.first + len(CONTROLS))

    def segment(self, text: str | None) -> bytes:
        """Ids of one escaped role or text, as little-endian 32-bit integers."""
        return np.array(self.plain.encode_ordinary(escape(text or "")), "<i4").tobytes()

    def assemble(self, turns: list[tuple[bytes, bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a conversation from its turns: ids of role and text, and whether the text is learned."""
        parts, deltas, at = [], {}, 0
        control = {k: np.array([k], "<i4") for k in (self.start, self.sep, self.end)}
        for role, text, learned in turns:
            ids, body = np.frombuffer(role, "<i4"), np.frombuffer(text, "<i4")
            parts += [control[self.start], ids, control[self.sep], body, control[self.end]]
            begin = at + len(ids) + 2
            at = begin + len(body) + 1
            if learned:
                deltas[begin] = deltas.get(begin, 0) + 1
                deltas[begin + len(body)] = deltas.get(begin + len(body), 0) - 1
        steps = np.zeros(at + 1, np.int8)
        for k, v in deltas.items():
            steps[k] += v
        return (np.concatenate(parts) if parts else np.zeros(0, "<i4")), np.cumsum(steps[:at]).astype(np.int8)

    def text(self, ids) -> str:
        """The formatted text that the ids stand for."""
        ids = np.asarray(ids)
        out, at = [], 0
        for k in np.flatnonzero(ids >= self.first):
            out += [self.plain.decode(ids[at:k].tolist()), CONTROLS[ids[k] - self.first]]
            at = k + 1
        return "".join([*out, self.plain.decode(ids[at:].tolist())])

    def turns(self, ids) -> list[tuple[str, str]]:
        """Roles and texts read back from the ids alone."""
        ids = np.asarray(ids)
        found, marks = [], np.flatnonzero(ids >= self.first)
        for a, b, c in zip(marks[::3], marks[1::3], marks[2::3], strict=True):
            if (ids[a], ids[b], ids[c]) != (self.start, self.sep, self.end):
                raise ValueError("the reserved ids are out of order")
            found.append(tuple(unescape(self.plain.decode(ids[x + 1 : y].tolist())) for x, y in ((a, b), (b, c))))
        return found

    def learned(self, ids, mask) -> str:
        """All text under the loss mask, run by run, unescaped."""
        ids, mask = np.asarray(ids), np.asarray(mask)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
        return "".join(unescape(self.plain.decode(ids[a:b].tolist())) for a, b in zip(edges[::2], edges[1::2], strict=True))


@lru_cache(maxsize=2)
def template(path: str, pattern: str) -> Template:
    return Template(path, pattern)


def format_conversations(rows: DataFrame, path: str, pattern: str, learned_role: str = "assistant") -> DataFrame:
    """conv_id, ids, mask and formatted text of each conversation of rows (conv_id, turn, role, text).

    Turns are encoded where they lie; only their ids are shuffled, to the conversation's task, and assembled from the
    sorted stream one conversation at a time.  A conversation is one row of the result, so it has to fit a row (2 GB) and is
    the most that a task holds at once; conversations that come in any number are no burden, one of any length is.
    """

    def encoded(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path, pattern)
        for batch in source:
            conv, turn, role, text = batch.columns
            roles = role.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [conv, turn, pa.array([r or "" for r in roles], pa.string()), pa.array([own.segment(r) for r in roles], pa.binary()), pa.array([own.segment(t) for t in text.to_pylist()], pa.binary())],
                ["conv_id", "turn", "role", "role_ids", "ids"],
            )

    def assembled(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path, pattern)
        done, size, current, turns = [], 0, None, []

        def batch_of(done):
            names = ["conv_id", "ids", "mask", "formatted"]
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)], names)

        def finish():
            ids, mask = own.assemble(turns)
            return current[0], ids, mask, own.text(ids)

        for batch in source:
            conv, _, role, role_ids, ids = (c.to_pylist() for c in batch.columns)
            for c, r, a, b in zip(conv, role, role_ids, ids, strict=True):
                if current is not None and current[0] != c:
                    done.append(finish())
                    size += len(done[-1][1])
                    turns = []
                current = (c,)
                turns.append((a, b, r == learned_role))
            if size > 1_000_000:
                yield batch_of(done)
                done, size = [], 0
        if current is not None:
            done.append(finish())
        if done:
            yield batch_of(done)

    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ids = turns.mapInArrow(encoded, "conv_id long, turn long, role string, role_ids binary, ids binary")
    return ids.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "ids").mapInArrow(assembled, "conv_id long, ids array<int>, mask array<tinyint>, formatted string")


def op9_chat_formatting(spark, sf_dir):
    """All conversations and one that talks in control strings, formatted; every column is read back from the output."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    awkward = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(awkward).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)

    def read_back(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path, pattern)
        for batch in source:
            conv, formatted = batch.column("conv_id"), batch.column("formatted").to_pylist()
            out = []
            for ids, mask, text in zip(batch.column("ids"), batch.column("mask"), formatted, strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                turns, learned = own.turns(ids), own.learned(ids, mask)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                out.append((len(turns), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([conv, *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["conv_id", *names])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_conversations(rows, path, pattern).mapInArrow(read_back, schema)


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, 32 + length(regexp_replace(role, '<(\\*)\|(im_start|im_sep|im_end)\|>', '<\\\1|\2|>', 'g'))
  + length(regexp_replace(text, '<(\\*)\|(im_start|im_sep|im_end)\|>', '<\\\1|\2|>', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
