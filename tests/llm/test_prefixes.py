import hashlib
import random
import zlib
from math import fmod

import pytest
from pyspark.sql import types as T

from paperloom.llm import prefixes

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.StringType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie by walking every sequence of first turns."""
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(c - int(fmod(c, 100)), [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        out.append(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(x) == len(node) + 1 for x in under),
                sum(not any(y[:-1] == x and y for y in members) for x in under), sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def rows_of(seed):
    pick = random.Random(seed)
    texts = ["", "a", "ab", "a\x00b", "naïve 漢字 😀", "b" * 3000, None]
    rows = []
    for c in [*pick.sample(range(-250, 500), 60), *range(0, 500, 200)]:
        for k in range(pick.randrange(1, 9)):
            rows.append((c, pick.choice([k, k, k, None]), pick.choice(["user", "assistant", None]), pick.choice(texts), "clash"))
    return [*rows, *rows[:5], (None, 0, "user", "lost", "clash")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_walk(spark, seed):
    rows = rows_of(seed)
    found = prefixes.trie(prefixes.rebuilt(prefixes.turns_of(spark.createDataFrame(rows, SCHEMA))))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


def test_many_equal_conversations_end_at_one_node(spark):
    """More members than a chunk holds, and a conversation without a turn of its own."""
    n = prefixes.CHUNK + 50
    rows = spark.range(1, n).selectExpr("id as conv_id", "cast(null as long) as turn", "'user' as role", "'hello' as text")
    found = {r.depth: r for r in prefixes.trie(prefixes.rebuilt(prefixes.turns_of(rows), block=10**9)).collect()}
    ends = [[c for c in range(1, n) if (zlib.crc32(str(c).encode()) % 6 == 0) == (d == 1)] for d in (0, 1)]
    assert [found[d].ends_sha256 for d in (0, 1)] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ends]
    assert (found[0].n_convs, found[1].n_convs, found[0].saved_tokens) == (n - 1, len(ends[1]), 5 * (len(ends[1]) - 1))


def test_no_conversations(spark):
    assert prefixes.trie(prefixes.rebuilt(prefixes.turns_of(spark.createDataFrame([], SCHEMA)))).collect() == []
