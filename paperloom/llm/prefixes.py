"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin with it.  The smallest member of a
node is also the smallest of every node below it on its own path, so each conversation owns a suffix of its path (or nothing),
and every node has one owner.  That turns sums over subtrees into sums over members, without walking the tree:

* tokens saved in a subtree: what its members' turns hold from the node on, less what of it they own;
* leaves of a subtree: members that own a leaf;  * children: members that own the next node of their path.

Windows over a conversation mark what it owns and sum what lies from each turn on; one group-by over prefixes, combined before
the shuffle, adds it up.  A prefix is known by 128 bits, which grow along the path: the exclusive or of two hashes of each
turn's depth and SHA-256 digest, so that texts are read where they lie and never shuffled.

Defined results: null roles and texts count as empty; turns are ordered by number, null first, ties by the digest of role and
text; repeated rows are repeated turns; rows with a null id belong to no conversation and are left out; a negative id's block
is SQL's ``c - c % 100``; an empty table has no nodes; extra columns are not returned.  A conversation's turns are ordered in one
task, which holds no more than a spillable sort; a node's members are never gathered: their ids are digested as a stream of
chunks of at most 4096 ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Ids of members that end at a node and are joined to one text at most.
CHUNK = 4096


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text, null as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and chars of each turn of rows (conv_id, turn, role, text)."""
    found = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        digest(F.col("role"), F.col("text")).alias("digest"),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return found.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin with the first h turns of their block's first one, h = crc32(id) % ``most``, and go on with
    their own turns after as many.  conv_id, depth, digest, chars; with a row of depth 0 and a null digest for each.

    At most ``most`` - 1 turns of one conversation in ``block`` are joined to the others.
    """
    base, share = F.col("conv_id") - F.col("conv_id") % block, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "chars")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", base.alias("base"), share.alias("share"))
    sizes = heads.groupBy("base").agg(F.count("*").alias("held"))
    convs = convs.join(sizes, "base", "left").select("conv_id", "base", "share", F.least("share", F.coalesce("held", F.lit(0))).alias("given"))
    given = convs.join(heads, "base").where(F.col("depth") <= F.col("share")).select("conv_id", "depth", "digest", "chars")
    own = turns.join(convs, "conv_id").where(F.col("pos") > F.col("share")).select("conv_id", (F.col("given") + F.col("pos") - F.col("share")).cast("int").alias("depth"), "digest", "chars")
    root = convs.select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return root.unionByName(given).unionByName(own)


def places(rows: DataFrame) -> DataFrame:
    """Each conversation's nodes: key (two hashes, with depth), the parent's key, ``rest``, the characters from the turn on, and ``ends``."""
    path = Window.partitionBy("conv_id").orderBy("depth")
    upto, whole = path.rowsBetween(Window.unboundedPreceding, 0), path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = [F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "depth", "digest")).cast("long") for seed in (1, 2)]
    found = rows.select("conv_id", "depth", "chars", *[h.alias(f"own{k}") for k, h in enumerate(own)])
    found = found.withColumns(
        {"a": F.expr("bit_xor(own0)").over(upto), "b": F.expr("bit_xor(own1)").over(upto), "rest": F.sum("chars").over(whole) - F.sum("chars").over(upto) + F.col("chars"), "ends": F.col("depth") == F.max("depth").over(whole)}
    )
    return found.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("own0")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own1")).alias("up_b"), "rest", "ends")


def ends_of(found: DataFrame) -> DataFrame:
    """a, b, depth, ends_sha256 of nodes at which conversations end: their ids in order, joined by commas."""
    chunks = (
        found.where("ends")
        .groupBy("a", "b", "depth", F.floor(F.col("conv_id") / CHUNK).alias("chunk"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    )

    def digested(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string())])

        def batch_of(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for batch in source:
            done = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "depth", "ids")), strict=True):
                if at != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield batch_of(done)
        if node is not None:
            yield batch_of([(*node, state.hexdigest())])

    return chunks.repartition("a", "b", "depth").sortWithinPartitions("a", "b", "depth", "chunk").mapInArrow(digested, "a long, b long, depth int, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``rows`` (conv_id, depth, digest, chars; depth from 0, gapless)."""
    found = materialize(places(rows), "trie-places")
    key = ["a", "b", "depth"]
    owners = found.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.every("ends").alias("leaf"))
    owners = owners.groupBy("conv_id").agg(F.min("depth").alias("first"), F.bool_or("leaf").alias("leaf"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    whole = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = found.join(owners, "conv_id", "left").withColumn("owned", F.coalesce(F.col("depth") >= F.col("first"), F.lit(False)))
    marked = marked.withColumns(
        {
            "kept": F.when(F.col("owned"), F.col("rest")).otherwise(F.coalesce(F.max(F.when(F.col("owned"), F.col("rest"))).over(whole), F.lit(0))),
            "next": F.coalesce(F.lead("owned").over(path), F.lit(False)),
            "up": F.when(F.col("owned") & F.lag("owned").over(path), F.col("conv_id")),
        }
    )
    nodes = marked.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("next").cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(False)).cast("long")).alias("n_leaves"),
        F.sum(F.col("rest") - F.col("kept")).alias("saved_tokens"),
        F.max("up").alias("up"),
        F.first("up_a").alias("up_a"),
        F.first("up_b").alias("up_b"),
    )
    nodes = materialize(nodes, "trie-nodes")
    # A node whose owner doesn't own the parent: one a conversation at most.
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    strangers = nodes.where(F.col("up").isNull() & (F.col("depth") > 0)).join(parents, ["up_a", "up_b", "depth"])
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    known = nodes.where(F.col("up").isNotNull() | (F.col("depth") == 0)).withColumn("parent_conv_id", F.col("up"))
    linked = known.select(*key[:2], *names).unionByName(strangers.withColumn("parent_conv_id", F.col("above")).select(*key[:2], *names))
    linked = linked.join(ends_of(found), key, "left")
    return linked.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), *names[2:], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def op13_prefix_trie(spark, sf_dir):
    """The trie of all conversations, rebuilt so that those of a block share beginnings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(turns_of(rows)))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos, d, length(text) AS chars FROM t),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM o),
crc AS (SELECT conv_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(s, ''), lambda c: unicode(c)::UBIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)::UBIGINT[]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS v FROM ids),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, (xor(v, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM crc),
n AS (SELECT conv_id AS base, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT h.*, least(h, coalesce(n, 0)) AS given FROM h LEFT JOIN n USING (base)),
r AS (SELECT g.conv_id, pos AS depth, d, chars FROM g JOIN o ON o.conv_id = g.base WHERE pos <= h
  UNION ALL SELECT g.conv_id, given + pos - h, d, chars FROM g JOIN o USING (conv_id) WHERE pos > h
  UNION ALL SELECT conv_id, 0, '', 0 FROM g),
p AS (SELECT conv_id, depth, chars, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM r),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids, bool_and(ends) AS leaf FROM p GROUP BY ALL),
sub AS (SELECT v.k, sum((u.n - 1) * u.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE u.leaf) AS n_leaves, count(*) FILTER (WHERE u.depth = v.depth + 1) AS n_children FROM nodes v JOIN nodes u ON starts_with(u.k, v.k) GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, n_children, n_leaves, saved_tokens, sha256(v.ids) AS ends_sha256
FROM nodes v JOIN sub ON sub.k = v.k LEFT JOIN nodes u ON v.depth > 0 AND u.k = left(v.k, length(v.k) - 64)
"""
