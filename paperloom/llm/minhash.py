"""Near-duplicate classes by DartMinHash.

Sketch.  A document is a set of shingles of five words, weighted by how often they occur.  Element x owns the strip
[0, weight(x)) of a plane whose other axis is rank; hashing throws darts into the strips of all possible elements, one to a
unit of area on average, the same for every document.  The plane is cut into regions by weight, [2^v - 1, 2^(v+1) - 1), and
each region into cells of area 1, 2^v wide and 2^-v tall, so that an element costs as many cells as the logarithm of its
weight and the darts it keeps.  A document keeps the darts below rank theta = T / total weight, about T = k ln k + 2k of them
whatever its size, deals each to one of k coordinates by its hash and keeps the earliest in each.  If a coordinate stays
empty, theta doubles.  Two documents agree in a coordinate with probability equal to their weighted Jaccard similarity
(least over greatest weights).  ``ROWS`` coordinates make a band; equal bands make candidates.

Classes.  Equal texts are one node from the start.  A bucket (documents with one band in common) is never expanded into its
pairs: each member is compared with the bucket's pivot, exactly and on whole texts, and those that are near are linked into classes
(connected components).  Two members x and y that the bucket of pivot p leaves in
different classes may still be near one another.  If no shingle that
goes beyond p (or occurs more often than in p) is in both, x and y share at most the lesser of what each has in common with p,
which is too little unless almost all of both is.  So such members are compared if they share one of the (few, least) shingles that go beyond the pivot, or if almost
all of both comes from it and sizes fit.  What two members share is what both have of the pivot and what both have beyond it; bitmaps of what each has beyond it, and of
what it lacks, bound that from above, and pairs that can't reach the similarity are dropped in the join.  A shingle that only one of the pivot's members has, or none
outside the largest class, brings no such pair together and stays out of the join.  This finds every link among a bucket's members, and copies
that drifted apart on their own give no pairs, however many they are.  Texts of similarity 0.8 share no band of 25 in 5 of 100,000 cases.

Words are runs of `[^\\x20\\x09-\\x0D]`; a text with 1 to 4 words has one shingle of all of them, a text without words none.
Defined results: null texts count as empty and equal texts (the empty one too) are one class; texts without words are near
nothing else; null ids are kept, and a class's id is the least id in it, null if it has none; repeated rows are in one class;
extra columns are not returned by :func:`near_duplicates` and kept by :func:`keep_one`; an empty table has no class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import discard, giving_back, materialize, table

#: Words of a shingle, least similarity, bands, coordinates of a band.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: Members of a pivot that are compared in one go; rows that are broadcast at most (24 bytes each); differences that go along with each;
#: words of 64 bits in a bitmap of differences.
CHUNK, BROADCAST_ROWS, CARRIED, BITMAP = 256, 400_000, 128, 8

_U = np.uint64
_BASE, _A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: P(Poisson(1) <= c).
_POISSON = np.cumsum([math.exp(-1) / math.factorial(c) for c in range(20)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _A
    x = x ^ (x >> _U(27))
    x = x * _B
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53




def _power_table(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64."""
    return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, 0x3C6EF372FE94F82B, _U)]), dtype=_U)


_powers = _power_table(255)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, in its order."""
    global _powers
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, _U)
    size = end - start
    if size.max() > len(_powers):
        _powers = _power_table(int(size.max()))
    body = data[inside]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(body)) - np.repeat(first, size)
    total = np.add.reduceat((body.astype(_U) + _U(1)) * _powers[place], first)
    return mix(total ^ (size.astype(_U) * _C))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of a text, sorted, and their counts."""
    w = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(w):
        return w, np.zeros(0, np.int64)
    k = min(words, len(w))
    total = np.zeros(len(w) - k + 1, _U)
    for i in range(k):
        total = mix(total + w[i : len(w) - k + 1 + i] + _BASE)
    return np.unique(total, return_counts=True)


def sketch(elements: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray | None:
    """DartMinHash: the earliest dart of each of k coordinates, as a hash; None without elements.  Weights are positive, 1 each if None."""
    if not len(elements):
        return None
    if weights is None:
        weights = np.ones(len(elements))
    regions = np.maximum(np.ceil(np.log2(weights + 1) - 1e-12).astype(np.int64), 1)
    level = np.arange(regions.sum()) - np.repeat(np.cumsum(regions) - regions, regions)
    strip = np.repeat(elements, regions)
    strip = np.where(level > 0, mix(strip ^ mix(level.astype(_U) * _C + _B)), strip)
    width = np.exp2(level)
    share = (np.repeat(weights, regions) - (width - 1)) / width  # of the strip's width that belongs to the element
    theta = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        # cells up to theta along the rank axis; the number of darts in each is Poisson(1), drawn from the cell's hash
        cells = np.ceil(theta * width).astype(np.int64)
        owner = np.repeat(np.arange(len(strip)), cells)
        row = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = mix(strip[owner] + mix(row.astype(_U) * _A + _C))
        count = np.searchsorted(_POISSON, uniform(cell), side="right")
        flat, owner, row = np.repeat(cell, count), np.repeat(owner, count), np.repeat(row, count)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(flat + (number.astype(_U) + _U(1)) * _BASE)
        rank = (uniform(dart) + row) / width[owner]
        keep = (rank < theta) & (uniform(mix(dart ^ _B)) < share[owner])
        dart, rank = dart[keep], rank[keep]
        coordinate = (mix(dart ^ _C) % _U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        out, seen = np.zeros(k, _U), np.zeros(k, bool)
        out[coordinate[order]] = dart[order]  # the earliest is written last
        seen[coordinate] = True
        if seen.all():
            return out
        theta *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    rows = signature.reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=_U) * _C)
    for r in range(rows.shape[1]):
        key = mix(key + rows[:, r])
    return key.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool) -> float:
    """Similarity of two sorted shingle sets with counts."""
    (x, n), (y, m) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(x):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = y[at] == x
    if not weighted:
        k = int(common.sum())
        return k / (len(x) + len(y) - k)
    both = float(np.minimum(n, m[at])[common].sum())
    return both / (float(n.sum() + m.sum()) - both)


# -- distributed steps -----------------------------------------------------------------------------------------------


def sketches(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, node (MD5 of the text), size (shingles) and bands (keys; empty without shingles) of each row; one narrow pass."""

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            nodes, sizes, bands = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                nodes.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                elements, counts = shingles(text)
                sizes.append(int(counts.sum()) if weighted else len(elements))
                signature = sketch(elements, counts.astype(np.float64) if weighted else None)
                bands.append([] if signature is None else band_keys(signature))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "node", "size", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(batches), "doc_id long, node binary, size long, bands array<bigint>")


_NONE = -(2**63)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if its counted rows are few, so that the texts it selects aren't shuffled; else the join shuffles them."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def excess(pivot: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], weighted: bool) -> np.ndarray:
    """How much of each shingle of ``own`` goes beyond ``pivot``."""
    (x, n), (y, m) = own, pivot
    if not weighted:
        n, m = np.ones_like(n), np.ones_like(m)
    if not len(y):
        return n
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return n - np.where(y[at] == x, np.minimum(n, m[at]), 0)


def bitmap(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``BITMAP`` words that have a bit for the hash of each element of positive weight, and by how much all weights exceed the bits.

    The common weight of two such sets is at most the bits that both have and the lesser excess: see :func:`shared_most`.
    """
    bits = np.zeros(64 * BITMAP, bool)
    bits[(elements[weights > 0] % _U(64 * BITMAP)).astype(np.int64)] = True
    return np.append(np.packbits(bits).view(np.int64), int(weights.sum()) - int(bits.sum()))


def shared_most(x: str, y: str) -> Column:
    """The most that the sets of two bitmaps can have in common."""
    both = [F.bit_count(F.col(x)[i].bitwiseAND(F.col(y)[i])) for i in range(BITMAP)]
    return sum(both[1:], both[0]) + F.least(F.col(x)[BITMAP], F.col(y)[BITMAP])


def surplus(pivot: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``own`` that go beyond ``pivot``, as many of the least as another text near ``own`` must share one of, and for each what
    goes beyond from there on.

    A near text shares SIMILARITY of the size of ``own`` at least, of which ``pivot`` can account for the common part only.  So
    much has to come from what goes beyond; shingles at the end whose weights together don't reach it can be left out.
    """
    x, n = own
    more = excess(pivot, own, weighted)
    total = int(n.sum()) if weighted else len(n)
    needed = max(1, math.ceil(SIMILARITY * total - (total - int(more.sum())) - 1e-9))
    tail = np.cumsum(more[::-1])[::-1]
    kept = (more > 0) & (tail >= needed)
    return x[kept], tail[kept]


def differences(pivot: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], weighted: bool) -> np.ndarray:
    """The shingles of :func:`surplus`."""
    return surplus(pivot, own, weighted)[0]


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, weighted: bool = True, detail: bool = False) -> DataFrame:
    """a, b, linked (their whole texts have ``SIMILARITY`` or more), common (size of the common part) of pairs (a, b) of nodes, and with
    ``detail`` the :func:`surplus` of b over a, beyond and rest, and the :func:`bitmap` of what b has beyond a, over, and of what it lacks of a,
    under; without, only pairs whose sizes allow the similarity.

    Only texts in such pairs leave the table.  The members b of a pivot a are dealt into chunks, each of which meets the pivot's
    text once, at its head, so that a pivot with a large share of all members is no burden to any task.
    """
    used = []
    if not detail:
        size = nodes.select("node", "size")
        sized = pairs.join(size.select(F.col("node").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("size").alias("nb")), "b")
        pairs = materialize(sized.where(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9).select("a", "b"), "pairs")
        used.append(pairs)
    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
    wanted = materialize(ends.join(nodes.select("node", F.coalesce("doc_id", F.lit(_NONE)).alias("k")), "node"), "wanted")
    used.append(wanted)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # dealt by node, once for both joins below
    texts = rows.join(_small(wanted), "k").where(F.unhex(F.md5("text")) == F.col("node")).groupBy("node").agg(F.first("text").alias("text"))
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    members = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "chunk", F.lit(True).alias("member"), "b", "text")
    heads = chunks.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("member"), F.col("a").alias("b"), "text")

    names = ["a", "b", "linked", "common"] + ["beyond", "rest", "over", "under"] * detail
    kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.float64()] + [pa.list_(pa.int64())] * 4 * detail
    schema = "a binary, b binary, linked boolean, common double" + ", beyond array<bigint>, rest array<bigint>, over array<bigint>, under array<bigint>" * detail

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = None, None
        for batch in source:
            out = []
            for a, member, b, text in zip(batch.column("a").to_pylist(), batch.column("member").to_pylist(), batch.column("b").to_pylist(), batch.column("text"), strict=True):
                if not member:
                    if head != a:
                        head, mine = a, shingles(text.as_py())
                    continue
                own = shingles(text.as_py())
                j = jaccard(mine, own, weighted)
                total = float(mine[1].sum() + own[1].sum()) if weighted else len(mine[0]) + len(own[0])
                row = (a, b, j >= SIMILARITY - 1e-12, j * total / (1 + j))
                if detail:
                    beyond, rest = surplus(mine, own, weighted)
                    row += (beyond.view(np.int64), rest, bitmap(own[0], excess(mine, own, weighted)), bitmap(mine[0], excess(own, mine, weighted)))
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    both = heads.unionByName(members).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member")
    done = materialize(both.select("a", "member", "b", "text").mapInArrow(giving_back(batches), schema), "rated")
    for table_ in used:
        discard(table_)
    return done


def met_marks(left: DataFrame) -> DataFrame:
    """``left`` (members node of pivots a), where beyond and rest keep only the shingles that another of the pivot's members has too and one
    of those that have it is outside; null if none is.

    No other can bring two members together.  Shingles and members are 64-bit hashes here: where two are equal by chance, more is kept.
    """
    own = F.xxhash64("a", "node")
    each = left.select(own.alias("own"), "outside", "a", F.posexplode("beyond").alias("at", "mark")).select(F.xxhash64("a", "mark").alias("key"), "own", "at", "outside")
    met = materialize(each.groupBy("key").agg(F.count("*").alias("n"), F.max("outside").alias("outside")).where("n > 1 and outside").select("key"), "met")
    kept = each.select("key", "own", "at").join(met, "key").groupBy("own").agg(F.array_sort(F.collect_set("at")).alias("kept"))
    of = lambda values: F.array_compact(F.transform("kept", lambda k: F.get(values, k))).alias(values)
    found = left.withColumn("own", own).join(kept, "own", "left")
    thinned = materialize(found.select(*(of(c) if c in ("beyond", "rest") else c for c in left.columns)), "left")
    discard(met)
    return thinned


def classes(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, node and root of each row: rows of one near-duplicate class have one root.

    Joins back to rows meet each root or node once on one side, so that a frequent one is split by adaptive execution.
    """
    base = materialize(sketches(docs, weighted), "sketches")
    nodes = materialize(base.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialize(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared")
    # a bucket's pivot is the member with the most company in all its buckets: of drifted copies the one closest to their origin,
    # and the same one for most of a group's buckets
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    pivots = shared.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("pivot"))
    members = materialize(shared.join(pivots, "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "members")
    discard(shared)
    rated = verify(members, nodes, docs, weighted, detail=True)
    discard(members)
    links = rated.where("linked").select("a", "b")
    roots = components(links)

    # of one pivot's members, those in other classes than most
    now = rated.join(nodes.select(F.col("node").alias("b"), "size"), "b").join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    counted = now.groupBy("a", "root").agg(F.count("*").alias("m"))
    largest = counted.groupBy("a").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("a", "top")
    all_left = materialize(now.join(largest, "a").select("a", F.col("b").alias("node"), "size", "common", "beyond", "rest", "over", "under", "root", (F.col("root") != F.col("top")).alias("outside")), "left")
    left = met_marks(all_left)
    discard(all_left)
    side = lambda df, c, *on: df.select(*on, F.col("node").alias(c), *(F.col(v).alias(f"{c}_{v}") for v in ("size", "common", "root", "outside", "over")))
    # sizes must fit, and what the pivot doesn't account for must lie within what both have beyond it, by the bits of its shingles
    needed = SIMILARITY / (1 + SIMILARITY) * (F.col("x_size") + F.col("y_size"))
    beyond = F.least(F.col("x_size") - F.col("x_common"), F.col("y_size") - F.col("y_common"))
    apart = (F.col("x_root") != F.col("y_root")) & (F.least("x_size", "y_size") >= SIMILARITY * F.greatest("x_size", "y_size") - 1e-9)
    apart &= (needed - F.least("x_common", "y_common") <= beyond + 1e-6) & (~F.col("x_outside") | (F.col("y") < F.col("x")))
    beyond = F.least(beyond, shared_most("x_over", "y_over"))
    # two near texts share something that the pivot doesn't have; the differences before each, the first ``CARRIED`` at most, go along, so
    # that a pair meets at the first of what it shares and not at all of it; from there on both must have what the pivot doesn't account for
    marks = left.select("*", F.posexplode("beyond").alias("at", "mark")).withColumn("before", F.slice("beyond", F.lit(1), F.least("at", F.lit(CARRIED))))
    marks = marks.withColumn("rest", F.element_at("rest", F.col("at") + 1))
    met = (needed - F.least("x_common", "y_common") <= F.least("x_rest", "y_rest", beyond) + 1e-6) & ~F.arrays_overlap("x_before", "y_before")
    marked = lambda df, c: side(df, c, "a", "mark", F.col("before").alias(f"{c}_before"), F.col("rest").alias(f"{c}_rest"))
    one = marked(marks.where("outside"), "y").join(marked(marks, "x"), ["a", "mark"]).where(apart & met).select("x", "y")
    # ... or have almost all from the pivot; sizes that fit are in one step of 1 / SIMILARITY or in neighbouring ones
    step_of = F.floor(F.log(F.col("size").cast("double")) / -math.log(SIMILARITY)).cast("int")
    inner = left.where(F.col("common") >= SIMILARITY * F.col("size") - 1e-6).withColumn("step", step_of)
    most = F.least("x_common", "y_common") >= needed - 1e-6
    # of the pivot, both have what x has but for what y alone lacks
    most &= F.col("x_common") - (shared_most("y_under", "y_under") - shared_most("x_under", "y_under")) + beyond >= needed - 1e-6
    around = inner.where("outside").withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    stepped = lambda df, c: side(df, c, "a", "step", F.col("under").alias(f"{c}_under"))
    two = stepped(around, "y").join(stepped(inner, "x"), ["a", "step"]).where(apart & most).select("x", "y")
    pairs = one.unionByName(two).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    step = materialize(pairs, "step")
    discard(left)
    if not step.isEmpty():
        more = verify(step, nodes, docs, weighted)
        before, roots = roots, components(links.unionByName(more.where("linked").select("a", "b")))
        discard(before)
        discard(more)
    for table_ in (step, rated, nodes):
        discard(table_)
    return base.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id and class_id (the least id of the class) of every row, and class_rows, the rows of the class."""
    rows = materialize(classes(docs, weighted), "classes")
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return rows.join(ids, "root").select("doc_id", "class_id", "class_rows")


def keep_one(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """One row of each class, all columns unchanged: the one with the least id, nulls last; of repeated rows, one."""
    rows = materialize(classes(docs, weighted), "classes")
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(_NONE)), F.col("node"))
    chosen = rows.groupBy("root").agg(F.min_by(F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("k"), "node"), order).alias("x"))
    chosen = materialize(chosen.select(F.col("x.k").alias("paperloom_k"), F.col("x.node").alias("paperloom_node")), "chosen")
    keyed = docs.withColumn("paperloom_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = keyed.join(_small(chosen), "paperloom_k").where(F.unhex(F.md5(text)) == F.col("paperloom_node"))
    repeated = rows.groupBy("doc_id", "node").count().where("count > 1").isEmpty()
    return (kept if repeated else kept.dropDuplicates(["paperloom_k", "paperloom_node"])).select(*docs.columns)


def op1_near_dedup(spark, sf_dir):
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
