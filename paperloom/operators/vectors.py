"""Nearest vectors, exactly or by codes.

Equal vectors are one entry that holds its first ids, so that a vector that a third of the rows have is one.  Entries lie in the cells
of a coarse k-means: its start comes from a bounded sample, and rounds over all entries move it, in which each task sends one sum a
cell.  A cell's entries are dealt into chunks, and its queries into parts, so that neither a full cell nor a popular one is a burden.

Exact search visits the nearest cells that hold enough entries first.  The distance reached bounds the second visit by the triangle
inequality: a cell is left out if its centre is farther than its radius and that distance together, and so is an entry whose distance
to the centre differs by more from the query's.  Search by codes visits the nearest cells only, rates entries by product-quantised
residuals (one byte for each part of the vector) and rates the best of them again by their vectors.

Defined results: null, empty and not finite vectors, and those whose length isn't that of most, aren't indexed and find nothing; a row
isn't its own neighbour, its copies are, at distance 0; equal distances are in the order of ids; fewer rows than asked for give
what there is; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import importable, materialize

#: Entries to start from and to learn codes from; cells at most; rounds over all entries; parts of a vector; values of a part's code.
SAMPLE, CELLS, ROUNDS, PARTS, VALUES = 20_000, 4096, 2, 16, 256
#: Entries of a chunk, queries of a part; of codes: share of the cells that are visited and entries that are rated again, for each asked for.
CHUNK, BATCH, PROBES, AGAIN = 4096, 256, 0.75, 12


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, a few rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, y.size))
    for a in range(0, len(x), step):
        out[a : a + step] = ((x[a : a + step, None] - y[None]) ** 2).sum(2)
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row, by products."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, 1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of at most ``k`` groups of rows by Lloyd's rounds, from rows drawn at random."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of vectors of one width as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


@dataclass
class VectorIndex:
    """Cells and code books, and the table of entries (entry, ids, vector, cell, gap to the centre, code)."""

    entries: DataFrame
    centres: np.ndarray
    books: np.ndarray  # parts, values, width of a part
    radius: np.ndarray
    sizes: np.ndarray  # ids that the entries of each cell hold
    counts: np.ndarray  # entries of each cell
    most: int

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (id, vector) with finite vectors of the length that most have, and that length."""
    kept = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0)).select("id", F.col("vector").cast("array<float>").alias("vector"))
    kept = kept.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    width = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (kept.where(F.size("vector") == width["n"]), width["n"]) if width else (kept, 0)


def build(rows: DataFrame, most: int = 10, cells: int | None = None) -> VectorIndex:
    """Index rows (id, vector) for searches of up to ``most`` neighbours."""
    importable(rows.sparkSession)
    kept, width = usable(rows)
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= most + 1)
    entries = materialize(first.groupBy("vector").agg(F.min("id").alias("entry"), F.sort_array(F.collect_list("id")).alias("ids")), "vector-entries")
    n = entries.count()
    if not n:
        return VectorIndex(entries, np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), most)
    picked = entries.select("entry").orderBy(F.xxhash64("entry")).limit(SAMPLE)
    sample = np.array([r[0] for r in entries.join(F.broadcast(picked), "entry").orderBy(F.xxhash64("entry")).select("vector").collect()], np.float64)
    centres = means(sample, min(cells or max(1, min(CELLS, round(math.sqrt(n)))), len(sample)))
    for _ in range(ROUNDS):
        centres = moved(entries, centres)
    parts = math.gcd(width, PARTS)
    rest = sample - centres[nearest(sample, centres)]
    books = [means(x, VALUES) for x in np.split(rest, parts, 1)]
    values = min(map(len, books))
    books = np.stack([b[:values] for b in books])

    def placed(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = matrix(batch.column("vector"), width)
            cell = nearest(x, centres)
            rest = x - centres[cell]
            code = np.stack([nearest(part, book) for part, book in zip(np.split(rest, parts, 1), books, strict=True)], 1).astype(np.uint8)
            columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt((rest**2).sum(1)), pa.float64()), pa.array([c.tobytes() for c in code], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell", "gap", "code"])

    known = materialize(entries.mapInArrow(placed, f"{entries._jdf.schema().toDDL()}, cell int, gap double, code binary"), "vector-cells")
    found = known.groupBy("cell").agg(F.max("gap"), F.sum(F.size("ids")), F.count("*")).collect()
    radius, sizes, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    for cell, gap, held, count in found:
        radius[cell], sizes[cell], counts[cell] = gap, held, count
    return VectorIndex(known, centres, books, radius, sizes, counts, most)


def moved(entries: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Means of the entries nearest to each centre; a task sends one sum for each cell that it has met."""
    k, width = centres.shape

    def sums(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width)), np.zeros(k, np.int64)
        for batch in source:
            x = matrix(batch.column("vector"), width)
            own = nearest(x, centres)
            np.add.at(total, own, x)
            count += np.bincount(own, minlength=k)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(met, width), pa.int32()), pa.array(np.tile(np.arange(width), len(met)), pa.int32()), pa.array(total[met].ravel()), pa.array(np.repeat(count[met], width))], ["cell", "axis", "total", "count"])

    found = entries.select("vector").mapInArrow(sums, "cell int, axis int, total double, count long").groupBy("cell", "axis").agg((F.sum("total") / F.sum("count")).alias("x")).collect()
    out = centres.copy()
    for cell, axis, x in found:
        out[cell, axis] = x
    return out


def _visits(index: VectorIndex, asked: DataFrame, choose) -> DataFrame:
    """query, vector, reach, cell for the cells that ``choose`` (distances to all centres, reach) names for each query."""
    centres, width = index.centres, index.width

    def visits(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            reach = batch.column("reach").to_numpy(zero_copy_only=False)
            away = np.sqrt(squared(matrix(batch.column("vector"), width), centres))
            named = [choose(d, r) for d, r in zip(away, reach, strict=True)]
            row = pa.array(np.repeat(np.arange(len(named)), [len(x) for x in named]))
            cell = np.concatenate([np.zeros(0, np.int64), *named])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("query", "vector", "reach")), pa.array(cell, pa.int32())], ["query", "vector", "reach", "cell"])

    return asked.select("query", "vector", "reach").mapInArrow(visits, "query long, vector array<float>, reach double, cell int")


def _rated(index: VectorIndex, visits: DataFrame, columns: list[str], rate, most: int) -> DataFrame:
    """query, entry, away of the first ``most`` of each query in each chunk that it visits; ``rate`` gives distances of all its entries."""
    spark, width = visits.sparkSession, index.width
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("parts"))
    # one row for each cell, CELLS at most
    chunks = spark.createDataFrame([(int(c), int(-(-index.counts[c] // CHUNK))) for c in np.flatnonzero(index.counts)], "cell int, chunks int")
    layout = F.broadcast(chunks.join(asked, "cell"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.entries.join(layout, "cell").select("cell", F.pmod(F.xxhash64("entry"), "chunks").cast("int").alias("chunk"), each("parts").alias("part"), "entry", *columns)
    right = visits.join(layout, "cell").select("cell", F.pmod(F.xxhash64("query"), "parts").cast("int").alias("part"), each("chunks").alias("chunk"), "query", "vector", "reach")

    def best(key, entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if entries.num_rows and queries.num_rows:
            vectors = matrix(queries.column("vector").combine_chunks(), width)
            reach = queries.column("reach").to_numpy()
            names, own = queries.column("query").to_numpy(), entries.column("entry").to_numpy()
            for k, away in rate(int(key[0].as_py()), entries, vectors, reach):
                near = np.flatnonzero(away < math.inf)
                if len(near) > most:
                    near = near[away[near] <= np.partition(away[near], most - 1)[most - 1]]
                near = near[np.lexsort((own[near], away[near]))][:most]
                for column, part in zip(out, (np.repeat(names[k], len(near)), own[near], away[near]), strict=True):
                    column.append(part)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate([np.zeros(0, kind), *v]) for c, v, kind in zip(("query", "entry", "away"), out, kinds, strict=True)})

    by = ["cell", "chunk", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "query long, entry long, away double")


def _asked(index: VectorIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (id, vector) as (id, query) and distinct ones (query, vector)."""
    kept = queries.where(F.col("id").isNotNull() & (F.size("vector") == index.width)).select("id", F.col("vector").cast("array<float>").alias("vector"))
    kept = kept.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    names = materialize(kept.groupBy("vector").agg(F.min("id").alias("query")), "vector-queries")
    return kept.join(names, "vector").select("id", "query"), names


def _answers(index: VectorIndex, asked: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """id, neighbour, away, rank from entries near to each query."""
    by = lambda c, *order: F.row_number().over(Window.partitionBy(c).orderBy(*order))
    near = near.withColumn("n", by("query", "away", "entry")).where(F.col("n") <= k + 1)
    ids = near.join(index.entries.select("entry", "ids"), "entry").select("query", "away", F.explode("ids").alias("neighbour"))
    ids = ids.withColumn("n", by("query", "away", "neighbour")).where(F.col("n") <= k + 1)
    pairs = asked.join(ids, "query").where("id <> neighbour").select("id", "neighbour", "away")
    return pairs.withColumn("rank", by("id", "away", "neighbour")).where(F.col("rank") <= k)


def exact(index: VectorIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows of each query (id, vector): id, neighbour, away, rank."""
    if not _fits(index, k):
        return queries.sparkSession.createDataFrame([], "id long, neighbour long, away double, rank int")
    asked, names = _asked(index, queries)
    sizes, radius, centres, width = index.sizes, index.radius, index.centres, index.width

    def holding(away, reach):
        order = np.argsort(away, kind="stable")
        order = order[sizes[order] > 0]
        return order[: int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1]

    def within(away, reach):
        return np.setdiff1d(np.flatnonzero((sizes > 0) & (away - radius <= reach + 1e-9)), holding(away, reach))

    def rate(cell, entries, vectors, reach):
        x, gap = matrix(entries.column("vector").combine_chunks(), width), entries.column("gap").to_numpy()
        for j, (q, r) in enumerate(zip(vectors, reach, strict=True)):
            away = np.full(len(x), math.inf)
            # what differs more from the query's distance to the centre is farther than what has been reached
            near = np.abs(gap - math.sqrt(((q - centres[cell]) ** 2).sum())) <= r + 1e-9
            away[near] = ((x[near] - q) ** 2).sum(1)
            yield j, away

    first = names.withColumn("reach", F.lit(math.inf))
    one = materialize(_rated(index, _visits(index, first, holding), ["vector", "gap"], rate, k + 1), "vector-first")
    held = one.join(index.entries.select("entry", F.size("ids").alias("m")), "entry")
    # the distance within which the first visit has k + 1 ids
    upto = F.sum("m").over(Window.partitionBy("query").orderBy("away", "entry").rowsBetween(Window.unboundedPreceding, 0))
    reached = held.withColumn("upto", upto).where(F.col("upto") >= k + 1).groupBy("query").agg(F.sqrt(F.min("away")).alias("reach"))
    again = names.join(reached, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(math.inf)))
    two = _rated(index, _visits(index, again, within), ["vector", "gap"], rate, k + 1)
    return _answers(index, asked, one.unionByName(two), k)


def by_codes(index: VectorIndex, queries: DataFrame, k: int = 10, probes: float = PROBES, again: int = AGAIN) -> DataFrame:
    """About the ``k`` nearest rows of each query (id, vector), as :func:`exact`: in a share ``probes`` of the cells, eight at least, the
    first ``again`` * ``k`` by their codes are rated by their vectors."""
    if not _fits(index, k):
        return queries.sparkSession.createDataFrame([], "id long, neighbour long, away double, rank int")
    asked, names = _asked(index, queries)
    n = max(8, math.ceil(probes * len(index.centres)))
    centres, books, sizes = index.centres, index.books, index.sizes

    def nearby(away, reach):
        order = np.argsort(away, kind="stable")
        return order[sizes[order] > 0][:n]

    def rate(cell, entries, vectors, reach):
        code = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.uint8).reshape(entries.num_rows, len(books))
        for j, q in enumerate(vectors):
            part = np.split(q - centres[cell], len(books))
            tables = np.stack([((book - p) ** 2).sum(1) for book, p in zip(books, part, strict=True)])
            yield j, tables[np.arange(len(books)), code].sum(1)

    visits = _visits(index, names.withColumn("reach", F.lit(math.inf)), nearby)
    rated = _rated(index, visits, ["code"], rate, again * k)
    short = rated.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("away", "entry"))).where(F.col("n") <= again * k)
    both = short.select("query", "entry").join(index.entries.select("entry", "vector"), "entry").join(names.select("query", F.col("vector").alias("asked")), "query")
    gap = F.aggregate(F.zip_with("vector", "asked", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, x: a + x)
    return _answers(index, asked, both.select("query", "entry", gap.alias("away")), k)


def _fits(index: VectorIndex, k: int) -> bool:
    """Whether there is anything to be found."""
    if k > index.most:
        raise ValueError(f"the index was built for {index.most} neighbours")
    return len(index.centres) > 0
