"""A table of records in versions: upserts by three unique keys, and commits of which only one can be next.

A version is a folder of files and a manifest, whose name is its number.  A writer puts its files into a folder of its own and then renames
the manifest into place, which fails if there is one already; so of two writers that started from one version one commits, and
the other gets a :class:`Conflict` and its files are never read.  Readers take the last manifest, so they see whole versions only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized_title
from ..operators import dedup
from ..schema import present
from ..session import materialize

#: Columns of a record that are filled in where they are missing.
FILLED = ("abstract", "pdf_url", "doi", "arxiv_id")


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of records (seq, title, doi, arxiv_id, abstract, pdf_url, citation_count, quality_score, …).

    A new record means the old one with its title, else the one with its DOI, else the one with its arXiv id; new records that mean none are
    first resolved among themselves, in their order, by the same keys.  A record keeps its own values but for the largest citation count,
    the last known quality score and what was missing, which is filled from the first new record that has it.  A DOI or arXiv id that two
    records would have stays with the one that had it, else with the first, and is null in the others: no value ever repeats, and no title,
    if none did before.  Null and empty keys mean nothing, a null title is the empty title; ``seq`` is unique over both tables.
    """
    key = F.coalesce(normalized_title("title"), F.lit(""))
    columns = old.columns
    ours = lambda df: df.select("seq", key.alias("title_"), present("doi").alias("doi_"), present("arxiv_id").alias("arxiv_"))
    keyed, known = ours(new), ours(old)
    target = None
    for name in ("title_", "doi_", "arxiv_"):
        one = known.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("seq").alias("target"))
        rest = keyed if target is None else keyed.join(target, "seq", "left_anti")
        found = materialize(rest.join(one, name).select("seq", "target"), "upsert-found")
        target = found if target is None else target.unionByName(found)
    fresh = new.join(target, "seq", "left_anti")
    led = dedup.leaders(fresh.select("seq", "title", "doi", "arxiv_id"), percent=None)
    target = target.unionByName(led.withColumnRenamed("leader", "target"))
    # the first record of each target: the old one, or the new one that leads
    rows = old.withColumns({"target": F.col("seq"), "turn": F.lit(0)}).unionByName(new.join(target, "seq").withColumn("turn", F.when(F.col("seq") == F.col("target"), 1).otherwise(2)))
    order = F.struct("turn", "seq")
    values = []
    for c in columns:
        if c == "citation_count":
            v = F.max(c)
        elif c == "quality_score":
            v = F.max_by(c, F.when(F.col(c).isNotNull(), order))
        elif c in FILLED:
            v = F.min_by(c, F.when(present(c).isNotNull(), order))
        else:
            v = F.min_by(c, order)
        values.append(v.alias(c))
    merged = rows.groupBy("target").agg(*values, *[F.min_by(present(c), order).alias(f"{c}_own") for c in ("doi", "arxiv_id")])
    merged = materialize(merged, "upsert-merged")
    for c in ("doi", "arxiv_id"):
        # whoever had the value itself comes before whoever is to be given it
        claim = F.struct(F.when(F.col(f"{c}_own").eqNullSafe(F.col(c)), 0).otherwise(1), F.col("target"))
        owner = merged.where(present(c).isNotNull()).groupBy(F.col(c).alias("value_")).agg(F.min_by("target", claim).alias("owner_"))
        merged = merged.join(owner, F.col(c) == F.col("value_"), "left").withColumn(c, F.when(F.col("owner_").isNull() | (F.col("owner_") == F.col("target")), F.col(c))).drop("value_", "owner_")
    return merged.select(*columns)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def last_version(spark: SparkSession, path: str) -> int:
    """Number of the last committed version, 0 if there is none."""
    jvm, at, files = _files(spark, f"{path}/manifests")
    if not files.util().exists(at):
        return 0
    names = (x.getPath().getName() for x in files.util().listStatus(at))
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads("".join(r[0] for r in spark.read.option("wholetext", True).text(f"{path}/manifests/{version}.json").collect()))


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default."""
    number = last_version(spark, path) if version is None else version
    if not number:
        raise ValueError(f"no version in {path}")
    known = manifest(spark, path, number)
    return spark.read.schema(known["schema"]).parquet(f"{path}/{known['data']}")


def commit(df: DataFrame, path: str, based_on: int, **notes) -> int:
    """Write ``df`` as the version after ``based_on`` and return its number; :class:`Conflict` if there is one already.

    ``notes`` are kept in the manifest.
    """
    spark, number, name = df.sparkSession, based_on + 1, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    jvm, at, files = _files(spark, f"{path}/manifests/{number}.json")
    own = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/.{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    out = files.create(own, flags, options)
    out.write(json.dumps({**notes, "version": number, "based_on": based_on, "data": name, "schema": df._jdf.schema().toDDL()}).encode())
    out.close()
    free = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    free[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        files.rename(own, at, free)
    except Exception as error:
        for left in (own, jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            files.delete(left, True)
        if files.util().exists(at):
            raise Conflict(f"version {number} of {path} was committed by another writer") from error
        raise
    return number


def upsert_into(new: DataFrame, path: str, attempts: int = 5) -> int:
    """Upsert into the last version of a table and commit; after a conflict, again into the version that won."""
    spark = new.sparkSession
    for left in range(attempts - 1, -1, -1):
        version = last_version(spark, path)
        old = read_version(spark, path, version) if version else new.limit(0)
        try:
            return commit(upsert(old, new.select(*old.columns)), path, version)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def upsert_seeded(rows: DataFrame, turns: str) -> DataFrame:
    """The table after upserting the rows of each turn, a few, one after the other, without versions."""
    table = None
    for (turn,) in rows.select(turns).distinct().orderBy(turns).collect():
        part = rows.where(F.col(turns) == turn).drop(turns)
        table = materialize(upsert(part.limit(0) if table is None else table, part), "upserted")
    return table
