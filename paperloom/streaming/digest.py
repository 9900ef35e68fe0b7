"""A digest of new records: duplicates are resolved as they arrive.

What decides about a record is which leaders came before it, so a batch is resolved with the leaders so far alone, by the same rounds as a
whole table (:func:`paperloom.operators.dedup.leaders`), and any split of the records into batches gives the same leaders.  The leaders are a
table in versions whose manifest names the batch: a batch that is run again after a failure finds itself committed and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup
from ..session import discard, materialize
from ..sinks import versions

#: What is kept of a leader.
KEPT = ("seq", "title", "doi", "arxiv_id", "at")


def resolve(old: DataFrame, batch: DataFrame, percent: int | None = None) -> DataFrame:
    """seq and leader of a batch's records (seq, title, doi, arxiv_id) after the leaders ``old``, which all came before, whatever their ``seq``."""
    last, first = old.agg(F.max("seq")).first()[0], batch.agg(F.min("seq")).first()[0]
    shift = max(0, last - first + 1) if last is not None and first is not None else 0
    both = old.select("seq", "title", "doi", "arxiv_id").unionByName(batch.select((F.col("seq") + shift).alias("seq"), "title", "doi", "arxiv_id"))
    led = dedup.leaders(both, percent)
    if last is None:
        return led
    own = lambda c: F.when(F.col(c) > last, F.col(c) - shift).otherwise(F.col(c)).alias(c)
    return led.where(F.col("seq") > last).select(own("seq"), own("leader"))


def take(batch: DataFrame, number: int, path: str, percent: int | None = None, horizon: str | None = None) -> None:
    """Resolve batch ``number`` of records (:data:`KEPT`), write its leaders under ``path``/assigned and commit all leaders so far.

    With ``horizon``, an interval, leaders that are older than the newest record by more are let go, which bounds what is kept; later records
    like them lead again.
    """
    spark = batch.sparkSession
    version = versions.last_version(spark, path)
    if version and versions.manifest(spark, path, version)["batch"] >= number:
        return
    batch = materialize(batch.select(*KEPT), "digest-batch")
    old = versions.read_version(spark, path, version) if version else batch.limit(0)
    led = materialize(resolve(old, batch, percent), "digest-led")
    led.write.mode("overwrite").parquet(f"{path}/assigned/batch={number}")
    leaders = old.unionByName(batch.join(led.where("seq = leader").select("seq"), "seq", "left_semi"))
    if horizon is not None:
        newest = leaders.agg(F.max("at").alias("newest"))  # one row
        leaders = leaders.join(F.broadcast(newest)).where(F.col("at").isNull() | (F.col("at") >= F.col("newest") - F.expr(f"INTERVAL {horizon}"))).drop("newest")
    versions.commit(leaders, path, version, batch=number)
    discard(batch)
    discard(led)


def follow(stream: DataFrame, path: str, checkpoint: str, percent: int | None = None, horizon: str | None = None):
    """Start a stream of records that keeps the digest under ``path``; it ends when all that is there has been taken."""
    step = lambda batch, number: take(batch, number, path, percent, horizon)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assigned(spark, path: str) -> DataFrame:
    """seq and leader of every record taken so far."""
    return spark.read.schema("seq long, leader long, batch int").parquet(f"{path}/assigned").select("seq", "leader")
