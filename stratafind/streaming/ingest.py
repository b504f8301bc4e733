"""Incremental ingestion: a file stream for new paths, hashes for edited ones, idempotent merges into bucketed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import clean, files
from ..operators.buckets import BucketTable
from ..plans.agent import lead


def processed(raw: DataFrame) -> DataFrame:
    """path, sha256, text, title, category, summary, status, error of files(path, content, sha256): each taken to its end.

    A file without content, whose bytes are no UTF-8, or of which cleaning leaves nothing ends in ERROR with the reason, and the
    others go on.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(F.col("content").isNull(), "no content").when(text.isNull(), "not UTF-8")
    read = raw.select("path", "sha256", F.coalesce(text, F.lit("")).alias("text"), X.title(F.col("path")).alias("title"), X.category(F.col("path")).alias("category"), error.alias("error"))
    done = clean.cleaned(read).withColumn("error", F.coalesce("error", F.when(F.col("text") == "", F.lit("no text"))))
    status = F.when(F.col("error").isNull(), F.lit("DONE")).otherwise(F.lit("ERROR"))
    return done.select("path", "sha256", "text", "title", "category", lead(F.col("text")).alias("summary"), status.alias("status"), "error")


def queued(found: DataFrame, known: DataFrame | None) -> DataFrame:
    """Of files(path, content, sha256) those to take up: new ones, changed ones that are not DONE, and those that ended in ERROR."""
    if known is None:
        return found
    held = known.select(F.col("path").alias("_path"), F.col("status").alias("_status"))
    return found.join(held, F.col("path") == F.col("_path"), "left").where("_status IS NULL OR _status = 'ERROR'").drop("_path", "_status")


def scan_once(spark: SparkSession, found: DataFrame, table: str, token: tuple[str, int] | None = None) -> None:
    """One turn of the loop: what is to be taken up is processed and merged by path."""
    merge(spark, processed(queued(found, current(spark, table))), table, token=token)


def merge(spark: SparkSession, new: DataFrame, table: str, key: str = "path", token: tuple[str, int] | None = None) -> None:
    """New rows replace old ones of their key, in the buckets of those keys alone; a replayed batch changes nothing."""
    kept = BucketTable(spark, table, key)
    kept.merge(new, token=token)
    kept.vacuum(keep=2)


def current(spark: SparkSession, table: str, key: str = "path") -> DataFrame | None:
    return BucketTable(spark, table, key).read()


def ingest_changes(spark: SparkSession, root: str, table: str) -> int:
    """The batch form: files whose hash is not on record, edits included. Returns how many were taken."""
    found = files.scan(spark, root)
    if (known := current(spark, table)) is not None:
        found = files.dirty(found, known.where("status = 'DONE'"))  # what ended in ERROR is tried again
    new = processed(found)
    n = new.count()
    if n:
        merge(spark, new, table)
    return n


def stream_new(spark: SparkSession, root: str, table: str, state: str, per_batch: int = 1000):
    """The stream form: every new path once, `per_batch` files at a time, until none is left. Edits need ingest_changes()."""
    source = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    )

    def take(batch: DataFrame, number: int) -> None:
        merge(spark, processed(batch.select("path", "content", F.sha2("content", 256).alias("sha256"))), table, token=(state, number))

    return source.writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start()
