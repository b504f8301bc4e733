"""The corpus pipeline: documents in, packed training sequences out. Each stage is written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratafind.llm import collinear, line_crf, secret_entropy, simhash_variants, swap_packing
from stratafind.llm.common import checkpoint_dir, cut_lineage, delete, released, table

#: The stage's near copies: least Jaccard similarity of sets of five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the line labelling reject go.

    Null, empty and blank texts fail the rules and go; texts are judged whole, however long; repeated rows are judged alike;
    ties of the labelling go to content; an empty table gives no rows; other columns stay as they are.
    """
    return line_crf.keep_documents(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once; other texts under that id stay too.

    Null, empty and blank texts count as copies of each other; a null id is the last of its group; of repeated rows one stays,
    the first by a hash of its columns; an empty table gives no rows; other columns stay as they are whatever their names.
    """
    found = simhash_variants.near_copies(docs, SHINGLE, SIMILARITY)
    first = found.where("doc_id <=> component_id").select("doc_id").distinct()
    # the row is kept whole under one name, so that no column of it can clash
    rows = docs.select(F.struct("*").alias("row"))
    stay = rows.join(first, F.col("row.doc_id").eqNullSafe(first["doc_id"]), "left_semi")
    once = Window.partitionBy("row.doc_id", F.xxhash64("row.text"), F.length("row.text")).orderBy(F.xxhash64("row"))
    return stay.withColumn("copy", F.row_number().over(once)).where("copy = 1").select([F.col("row").getField(c).alias(c) for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of MIN_WORDS or more that stand in an earlier document are cut out; documents left blank by that go.

    Null and empty texts and rows without id stay as they are; texts are read whole, however long; repeated rows are cut alike;
    of texts under one id each loses only what it holds; an empty table gives no rows; other columns stay as they are.
    """
    # written once: the cutting groups its spans while the documents pass by
    return collinear.without(docs, cut_lineage(collinear.found_in(docs)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    Null, empty and very long texts are scanned like any other (null stays null), repeated rows each stay, an empty table gives
    no rows; n_chars follows a changed text, other columns stay as they are whatever their names.
    """
    # the row is kept whole under one name, so that no column of it can clash
    scanned = secret_entropy.scan(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")))
    hit = F.size("found") > 0
    masked = scanned.select("row", hit.alias("hit"), F.when(hit, secret_entropy.redacted(F.col("text"), F.col("found"))).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return masked.select([new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents with their places.

    Null and empty texts are a piece of the end token alone; longer texts are cut, whole; repeated rows are packed as often as
    they occur; an empty table gives no rows; other columns are left out.
    """
    return swap_packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]

#: The chain of a fitted model, fingerprints and alignments is beyond SQL; tests/llm hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables of earlier ones are removed once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}-{name}.parquet"
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
