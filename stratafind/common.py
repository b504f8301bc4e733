"""Joins and lineage cuts shared by operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a small side is broadcast.
BROADCAST_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, as in tests, gets one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kept: list[str]) -> DataFrame:
    """The frame as a table of the shared folder, noted in `kept` for whoever removes it."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A frame that a loop makes anew each round, kept as a table of the shared folder; the one before is removed.

    A checkpoint would hand on what Spark has inferred of its rows, and that grows with every round.
    """

    def __init__(self, df: DataFrame):
        self.path, self.df = None, df
        self.put(df)

    def put(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        if before:
            delete(spark, before)
        return self.df

    def last(self) -> DataFrame:
        """The frame with its table removed: checkpointed."""
        df = cut_lineage(self.df)
        delete(df.sparkSession, self.path)
        return df


def against_all(queries: DataFrame, rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Every query with every row. A checked small query set is broadcast; a larger one is dealt into blocks of `limit`
    queries, and the rows visit each block through an equality join."""
    n = queries.limit(limit + 1).count()
    if n <= limit:
        return rows.crossJoin(F.broadcast(queries))
    blocks = -(-queries.count() // limit)
    key = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))
    spread = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(queries.withColumn("_block", key), "_block").drop("_block")


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the rows are few enough; else Spark shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
