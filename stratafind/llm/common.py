"""What the operators share: table access, lineage cuts, words."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local master, as in tests, gets one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation of what led to it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_written: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Like cut_lineage, but as a compressed Parquet table: for wide or long intermediates."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table from the shared folder, whatever file system it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Tables that operators write inside are removed at the end; what was built on them must have been stored by then."""
    mark = len(_written)
    try:
        yield
    finally:
        for path in _written[mark:]:
            delete(spark, path)
        del _written[mark:]


def groups_for(rows: int, size: int) -> int:
    """Groups of at most about `size` rows."""
    return max(1, math.ceil(rows / size))


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never reach an operator's plan."""
    return df.select(*[df[n] for n in names])


#: Rows of texts in an Arrow batch, and of those, rows a worker turns into Python objects at once: both bound memory.
BATCH_ROWS, SLICE_ROWS = 1000, 500


def to_python(df: DataFrame, *names: str) -> DataFrame:
    """require() for rows with whole texts that go to Python: smaller Arrow batches than the default suit them."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return require(df, *(names or df.columns))


def give_back() -> None:
    """Memory of a worker that is free goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def sliced(batches, rows: int = SLICE_ROWS, *held):
    """The Arrow batches in zero-copy slices; after the last, what was `held` for the task is emptied and memory given back."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        for cache in held:
            cache.clear()
        give_back()
