"""Bucketed merges: what is rewritten, what a crash leaves, and the rows against a dictionary."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from stratafind.operators import buckets
from stratafind.operators.buckets import BucketTable

SCHEMA = "id string, v long"


def bucket(key, n):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n


def rows(table):
    return {r["id"]: r["v"] for r in table.read().collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, "id", 32)
    assert table.read() is None
    table.merge(spark.createDataFrame([(f"k{i}", i) for i in range(1000)], SCHEMA))
    before = files(path)
    change = table.merge(spark.createDataFrame([(f"k{i}", -i) for i in range(0, 1000, 100)], SCHEMA))
    want = sorted({bucket(f"k{i}", 32) for i in range(0, 1000, 100)})
    assert change.rewritten == want and len(files(path) - before) == len(want) < 32
    assert rows(table) == {f"k{i}": -i if i % 100 == 0 else i for i in range(1000)}
    assert {r["bucket"]: r["version"] for r in table.written().collect()} == {b: 2 if b in want else 1 for b in range(32)}
    assert rows(BucketTable(spark, path, "id")) == rows(table)  # the number of buckets is the table's own
    assert {r["id"]: r["v"] for r in table.read(1).collect()} == {f"k{i}": i for i in range(1000)}  # as it was
    assert table.vacuum() == len(want) and len(files(path)) == 32 and table.versions() == [2]


def test_crash_before_the_rename_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "t"), "id", 4)
    table.merge(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA))

    def lost(self, manifest):
        raise OSError("executor of the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_publish", lost)
        with pytest.raises(OSError):
            table.merge(spark.createDataFrame([("a", 10), ("c", 3)], SCHEMA))
    assert rows(table) == {"a": 1, "b": 2} and table.versions() == [1]
    table.vacuum()
    assert rows(table) == {"a": 1, "b": 2}
    table.merge(spark.createDataFrame([("a", 10), ("c", 3)], SCHEMA))
    assert rows(table) == {"a": 10, "b": 2, "c": 3}


def test_second_writer_of_a_version_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one, other = BucketTable(spark, path, "id", 4), BucketTable(spark, path, "id", 4)
    one.merge(spark.createDataFrame([("a", 1)], SCHEMA))
    stale = other.manifest()
    one.merge(spark.createDataFrame([("b", 2)], SCHEMA))
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(buckets.Conflict):
        other.merge(spark.createDataFrame([("c", 3)], SCHEMA))
    assert rows(one) == {"a": 1, "b": 2}


def test_random_merges_and_removals(spark, tmp_path):
    r, table, want = random.Random(4), BucketTable(spark, str(tmp_path / "t"), "id", 8), {}
    for k in range(5):
        new = {f"k{r.randrange(40)}": r.randrange(100) for _ in range(12)}
        table.merge(spark.createDataFrame(list(new.items()) + [(None, 7)], SCHEMA))
        want |= new
        gone = [x for x in want if r.random() < 0.2]
        table.remove(spark.createDataFrame([(x,) for x in gone] + [("never",)], "id string"))
        for x in gone:
            del want[x]
        assert rows(table) == want
    table.remove(table.read().select("id"))
    assert rows(table) == {} and table.read().columns == ["id", "v"]


def test_order_replays_and_new_columns(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "id", 4)
    batch = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2)], SCHEMA)
    assert table.merge(batch, order=("v",), token=("s", 0)).version == 1
    assert table.merge(batch, token=("s", 0)).version == 1 and rows(table) == {"a": 3}  # a replayed batch
    table.merge(spark.createDataFrame([("b", 4, "x")], SCHEMA + ", w string"), token=("s", 1))
    assert {(r["id"], r["v"], r["w"]) for r in table.read().collect()} == {("a", 3, None), ("b", 4, "x")}
    table.merge(batch.where(F.lit(False)))
    assert rows(table) == {"a": 3, "b": 4}
