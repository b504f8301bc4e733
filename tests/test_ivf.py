"""The inverted file against a scan: the same answers from a part of the lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafind.operators import ivf
from stratafind.operators.ivf import InvertedFile

VECTORS, QUERIES = "vec_id long, embedding array<double>", "query_id long, q array<double>"


def scan(vectors, queries, top):
    out = set()
    for i, q in queries:
        scores = []
        for j, v in vectors:
            if j is None or v is None:
                continue
            n = np.linalg.norm(q) * np.linalg.norm(v)
            scores.append((-(round(float(np.dot(q, v)) / n, 9) if n else 0.0), j))
        out |= {(i, j, rank) for rank, (_, j) in enumerate(sorted(scores)[:top])}
    return out


def found(index, spark, queries, top):
    return {(r["query_id"], r["id"], r["rank"]) for r in index.query(spark.createDataFrame(queries, QUERIES), top).collect()}


def clustered(n, seed, dim=16, groups=25):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + 0.15 * r.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("lists", [1, 7, None])
def test_answers_are_those_of_a_scan(spark, tmp_path, lists):
    rows = clustered(900, 1)
    queries = [(i, v) for i, v in rows[::45]] + [(1000 + i, np.random.default_rng(i).normal(size=16).tolist()) for i in range(5)]
    index = InvertedFile.build(spark.createDataFrame(rows[:500], VECTORS), str(tmp_path / "v"), lists)
    index.append(spark.createDataFrame(rows[500:], VECTORS))
    for top in (1, 5, 60):
        assert found(InvertedFile(spark, str(tmp_path / "v")), spark, queries, top) == scan(rows, queries, top)


def test_few_lists_are_read_where_vectors_cluster(spark, tmp_path):
    rows = clustered(2000, 2)
    index = InvertedFile.build(spark.createDataFrame(rows, VECTORS), str(tmp_path / "v"))
    queries = spark.createDataFrame(rows[::100], QUERIES)
    read = index.reads(queries).agg(F.avg(F.col("lists_read") / F.col("lists")).alias("share"), F.count("*").alias("n")).first()
    assert read["n"] == 20 and read["share"] < 0.3


def test_odd_rows(spark, tmp_path):
    """Vectors of length zero, of another dimension, null ones, repeated and tied ones; fewer than are asked for."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, [-1.0, 0.0]), (6, [0.0, 3.0])]
    index = InvertedFile.build(spark.createDataFrame(rows, VECTORS), str(tmp_path / "v"))
    queries = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.5, 0.5])]
    for top in (2, 10):
        assert found(index, spark, queries, top) == scan(rows, queries, top)
    empty = InvertedFile.build(spark.createDataFrame([], VECTORS), str(tmp_path / "e"))
    empty.append(spark.createDataFrame(rows, VECTORS))
    assert found(empty, spark, queries, 10) == scan(rows, queries, 10)


def test_an_append_rewrites_no_list(spark, tmp_path):
    import os

    index = InvertedFile.build(spark.createDataFrame(clustered(300, 3), VECTORS), str(tmp_path / "v"))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "v" / "lists") for f in names}
    before = files()
    index.append(spark.createDataFrame([(10_000, [1.0] * 16)], VECTORS))
    after = files()
    assert all(after[f] == t for f, t in before.items()) and len(after) > len(before)


def test_the_fit_sends_its_sample_alone_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(ivf, "SAMPLE", 64)
    df = spark.createDataFrame([(i, v) for i, v in clustered(4000, 5, 64)], VECTORS).repartition(40).checkpoint()
    status, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def sent():
        stages = status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).resultSize() for i in range(stages.size())}

    before, centroids, after = sent(), ivf.fitted(df, 5), sent()
    rows = sorted(df.select(F.xxhash64("vec_id").alias("h"), "vec_id", "embedding").collect())[:64]
    few = ivf.fitted(spark.createDataFrame([(r.vec_id, r.embedding) for r in rows], VECTORS), 5)
    assert centroids.shape[0] == 5 and np.array_equal(centroids, few)
    one = 8 * len(rows[0].embedding)
    assert max(n for s, n in after.items() if s not in before) < 40 * 64 * one / 3


def test_a_sample_of_one_repeated_id_is_still_full(spark, monkeypatch):
    monkeypatch.setattr(ivf, "SAMPLE", 64)
    df = spark.createDataFrame([(7, [float(i), 1.0]) for i in range(500)], VECTORS)
    assert ivf._sample(df, 500).count() == 64
