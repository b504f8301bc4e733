"""Search by blocks and by documents: held to the row-by-row forms, and nothing shuffled that a rank or a term rules out."""

import random

import numpy as np
from pyspark.sql import functions as F

from stratafind.operators import graph as G, retrieval as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_pruned_before_the_shuffle(spark):
    df = spark.createDataFrame([(k % 3, k, float(k % 7)) for k in range(60)], "q long, id long, score double")
    assert "WindowGroupLimit" in plan(R.ranked(df, "q", F.col("score").desc(), "id", top=2))
    got = {(r.q, r.id): r["rank"] for r in R.ranked(df, "q", F.col("score").desc(), "id", top=2).collect()}
    want = {}
    for q in range(3):
        for rank, k in enumerate(sorted((k for k in range(60) if k % 3 == q), key=lambda k: (-(k % 7), k))[:2]):
            want[q, k] = rank
    assert got == want


def test_texts_are_tokenised_once(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "")], "doc_id long, text string")
    assert plan(R.bm25_index(docs)).count("regexp_extract_all(") == 1


def test_blocks_agree_with_rows_and_odd_vectors_keep_their_place(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 64)
    monkeypatch.setattr(R, "LEAST_BLOCK", 16)
    monkeypatch.setattr(R, "TILE", (8, 16))
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(4)], 0) for i in range(300)]
    rows += [(1000, None, 0), (1001, [1.0, 2.0], 0), (1002, [0.0] * 4, 0), (None, [1.0] * 4, 0), (1003, [1.0, None, 0.0, 1.0], 0), (1004, [float("inf"), 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = df.where("vec_id % 7 = 0 OR vec_id >= 1000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = R.vector_index(df)
    want = R.ranked(R.scored(index, asked).withColumn("score", F.round("score", 9)), "query_id", F.col("score").desc(), "id", top=5)
    held = lambda d: sorted(map(str, d.select("query_id", "id", "score", "rank").collect()))
    assert held(R.vector_search(index, asked)) == held(want)
    fine = df.where("vec_id < 300")
    each = R.scored(R.vector_index(fine), fine.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).where("id <> query_id").withColumn("score", F.round("score", 9))
    assert held(R.nearest(df.where("vec_id < 300"), fine.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3)) == held(R.ranked(each, "query_id", F.col("score").desc(), "id", top=3))


def test_terms_of_documents_score_as_the_index_does(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, ""), (3, None), (4, "bb cc dd"), (4, "bb cc ee"), (5, "x y")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "aa bb"), (2, "cc zz"), (3, "")], "query_id long, text string")
    found = [sorted(map(tuple, d.collect())) for d in (R.bm25_of(docs, asked), R.bm25_search(R.bm25_index(docs), R.bm25_stats(docs), asked))]
    assert found[0] == found[1] and len(found[0]) == 3


def test_edges_meet_the_frontier_before_a_shuffle(spark):
    nodes = spark.createDataFrame([(x, x.upper(), ["N"]) for x in "abcdef"], "id string, name string, labels array<string>")
    edges = spark.createDataFrame([(f"{s}{d}", s, d, "R", None) for s, d in ("ab", "bc", "ca", "cd", "ee", "ef")], "edge_id string, src string, dst string, rel_type string, valid_from string")
    seeds = spark.createDataFrame([("A",)], "name string")
    found = G.expand(nodes, edges, seeds, 2, None)
    assert {(r.id, r.hop) for r in found.collect()} == {("b", 1), ("c", 1), ("b", 2), ("c", 2), ("d", 2)}
    near = G.NEAR
    try:
        G.NEAR = 0
        assert sorted(map(str, G.expand(nodes, edges, seeds, 2, None).collect())) == sorted(map(str, found.collect()))
    finally:
        G.NEAR = near


def test_simple_edges_are_shuffled_by_each_end_once(spark):
    nodes = spark.createDataFrame([(x, x.upper(), [k]) for x, k in [("a", "N"), ("b", "N"), ("c", "N"), ("d", "N"), ("z", "Category"), ("a", "N")]], "id string, name string, labels array<string>")
    rows = [("1", "b", "a", "R"), ("2", "a", "b", "S"), ("0", "a", "b", "T"), ("3", "c", "c", "R"), ("4", "z", "a", "R"), ("5", "x", "a", "R"), ("6", "d", "c", "U"), ("7", None, "c", "U"), ("8", "a", None, "U")]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, rel_type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = G.simple(nodes, edges)
        # edges by either end, and the ids, which are told apart where they meet them
        assert plan(df).count("Exchange hashpartitioning") <= 4
        assert sorted(map(tuple, df.collect())) == [("a", "b", "S"), ("c", "d", "U")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_sent_as_often_in_large_tables_as_in_small_ones():
    for share in (1, 100):
        copies = set()
        for n in (60_000, 600_000):
            rows, asks = R._grid(n, n // share, 64)
            assert rows * asks >= R.PAIRS - R.PAIRS // 8 and max(n / rows, n / share / asks) <= R.BLOCK
            copies.add(asks + rows / share)
        assert len(copies) == 1 and max(copies) <= 14
    # long vectors have smaller blocks
    assert 600_000 / R._grid(600_000, 600_000, 1024)[0] * 1024 <= R.COMPONENTS


def test_scores_closer_than_single_precision_keep_their_order(monkeypatch):
    monkeypatch.setattr(R, "TILE", (8, 32))
    rnd = np.random.default_rng(4)
    q = rnd.standard_normal((20, 8))
    near = q[:1] + rnd.standard_normal((400, 8)) * 3e-5
    r = np.concatenate([near, rnd.standard_normal((200, 8)), np.repeat(q[1:2], 300, 0), np.zeros((5, 8))])
    q, r = (np.divide(x, np.sqrt((x * x).sum(1, keepdims=True)), out=np.zeros_like(x), where=x != 0) for x in (q, r))
    i, j, score = R._best(q, r, np.arange(20) * 45, np.arange(len(r)), 3, False)
    s = np.round(q @ r.T, 9) + 0.0
    s[np.arange(20), np.arange(20) * 45] = -np.inf
    want = [(a, b) for a in range(20) for b in np.lexsort((np.arange(len(r)), -s[a]))[:3]]
    assert list(zip(i, j)) == want and np.array_equal(score, s[i, j])


def test_folding_shuffles_only_what_may_touch_a_property(spark):
    ids = [f"n{k}" for k in range(400)]
    nodes = [(i, i.upper(), {"kind": "N"}) for i in ids] + [("x1", "Colour : red", {}), ("x2", "Size: 3:4", {}), ("x3", "no colon", {}), ("x4", "Id: 7", {}), (None, "nobody", {})]
    edges = [(f"e{k}", ids[k], ids[(k * 7 + 1) % 400], "R") for k in range(400)] + [("l", "n5", None, "R"), ("m", None, "n6", "R"), ("b", "x1", "n7", "R"), ("c", "n8", "x2", "S")]
    edges += [("h1", "n1", "x1", "HAS_PROPERTY"), ("h2", "n1", "x2", "HAS_PROPERTY"), ("h3", "n2", "x3", "HAS_PROPERTY"), ("h4", "n3", "x4", "HAS_PROPERTY"), ("h5", "n4", "x1", "HAS_PROPERTY")]
    nodes = spark.createDataFrame(nodes, "id string, name string, props map<string,string>")
    edges = spark.createDataFrame(edges, "edge_id string, src string, dst string, rel_type string")
    folded, left = G.fold_properties(nodes, edges)
    extra = {"n1": {"colour": "red", "size": "3:4"}, "n4": {"colour": "red"}}
    want = {i: {"kind": "N"} | extra.get(i, {}) for i in ids} | {None: {}}
    for words in (G.SIEVE, 1):
        held = G.SIEVE
        G.SIEVE = words
        try:
            folded, left = G.fold_properties(nodes, edges)
            assert {r.id: r.props for r in folded.collect()} == want and folded.count() == len(want)
            assert sorted(r.edge_id for r in left.collect()) == sorted([f"e{k}" for k in range(400)] + ["l", "m"])
        finally:
            G.SIEVE = held
    mine, others = G._sieve(spark.createDataFrame([("x1",), ("x2",)], "id string"))(edges, "src", "dst")
    assert mine.count() < 20 and mine.count() + others.count() == edges.count()
    assert "Exchange hashpartitioning(src" not in plan(others) and "Exchange hashpartitioning(dst" not in plan(others)
