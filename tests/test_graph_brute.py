"""Louvain, star clusters, components and clean-up against plain Python on small graphs."""

import difflib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafind import registry
from stratafind.operators import graph as G, retrieval as R
from test_resolve import greedy

SF = "/root/testdata/sf0.001"


def modularity(edges, of):
    m = len(edges)
    degree, inside = Counter(), 0
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
        inside += of[a] == of[b]
    total = Counter()
    for n, d in degree.items():
        total[of[n]] += d
    return inside / m - sum((t / (2 * m)) ** 2 for t in total.values())


def test_louvain_finds_planted_groups(spark):
    r, edges = random.Random(1), []
    for g in range(5):
        for i in range(12):
            edges += [(f"g{g}n{i:02d}", f"g{g}n{j:02d}") for j in range(i) if r.random() < 0.6]
    edges += [(f"g{r.randrange(5)}n{r.randrange(12):02d}", f"g{r.randrange(5)}n{r.randrange(12):02d}") for _ in range(8)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a string, b string")
    of = {x.node: x.community for x in G.louvain(df).collect()}
    assert set(of) == {n for e in edges for n in e} and all(of[c] == c for c in of.values())
    planted = {n: n[:2] for n in of}
    assert modularity(edges, of) >= modularity(edges, planted) - 0.02
    state = spark.createDataFrame([(n, float(sum(n in e for e in edges)), c) for n, c in of.items()], "x string, k double, c string")
    both = Counter(edges) + Counter((b, a) for a, b in edges)
    w = spark.createDataFrame([(a, b, float(k)) for (a, b), k in both.items()], "x string, y string, w double")
    assert abs(G.modularity(w, state, 2.0 * len(edges)) - modularity(edges, of)) < 1e-9


def test_louvain_settles(spark):
    """Over the whole graph: every node has a community named by a member, and no single move gains modularity any more."""
    rows = registry.QUERIES["com_louvain"](spark, SF).collect()
    of = {x["node"]: x["community"] for x in rows}
    edges = [(x["src"], x["dst"]) for x in registry.QUERIES["g_edges_fetch"](spark, SF).collect()]
    assert set(of) == {n for e in edges for n in e} and all(of[c] == c for c in of.values())
    assert modularity(edges, of) > 0.15 and modularity(edges, of) > modularity(edges, {n: n for n in of})


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.component for x in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


def stars(rows, alike):
    """seed, id of greedy stars in id order."""
    out, free = set(), {i for i, _ in rows}
    for i, a in sorted(rows, key=lambda x: x[0]):
        if i in free:
            free.discard(i)
            for j, b in rows:
                if j in free and alike(a, b):
                    out.add((i, j))
                    free.discard(j)
    return out


def test_er_semantic(spark):
    blocks = defaultdict(list)
    for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        v = np.array(x["embedding"], float)
        blocks[x["label"]].append((x["vec_id"], v / max(np.linalg.norm(v), 1e-10)))
    want = set().union(*(stars(sorted(rows, key=lambda x: x[0]), lambda a, b: a @ b >= 0.35) for rows in blocks.values()))
    assert {tuple(x) for x in registry.QUERIES["er_semantic"](spark, SF).collect()} == want and want


def test_er_lexical(spark):
    blocks = defaultdict(list)
    for x in spark.read.parquet(f"{SF}/part.parquet").collect():
        blocks[x["p_brand"]].append((x["p_partkey"], x["p_name"].lower().strip()))
    want = set().union(*(stars(sorted(rows), lambda a, b: difflib.SequenceMatcher(None, a, b).ratio() >= 0.85) for rows in blocks.values()))
    assert {tuple(x) for x in registry.QUERIES["er_lexical"](spark, SF).collect()} == want


def test_er_reltypes(spark):
    assert {tuple(x) for x in registry.QUERIES["er_reltypes"](spark, SF).collect()} == {("SUPPLIED BY", "SUPPLIED_BY")}


def merged(nodes, edges, groups):
    """nodes {id: [name, labels, v]} and edges [(edge_id, src, dst, kind, q)] after each group became its best node."""
    degree = Counter(x for _, s, d, _, _ in edges for x in {s, d})
    canon = {}
    for ids in groups:
        keep = min(ids, key=lambda i: (-10 * degree[i], len(nodes[i][0]), i))
        canon |= {i: keep for i in ids if i != keep}
    left = {i: list(n) for i, n in nodes.items() if i not in canon}
    for i in sorted(canon):
        left[canon[i]][2] = nodes[i][2]
    joined = {}
    for e, s, d, kind, q in sorted(edges):
        to = (canon.get(s, s), canon.get(d, d), kind)
        if (s in canon or d in canon) and to[0] == to[1]:
            continue
        joined[to] = (joined.get(to, (e,))[0], q)
    return left, [(e, *to, q) for to, (e, q) in joined.items()]


def test_er_cleanup(spark):
    """The whole clean-up in plain Python: equal names, kinds of edges, likeness by label, parallel edges."""
    parts = {f"p{x['p_partkey']}": (x["p_name"], ["__Entity__", x["p_brand"]], x["p_brand"]) for x in spark.read.parquet(f"{SF}/part.parquet").collect()}
    vectors = {f"p{x['vec_id']}": x["embedding"] for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    edges = [(f"e{x['l_orderkey'] * 10 + x['l_linenumber']:012d}", f"p{x['l_partkey']}", f"s{x['l_suppkey']}", "SUPPLIED_BY" if x["l_linenumber"] % 2 == 0 else "SUPPLIED BY", str(int(x["l_quantity"]))) for x in lines]
    buckets = defaultdict(list)
    for i, (name, _, _) in parts.items():
        buckets[name.strip().lower().replace(" ", "_")].append(i)
    nodes, edges = merged(parts, edges, buckets.values())
    edges = [(e, s, d, "SUPPLIED BY", q) for e, s, d, _, q in edges]
    found = defaultdict(list)
    for _, seed, i in greedy([(i, n[0], n[1], vectors.get(i)) for i, n in nodes.items()], 0.85):
        found[seed].append(i)
    nodes, edges = merged(nodes, edges, [[seed, *ids] for seed, ids in found.items()])
    assert {(x["src"], x["dst"], x["rel_type"], x["edge_id"], x["q"]) for x in registry.QUERIES["er_cleanup"](spark, SF).collect()} == {(s, d, k, e, q) for e, s, d, k, q in edges}
    assert {tuple(x) for x in registry.QUERIES["er_cleanup_nodes"](spark, SF).select("id", "name", "labels", "v").collect()} == {(i, n[0], ",".join(n[1]), n[2]) for i, n in nodes.items()}


def test_cleanup_in_order(spark):
    """Kinds and names that meet only after the steps before them."""
    nodes = [(i, n, [k], {"kind": k}) for i, n, k in [("a", "Acme Corp", "Org"), ("b", "acme corp ", "Org"), ("c", "Acme Corps", "Org"), ("d", "Bolt", "Part"), ("e", "Acme Corps", "Part")]]
    edges = [("1", "a", "d", "MAKES", {"q": "1"}), ("2", "b", "d", "MAKE", {"q": "2"}), ("3", "c", "d", "MAKES", {"q": "3"}), ("4", "a", "c", "OWNS", {}), ("5", "d", "a", "MADE_BY", {})]
    n = spark.createDataFrame(nodes, "id string, name string, labels array<string>, props map<string,string>")
    e = spark.createDataFrame(edges, "edge_id string, src string, dst string, rel_type string, props map<string,string>")
    none = lambda held: held.select("id", F.lit(None).cast("array<double>").alias("embedding"))
    left, linked = G.cleanup(n, e, none, 0.85)
    # equal names first (b into a, and e into c), then kinds, then a and c by name; the loop between these goes
    assert {r["id"] for r in left.collect()} == {"a", "d"}
    assert {(r["src"], r["dst"], r["rel_type"], r["edge_id"]) for r in linked.collect()} == {("a", "d", "MAKE", "1"), ("d", "a", "MADE_BY", "5")}


def test_tools_fail_alone(spark):
    planned = spark.createDataFrame([(1, "q", "good,late,early"), (2, "r", "good"), (3, "s", "early")], "query_id long, text string, tools string")
    answer = lambda asked: asked.select("query_id", F.lit(0).alias("rank"), "text").withColumnRenamed("text", "id")

    def early(asked):
        raise ValueError("no index")

    late = lambda asked: answer(asked).withColumn("id", F.raise_error(F.lit("down")).cast("string"))
    rows, errors = R.run_tools(planned, {"early": early, "good": answer, "late": late, "unasked": answer})
    assert {tuple(r) for r in rows.collect()} == {(1, "good", 0, "q"), (2, "good", 0, "r")} and errors.keys() == {"early", "late"}
    assert R.run_tools(planned, {"early": early})[0].collect() == []


def test_components_read_their_edges_once_for_all_rounds(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    rows = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)] * 2 + [("x", "x"), ("z", "y")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "a string, b string")
    found = {x.node: x.component for x in G.components(df).collect()}
    assert found == {f"n{i:02}": "n00" for i in range(41)} | {"x": "x", "y": "y", "z": "y"}
    assert read.value <= 2 * len(rows)


def test_a_louvain_round_shuffles_weights_once_and_finds_the_modularity_before(spark):
    r = random.Random(7)
    pairs = sorted({(min(p), max(p)) for p in ((r.randrange(30), r.randrange(30)) for _ in range(120))})
    rows = [(a, b, float(1 + (a + b) % 3)) for a, b in pairs]
    w = spark.createDataFrame([(a, b, 2 * k if a == b else k) for a, b, k in rows] + [(b, a, k) for a, b, k in rows if a != b], "x long, y long, w double")
    double_m, loops = w.agg(F.sum("w")).first()[0], w.where("x = y").agg(F.sum("w")).first()[0]
    state = w.groupBy("x").agg(F.sum("w").alias("k")).withColumn("c", F.col("x") % 5).checkpoint()
    names = state.select("x", F.col("x").cast("string").alias("s"))
    near = w.where("x <> y").join(state.select("x", "k"), "x").select("x", "y", "w", "k").repartition("y").sortWithinPartitions("y").checkpoint()
    kept = []
    after, before = G._moved(near, state, names, double_m, loops, 0, kept)
    assert abs(before - G.modularity(w, state, double_m)) < 1e-9
    assert {x.x for x in after.collect()} == {x.x for x in state.collect()} and G.modularity(w, after, double_m) > before
    assert abs(G._moved(near, after, names, double_m, loops, 1, kept)[1] - G.modularity(w, after, double_m)) < 1e-9


def test_components_leave_nothing_of_their_rounds_on_disk(spark):
    import os

    from stratafind.common import shared_folder

    shared_folder(spark)
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    r, before = random.Random(9), set(os.listdir(at))
    edges = [(f"a{r.randrange(400)}", f"a{r.randrange(400)}") for _ in range(260)] + [(f"h{i % 3}", f"b{i}") for i in range(90)] + [("z", "z"), ("b1", "b1"), (None, "a1"), ("q", None)]
    root = {n: n for e in edges if None not in e for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = G.components(spark.createDataFrame(edges, "a string, b string"))
    assert len(set(os.listdir(at)) - before) == 1
    assert sorted(map(tuple, found.collect())) == sorted((n, find(n)) for n in root)
    loops = G.components(spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string"))
    assert sorted(map(tuple, loops.collect())) == [("x", "x"), ("y", "y")]
    assert G.components(spark.createDataFrame([], "a string, b string")).collect() == []
