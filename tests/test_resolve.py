"""Star clusters over blocks against the greedy pass in plain Python; the filters against all pairs."""

import difflib
import random
import string

import numpy as np
import pytest

from stratafind.operators import resolve as E

NODES = "id long, name string, labels array<string>, embedding array<double>"


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b)) / n if n else 0.0


def greedy(nodes, threshold):
    """(block, seed, id), block after block in order of appearance; who is clustered takes no part in later ones."""
    blocks: dict = {}
    for n in sorted(nodes, key=lambda n: n[0]):
        for label in [x for x in dict.fromkeys(n[2] or []) if x not in ("__Entity__", "__Node__")] or ["__UNLABELED__"]:
            blocks.setdefault(label, []).append(n)
    gone, out = set(), set()
    for label, rows in blocks.items():
        by_vector = all(r[3] is not None for r in rows)
        taken = set()
        for k, a in enumerate(rows):
            if a[0] in taken or a[0] in gone:
                continue
            star = []
            for b in rows[k + 1 :]:
                if b[0] in taken or b[0] in gone:
                    continue
                like = cosine(a[3], b[3]) if by_vector else difflib.SequenceMatcher(None, a[1].lower().strip(), b[1].lower().strip()).ratio()
                if like >= threshold:
                    star.append(b[0])
            taken |= {a[0], *star}
            out |= {(label, a[0], b) for b in star}
            if star:
                gone |= {a[0], *star}
    return out


def made(seed, n=150):
    r = random.Random(seed)
    centres = [np.array([r.gauss(0, 1) for _ in range(6)]) for _ in range(12)]
    rows = []
    for i in range(n):
        v = (r.choice(centres) + np.array([r.gauss(0, 0.25) for _ in range(6)])).round(2).tolist()
        labels = r.sample(["A", "B", "C", "__Entity__", "D"], r.randint(0, 3))
        rows.append((i, f" Name {r.randrange(30)}" + r.choice(["", " x", "Y"]), labels, r.choice([v, v, [1.0] * 6, [0.0] * 6]) if i % 40 else v))
    ids = list(range(n))
    r.shuffle(ids)
    return [(ids[k], *row[1:]) for k, row in enumerate(rows)]


def found(spark, nodes, threshold):
    rows = E.clusters(spark.createDataFrame(nodes, NODES), threshold).collect()
    assert len(rows) == len(set(rows))
    return {(r["block"], r["seed"], r["id"]) for r in rows}


@pytest.mark.parametrize("seed,threshold", [(1, 0.9), (2, 0.8), (3, 0.97)])
def test_blocks_of_vectors(spark, seed, threshold):
    nodes = made(seed)
    assert found(spark, nodes, threshold) == greedy(nodes, threshold)


def test_blocks_of_names_and_of_both(spark):
    """Where one node of a block has no vector, its names decide; other blocks of the same nodes go by vector."""
    nodes = [(i, n, ls, None if "C" in ls or not ls else v) for i, n, ls, v in made(4, 100)]
    assert found(spark, nodes, 0.85) == greedy(nodes, 0.85)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 8)
    nodes = [(i, n, ["A"], v) for i, n, _, v in made(6)]
    assert found(spark, nodes, 0.9) == greedy(nodes, 0.9)


def test_a_chain_waits_for_its_start(spark):
    """Each node is like its two neighbours alone: every third... the greedy pass takes them two by two."""
    nodes = [(i, "", ["A"], [float(np.cos(0.1 * i)), float(np.sin(0.1 * i))]) for i in range(15)]
    assert found(spark, nodes, float(np.cos(0.12))) == greedy(nodes, float(np.cos(0.12))) and greedy(nodes, float(np.cos(0.12)))


def test_no_tile_pairs_that_are_far_apart(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 16)
    r = np.random.default_rng(1)
    centres = np.eye(20)
    rows = [(0, i, (centres[i % 20] + 0.01 * r.normal(size=20)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "block int, id long, v array<double>")
    n = E.tiles(df).count()
    got = {(x["a"], x["b"]) for x in E.alike_vectors(df, 0.9).collect()}
    assert n >= 25 and got == {(a, b) for a in range(400) for b in range(a + 1, 400) if a % 20 == b % 20}


def test_vectors_are_sent_once_for_each_group_and_not_for_each_tile(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 8)
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(None if i % 2 else "b", i, x.tolist()) for i, x in enumerate(v)], "block string, id long, v array<double>")
    want = {(i % 2, i, j) for i in range(400) for j in range(i + 2, 400, 2) if v[i] @ v[j] >= 0.7}
    for group in (64, 8192):
        monkeypatch.setattr(E, "GROUP", group)
        before = written(spark)
        got = [(int(x["block"] is None), x["a"], x["b"]) for x in E.alike_vectors(df, 0.7).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # the last time there is one group for each block: rows pass with their tiles' tables and once more
    assert written(spark) - before < 4 * 400 * 6 * 8 + 100_000


def written(spark):
    """Bytes shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def names(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice(string.ascii_lowercase + " ") for _ in range(r.randint(0, 14))) for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = [r.choice("abc ")] * r.randint(0, 1)
        out.append("".join(w))
    return out + ["", "a", "aa", "ab", "aaaaaaaa", "aaaaaaab", "x" * 250, "x" * 248 + "yz"]


@pytest.mark.parametrize("threshold", [0.5, 0.67, 0.85, 0.95, 1.0])
def test_name_filter_loses_no_pair(spark, threshold):
    rows = list(enumerate(names(int(threshold * 100), 140)))
    df = spark.createDataFrame([("b", i, x) for i, x in rows], "block string, id long, name string")
    want = {(i, j) for i, x in rows for j, y in rows if i < j and difflib.SequenceMatcher(None, x, y).ratio() >= threshold}
    assert {(x["a"], x["b"]) for x in E.alike_names(df, threshold).collect()} == want
    if threshold >= 0.85:  # and lets few others by
        assert E.name_candidates(df, threshold).count() < len(rows) * (len(rows) - 1) / 2 / 4


def test_odd_nodes(spark):
    assert found(spark, [], 0.9) == set()
    nodes = [(1, "Same", ["A", "A"], [1.0, 0.0]), (2, "same ", ["A"], [1.0, 0.0]), (3, "x", None, [0.0, 0.0]), (4, "y", [], [0.0, 0.0]), (5, "z", ["__Node__"], [1.0]), (6, "w", ["A"], [1.0])]
    nodes += [(100 + i, "Hot", ["H"], [0.5, 0.5]) for i in range(300)]
    got = found(spark, nodes, 0.9)
    assert ("A", 1, 2) in got and {(b, s, i) for b, s, i in got if b == "H"} == {("H", 100, 100 + i) for i in range(1, 300)}
    assert not [x for x in got if x[0] == "__UNLABELED__"]
