"""Vector codes against plain Lloyd rounds, in Python's integers."""

import hashlib
import random

import numpy as np
import pytest

from stratafind.llm import elkan_codes
from stratafind.llm.queries import QUERIES

SCHEMA = "vec_id long, label string, embedding array<float>, code int, kind string, error string"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of every row that takes part, and the digest of the codebooks."""
    rows = [r for r in rows if r[2] and all(x is not None and np.isfinite(x) for x in r[2])]
    rows.sort(key=lambda r: (r[0] is not None, r[0], r[2]))
    rows = [r for r in rows if len(r[2]) == len(rows[0][2])]
    whole = [[int(np.floor(np.float64(np.float32(x)) * 4096)) for x in r[2]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        at = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [c[p] for c, a in zip(cut, at) if a[p] == e]:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(r[0], bytes(e for _, e in f).hex(), d, by_label[r[1]], sha) for r, f, d in zip(rows, found, errors)]


def found(spark, rows):
    return [tuple(r) for r in elkan_codes.coded(spark.createDataFrame([(i, l, v, 1, "x", "y") for i, l, v in rows], SCHEMA)).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds(spark, seed):
    """Clustered and coarse vectors: many ties, equal entries, entries that lose all their parts."""
    r = random.Random(seed)
    centres = [[r.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(16)] for _ in range(20)]
    rows = [(i, r.choice(["a", "b", None]), [x + r.choice([0, 0, 1 / 4096, -2 / 4096]) for x in r.choice(centres)]) for i in range(400)]
    assert ordered(found(spark, rows)) == ordered(plain(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, "l", [float(i % 3)] * 8) for i in range(5, 12)]
    odd = [(1, "l", None), (2, None, [nan] * 8), (3, "l", [inf] + [0.0] * 7), (4, "l", [None] + [0.0] * 7), (20, "l", [1.0] * 9), (21, "l", []), (6, "l", [0.0] * 8), (6, None, [0.0] * 8), (None, "l", [3.0] * 8)]
    rows = base + odd
    got = found(spark, rows)
    assert ordered(got) == ordered(plain(rows)) and len(got) == len(base) + 3
    assert found(spark, []) == [] and found(spark, odd[:4]) == []


def test_length_that_does_not_divide_and_huge_components(spark):
    rows = [(i, "l", [float(i), 2.0, -1.0]) for i in range(40)] + [(50, "l", [3e38, -3e38, 0.0])]
    got = found(spark, rows)
    padded = [(i, l, v + [0.0] * 5) for i, l, v in rows[:-1]] + [(50, "l", [16384.0, -16384.0, 0.0] + [0.0] * 5)]
    assert ordered(got) == ordered(plain(padded))


def test_bounds_rule_out_most_distances(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(16, 64))
    rows = [(i, "l", (centres[i % 16] + r.normal(size=64) * 0.05).tolist()) for i in range(600)]
    done = elkan_codes.encode(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>"))
    assert done.measured[0] == 600 * 8 * 16 and done.measured[-1] < done.measured[0] / 5


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert ordered([tuple(r) for r in QUERIES["op11_elkan_codes"](spark, sf).collect()]) == ordered(plain(rows))
