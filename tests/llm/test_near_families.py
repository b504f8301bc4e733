"""Families of near copies: rows as many as texts, and every pair that meets is compared, in one task or block by block."""

import random

import numpy as np
import pytest

from stratafind.llm import simhash_variants
from test_near_copies import brute_groups
from test_near_groups import group
from test_operators import rng_words


def test_a_run_gives_rows_as_its_texts(spark):
    rows = [(key, name, 5, 7) for key in range(20) for name in range(key, key + 16)]
    met = simhash_variants._candidates(spark.createDataFrame(rows, "key long, name long, w0 long, w1 long")).collect()
    assert len(met) <= len(rows)
    assert {x for p in met for x in (p["a"], p["b"])} == {r[1] for r in rows}


@pytest.mark.parametrize("two", [False, True])
def test_alike_is_brute_force(two):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, (2, 60))
    sets = [np.unique(np.concatenate([base[k % 2, r.permutation(60)[: r.integers(48, 61)]], r.integers(0, 2**63, r.integers(0, 12))])).astype("<u8") for k in range(150)] + [np.zeros(0, "<u8")]
    side = r.integers(0, 2, len(sets)) if two else np.zeros(len(sets), int)
    name = r.permutation(len(sets))
    root = dict(zip(name.tolist(), name.tolist()))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and not (two and side[i] == side[j]):
                x, y = sorted((find(name[i]), find(name[j])))
                root[y] = x
    got = dict(zip(*(x.tolist() for x in simhash_variants._alike(name, side, sets, 0.8))))
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root} and len(set(got.values())) > 1


def test_family_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_variants, "BLOCK_SHINGLES", 4000)
    r = random.Random(9)
    rows = list(enumerate(group(r, 150) + [" ".join(rng_words(r, 120)) for _ in range(20)]))
    found = {x.doc_id: x.component_id for x in simhash_variants.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == brute_groups(rows)
