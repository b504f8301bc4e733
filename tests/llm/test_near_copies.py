"""The pipeline's near copies against exact Jaccard similarities."""

import random

import pytest

from stratafind.llm import simhash_variants
from test_operators import brute_similarities, rng_words


def brute_groups(rows, similarity=0.8):
    """Smallest id of its group, by id."""
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), j in brute_similarities(rows).items():
        if j >= similarity:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in root}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {x.doc_id: x.component_id for x in simhash_variants.near_copies(df).collect()}


@pytest.mark.parametrize("run", [8192, 32])
def test_near_copies_in_large_runs_of_loosely_alike_texts(spark, monkeypatch, run):
    """Pages of one template (similarity about 0.65 and 0.77) under common keys, and pairs of near copies among them."""
    monkeypatch.setattr(simhash_variants, "RUN", run)
    r, rows = random.Random(5), []
    for own in (60, 35):
        base = rng_words(r, 240)
        for _ in range(80):
            page = base + [f"p{r.randrange(10**6)}" for _ in range(own)]
            rows += [(len(rows), " ".join(page)), (len(rows) + 1, " ".join(page[:-12] + [f"q{r.randrange(10**6)}" for _ in range(12)]))]
    want = brute_groups(rows)
    assert len(set(want.values())) == 160
    assert found(spark, rows) == want


def test_near_copies_are_exact_at_the_limit(spark):
    """Pairs at 0.76 to 0.84, short and long: those of 0.8 link, no other."""
    r, rows = random.Random(6), []
    for n in (8, 12, 24, 60, 150, 400):
        for _ in range(60):
            base = [f"w{r.randrange(10**6)}" for _ in range(n + 4)]
            cut = max(1, round(n * r.uniform(0.08, 0.14)))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:-cut] + [f"v{r.randrange(10**6)}" for _ in range(cut)]))]
    alike = brute_similarities(rows)
    assert sum(0.78 <= j < 0.8 for j in alike.values()) > 10 and sum(0.8 <= j < 0.82 for j in alike.values()) > 10
    got = found(spark, rows)
    linked = {(2 * i, 2 * i + 1) for i in range(len(rows) // 2) if got[2 * i] == got[2 * i + 1]}
    over = {p for p, j in alike.items() if j >= 0.8}
    assert linked <= over and len(over - linked) <= 0.01 * len(over)
