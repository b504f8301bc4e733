"""A large group of near copies with all degrees of change: recall against brute force, and verifications linear in its size."""

import random

from stratafind.llm import simhash_variants
from test_near_copies import brute_groups
from test_operators import rng_words


def group(r, size, words=140):
    """Copies of one text with none to seven of its words replaced: similarities from 0.3 to 0.97, on both sides of the limit."""
    base = rng_words(r, words)
    out = []
    for _ in range(size):
        copy = list(base)
        for i in r.sample(range(words), r.randrange(8)):
            copy[i] = f"new{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_large_group(spark, monkeypatch):
    r, asked, count = random.Random(3), [], simhash_variants._verified

    def counted(pairs, held, similarity):
        asked.append(pairs.count())
        return count(pairs, held, similarity)

    monkeypatch.setattr(simhash_variants, "_verified", counted)
    rows = list(enumerate(group(r, 500) + [" ".join(rng_words(r, 120)) for _ in range(50)]))
    want = brute_groups(rows)
    found = {x.doc_id: x.component_id for x in simhash_variants.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    linked = [d for d, c in want.items() if c != d]
    assert len(linked) > 200 and sum(found[d] == want[d] for d in linked) >= 0.98 * len(linked)
    assert all(found[d] == d for d, c in want.items() if c == d and d not in want.values() or d >= 500)  # nothing else is linked
    assert sum(asked) <= 60 * len(rows)
