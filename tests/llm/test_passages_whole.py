"""Passages that stand in a later document more than once."""

import random
from collections import defaultdict

import numpy as np
import pytest
from stratafind.llm import collinear
from test_operators import texts  # noqa: F401  (a fixture)


def covered(rows):
    cover = defaultdict(set)
    for r in rows:
        cover[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return cover


def test_every_copy_in_the_later_document(spark):
    r = random.Random(9)
    plain = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, line, a, b = plain(60), plain(25), plain(30), plain(30)
    docs = {
        1: plain(80) + p + plain(40), 2: plain(20) + p + plain(30) + p + plain(10) + p,
        3: plain(30) + a + line + b + plain(20), 4: line + plain(40) + a + line + b + plain(15),
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = collinear.passages(df)
    cover = covered(found.collect())
    assert cover[2] == {*range(20, 80), *range(110, 170), *range(180, 240)} and cover[4] == set(range(65, 150)) and set(cover) == {2, 4}
    left = {r["doc_id"]: r["text"].split() for r in collinear.without(df.withColumn("n_chars", df["doc_id"]), found).collect()}
    assert left[2] == docs[2][:20] + docs[2][80:110] + docs[2][170:180]


def test_every_exact_repeat_without_exception(spark, texts):
    cover = covered(collinear.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    first, lost = {}, []
    for d, t in sorted(texts):
        w = (t or "").encode().lower().split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d and not cover[d].issuperset(range(i + 2, i + 48)):
                lost.append((d, i))
    assert not lost


def shadowed(window):
    """Document 1 holds every window of a passage, each in a context of its own; 2 and 3 hold the whole passage."""
    r = random.Random(window)
    passage = [f"p{i}" for i in range(100)]
    fill = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    first = []
    for i in range(100 - window + 1):
        first += fill(9) + passage[i : i + window]
    return {1: first + fill(9), 2: fill(30) + passage + fill(30), 3: fill(40) + passage + fill(20)}


@pytest.mark.parametrize("window", [5, 8, 12, 19])
@pytest.mark.parametrize("partitions", [1, 2, 3])
def test_windows_that_stood_elsewhere_hide_no_passage(spark, window, partitions):
    rows = [(i, " ".join(w)) for i, w in shadowed(window).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions, "doc_id")
    cover = set()
    for x in collinear.passages(df).collect():
        assert (x["doc_id"], x["source_doc_id"]) in ((3, 2), (3, 1), (2, 1))
        if x["doc_id"] == 3:
            cover |= set(range(x["start_word"], x["end_word"]))
    assert cover == set(range(40, 140))


@pytest.mark.parametrize("docs,places", [((5, 9), 10), ((-(2**63), 2**63 - 1), 100), ((-7, 2**32 + 5), 70_000), ((3, 3), 65_536)])
def test_seeds_as_bytes(docs, places):
    r = np.random.default_rng(places)
    h, around = r.integers(-(2**63), 2**63 - 1, 50), r.integers(0, 2 ** (8 * collinear.AROUND), 50, dtype=np.uint64)
    doc, pos = np.resize(np.array(docs, np.int64), 50), r.integers(0, places + 1, 50).astype(np.int32)
    again = collinear.seeds_from_bytes(collinear.seeds_as_bytes(h, doc, pos, around))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(again, (h, doc, pos, around)))
