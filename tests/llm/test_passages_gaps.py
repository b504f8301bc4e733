"""Passages far apart, made of known lines, or changed here and there; the cost of aligning; odd input of the cutting."""

import random
import time
from collections import defaultdict

import corpus_pipeline
from stratafind.llm import collinear


def frame(spark, docs):
    return spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


def cover_of(rows):
    cover = defaultdict(set)
    for r in rows:
        cover[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return cover


def plain(r, n):
    return [f"w{r.randrange(10**7)}" for _ in range(n)]


def test_pairs_of_passages_at_any_distance(spark):
    r, docs, want = random.Random(1), {}, {}
    for k, gap in enumerate((20, 30, 40, 46, 60, 100, 150, 400, 1000, 3000)):
        for j, size in enumerate((55, 100, 700)):
            p, q, i = plain(r, size), plain(r, size), 2 * (3 * k + j) + 1
            docs[i] = plain(r, 30) + p + plain(r, gap) + q + plain(r, 30)
            docs[i + 1] = plain(r, 12) + p + plain(r, gap) + q + plain(r, 25)
            want[i + 1] = {*range(12, 12 + size), *range(12 + size + gap, 12 + 2 * size + gap)}
    df = frame(spark, docs)
    cover = cover_of(collinear.passages(df).collect())
    assert {d: c for d, c in cover.items() if c} == want
    left = {x["doc_id"]: x["text"].split() for x in corpus_pipeline.substring_dedup(spark, df, "").collect()}
    assert left == {d: [x for i, x in enumerate(w) if i not in want.get(d, ())] for d, w in docs.items()}


def test_passages_of_lines_that_stood_elsewhere(spark):
    """Each line of the passage first stood in a document of its own; the passage itself stands in two later ones."""
    r, docs, want = random.Random(2), {}, {}
    for _ in range(60):
        lines = [plain(r, n) for n in r.choice(((12, 16, 12, 16), (16, 12, 16, 14), (13, 13, 13, 13), (12, 12, 12, 12, 16)))]
        for line in lines:
            docs[len(docs)] = plain(r, 40) + line + plain(r, 40)
        whole = [x for line in lines for x in line]
        docs[len(docs)] = plain(r, 35) + whole + plain(r, 30)
        docs[len(docs)] = plain(r, 20) + whole + plain(r, 45)
        want[len(docs) - 1] = set(range(20, 20 + len(whole)))
    cover = cover_of(collinear.passages(frame(spark, docs)).collect())
    assert sum(cover[d] >= w for d, w in want.items()) >= 0.95 * len(want) and set(cover) <= set(want)


def test_changed_passages(spark):
    """Passages with every n-th word replaced (about 83, 87 and 90 % alike): most are found, almost all of the longer ones."""
    r, docs, want = random.Random(3), {}, defaultdict(list)
    for every in (6, 8, 10):
        for size in (55, 60, 80, 150):
            for _ in range(50):
                p = plain(r, size)
                docs[len(docs)] = plain(r, 25) + p + plain(r, 25)
                docs[len(docs)] = plain(r, 25) + [f"x{r.randrange(10**7)}" if i % every == every - 1 else x for i, x in enumerate(p)] + plain(r, 25)
                want[every, size].append(len(docs) - 1)
    cover = cover_of(collinear.passages(frame(spark, docs)).collect())
    share = {k: sum(len(cover[d]) >= 0.8 * k[1] for d in ds) / len(ds) for k, ds in want.items()}
    assert all(v >= 0.9 for v in share.values()), share
    assert set(cover) <= {d for ds in want.values() for d in ds}


def test_lost_and_added_words(spark):
    r, p = random.Random(4), plain(random.Random(5), 160)
    edited = p[:30] + p[32:70] + ["new", "words"] + p[70:110] + p[111:]
    docs = {1: plain(r, 30) + p + plain(r, 30), 2: plain(r, 40) + edited + plain(r, 30)}
    cover = cover_of(collinear.passages(frame(spark, docs)).collect())
    assert cover == {2: set(range(40, 40 + len(edited)))}


def test_common_and_alignment_cost():
    r = random.Random(6)

    def quadratic(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], (before + 1 if x == y else max(row[j], row[j - 1]))
        return row[-1]

    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(30))] for _ in "xy")
        assert collinear.common(a, b) == quadratic(a, b)
    began = time.time()
    p, q = plain(r, 2000), plain(r, 2000)
    a, b = p + plain(r, 3000) + q, p + plain(r, 3000) + q
    anchors = [(i, i) for i in (*range(0, 1990, 9), *range(5000, 6990, 9))]
    assert [(x0, x1) for x0, x1, *_ in collinear.align([x.encode() for x in a], [x.encode() for x in b], anchors)] == [(0, 2000), (5000, 7000)]
    assert time.time() - began < 5


def test_repeated_lines_stay_linear(spark):
    """A text of one line said a thousand times, in two documents: covered whole, in time."""
    line = [f"say{i}" for i in range(9)]
    docs = {1: ["start"] + line * 1000, 2: ["other", "start"] + line * 1500}
    began = time.time()
    cover = cover_of(collinear.passages(frame(spark, docs)).collect())
    assert set(cover) == {2} and len(cover[2]) >= 9 * 1500 - 2 and time.time() - began < 60


def test_cutting_odd_input(spark):
    """One id with two texts, nulls, repeated rows, columns with the names used inside."""
    r = random.Random(7)
    p = plain(r, 80)
    rows = [(1, " ".join(plain(r, 20) + p)), (2, " ".join(p + plain(r, 30))), (2, " ".join(plain(r, 200))), (2, None), (None, " ".join(p)), (3, ""), (4, " ".join(p)), (4, " ".join(p)), (5, "short")]
    df = spark.createDataFrame([(i, t, 1, "a", "b", "c") for i, t in rows], "doc_id long, text string, n_chars long, row string, spans string, hit string")
    left = sorted(collinear.without(df, collinear.found_in(df)).collect(), key=str)
    kept = [(x["doc_id"], x["text"]) for x in left]
    want = [(i, t) for i, t in rows if i != 4]
    want[1] = (2, rows[1][1][len(" ".join(p)) :])
    assert sorted(kept, key=str) == sorted(want, key=str) and all(x["row"] == "a" and x["spans"] == "b" for x in left)
    empty = df.limit(0)
    assert collinear.without(empty, collinear.found_in(empty)).collect() == [] and corpus_pipeline.substring_dedup(spark, empty, "").collect() == []
