"""Spelling variants against all pairs of words; the automata against their word lists."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stratafind.llm import spelling_automata
from stratafind.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, word string, n string, number int"


def near(a, b):
    """One code point more, less or another."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    out, form, count = set(), {}, {}
    for w in n:
        close = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w], count[w] = (best if best and n[best] >= 2 * n[w] else None), len(close)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def made(seed):
    """Texts of words, and of words with one fault or more, in several scripts' letters."""
    r = random.Random(seed)
    letters = "abcdeéßÿñ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(60)]
    rows = []
    for doc in range(40):
        text = []
        for _ in range(120):
            w = r.choice(words[: r.randint(1, 60)])
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", r.choice(letters), r.choice(letters) + w[k]]) + w[k + 1 :]
            text.append(w.title() if r.random() < 0.2 else w)
        rows.append((doc, r.choice([" ", ", ", "1", "\n"]).join(text)))
    return rows


def found(spark, rows):
    got = spelling_automata.variants(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_automaton():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(400)})
    a = spelling_automata.Automaton(words)
    assert [a.walk(a.root, 0, w)[1] for w in words] == list(range(len(words)))  # a perfect hash, in order
    assert a.words[a.root] == len(words) and len(a.final) < sum(map(len, words)) / 3
    for w in words[::7]:
        for k in range(len(w) + 1):
            want = {i for i, v in enumerate(words) if v.startswith(w[:k]) and (near(v[k:], w[k:]))}
            assert a.near(w[:k], w[k:]) == want
    assert spelling_automata.Automaton([]).near("", "a") == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = made(seed)
    assert found(spark, rows) == plain(rows)


def test_small_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(spelling_automata, "BLOCK_WORDS", 16)
    monkeypatch.setattr(spelling_automata, "VISITORS", 10)
    monkeypatch.setattr(spelling_automata, "HELD_WORDS", 50)
    rows = made(5)
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "house " * 5), (3, "house " * 5), (None, "hause " * 4), (4, "HOUSE×É÷ÿ " * 3), (5, "x" * 200_000 + " mouse mouse mouse"), (6, "a" * 200_000 + " mouse"), (7, ("abcde " * 3 + "abcdf ") * 4)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == set() and found(spark, [(1, "few")]) == set()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op13_spelling_automata"](spark, sf).collect()} == plain(rows)
