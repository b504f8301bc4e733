"""Quality rules: line labelling by a linear-chain conditional random field (operator 5).

Each line of a text is content or boilerplate. A two-state chain scores lines by shape features and by the step from the
line before; Viterbi decoding picks the best labelling of the whole text, and a document stays if at least CONTENT_SHARE of
its words stand in content lines. Weights are fitted here, by gradient ascent on the chain's conditional likelihood, from
the whole texts of a bounded sample of labelled documents: lines of well-graded documents are content, unless they repeat an
earlier line; lines of badly graded ones are boilerplate.

Defined results: null text has no words, fails the base rule and is not kept; texts are read whole; lines without words take
no part in the chain; ties of the decoding go to content; without usable labels PRIOR weights are used; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored. A document with several labels takes the least. Of
several texts under a sampled id the smallest is fitted.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import require, sliced, to_python

#: Documents of each grade that the chain is fitted on: the bound of what reaches the driver.
SAMPLE_DOCS = 600
#: Lines of a stretch: the sampled texts, which are used whole, are fitted stretch by stretch.
STRETCH = 64
CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FEATURES = ("one", "words", "upper", "symbols", "bangs", "digits", "ends", "word_length", "repeats", "variety", "short")
#: Emission weights for content against boilerplate where no labels are at hand, in the order of FEATURES.
PRIOR = ((1.5, 0.5, -4.0, -12.0, -12.0, -4.0, 0.5, 0.0, -2.0, 1.0, -0.5), ((0.5, -0.5), (-0.5, 0.5)))

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()


def features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    n, size = len(words), len(line)
    left = len(line.translate(None, _LETTERS))
    letters = size - left
    upper = size - len(line.translate(None, _UPPER))
    chars = max(1, sum(map(len, words)))
    return (
        1.0, min(1.0, math.log1p(n) / 5), upper / max(1, letters), (size - len(line.translate(None, b"#*$%&|<>"))) / n,
        line.count(b"!") / n, (size - len(line.translate(None, b"0123456789"))) / chars, 1.0 if line.rstrip()[-1:] in b".?!" else 0.0,
        min(3.0, chars / n / 8), 1.0 if seen else 0.0, len(set(words)) / n, 1.0 if n < 4 else 0.0,
    )


def lines_of(data: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and word counts of the lines with words, and how many of these equal an earlier one."""
    out, counts, again, seen = [], [], 0, set()
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            known = line in seen
            again += known
            seen.add(line)
            out.append(features(line, words, known))
            counts.append(len(words))
    return out, counts, again


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in twice:
            hit[i] = hit[i + 1] = hit[i + 2] = 1
    return sum(hit)


def viterbi(scores: list[float], step) -> list[int]:
    """Best labelling; scores: content against boilerplate by line; step[a][b]: weight of label b after label a."""
    (t00, t01), (t10, t11) = step
    back, b, c = [], 0.0, scores[0] if scores else 0.0
    for s in scores[1:]:
        from_b = 0 if b + t00 > c + t10 else 1
        from_c = 0 if b + t01 > c + t11 else 1
        b, c = (b + t00 if from_b == 0 else c + t10), (b + t01 if from_c == 0 else c + t11) + s
        back.append((from_b, from_c))
    label = 1 if c >= b else 0
    out = [label] * bool(scores)
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def stretches(chains):
    """Chains cut into pieces of STRETCH lines, with the weight of a line: one over its chain's lines."""
    return [(f[at : at + STRETCH], y[at : at + STRETCH], 1 / len(y)) for f, y in chains for at in range(0, len(y), STRETCH)]


def fit(chains: list[tuple[list[tuple[float, ...]], list[int]]], rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3):
    """Weights (emission, step) by gradient ascent on the conditional log-likelihood, all stretches of the chains at once."""
    import numpy as np

    if not chains or len({y for _, ys in chains for y in ys}) < 2:
        return PRIOR
    cut = stretches(chains)
    size, length, k = len(cut), max(len(y) for _, y, _ in cut), len(FEATURES)
    x, y, on = np.zeros((size, length, k)), np.zeros((size, length), int), np.zeros((size, length), bool)
    for i, (f, labels, _) in enumerate(cut):
        x[i, : len(labels)], y[i, : len(labels)], on[i, : len(labels)] = f, labels, True
    w, t = np.array(PRIOR[0]), np.array(PRIOR[1])
    moments = [np.zeros(k), np.zeros(k), np.zeros((2, 2)), np.zeros((2, 2))]
    pairs = on[:, 1:] & on[:, :-1]
    # each chain and both labels weigh alike, so that the more common grade does not set the bias
    weigh = on * np.array([w for _, _, w in cut])[:, None]
    weigh = np.where(y == 1, weigh / max(1e-9, (weigh * (y == 1)).sum()), weigh / max(1e-9, (weigh * (y == 0)).sum())) * on
    for r in range(1, rounds + 1):
        e = np.stack([np.zeros((size, length)), x @ w], -1)
        ahead, behind = np.zeros((size, length, 2)), np.zeros((size, length, 2))
        ahead[:, 0] = e[:, 0]
        for i in range(1, length):
            ahead[:, i] = np.where(on[:, i, None], e[:, i] + np.logaddexp(ahead[:, i - 1, :1] + t[0], ahead[:, i - 1, 1:] + t[1]), ahead[:, i - 1])
        for i in range(length - 2, -1, -1):
            nxt = e[:, i + 1] + behind[:, i + 1]
            behind[:, i] = np.where(on[:, i + 1, None], np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:]), 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
        content = np.exp(ahead[..., 1] + behind[..., 1] - whole)
        gw = (((y - content) * weigh)[..., None] * x).sum((0, 1)) - ridge * w
        gt = np.zeros((2, 2))
        pair_weigh = np.where(pairs, weigh[:, 1:], 0)
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(ahead[:, :-1, a] + t[a, b] + e[:, 1:, b] + behind[:, 1:, b] - whole)
                gt[a, b] = ((((y[:, :-1] == a) & (y[:, 1:] == b)) - p) * pair_weigh).sum() - ridge * t[a, b]
        for v, g, m, s in ((w, gw, 0, 1), (t, gt, 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[s] = 0.99 * moments[s] + 0.01 * g * g
            v += rate * moments[m] / (1 - 0.9**r) / (np.sqrt(moments[s] / (1 - 0.99**r)) + 1e-8)
    return tuple(w.tolist()), tuple(map(tuple, t.tolist()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS):
    """Fit on at most `sample` documents of each grade, the first by a hash of their ids."""
    grades = require(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # which documents: keys only, so that the texts of the sample alone are fetched
    ids = require(docs, "doc_id").join(grades, "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [r for q in (0, 1) for r in ids.where(F.least(F.greatest("quality", F.lit(0)), F.lit(1)) == q).orderBy("h", "doc_id").limit(sample).collect()]
    grade = {r["doc_id"]: r["quality"] for r in chosen}
    if not grade:
        return PRIOR
    # one text for each chosen id, whatever the rows under it
    rows = require(docs, "doc_id", "text").where(F.col("doc_id").isin(list(grade))).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    chains = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        f, _, _ = lines_of((r["text"] or "").encode())
        if f:
            good = int(grade[r["doc_id"]] >= 1)
            chains.append((f, [good and int(not x[FEATURES.index("repeats")]) for x in f]))
    return fit(chains)


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge_text(text: str | None, model) -> tuple:
    """Everything after doc_id in VERDICT, for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    rows, counts, again = lines_of(data)
    repeated = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    w, step = model
    labels = viterbi([sum(a * b for a, b in zip(w, f)) for f in rows], step)
    share = sum(c for c, y in zip(counts, labels) if y) / n if n else 0.0
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), again, repeated, failed, not failed and share >= CONTENT_SHARE, share


def judge(docs: DataFrame, model) -> DataFrame:
    """doc_id and the verdict for every document."""

    def run(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64())
        names = [c.split()[0] for c in VERDICT.split(", ")]
        for b in sliced(batches):
            cols = list(zip(*[judge_text(t, model) for t in b.column(1).to_pylist()])) or [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    return to_python(docs, "doc_id", "text").mapInArrow(run, VERDICT)


def keep_documents(docs: DataFrame, model) -> DataFrame:
    """The documents that stay, all their columns; one pass over the texts."""

    @F.pandas_udf("boolean")
    def stays(text: pd.Series) -> pd.Series:
        return pd.Series([bool(judge_text(t, model)[6]) for t in text], dtype=bool)

    return to_python(docs).where(stays(F.col("text")))
