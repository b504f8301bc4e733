"""Cleaning on long runs: the same results as the plain patterns in Python, and time in proportion."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stratafind.functions import text as X
from stratafind.operators import clean

#: The rules as they are stated, with Python's engine.
PLAIN = {
    "dehyphenated": lambda t: re.sub(r"(\w+)-\s*\n\s*(\w+)", r"\1\2", t),
    "no_page_numbers": lambda t: re.sub(r"(?m)^\s*-\s*\d+\s*-\s*$", "", re.sub(r"(?m)^\s*\d+\s*\|\s*[Pp]\s*a\s*g\s*e\s*$", "", re.sub(r"(?m)^[\-\s]*[Pp]age\s+\d+\s*(of\s+\d+)?[\-\s]*$", "", t))),
    "no_legal": lambda t: re.sub(r"(?i)(confidential|proprietary|all rights reserved|copyright\s+©?\s*\d{4})[^\n]*", "", t),
    "no_empty_numbers": lambda t: re.sub(r"(?m)^\s*(\d+\.)+\s*$", "", t),
    "strip": lambda t: t.strip(),
    "tidy_space": lambda t: re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in t.split("\n"))).strip(),
}


@pytest.mark.parametrize("name", PLAIN)
def test_rules_on_random_texts(spark, name):
    r = random.Random(name)
    bits = ["a", "bc", "é", "-", "\n", "\n", " ", "\t", "1", "12", ".", "1.", "1.2.", "Page ", "page 3", " of 4", "|", "Page", "- 3 -", "copyright ", "©", "2020", "Confidential x", "..", "5 | P a g e"]
    rows = sorted({"".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)})
    got = {x["t"]: x["r"] for x in spark.createDataFrame([(x,) for x in rows], "t string").select("t", getattr(X, name)(F.col("t")).alias("r")).collect()}
    assert {t: got[t] for t in rows if got[t] != PLAIN[name](t)} == {}


@pytest.mark.parametrize("run", ["1.", "a", "a1", "\n", " ", "- ", "copyright ", "a-\n", "\n\n\n", " \t", "Page 1\n", "12 "])
def test_long_runs(spark, run):
    """A million characters of each, with something else behind them."""
    frame = spark.createDataFrame([(1, run * (1_000_000 // len(run)) + "!"), (2, "x " + run * (1_000_000 // len(run)))], "doc_id long, text string")
    began = time.time()
    assert len(clean.cleaned(frame).select(F.length("text")).collect()) == 2
    assert time.time() - began < 40
