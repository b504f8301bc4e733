"""Exact duplicates against a dictionary of texts; the filters against their promise."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafind.llm import fuse_dedup
from stratafind.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, digest string, n long, kept string, part int"


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out, stays = Counter(), set()
    for i, t in rows:
        t = t or ""
        first = i == keep[t] and t not in stays
        stays |= {t} if first else set()
        out[i, keep[t], len(groups[t]), first, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def found(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)
    return Counter(tuple(r) for r in fuse_dedup.deduplicate(frame, **how).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 50_000])
def test_filter_holds_all_members_and_few_others(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    f = fuse_dedup.FuseFilter.of(keys)
    assert f.passes(keys).all()
    assert f.passes(r.integers(0, 2**64, 200_000, dtype=np.uint64)).mean() < 2e-4
    assert n < 50_000 or len(f.slots) < 1.3 * n


ROWS = [(1, None), (2, ""), (3, " "), (None, "no id"), (None, "no id"), (None, "one id"), (4, "one id"), (5, "long " * 50_000), (6, "long " * 50_000), (7, "twice"), (7, "twice"), (7, "other text, same id"), (8, "É"), (9, "é"), (10, "é")] + [(100 + k, "hot") for k in range(300)]


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_odd_rows(spark, batches):
    assert found(spark, ROWS, batches=batches) == plain(ROWS)


def test_empty_table(spark):
    assert not found(spark, [])


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark):
    rows = ROWS + [(1000 + k, f"text {k % 150}") for k in range(400)]
    weak = lambda counts: Counter((*row[:4], row[4][:2]) for row in counts.elements())
    assert weak(found(spark, rows, batches=3, digest=lambda t: F.substring(F.sha2(t, 256), 1, 2))) == weak(plain(rows))


def test_small_filters_and_deals(spark, monkeypatch):
    monkeypatch.setattr(fuse_dedup, "FILTER_KEYS", 50)
    monkeypatch.setattr(fuse_dedup, "ARRIVALS", 20)
    rows = [(k, f"text {k % 700}") for k in range(1500)]
    assert found(spark, rows, batches=3) == plain(rows)


def test_only_positives_reach_the_buckets(spark):
    rows = [(k, f"text {k}") for k in range(2000)]
    frame = fuse_dedup.digested(spark.createDataFrame(rows, "doc_id long, text string"))
    first, _ = fuse_dedup.ingest(frame.where("doc_id < 1000"), [])
    arrivals = frame.where("doc_id >= 990").groupBy("digest").count()
    passed = {r["digest"] for r in fuse_dedup.screened(arrivals, first, 1010).collect()}
    held = {hashlib.sha256(f"text {k}".encode()).hexdigest() for k in range(990, 1000)}
    assert held <= passed and len(passed) < len(held) + 3
    first.drop()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op12_fuse_dedup"](spark, sf).collect()) == plain(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]
