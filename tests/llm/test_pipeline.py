"""Each stage of the pipeline against brute force on what the stage before it kept."""

from collections import Counter

import corpus_pipeline
from stratafind.llm import line_crf
from test_operators import brute_base, brute_similarities, check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], []
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        rows = frame.collect()
        kept.append(rows)
        if name != "packing":
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(rows, docs.schema)
    quality, near, cut, clean, packed = kept
    assert names == ["quality", "near_dedup", "substring_dedup", "secrets", "packing"]

    model = line_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in quality} == {r["doc_id"] for r in docs.collect() if line_crf.judge_text(r["text"], model)[6]}

    text, stay = {r["doc_id"]: r["text"] for r in quality}, {r["doc_id"] for r in near}
    alike = brute_similarities(text.items())
    assert not [p for p, j in alike.items() if j >= 0.86 and stay.issuperset(p)]  # of near copies one stays
    assert all(any(j >= 0.74 for p, j in alike.items() if d in p) for d in text.keys() - stay)  # and nothing else goes
    assert Counter(r["text"] for r in near) == Counter(r["text"] for r in quality if r["doc_id"] in {x["doc_id"] for x in near})

    before = {r["doc_id"]: r["text"] for r in near}
    words = lambda t: t.encode().lower().split()
    windows = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    shared = Counter(x for t in before.values() for x in windows(words(t), 20))
    changed = {r["doc_id"] for r in cut if r["text"] != before[r["doc_id"]]} | set(before) - {r["doc_id"] for r in cut}
    assert changed <= {d for d, t in before.items() if any(shared[x] > 1 for x in windows(words(t), 20))}  # clean documents stay as they are
    left = Counter(x for r in cut for x in windows(words(r["text"]), 60))
    assert not [x for x, n in left.items() if n > 1]  # no long passage stands in two documents any more
    assert all(r["n_chars"] == len(r["text"]) for r in cut if r["doc_id"] in changed)

    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in cut} and not any(brute_base(r["text"]) for r in clean)
    uncut = {r["doc_id"]: r["text"] for r in cut}
    assert all(r["text"] == uncut[r["doc_id"]] for r in clean if "[SECRET]" not in r["text"])

    check_packing(packed, [(r["doc_id"], r["text"]) for r in clean])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
