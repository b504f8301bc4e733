"""Hand-derived results, properties and edge cases of single functions."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from stratafind.common import against_all
from stratafind.functions import text as X
from stratafind.operators import chunking, clean, files, graph, resolve, retrieval
from stratafind.sources import html
from stratafind.streaming import ingest


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("r")).first()["r"]


def test_cleaning_rules(spark):
    cases = [
        (X.dehyphenated, "en- \nvironment é-\nn", "environment én"), (X.unspaced, "T h e  r e s u l t, a b c d and a b", "The  result, abcd and a b"), (X.plain_marks, "“x”…–—’", '"x"...---\''),
        (X.no_page_numbers, "Page 3 of 12\n[Page 2]\n- 3 -\n12 | P a g e\nx", "\n[Page 2]\n\nx"), (X.no_legal, "X © Copyright © 2020 y\nz", "X © \nz"), (X.no_draft, "drafty DRAFT copy\nz", "drafty \nz"),
        (X.no_empty_numbers, "1.2.\n1.2 a", "\n1.2 a"), (X.tidy_space, " a  \n\n\n\n b \t", "a\n\n b"), (X.titled, "3d o'neil-x", "3D O'Neil-X"), (X.exact_key, " A b\t", "a_b"), (X.safe_topic, "a-b é", "a_b_é"),
    ]
    for fn, value, want in cases:
        assert one(spark, fn, value) == want, (fn, value)


def test_repeated_lines(spark):
    text = "head line\na\n head line \nb\nhead line\nabc\nabc\nabc\nabc\nhead line"
    df = clean.without_repeated_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert [r["text"] for r in df.orderBy("doc_id").collect()] == ["a\nb\nabc\nabc\nabc\nabc", None, ""]


def test_sections():
    assert chunking.split_sections("# Intro\nA\n[Page 2]\nB\n1.2 Background\nC") == [("A", "Intro", 1), ("B", "Intro", 2), ("C", "1.2 Background", 2)]
    assert chunking.split_sections("plain") == [("plain", "Preamble", 1)]


def test_sentence_packing():
    text = " ".join(f"Word{i} goes on here." for i in range(100))
    parts = chunking.pack_sentences(text, 40, 8)
    assert all(chunking.count_tokens(p) <= 40 for p in parts) and parts[1].split()[:8] == parts[0].split()[-8:]
    doc = "# Introduction\n" + "One sentence about it. " * 50 + "\n# Methodology\n" + "Another sentence of it. " * 100 + "\n# Results\n" + "A third kind of sentence. " * 150
    assert all(chunking.count_tokens(c) <= 768 for part, _, _ in chunking.split_sections(doc) for c in chunking.split_big(part))


def test_html():
    title, found = html.read("<html><head><title>T</title><script>no()</script></head><body><nav>menu</nav><p>before</p><h1>One</h1><p>a &amp; b</p><h2>Empty</h2><h3>Three</h3>c<footer>f</footer></body></html>")
    assert title == "T" and found == [(0, "", "before"), (1, "One", "a & b"), (3, "Three", "c")]


def test_reading_order(spark):
    words = spark.createDataFrame([(1, 10.0, 50.0, "b"), (1, 10.4, 5.0, "a"), (1, 30.0, 1.0, "c")], "page int, top double, x0 double, text string")
    assert files.reading_order(words).first()["text"] == "a b\nc"


def test_fusion_ties_keep_first_seen(spark):
    c = spark.createDataFrame([(1, 0, 0, 7), (1, 0, 1, 8), (1, 1, 0, 9), (1, 1, 1, 7)], "query_id int, list_ord int, rank int, id int")
    got = [r["id"] for r in retrieval.fuse(c).orderBy("fused_rank").collect()]
    assert got == [7, 9, 8]


def test_against_all_in_blocks(spark):
    q, r = spark.range(25).withColumnRenamed("id", "q"), spark.range(10)
    assert against_all(q, r, limit=4).distinct().count() == against_all(q, r).distinct().count() == 250


def test_components_and_communities(spark):
    r = random.Random(2)
    groups = [[f"{g}-{i}" for i in range(12)] for g in "abc"]
    pairs = [(x, y) for g in groups for x in g for y in g if x < y and r.random() < 0.6] + [("a-1", "b-1")]
    e = spark.createDataFrame(pairs, "a string, b string")
    comp = {x["node"]: x["component"] for x in graph.components(e).collect()}
    assert set(comp.values()) == {min(groups[0] + groups[1]), min(groups[2])}
    found = defaultdict(set)
    for x in graph.louvain(e).collect():
        found[x["community"]].add(x["node"])
    assert sum(map(len, found.values())) == len(comp)  # a partition
    assert all(len({comp[n] for n in c}) == 1 for c in found.values())  # that crosses no component

    def modularity(parts):
        of = {n: k for k, p in enumerate(parts) for n in p}
        m, deg, inside = len(pairs), defaultdict(int), 0
        for a, b in pairs:
            inside += of[a] == of[b]
            deg[of[a]] += 1
            deg[of[b]] += 1
        return inside / m - sum((d / 2 / m) ** 2 for d in deg.values())

    assert modularity(found.values()) > 0.5 * modularity(groups)


def test_star_clusters_are_not_transitive(spark):
    v = [(0, 1, "", [1.0, 0.0]), (0, 2, "", [0.9, 0.436]), (0, 3, "", [0.62, 0.785])]
    df = spark.createDataFrame(v, "block int, id int, name string, embedding array<double>")
    assert {(r["seed"], r["id"]) for r in resolve.star_clusters(df, 0.85).collect()} == {(1, 2)}


def test_merging_keeps_endpoints(spark):
    e = spark.createDataFrame([("e1", "a", "b", "R", {"x": "1"}), ("e2", "c", "b", "R", {"x": "2", "y": "3"}), ("e3", "a", "c", "R", {}), ("e4", "d", "d", "R", {})], "edge_id string, src string, dst string, rel_type string, props map<string,string>")
    remap = spark.createDataFrame([("c", "a")], "dup string, canon string")
    got = {(r["src"], r["dst"]): (r["edge_id"], r["props"]) for r in graph.move_edges(e, remap).collect()}
    assert got == {("a", "b"): ("e1", {"x": "2", "y": "3"}), ("d", "d"): ("e4", {})}


def test_ingestion(spark, tmp_path):
    root, table = tmp_path / "in" / "My Cat", str(tmp_path / "table")
    root.mkdir(parents=True)
    (root / "one.txt").write_text("draft gone\nkept")
    (root / "two.txt").write_text("second")
    at = f"file://{root.parent}"
    ingest.stream_new(spark, at, table, str(tmp_path / "state")).awaitTermination()
    assert {r["text"] for r in ingest.current(spark, table).collect()} == {"kept", "second"}
    (root / "two.txt").write_text("edited")
    ingest.stream_new(spark, at, table, str(tmp_path / "state")).awaitTermination()
    assert "edited" not in {r["text"] for r in ingest.current(spark, table).collect()}  # a stream takes new paths alone
    assert ingest.ingest_changes(spark, at, table) == 1 and ingest.ingest_changes(spark, at, table) == 0
    assert {r["text"] for r in ingest.current(spark, table).collect()} == {"kept", "edited"}


def test_files_end_in_error_with_a_reason_and_are_tried_again(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = [("./data/a/x.txt", b"One. Two! Three?"), ("./data/a/bad.txt", b"\xff\xfe"), ("./data/b/none.txt", None), ("./data/blank.txt", b" \n")]
    found = lambda rows: spark.createDataFrame(rows, "path string, content binary").withColumn("sha256", F.sha2("content", 256))
    ingest.scan_once(spark, found(rows), table)
    ended = {r["path"]: (r["category"], r["summary"], r["status"], r["error"]) for r in ingest.current(spark, table).collect()}
    assert ended == {
        "./data/a/x.txt": ("a", "One. Two!", "DONE", None), "./data/a/bad.txt": ("a", "", "ERROR", "not UTF-8"), "./data/b/none.txt": ("b", "", "ERROR", "no content"), "./data/blank.txt": ("general", "", "ERROR", "no text"),
    }
    assert {r["path"] for r in ingest.queued(found(rows), ingest.current(spark, table)).collect()} == {p for p, _ in rows[1:]}
    ingest.scan_once(spark, found([("./data/a/x.txt", b"changed"), ("./data/a/bad.txt", b"good")]), table)
    again = {r["path"]: (r["text"], r["status"]) for r in ingest.current(spark, table).collect()}
    assert again["./data/a/x.txt"] == ("One. Two! Three?", "DONE") and again["./data/a/bad.txt"] == ("good", "DONE") and len(again) == 4
