"""File parsers on odd files, providers, kept stores, the service's calls and the command line."""

import json
import zlib

from stratafind import __main__ as cli, api, progress
from stratafind.operators import stores
from stratafind.sources import documents as D

SF = "/root/testdata/sf0.001"


def test_pdf_text_operators():
    content = b"BT 14 TL 1 0 0 1 50 700 Tm [(Sp) -300 (lit \\(ed\\)) 20 (!)] TJ T* (next \\351\\n) Tj 0 -14 Td <48656C6C6F> Tj (x) ' ET"
    assert D.in_order(D.placed(content)) == "Sp lit (ed)!\nnext é\nHello\nx"
    assert D.in_order([(10.0, 90.0, "b"), (12.0, 5.0, "a"), (30.0, 0.0, "c")]) == "a b\nc"


def test_pdf_files(spark):
    broken = D.as_pdf(["one", "two"]).replace(zlib.compress(b""), b"")
    pictured = D.as_pdf([]).replace(b"/Type /Page /Parent", b"/Type /Page /XObject << /Image 9 0 R >> /Parent")
    rows = [("a", D.as_pdf([f"line {i}" for i in range(95)])), ("b", b""), ("c", b"%PDF-1.4 nonsense"), ("d", None), ("e", pictured), ("f", broken)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {(r["path"], r["page_number"]): r for r in D.load_pdf(df, lambda data, n: f"seen {n}").collect()}
    assert [k for k in sorted(got) if k[0] == "a"] == [("a", 1), ("a", 2), ("a", 3)] and got["a", 3]["text"].startswith("[Page 3]\nline 80\n") and got["a", 1]["total_pages"] == 3
    assert got["e", 1]["text"] == "[Page 1]\nseen 1" and got["e", 1]["used_ocr"] and got["f", 1]["text"] == "[Page 1]\none\ntwo" and not [k for k in got if k[0] in "bcd"]
    assert D.load_pdf(df.limit(0)).collect() == []


def test_word_file(spark):
    data = D.as_docx([("text", "before"), ("heading", "One & two"), ("text", "a < b"), ("table", [["h", "i"], ["1", ""]]), ("heading", "Three")])
    got = [tuple(r) for r in D.load_docx(spark.createDataFrame([("w", data)], "path string, content binary")).orderBy("ord").collect()]
    assert got == [("w", 0, "", "One & two|Three", "before"), ("w", 1, "One & two", "One & two|Three", "a < b\n[TABLE]\n| h | i |\n| --- | --- |\n| 1 |  |\n[/TABLE]"), ("w", 2, "Three", "One & two|Three", "")]


def test_graph_store(spark, tmp_path):
    store = stores.GraphStore(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([("a", "A", "T"), (None, "B", "T"), (None, "B", "T")], "id string, name string, type string")
    for _ in range(2):
        store.upsert_nodes(nodes)
        store.upsert_edges(spark.createDataFrame([("a", "R", "b"), ("a", "R", None), ("a", "R", "b")], "src string, relation string, dst string"))
    assert store.nodes().count() == 2 and [tuple(r)[:3] for r in store.edges().select("src", "relation", "dst").collect()] == [("a", "R", "b")]
    assert stores.clear(spark, str(tmp_path / "g")) and not stores.clear(spark, str(tmp_path / "g"))


def test_service(spark, tmp_path, capsys):
    assert api.health(spark, SF)["status"] == "ok" and len(api.suggestions(spark, SF)) == 4
    assert api.title(spark, "x" * 50) == "x" * 40 + "..." and api.plan(spark, "hello there")["is_generic"]
    events = list(api.chat_stream(spark, SF, 0))
    assert json.loads(events[0][6:])["type"] == "status" and json.loads(events[-1][6:])["type"] == "done"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("some text")
    table = str(tmp_path / "table")
    assert api.ingest_trigger(spark, str(tmp_path / "in"), table) == 1 and api.ingest_trigger(spark, str(tmp_path / "in"), table) == 0
    assert api.ingest_status(spark, table).count() == 1
    assert cli.main(["list"]) == 0 and "ret_hybrid" in capsys.readouterr().out
    assert cli.main(["run", "adm_check", SF], spark) == 0 and cli.main(["clear", table], spark) == 0


def test_progress(spark):
    df, seen = progress.observed(spark.range(7), "count")
    df.write.format("noop").mode("overwrite").save()
    told = []
    progress.report(seen, "count", lambda step, rows: told.append((step, rows)))
    assert told == [("count", 7)]
