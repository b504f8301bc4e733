"""Queries without SQL against plain Python versions of their rules."""

import re
from collections import Counter, defaultdict

from stratafind import registry
from stratafind.catalog.text import AFTER, BEFORE
from stratafind.functions import text as X
from test_cleaning_long import PLAIN

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def unspaced(t):
    return re.sub(r"\b(?:[A-Za-z] ){2,}[A-Za-z]\b", lambda m: m[0].replace(" ", ""), t, flags=re.A)


def cleaned(t):
    t = re.sub(X.CONTROL, "", t)
    t = unspaced(re.sub(r"(\w+)-\s*\n\s*(\w+)", r"\1\2", t))
    for a, b in X.MARKS:
        t = t.replace(a, b)
    t = PLAIN["no_legal"](PLAIN["no_page_numbers"](t))
    t = PLAIN["no_empty_numbers"](re.sub(X.DRAFT, "", t))
    lines = t.split("\n")
    n = Counter(x.strip() for x in lines if len(x.strip()) > 5)
    t = "\n".join(x for x in lines if n[x.strip()] < 4)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in t.split("\n"))).strip()


def test_cln_spaced(spark):
    want = {d: unspaced(BEFORE + t + AFTER) for d, t in texts(spark).items()}
    assert {r["doc_id"]: r["text"] for r in rows(spark, "cln_spaced")} == want and all("The" in t for t in want.values())


def test_cln_pipeline(spark):
    want = {d: cleaned(BEFORE + t + AFTER) for d, t in texts(spark).items()}
    assert {r["doc_id"]: r["text"] for r in rows(spark, "cln_pipeline")} == want


def test_src_reading_order(spark):
    pages = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        pages[r["l_orderkey"]].append((r["l_extendedprice"], r["l_quantity"], str(r["l_linenumber"])))
    want = {}
    for page, words in pages.items():
        words = sorted(words, key=lambda w: (round(w[0] / 5) * 5, w[1], w[2]))
        lines = [[words[0]]]
        for before, w in zip(words, words[1:]):
            if abs(w[0] - before[0]) > 5:
                lines.append([])
            lines[-1].append(w)
        want[page] = "\n".join(" ".join(t for _, _, t in sorted(line, key=lambda w: (w[1], w[2]))) for line in lines)
    assert {r["page"]: r["text"] for r in rows(spark, "src_reading_order")} == want


def test_fn_json_slice(spark):
    assert all(r["json"] == f'{{"a": {r["item_id"]}}}' and r["flag"] is True for r in rows(spark, "fn_json_slice"))


def test_chunks_hold_their_documents(spark):
    """Parents hold every word of their document in order, within their size; children those of their parent; counts agree."""
    docs, big = texts(spark), defaultdict(list)
    for r in rows(spark, "chk_recursive"):
        big[r["doc_id"]].append(r)
    for d, t in docs.items():
        words = lambda x: re.findall(r"\w+", x or "")
        missing = Counter(words(t)) - Counter(w for r in big[d] for w in words(r["text"]))
        heads = Counter(w for r in big[d] for w in words(r["section_title"]))
        assert not missing - heads and sorted(r["ord"] for r in big[d]) == list(range(len(big[d])))
        assert len({r["chunk_id"] for r in big[d]}) == len(big[d])
    assert {r["doc_id"]: r["n_chunks"] for r in rows(spark, "inc_insert_pass")} == {d: len(r) for d, r in big.items() if r}
    children = defaultdict(list)
    for r in rows(spark, "chk_children"):
        children[r["parent_id"]].append(r["text"])
    for parts in big.values():
        for r in parts:
            held = Counter(w for c in children[r["chunk_id"]] for w in re.findall(r"\w+", c))
            assert not Counter(re.findall(r"\w+", r["text"])) - held
