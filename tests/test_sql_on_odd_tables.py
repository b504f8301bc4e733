"""Queries against their SQL on small tables whose rows tell apart what the test tables do not."""

import collections

import duckdb
import pytest

from stratafind import registry


@pytest.fixture
def agree(spark, tmp_path):
    def run(name, table, sql):
        con = duckdb.connect()
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        con.execute("SET threads = 1")
        df, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLE[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        held = lambda names, data: collections.Counter(tuple(str(r[names.index(c)]) for c in columns) for r in data)
        assert held(df.columns, [tuple(r) for r in df.collect()]) == held(want.columns, want.fetchall())

    return run


TEXTS = "SELECT * FROM (VALUES (1, '0997 first' || chr(10) || ' 1232 second 1 ' || chr(10) || '2 third 2', 'de', 's1', 30), (2, '0' || chr(10) || '  1 ', 'fr', 's2', 5)) d(doc_id, text, lang, source, n_chars)"


@pytest.mark.parametrize("name", ["src_pdf", "src_docx"])
def test_lines_keep_digits_that_equal_their_place(agree, name):
    agree(name, "documents", TEXTS)


def test_page_whose_url_another_page_holds_is_downloaded(agree):
    agree("src_download", "pages", "SELECT * FROM (VALUES (4, 'http://a/b'), (5, 'http://a/b'), (6, 'http://a/c'), (8, 'http://a/c')) p(page_id, url)")


def test_first_row_of_equal_order_gives_the_type(agree):
    agree("kg_build", "lineitem", "SELECT 1 AS l_orderkey, 1 AS l_linenumber, 7 + i % 3 AS l_partkey, CASE WHEN i < 3 THEN 'R' ELSE 'A' END AS l_returnflag, 'O' AS l_linestatus FROM range(9) r(i)")
