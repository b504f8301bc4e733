"""Web backends over a transport: a table of results(ord, link, title) that answers every query; offline, pages stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

# The definitions' query and what a term keeps, the suffix of an encyclopaedia's titles.
DEFINITION, PER_TERM = " definition meaning", 2
HOST, SUFFIX = "wikipedia.org", " - Wikipedia"


def stub_transport(pages: DataFrame) -> DataFrame:
    """ord, link, title: every third page is an encyclopaedia's, some of them twice."""
    third = F.col("page_id") % 3 == 0
    link = F.when(third, F.concat(F.lit(f"https://en.{HOST}/wiki/P"), (F.col("page_id") % 50).cast("string"))).otherwise(F.col("url"))
    return pages.select(F.col("page_id").alias("ord"), link.alias("link"), F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.when(third, F.lit(SUFFIX)).otherwise(F.lit(""))).alias("title"))


def _slot(c: Column) -> Column:
    return F.pmod(c, F.lit(7))


def answered(queries: DataFrame, transport: DataFrame) -> DataFrame:
    """queries(query, ...) with the results that the stub gives each: those in its slot of seven."""
    return queries.withColumn("slot", _slot(F.length("query"))).join(transport.withColumn("slot", _slot(F.col("ord")).cast("int")), "slot").drop("slot")


def wikipedia(transport: DataFrame) -> DataFrame:
    """ord, link, title of the encyclopaedia's results, first of each link, without the suffix."""
    first = Window.partitionBy("link").orderBy("ord")
    kept = transport.where(F.contains("link", F.lit(HOST))).withColumn("r", F.row_number().over(first)).where("r = 1")
    return kept.select("ord", "link", F.regexp_replace("title", f"{SUFFIX}$", "").alias("title"))


def definitions(terms: DataFrame, transport: DataFrame) -> DataFrame:
    """term, query, ord, link: the first results of each term's query."""
    asked = terms.withColumn("query", F.concat("term", F.lit(DEFINITION)))
    ranked = answered(asked, transport).withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("ord")))
    return ranked.where(F.col("r") <= PER_TERM).select("term", "query", "ord", "link")


def downloads(links: DataFrame, held: DataFrame, key: str = "file_name") -> DataFrame:
    """links(url, ...) with file_name (made safe) and status: exists where held(key) has the link's key already, else downloaded.

    By file name two links to one url are one file; by a key of their own each is fetched for itself.
    """
    named = links.withColumn("file_name", F.concat(X.safe_file_name(F.col("url")), F.lit(".html")))
    return named.join(held.select(key).distinct().withColumn("known", F.lit(True)), key, "left").withColumn("status", F.when(F.col("known"), "exists").otherwise("downloaded")).drop("known")
