"""Cleaning of whole documents; every step is its own projection, so that no expression is evaluated once per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X


def without_repeated_lines(docs: DataFrame, least: int = X.REPEATED_LINES, longer: int = X.REPEATED_LENGTH) -> DataFrame:
    """Lines of more than `longer` characters (stripped) that occur `least` times or more in the text go, all of them.

    In sorted order a line is frequent if an equal one stands `least` - 1 places on.
    """
    d = docs.withColumn("_lines", F.split("text", "\n", -1))
    d = d.withColumn("_bare", F.transform("_lines", X.strip))
    d = d.withColumn("_sorted", F.array_sort(F.filter("_bare", lambda x: F.length(x) > longer)))
    d = d.withColumn("_often", F.array_distinct(F.filter("_sorted", lambda x, i: F.get("_sorted", i + F.lit(least - 1)) == x)))
    kept = F.filter("_lines", lambda x, i: ~F.array_contains("_often", F.get("_bare", i)))
    return d.withColumn("text", F.when(F.size("_often") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).drop("_lines", "_bare", "_sorted", "_often")


def cleaned(docs: DataFrame) -> DataFrame:
    """All steps in their fixed order: encoding, artefacts, boilerplate, white space."""
    c = X.plain_marks(X.unspaced(X.dehyphenated(X.no_control(F.col("text")))))
    d = docs.withColumn("text", X.no_empty_numbers(X.no_draft(X.no_legal(X.no_page_numbers(c)))))
    return without_repeated_lines(d).withColumn("text", X.tidy_space(F.col("text")))
