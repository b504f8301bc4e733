"""Set, limit and grouping operators over results, files and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_of(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def first_wins(results: DataFrame) -> DataFrame:
    """By id, else by link; results with neither go."""
    return first_of(results.withColumn("_k", F.coalesce("id", "link")).where("_k IS NOT NULL"), "_k").drop("_k")


def combined(kept: DataFrame, current: DataFrame) -> DataFrame:
    """What was kept, and the current results of which neither link nor id was."""
    fresh = current.join(kept.select("link"), "link", "left_anti").join(kept.select("id"), "id", "left_anti")
    return kept.unionByName(fresh.select(kept.columns))


def union_modes(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _grouped(results: DataFrame) -> DataFrame:
    capital = F.concat(F.upper(F.substring("source", 1, 1)), F.expr("substring(source, 2)"))
    return results.withColumn("source", capital).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", F.coalesce("id", "link").alias("item")))).alias("r"))


def by_source(results: DataFrame) -> DataFrame:
    return _grouped(results).select("source", "n", F.array_join(F.transform("r", lambda x: x["item"]), ",").alias("items"))


def report_sections(results: DataFrame) -> DataFrame:
    lines = F.transform("r", lambda x: F.concat(F.lit("- "), x["item"]))
    return _grouped(results).select("source", F.concat(F.lit("## "), "source", F.lit("\n"), F.array_join(lines, "\n")).alias("section"))


def tree_report(results: DataFrame, top: int = 10) -> DataFrame:
    first = results.orderBy("ord").limit(top).groupBy().agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("id", "link").alias("item")))).alias("r"))
    return first.select(F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["item"])), "\n").alias("section"))


def files_by_category(files: DataFrame, categories: DataFrame) -> DataFrame:
    joined = files.join(categories, "path", "left").withColumn("category", F.coalesce("category", F.lit("general")))
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def evaluation(cases: DataFrame) -> DataFrame:
    """Means of the metrics; a case without reference has similarity 0."""
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6).alias(c)
    return cases.agg(F.count(F.lit(1)).alias("cases"), *map(mean, ("faithfulness", "relevancy", "similarity", "latency")))


def first_per(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def within_budget(docs: DataFrame, key: str, order: str, budget: int, least: int) -> DataFrame:
    """Texts in order while characters remain, each cut to what remains but to no less than `least`."""
    lengths = docs.select(key, order, F.length("text").cast("long").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = lengths.withColumn("_before", before).where(F.col("_before") < budget).drop("_n")
    return docs.join(chosen, [key, order]).withColumn("snippet", F.substr("text", F.lit(1), F.greatest(F.lit(least).cast("long"), F.lit(budget) - F.col("_before")).cast("int")))


def last_turns(turns: DataFrame, n: int = 4) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = turns.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n)
    line = F.concat(F.upper("role"), F.lit(": "), "text")
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def capped(texts: Column, n: int, chars: int) -> Column:
    return F.array_join(F.transform(F.slice(texts, 1, n), lambda x: F.substring(x, 1, chars)), "\n---\n")


def largest_json(c: Column) -> Column:
    """The widest {...} or [...] slice of a reply."""
    return F.regexp_extract(c, r"(?s)[{\[].*[}\]]", 0)


def parsed_flag(c: Column, field: str) -> Column:
    """A boolean field of a reply's JSON; true where it cannot be read."""
    return F.coalesce(F.get_json_object(F.regexp_extract(c, r"(?s)\{.*\}", 0), f"$.{field}").cast("boolean"), F.lit(True))


def conversation_list(turns: DataFrame) -> DataFrame:
    """Turns, last turn and title (first message, 40 characters) of each conversation."""
    first = F.when(F.col("turn") == 0, F.concat(F.substring("text", 1, 40), F.when(F.length("text") > 40, F.lit("...")).otherwise(F.lit(""))))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"), F.min(first).alias("title"))
