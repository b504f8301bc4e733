"""Files as tables: discovery, hashes and change tracking; tables and reading order of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

# Endings that discovery (case-sensitive) and the background scan (any case) take, and loaders by ending.
DISCOVERED = (".txt", ".pdf", ".docx", ".md")
SCANNED = (".txt", ".md", ".pdf", ".docx", ".doc", ".html", ".htm", ".png", ".jpg", ".jpeg", ".bmp", ".tiff")
LOADERS = {"pdf": ("pdf",), "docx": ("docx", "doc"), "html": ("html", "htm"), "text": ("txt", "md"), "image": ("png", "jpg", "jpeg", "bmp", "tiff")}


def _ends(path: Column, endings) -> Column:
    return path.rlike("(?:" + "|".join(e.replace(".", "[.]") for e in endings) + ")$")


def discovered(files: DataFrame) -> DataFrame:
    return files.where(_ends(F.col("path"), DISCOVERED))


def loader(path: Column) -> Column:
    ending, out = F.lower(F.regexp_extract(path, r"[.]([^./]*)$", 1)), F.lit("default")
    for name, endings in LOADERS.items():
        out = F.when(ending.isin(*endings), F.lit(name)).otherwise(out)
    return out


def to_ingest(files: DataFrame, status: DataFrame, tracker: DataFrame) -> DataFrame:
    """Scanned files without a live or finished status and with a hash not on record."""
    busy = status.where(F.col("status").isin("pending", "processing", "done")).select("path")
    return dirty(files.where(_ends(F.lower("path"), SCANNED)).join(busy, "path", "left_anti"), tracker)


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col("text"), 256)).drop("text")


def changed(now: DataFrame, tracker: DataFrame) -> DataFrame:
    known = tracker.select("path", F.col("sha256").alias("known"))
    return now.join(known, "path", "left").withColumn("changed", ~F.col("sha256").eqNullSafe(F.col("known"))).drop("known")


def dirty(now: DataFrame, tracker: DataFrame, force: bool = False) -> DataFrame:
    return now if force else now.join(tracker.select("path", "sha256"), ["path", "sha256"], "left_anti")


def to_regenerate(now: DataFrame, tracker: DataFrame, guardrails: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Clean files of the categories whose guardrails changed."""
    moved = guardrails if force else guardrails.join(known, ["category", "sha256"], "left_anti")
    return now.join(tracker.select("path", "sha256"), ["path", "sha256"], "left_semi").join(moved.select("category").distinct(), "category", "left_semi")


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a Markdown table; nulls are empty cells, a rule follows the first row."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, 0), lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))), "\n")).otherwise(F.lit(""))


def reading_order(words: DataFrame) -> DataFrame:
    """page, text: words(page, top, x0, text) sorted by bands of five points, broken into lines, each line by x0."""
    band = F.bround(F.col("top") / 5) * 5
    by_page = Window.partitionBy("page").orderBy("band", "x0", "text")
    # a line goes on while the word is within five points of the one before
    gap = F.abs(F.col("top") - F.lag("top").over(by_page)) > 5
    lined = words.withColumn("band", band).withColumn("line", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(by_page))
    per_line = lined.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("words"))
    return per_line.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "words"))), lambda w: w["words"]), "\n").alias("text"))


def scan(spark, root: str) -> DataFrame:
    """path, content, sha256 of a folder's files, recursively."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "content", F.sha2("content", 256).alias("sha256"))


def load_text(files: DataFrame) -> DataFrame:
    return files.select("path", F.decode("content", "UTF-8").alias("text"), X.title(F.col("path")).alias("title"), X.category(F.col("path")).alias("category"))
