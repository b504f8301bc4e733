"""The extractor list against the extractors one by one; a provider in workers that fails now and then."""

import re

from pyspark.sql import functions as F

from stratafind import providers as P, registry
from stratafind.operators import extractors as E

SF = "/root/testdata/sf0.001"


def test_a_list_reads_the_chunks_once(spark):
    df = registry.QUERIES["kg_extractors"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bRelation\b", plan)) == 1
    assert {r["extractor"] for r in df.collect()} >= {"schema", "implicit"}


def test_lists(spark):
    rows = [("d", "a", 0, "Ann met bob. Ann Lee sang well"), ("d", "b", 1, None), ("e", "c", 0, "")]
    chunks = spark.createDataFrame(rows, "doc string, chunk string, ord int, text string")
    found = lambda *a, **b: {tuple(r) for r in E.extracted(chunks, E.listed(P.Rules(), *a, **b)).collect()}
    links = {("a", "implicit", 1, "a", "SOURCE", "d"), ("a", "implicit", 2, "a", "NEXT", "b"), ("b", "implicit", 1, "b", "SOURCE", "d"), ("b", "implicit", 2, "b", "PREVIOUS", "a"), ("c", "implicit", 1, "c", "SOURCE", "e")}
    told = {("a", "schema", 1, "Ann", "MET", "bob"), ("a", "schema", 2, "Lee", "SANG", "well")}
    free = {("a", "free_form", 1, "Ann", "RELATED_TO", "Lee")}
    assert found(True) == told | links and found(False) == free | links and found(True, True) == told | free | links
    assert found(True, relations=["SANG"]) == {("a", "schema", 1, "Lee", "SANG", "well")} | links


def shaky():
    """A provider whose class travels with it."""

    class Shaky:
        """Raises on every fifth call, and always on a text that says so."""

        calls = loads = 0

        def load(self):
            type(self).loads += 1
            assert type(self).loads == 1  # once a worker process

        def triplets(self, texts):
            type(self).calls += 1
            if type(self).calls % 5 == 0 or "never" in texts:
                raise TimeoutError("no answer")
            return [[(m[1], m[2].upper(), m[3]) for m in re.finditer(P.TRIPLET, x)][: P.TRIPLETS] for x in texts]

    return Shaky()


def test_a_provider_that_fails_loses_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = docs.select(F.col("doc_id").alias("chunk"), "text").repartition(4)
    found, failed = E.in_workers(chunks, shaky(), "shaky", batch=3)
    got = sorted(tuple(r)[:5] for r in found.where("error IS NULL").collect())
    assert got == sorted(tuple(r) for r in registry.QUERIES["llm_triplets"](spark, SF).select("doc_id", "ord", "subject", "relation", "object").collect())
    assert failed.value > 5
    bad = spark.createDataFrame([(1, "never"), (2, None)], "chunk long, text string").coalesce(1)
    assert {(r["chunk"], r["error"]) for r in E.in_workers(bad, shaky(), "shaky again", batch=1)[0].collect()} == {(1, "no answer")}
