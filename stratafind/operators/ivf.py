"""An inverted-file index of dense vectors, searched exactly.

Centroids are fitted on a bounded sample of unit vectors; every vector goes to the list of its nearest centroid and is stored
with its distance to it. For unit vectors a higher cosine is a smaller distance, and distances obey the triangle inequality: a
member x of the list of c is no nearer to a query q than |d(q,c) - d(x,c)|, and no member is nearer than d(q,c) - radius. A
query first reads its nearest lists, until they hold enough members; the k-th best of those bounds what is still to be
looked for, and only lists, and of these only members, that the bound does not rule out are read after that. So the answer is
that of a scan, whatever the centroids are, and more vectors are appended without fitting anew.

Lists are Parquet folders by list number. The centroids, of LISTS at most, are what tasks and the driver hold whole; radii are
counted with each append. Vectors of length zero, or of another length than the centroids', go to list -1, which every query
reads. Rows without id or vector are left out.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..common import BROADCAST_ROWS, delete, exists
from ..functions import text as X

#: Lists at most, and vectors the centroids are fitted on; LLOYD rounds of that.
LISTS, SAMPLE, LLOYD = 1024, 16_384, 8
#: Slack for rounding in distances.
SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _sample(held: DataFrame, n: int) -> DataFrame:
    """v of the SAMPLE rows of n whose hash is smallest.

    An ordered limit would send that many rows of each partition to the driver, so that most of a table passed through it. Rows
    over a bound of the hash, which leaves a little more than SAMPLE, are out beforehand, and one task picks among the others.
    """
    rows, share = held.select("vec_id", F.xxhash64("vec_id").alias("h"), F.col("embedding").cast("array<double>").alias("v")), 1.1 * SAMPLE
    near = rows
    while share < n:
        near = rows.where(F.col("h") < F.lit(int(2**64 * (share / n)) - 2**63))
        if near.count() >= SAMPLE:
            break
        near, share = rows, 2 * share
    return near.repartition(1).sortWithinPartitions("h", "vec_id").limit(SAMPLE).select("v")


def fitted(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Centroids by Lloyd's rounds on the SAMPLE rows whose hash is smallest; the square root of the rows, LISTS at most."""
    held = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    n = held.count()
    rows = _sample(held, n).collect()
    if not rows:
        return np.zeros((0, 0))
    dim = max({len(r["v"]) for r in rows}, key=lambda d: (sum(len(r["v"]) == d for r in rows), d))
    v = _unit(np.array([r["v"] for r in rows if len(r["v"]) == dim], float))
    v = v[np.linalg.norm(v, axis=1) > 0]
    k = min(len(v), lists or min(LISTS, max(1, math.isqrt(n))))
    c = v[np.linspace(0, len(v) - 1, k).astype(int)] if k else np.zeros((0, dim))
    for _ in range(LLOYD if k else 0):
        at = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        moved = _unit(sums)
        c = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, c)
    return c


class InvertedFile:
    """Vectors under a folder: build, append, read, query."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
        self.centroids = np.array([r["c"] for r in rows], float).reshape(len(rows), len(rows[0]["c"]) if rows else 0)
        kind = spark.read.parquet(f"{path}/kinds").first()
        self.schema = f"id {kind['id']}, embedding {kind['embedding']}, gap double, list int"

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> InvertedFile:
        spark, c = vectors.sparkSession, fitted(vectors, lists)
        if exists(spark, path):
            delete(spark, path)
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "list int, c array<double>").write.parquet(f"{path}/centroids")
        kinds = dict(vectors.dtypes)
        spark.createDataFrame([(kinds["vec_id"], kinds["embedding"])], "id string, embedding string").write.parquet(f"{path}/kinds")
        index = cls(spark, path)
        index.append(vectors)
        return index

    def append(self, vectors: DataFrame) -> None:
        """Into the lists of the centroids there are; other lists' files stay as they are."""
        c = self.centroids

        def place(batches):
            import pyarrow as pa

            for b in batches:
                rows = b.column(1).to_pylist()
                lists, gaps = np.full(len(rows), -1), np.zeros(len(rows))
                fit = [i for i, v in enumerate(rows) if len(v) == c.shape[1] and any(v)] if len(c) else []
                if fit:
                    d = _distances(_unit(np.array([rows[i] for i in fit], float)), c)
                    lists[fit], gaps[fit] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gaps), pa.array(lists, pa.int32())], names=["id", "embedding", "gap", "list"])

        placed = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding").mapInArrow(place, self.schema)
        run = f"{self.path}/lists/run={uuid.uuid4().hex}"
        # a long list is split over several files
        placed.hint("rebalance", "list").write.partitionBy("list").parquet(run)
        self.spark.read.schema(self.schema).parquet(run).groupBy("list").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.path}/radii")

    def vectors(self) -> DataFrame:
        """id, embedding, norm, gap, list."""
        held = self.spark.read.schema(self.schema + ", run string").parquet(f"{self.path}/lists")
        return held.withColumn("norm", F.sqrt(X.dot(F.col("embedding"), F.col("embedding")))).drop("run")

    def radii(self) -> dict[int, tuple[float, int]]:
        """list -> radius, members: one row a list."""
        return {r["list"]: (r["radius"], r["n"]) for r in self.spark.read.parquet(f"{self.path}/radii").groupBy("list").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()}

    def _visits(self, queries: DataFrame, first: bool, top: int) -> DataFrame:
        """query_id, q, bound, list, dq: the lists a query reads first, or those that remain under its bound."""
        c, held = self.centroids, self.radii()
        radius = np.array([held.get(i, (-1.0, 0))[0] for i in range(len(c))])
        members = np.array([held.get(i, (0.0, 0))[1] for i in range(len(c))])
        rest = -1 in held

        def choose(batches):
            import pyarrow as pa

            for b in batches:
                out: list = [[], [], []]
                for i, (q, bound) in enumerate(zip(b.column("q").to_pylist(), b.column("bound").to_pylist())):
                    fits = len(c) and q is not None and len(q) == c.shape[1] and any(q)
                    d = _distances(_unit(np.array([q], float)), c)[0] if fits else np.zeros(len(c))
                    order = np.argsort(d - radius, kind="stable")
                    order = order[members[order] > 0]
                    enough = int(np.searchsorted(np.cumsum(members[order]), top)) + 1
                    if not fits:  # no bound is known: everything, at once
                        chosen = order if first else order[:0]
                    elif first:
                        chosen = order[:enough]
                    else:
                        later = order[enough:]
                        chosen = later if bound is None else later[(d - radius)[later] <= bound + SLACK]
                    for x in [*([-1] if rest and first else []), *chosen.tolist()]:
                        for column, y in zip(out, (i, x, float(d[x]) if x >= 0 and fits else 0.0)):
                            column.append(y)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(k).take(at) for k in range(3)] + [pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], names=["query_id", "q", "bound", "list", "dq"])

        kinds = dict(queries.dtypes)
        return queries.select("query_id", "q", "bound").mapInArrow(choose, f"query_id {kinds['query_id']}, q {kinds['q']}, bound double, list int, dq double")

    def _scored(self, visits: DataFrame, small: bool) -> DataFrame:
        """query_id, id, score of the visited lists' members that the bound leaves."""
        visits = F.broadcast(visits) if small else visits
        n = F.col("norm") * F.sqrt(X.dot(F.col("q"), F.col("q")))
        met = self.vectors().join(visits, "list").where((F.col("list") < 0) | F.col("bound").isNull() | (F.abs(F.col("dq") - F.col("gap")) <= F.col("bound") + SLACK))
        return met.select("query_id", "id", F.round(F.when(n == 0, F.lit(0.0)).otherwise(X.dot(F.col("embedding"), F.col("q")) / n), 9).alias("score"))

    def query(self, queries: DataFrame, top: int = 5) -> DataFrame:
        """query_id, id, score (cosine), rank for queries(query_id, q), as a scan gives them."""
        asked = queries.select("query_id", "q", F.lit(None).cast("double").alias("bound"))
        best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= top).withColumn("rank", F.col("rank") - 1)
        # visits are broadcast where the queries are few enough to be, times the lists that they can visit
        small = queries.limit(BROADCAST_ROWS + 1).count() * (len(self.centroids) + 1) <= 10 * BROADCAST_ROWS
        first = best(self._scored(self._visits(asked, True, top), small)).select("query_id", "id", "score")
        # the distance of the k-th best, to half a unit of the scores' last digit
        kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= top, F.sqrt(F.greatest(2 - 2 * (F.min("score") - 1e-9), F.lit(0.0)))).alias("bound"))
        left = queries.select("query_id", "q").join(kth, "query_id", "left")
        return best(first.unionByName(self._scored(self._visits(left, False, top), small))).select("query_id", "id", "score", "rank")

    def reads(self, queries: DataFrame, top: int = 5) -> DataFrame:
        """query_id, lists_read, lists: how much of the index each query's answer took."""
        found = self.query(queries, top).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= top, F.sqrt(F.greatest(2 - 2 * (F.min("score") - 1e-9), F.lit(0.0)))).alias("bound"))
        asked = queries.select("query_id", "q").join(found, "query_id", "left")
        both = self._visits(asked.withColumn("bound", F.lit(None).cast("double")), True, top).unionByName(self._visits(asked, False, top))
        return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("lists_read")).withColumn("lists", F.lit(len(self.radii())).cast("long"))
