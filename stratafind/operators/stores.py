"""Kept indexes: postings, summaries and the graph as tables in a folder; clearing and checking them. Vectors: ivf.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..common import delete, exists
from . import retrieval
from .buckets import BUCKETS, BucketTable


class SparseIndex:
    """BM25 postings and corpus figures under a folder."""

    def __init__(self, postings: DataFrame, stats: DataFrame):
        self.postings, self.stats = postings, stats

    @classmethod
    def build(cls, docs: DataFrame) -> SparseIndex:
        return cls(retrieval.bm25_index(docs), retrieval.bm25_stats(docs))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SparseIndex:
        return cls(*retrieval.load_bm25(spark, path))

    def write(self, path: str) -> None:
        self.postings.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    def query(self, queries: DataFrame, top: int = 10) -> DataFrame:
        return retrieval.bm25_search(self.postings, self.stats, queries, top)


class SummaryIndex:
    """A flat list of summaries in the order of their insertion; a query gets the first ones."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def build(cls, summaries: DataFrame) -> SummaryIndex:
        """summaries(id, insert_ord, text)."""
        return cls(summaries.select("id", "insert_ord", "text"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SummaryIndex:
        return cls(spark.read.parquet(f"{path}/summaries"))

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/summaries")

    def query(self, queries: DataFrame, top: int = 2) -> DataFrame:
        """query_id, rank, id, text: the same `top` summaries for every query."""
        first = self.table.orderBy("insert_ord").limit(top)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("insert_ord")) - 1)
        # at most `top` rows
        return queries.select("query_id").crossJoin(F.broadcast(ranked.select("rank", "id", "text")))


class GraphStore:
    """Nodes and edges as bucketed tables under a folder; upserts replace by id in the buckets they touch, edges without an end
    are dropped, nodes without id get one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self._nodes = BucketTable(spark, f"{path}/nodes", "id", buckets)
        self._edges = BucketTable(spark, f"{path}/edges", "edge_id", buckets)

    def upsert_nodes(self, nodes: DataFrame) -> None:
        """nodes(id, name, type): a null id becomes one made of the name and type, the same in a repeated run."""
        made = F.sha2(F.concat_ws("|", F.lit("node"), "name", "type"), 256)
        self._nodes.merge(nodes.withColumn("id", F.coalesce("id", made)))

    def upsert_edges(self, edges: DataFrame) -> None:
        """edges(src, relation, dst)."""
        kept = edges.where("src IS NOT NULL AND dst IS NOT NULL").withColumn("edge_id", F.concat_ws("|", "src", "relation", "dst"))
        self._edges.merge(kept)

    def nodes(self) -> DataFrame:
        return self._nodes.read()

    def edges(self) -> DataFrame:
        return self._edges.read()


def clear(spark: SparkSession, path: str) -> bool:
    """Remove everything kept under a folder; whether there was anything."""
    was = exists(spark, path)
    if was:
        delete(spark, path)
    return was


def checked(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """name, reachable, rows of tables; one that cannot be read is not reachable."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.lit(True).alias("reachable"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def reachable(spark: SparkSession, path: str) -> bool:
    return exists(spark, path)
