"""The service's calls as functions: health, suggestions, answers, titles, ingestion. A server needs only to map them to paths."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import registry
from .plans import agent
from .streaming import ingest


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a result that is small by its own limit."""
    return [r.asDict(recursive=True) for r in df.collect()]


def health(spark: SparkSession, data: str) -> dict:
    return {"status": "ok", "tables": _rows(registry.QUERIES["adm_check"](spark, data))}


def suggestions(spark: SparkSession, data: str) -> list[str]:
    """Four questions about the best connected entities."""
    return [r["suggestion"] for r in registry.QUERIES["ret_suggest"](spark, data).collect()]


def title(spark: SparkSession, message: str) -> str:
    return spark.createDataFrame([(message,)], "m string").select(agent.conversation_title(F.col("m"))).first()[0]


def plan(spark: SparkSession, question: str) -> dict:
    return spark.createDataFrame([(question,)], "q string").select(agent.plan(F.col("q")).alias("p")).first()["p"].asDict()


def chat(spark: SparkSession, data: str, query_id: int) -> dict | None:
    """The stated question's answer, after as many corrections as it took."""
    found = _rows(registry.QUERIES["corrective_answer"](spark, data).where(F.col("query_id") == query_id))
    return found[0] if found else None


def chat_stream(spark: SparkSession, data: str, query_id: int) -> Iterator[str]:
    """The same as server-sent events: a status, then the answer."""
    import json

    yield f"data: {json.dumps({'type': 'status', 'message': 'retrieving'})}\n\n"
    yield f"data: {json.dumps({'type': 'done', 'answer': chat(spark, data, query_id)})}\n\n"


def ingest_trigger(spark: SparkSession, root: str, table: str) -> int:
    """Take what is new or changed now; how many files that were."""
    return ingest.ingest_changes(spark, root, table)


def ingest_status(spark: SparkSession, table: str) -> DataFrame:
    return ingest.current(spark, table).select("path", "sha256", "status", "error")
