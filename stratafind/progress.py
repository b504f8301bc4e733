"""Progress of long jobs: rows counted as they pass, without a second job."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Observation, functions as F


class Progress(Protocol):
    def __call__(self, step: str, rows: int) -> None: ...


def observed(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """The frame, and what it will have counted once it was written; get(observation) waits for that."""
    seen = Observation(step)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def report(seen: Observation, step: str, progress: Progress) -> None:
    progress(step, seen.get["rows"])
