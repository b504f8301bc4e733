"""Extractors of relations from chunks: a list of them reads a chunk once, and providers that are no columns run in workers.

An extractor gives an array of one struct type for a chunk, so that all of a list stand side by side in one projection and are
inlined together: however many there are, the chunks are scanned once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..providers import Model

PATH = "array<struct<extractor:string,ord:int,subject:string,relation:string,object:string>>"
Extractor = Callable[[DataFrame], Column]


def _named(name: str, made: Column) -> Column:
    return F.transform(made, lambda x, i: F.struct(F.lit(name).alias("extractor"), (i + F.lit(1)).cast("int").alias("ord"), x["subject"].alias("subject"), x["relation"].alias("relation"), x["object"].alias("object"))).cast(PATH)


def schema(model: Model, relations: list[str] | None = None) -> Extractor:
    """The model's triplets; with relations, only those of a declared kind."""

    def of(chunks: DataFrame) -> Column:
        made = model.triplets(chunks["text"])
        return _named("schema", made if relations is None else F.filter(made, lambda x: x["relation"].isin(*relations)))

    return of


def free_form(model: Model) -> Extractor:
    return lambda chunks: _named("free_form", model.pairs(chunks["text"]))


def implicit(chunks: DataFrame) -> Column:
    """SOURCE, NEXT and PREVIOUS of a chunk, where there are such: chunks have doc, before and next."""
    path = lambda kind, to: F.struct(chunks["chunk"].alias("subject"), F.lit(kind).alias("relation"), chunks[to].alias("object"))
    return _named("implicit", F.filter(F.array(path("SOURCE", "doc"), path("NEXT", "next"), path("PREVIOUS", "before")), lambda x: x["object"].isNotNull()))


def listed(model: Model, guarded: bool, with_free_form: bool = False, relations: list[str] | None = None) -> list[Extractor]:
    """With guardrails the schema's extractor, and the free one if asked for; without them the free one; the implicit one always."""
    return [*([schema(model, relations)] if guarded else []), *([free_form(model)] if with_free_form or not guarded else []), implicit]


def extracted(chunks: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """chunk, extractor, ord, subject, relation, object of chunks(doc, chunk, ord, text); null texts give what stands outside them."""
    by = Window.partitionBy("doc").orderBy("ord")
    placed = chunks.select("doc", "chunk", F.coalesce("text", F.lit("")).alias("text"), F.lead("chunk").over(by).alias("next"), F.lag("chunk").over(by).alias("before"))
    return placed.select("chunk", F.inline(F.flatten(F.array(*[e(placed) for e in extractors]))))


# ---- providers in workers


class Worker(Protocol):
    """What a provider is in a worker: load() comes once a worker process, before the first batch."""

    def load(self) -> None: ...
    def triplets(self, texts: list[str]) -> list[list[tuple[str, str, str]]]: ...


_loaded: dict[str, Worker] = {}


def in_workers(chunks: DataFrame, provider: Worker, name: str, batch: int = 64, tries: int = 3) -> tuple[DataFrame, object]:
    """chunk, ord, subject, relation, object, error of chunks(chunk, text); and a counter of calls that failed.

    The provider is broadcast once and loaded once a worker process. A call takes `batch` texts and is made again where it
    raises; after `tries` of them its chunks come as rows with the error, so that none is lost. Failed calls are counted as they
    happen; a task that runs again counts again.
    """
    sc = chunks.sparkSession.sparkContext
    # by value, so that a class of a script or a notebook goes along
    sent, failed = sc.broadcast(cloudpickle.dumps(provider)), sc.accumulator(0)

    def run(frames):
        import pandas as pd

        if name not in _loaded:
            _loaded[name] = cloudpickle.loads(sent.value)
            _loaded[name].load()
        for frame in frames:
            rows: list = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                for turn in range(tries):
                    try:
                        answers, error = _loaded[name].triplets([t or "" for t in part["text"]]), None
                        break
                    except Exception as e:  # whatever it is: the call is made again, or its rows say why not
                        failed.add(1)
                        answers, error = [[]] * len(part), str(e)
                for chunk, found in zip(part["chunk"].tolist(), answers):
                    rows += [(chunk, None, None, None, None, error)] if error else [(chunk, k, *x, None) for k, x in enumerate(found, 1)]
            made = pd.DataFrame(rows, columns=["chunk", "ord", "subject", "relation", "object", "error"], dtype=object)
            yield made.astype({"ord": "Int32"})

    kind = dict(chunks.dtypes)["chunk"]
    return chunks.select("chunk", "text").mapInPandas(run, f"chunk {kind}, ord int, subject string, relation string, object string, error string"), failed
