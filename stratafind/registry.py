"""All queries of the engine's own operators, with the SQL they must agree with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register fn(t, spark) under a name; t(table) loads a table of the data set, t.stream(table) reads it as a stream."""

    def add(fn):
        def run(spark, sf_dir):
            def load(table):
                return spark.read.parquet(f"{sf_dir}/{table}.parquet")

            def stream(table, **options):
                # a pattern, as a stream takes no path of a single file
                return spark.readStream.schema(load(table).schema).options(**options).parquet(f"{sf_dir}/{table}.parque[t]")

            load.stream = stream
            return fn(load, spark)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


from . import catalog  # noqa: E402,F401
