from . import agent, graph, ingestion, providers, retrieval, sources, text  # noqa: F401
