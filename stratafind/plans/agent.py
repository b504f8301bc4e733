"""Planning, routing and grading without a language model: rules that hold where a model fails, as columns.

Providers may replace any of these; each takes and gives columns of the same names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_any, strip

# Words that decide how a query is planned and which texts may hold times.
CONVERSATIONAL = ("hi", "hello", "hey", "howdy", "what's up", "who are you", "what can you do")
GLOBAL = ("main theme", "overall", "summarize", "summary", "overview", "big picture", "across all", "general", "common pattern", "recurring", "high level", "key takeaway", "in general")
GLOBAL_ROUTER = (*GLOBAL, "holistic", "what are the themes", "across documents")
TEMPORAL = ("since", "from", "until", "to", "between", "during", "started", "ended", "joined", "left", "resigned", "appointed", "established", "founded", "dissolved")


def plan(query: Column) -> Column:
    """struct(query_type, tools, is_generic) by the fallback rules."""
    q = F.lower(strip(query))
    words = F.size(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""))
    generic = (words <= 2) | F.exists(F.array(*map(F.lit, CONVERSATIONAL)), lambda w: F.startswith(q, w))
    broad = contains_any(q, GLOBAL)
    pick = lambda a, b, c: F.when(generic, F.lit(a)).when(broad, F.lit(b)).otherwise(F.lit(c))
    return F.struct(
        pick("GENERIC", "GLOBAL", "LOCAL").alias("query_type"),
        pick("community_search,summary_search", "summary_search,community_search,vector_search", "vector_search,graph_search").alias("tools"), generic.alias("is_generic"),
    )


def route(query: Column, proposed: Column) -> Column:
    """An unknown or local type becomes global on a keyword; without a proposal HYBRID."""
    return F.when(proposed.isNull(), F.lit("HYBRID")).when(proposed.isin("UNKNOWN", "LOCAL") & contains_any(F.lower(query), GLOBAL_ROUTER), F.lit("GLOBAL")).otherwise(proposed)


def temporal(text: Column) -> Column:
    """Whether a text may hold times at all: the gate before the provider."""
    return contains_any(F.lower(text), TEMPORAL)


def conversation_title(message: Column) -> Column:
    return F.concat(F.substring(message, 1, 40), F.when(F.length(message) > 40, F.lit("...")).otherwise(F.lit("")))


def lead(text: Column, sentences: int = 2) -> Column:
    """Default summary: the first sentences of the whole text; no more of it is looked at than these take."""
    part = r"[.!?]*+([^.!?]++[.!?])"
    pattern = "^" + part + f"(?:{part})?" * (sentences - 1)
    return F.concat(*[F.regexp_extract(text, pattern, k + 1) for k in range(sentences)])


def grade(context_chars: Column, verdict: Column) -> Column:
    """Relevant unless the context is empty; an unreadable verdict passes."""
    return F.when(F.coalesce(context_chars, F.lit(0)) == 0, F.lit(False)).otherwise(F.coalesce(verdict, F.lit(True)))


def corrective_rounds(graded: DataFrame, limit: int = 2) -> DataFrame:
    """grades and rewrites of the retrieval loop: at most `limit` grades, a rewrite and a new retrieval after the first failure.

    graded(query_id, first, second): whether each try's context was found relevant.
    """
    return graded.select("query_id", F.when(F.col("first"), F.lit(1)).otherwise(F.lit(limit)).alias("grades"), F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1)).alias("rewrites"), (F.col("first") | F.col("second")).alias("relevant"))


def rewrite(query: Column, proposed: Column) -> Column:
    """A proposed new wording without its quotes; the query itself where that is missing or shorter than five characters."""
    bare = F.regexp_replace(strip(proposed), "^[\"']+|[\"']+$", "")
    return F.when(F.length(bare) >= 5, bare).otherwise(query)


def refined(current: Column, proposed: Column) -> Column:
    """A refined plan if it reads as a JSON object; else the plan as it was."""
    return F.when(F.regexp_like(proposed, F.lit(r"^\s*\{")) & F.get_json_object(proposed, "$").isNotNull(), proposed).otherwise(current)


def synthesis_context(results: DataFrame, top: int = 15) -> DataFrame:
    """topic, context of results(topic, ord, source, title, snippet): the first `top` results, as a report's input."""
    from pyspark.sql import Window

    first = results.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("ord"))).where(F.col("r") <= top)
    item = F.concat(F.lit("["), F.upper(F.coalesce("source", F.lit("web"))), F.lit("] "), F.coalesce("title", F.lit("No Title")), F.lit("\n"), F.coalesce("snippet", F.lit("")))
    kept = first.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("r", item.alias("item")))).alias("items"))
    return kept.select("topic", F.array_join(F.transform("items", lambda x: x["item"]), "\n---\n").alias("context"))


def research_plan(topic: str, mode: str) -> list[tuple[str, str]]:
    """(backend, query) of a topic where no model plans."""
    if mode == "deep":
        return [("wiki", f"{topic}: background and main ideas"), ("arxiv", f"survey of research on {topic}"), ("news", f"recent news about {topic}"), ("local", f"own documents on {topic}"), ("web", f"introduction to {topic}")]
    second = {"wiki": (f"{topic} encyclopedia", f"how {topic} developed"), "local": (topic, f"own notes on {topic}")}.get(mode, (topic, f"what is new in {topic}"))
    return [(mode, q) for q in second]


def build_knowledge(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of triplets(chunk, ord, subject, subject_type, relation, object, object_type, at): ids normalised, a node's
    first type wins. Where rows tell their place in the table (`at`), equal ord are taken in that order, subjects before objects."""
    place = lambda end: F.struct("ord", *([F.lit(end).alias("end"), "at"] if "at" in triplets.columns else [])).alias("place")
    ends = reduce(DataFrame.unionByName, [triplets.select(place(i), F.col(end).alias("name"), F.col(f"{end}_type").alias("type")) for i, end in enumerate(("subject", "object"))])
    key = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("_")))
    nodes = ends.groupBy(key(F.col("name")).alias("id")).agg(F.min_by("type", F.struct("place", "type")).alias("type"))
    edges = triplets.select(key(F.col("subject")).alias("src"), "relation", key(F.col("object")).alias("dst")).distinct()
    return nodes, edges


def implicit_edges(chunks: DataFrame) -> DataFrame:
    """SOURCE, NEXT and PREVIOUS of chunks(chunk_id, doc_id, ord)."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id").orderBy("ord")
    near = chunks.withColumn("next", F.lead("chunk_id").over(by)).withColumn("before", F.lag("chunk_id").over(by))
    edge = lambda rel, dst: F.struct(F.lit(rel).alias("rel_type"), dst.cast("string").alias("dst"))
    made = near.select("chunk_id", F.explode(F.array(edge("SOURCE", F.col("doc_id")), edge("NEXT", F.col("next")), edge("PREVIOUS", F.col("before")))).alias("e"))
    return made.select(F.col("chunk_id").alias("src"), "e.rel_type", "e.dst").where("dst IS NOT NULL")


def knowledge_prompt(guardrails: DataFrame) -> DataFrame:
    """category, prompt of guardrails(category, objects, relations, conventions): the extraction prefix."""
    part = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head + ": "), F.array_join(items, ", ")))
    return guardrails.select("category", F.concat_ws("\n", F.concat(F.lit("Category: "), "category"), part("Objects", F.col("objects")), part("Relations", F.col("relations")), F.concat(F.lit("Conventions: "), "conventions"), F.lit("Extract the triplets now")).alias("prompt"))


def with_context(prompt: Column, entities: Column) -> Column:
    return F.when(F.size(entities) == 0, prompt).otherwise(F.replace(prompt, F.lit("Extract the triplets now"), F.concat(F.lit("Known entities: "), F.array_join(entities, ", "), F.lit("\nExtract the triplets now"))))
