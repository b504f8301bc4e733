"""Queries of planning, grading, extraction and incremental ingestion."""

from pyspark.sql import functions as F

from ..common import shared_folder
from ..operators import chunking
from ..plans import agent as A
from ..registry import query

any_of = lambda words, c: "(" + " OR ".join(f"contains({c}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
ASKED = "(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Overview of ' || text WHEN 1 THEN 'history ' || text WHEN 2 THEN left(text, 3) ELSE text END AS q, text FROM conversations)"
GENERIC = "(len(list_filter(string_split_regex(lower(q), '\\s+'), lambda x: x <> '')) <= 2 OR " + " OR ".join(f"starts_with(regexp_replace(lower(q), '^\\s+', ''), '{w.replace(chr(39), chr(39) * 2)}')" for w in A.CONVERSATIONAL) + ")"


def asked(t):
    n, x = F.col("turn") % 4, F.col("text")
    return t("conversations").select("conv_id", "turn", "text", F.when(n == 0, F.concat(F.lit("Overview of "), x)).when(n == 1, F.concat(F.lit("history "), x)).when(n == 2, F.substring(x, 1, 3)).otherwise(x).alias("q"))


query("llm_plan", f"SELECT conv_id, turn, CASE WHEN {GENERIC} THEN 'GENERIC' WHEN {any_of(A.GLOBAL, 'lower(q)')} THEN 'GLOBAL' ELSE 'LOCAL' END AS query_type, CASE WHEN {GENERIC} THEN 'community_search,summary_search' WHEN {any_of(A.GLOBAL, 'lower(q)')} THEN 'summary_search,community_search,vector_search' ELSE 'vector_search,graph_search' END AS tools FROM {ASKED}")(
    lambda t, _: asked(t).withColumn("p", A.plan(F.col("q"))).select("conv_id", "turn", "p.query_type", "p.tools")
)
query("ret_generic_skip", f"SELECT count(*) AS n FROM {ASKED} WHERE {GENERIC}")(lambda t, _: asked(t).where(A.plan(F.col("q"))["is_generic"]).agg(F.count(F.lit(1)).alias("n")))
query("llm_route", f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'HYBRID' WHEN turn % 3 = 1 AND {any_of(A.GLOBAL_ROUTER, 'lower(q)')} THEN 'GLOBAL' WHEN turn % 3 = 1 THEN 'LOCAL' ELSE 'GENERIC' END AS query_type FROM {ASKED}")(
    lambda t, _: asked(t).select("conv_id", "turn", A.route(F.col("q"), F.when(F.col("turn") % 3 == 1, "LOCAL").when(F.col("turn") % 3 == 2, "GENERIC")).alias("query_type"))
)
query("llm_title", "SELECT conv_id, turn, substr(text, 1, 40) || CASE WHEN length(text) > 40 THEN '...' ELSE '' END AS title FROM conversations")(lambda t, _: t("conversations").select("conv_id", "turn", A.conversation_title(F.col("text")).alias("title")))
query("llm_grade_ret", "SELECT doc_id, CASE WHEN toxic = 1 THEN false WHEN doc_id % 2 = 0 THEN true ELSE quality = 1 END AS relevant FROM labels")(
    lambda t, _: t("labels").select("doc_id", A.grade(F.when(F.col("toxic") == 1, F.lit(0)).otherwise(F.lit(9)), F.when(F.col("doc_id") % 2 == 1, F.col("quality") == 1)).alias("relevant"))
)
query("llm_grade_ans", "SELECT doc_id, CASE WHEN toxic = 1 THEN false ELSE quality = 1 END AS grounded FROM labels")(lambda t, _: t("labels").select("doc_id", A.grade(1 - F.col("toxic"), F.col("quality") == 1).alias("grounded")))
query("crag_loop", "SELECT doc_id AS query_id, CASE WHEN quality = 1 THEN 1 ELSE 2 END AS grades, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS rewrites, quality = 1 OR toxic = 1 AS relevant FROM labels")(
    lambda t, _: A.corrective_rounds(t("labels").select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("first"), (F.col("toxic") == 1).alias("second")))
)
query("llm_doc_summary", "SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[^.!?]+[.!?]'), 1, 2), '') AS summary FROM documents")(lambda t, _: t("documents").select("doc_id", A.lead(F.col("text")).alias("summary")))
PROPOSED = "CASE turn % 3 WHEN 0 THEN '\"' || text || '\" ' WHEN 1 THEN ' abc ' END"
query("llm_rewrite", f"SELECT conv_id, turn, CASE WHEN length(p) >= 5 THEN p ELSE text END AS rewritten FROM (SELECT *, trim(trim({PROPOSED}), '\"''') AS p FROM conversations)")(
    lambda t, _: t("conversations").select("conv_id", "turn", A.rewrite(F.col("text"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"'), "text", F.lit('" '))).when(F.col("turn") % 3 == 1, F.lit(" abc "))).alias("rewritten"))
)
query("llm_refine_plan", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE 'kept' END AS plan FROM events")(
    lambda t, _: t("events").select("event_id", A.refined(F.lit("kept"), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("no plan"))).alias("plan"))
)
query("llm_synthesis", "SELECT topic, string_agg('[' || upper(source) || '] ' || lang || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY doc_id) AS context FROM (SELECT *, source AS topic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 15 GROUP BY topic")(
    lambda t, _: A.synthesis_context(t("documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("ord"), "source", F.col("lang").alias("title"), F.col("text").alias("snippet")))
)
query("kg_context_prefix", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || chr(10) || 'Known entities: a, b' || chr(10) || 'Extract the triplets now' ELSE text || chr(10) || 'Extract the triplets now' END AS prefix FROM benchmark")(
    lambda t, _: t("benchmark").select("item_id", A.with_context(F.concat("text", F.lit("\nExtract the triplets now")), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))).alias("prefix"))
)
query("kg_prompt", "SELECT source AS category, 'Category: ' || source || chr(10) || 'Objects: ' || array_to_string(list_sort(list(DISTINCT lang)), ', ') || chr(10) || 'Relations: RELATED_TO' || chr(10) || 'Conventions: none' || chr(10) || 'Known entities: a, b' || chr(10) || 'Extract the triplets now' AS prompt FROM documents GROUP BY source")(
    lambda t, _: A.knowledge_prompt(t("documents").groupBy(F.col("source").alias("category")).agg(F.array_sort(F.collect_set("lang")).alias("objects")).withColumn("relations", F.array(F.lit("RELATED_TO"))).withColumn("conventions", F.lit("none"))).withColumn("prompt", A.with_context(F.col("prompt"), F.array(F.lit("a"), F.lit("b"))))
)


def triplets(t):
    return t("lineitem").select(
        F.struct("_metadata.file_path", "_metadata.row_index").alias("at"), F.col("l_orderkey").alias("chunk"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("subject"), F.col("l_returnflag").alias("subject_type"),
        F.lit("SHIPPED_BY").alias("relation"), F.concat(F.lit("Mode "), F.col("l_linestatus")).alias("object"), F.lit("Mode").alias("object_type"),
    )


query("kg_build", "SELECT lower(replace(name, ' ', '_')) AS id, min_by(type, ord) AS type FROM (SELECT 'Part ' || l_partkey AS name, l_returnflag AS type, l_orderkey * 10 + l_linenumber AS ord FROM lineitem UNION ALL SELECT 'Mode ' || l_linestatus, 'Mode', l_orderkey * 10 + l_linenumber FROM lineitem) GROUP BY 1")(lambda t, _: A.build_knowledge(triplets(t))[0])
query("kg_edges", "SELECT DISTINCT 'part_' || l_partkey AS src, 'SHIPPED_BY' AS relation, lower('mode_' || replace(l_linestatus, ' ', '_')) AS dst FROM lineitem")(lambda t, _: A.build_knowledge(triplets(t))[1])
query("llm_implicit", "SELECT src, rel_type, dst FROM (SELECT conv_id || '-' || turn AS src, 'SOURCE' AS rel_type, conv_id::VARCHAR AS dst FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'NEXT', lead(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations UNION ALL SELECT conv_id || '-' || turn, 'PREVIOUS', lag(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations) WHERE dst IS NOT NULL")(
    lambda t, _: A.implicit_edges(t("conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord")))
)


@query("inc_stream", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def inc_stream(t, spark):
    """The status log as a stream, taken to its end in batches and merged; equal to the batch result."""
    events = t("events")
    path = events.inputFiles()[0].rsplit("/", 1)[0]
    log = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet" if "/events.parquet/" not in events.inputFiles()[0] else "*.parquet").parquet(path)
    name = f"stream_{id(log)}"
    run = log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).writeStream.outputMode("complete").format("memory").queryName(name)
    run.option("checkpointLocation", shared_folder(spark) + f"/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


query("inc_windowed", "SELECT event_type, epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS hour_s, count(*) AS n FROM events GROUP BY 1, 2")(lambda t, _: t("events").groupBy("event_type", F.unix_timestamp(F.window("ts", "1 hour")["start"]).alias("hour_s")).agg(F.count(F.lit(1)).alias("n")))
query("inc_graph_append", "SELECT DISTINCT user_id AS src, event_type AS dst FROM events")(lambda t, _: t("events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst")).unionByName(t("events").where("event_id % 2 = 0").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"))).distinct())
query("inc_insert_pass")(lambda t, _: chunking.big_chunks(t("documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks")))
