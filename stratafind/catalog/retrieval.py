"""Queries of indexes, ranking, fusion and context."""

import uuid

from pyspark.sql import Window, functions as F

from ..common import checked_broadcast, shared_folder
from ..functions import text as X
from ..operators import chunking, graph as G, retrieval as R
from ..operators.ivf import InvertedFile
from ..plans import agent as A
from ..registry import query
from .agent import GENERIC as A_GENERIC, any_of
from .graph import EDGES, edges

A_GLOBAL = any_of(A.GLOBAL, "lower(q)")

VQ = "(SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)"
VECTOR = f"""(SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::INT AS rank FROM
    (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 9) AS score FROM embeddings, {VQ}))"""
TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
POST = f"(SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(toks)::INT AS dl, unnest(toks) AS term FROM (SELECT doc_id AS id, {TOK} AS toks FROM documents)) GROUP BY ALL)"
BM25 = f"""(WITH post AS MATERIALIZED {POST}, stats AS MATERIALIZED (SELECT count(*) AS n, avg(len({TOK})) AS avgdl FROM documents),
    asked AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark),
    held AS MATERIALIZED (SELECT * FROM post WHERE term IN (SELECT term FROM asked)), df AS MATERIALIZED (SELECT term, count(*) AS df FROM held GROUP BY term),
    weighed AS MATERIALIZED (SELECT term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w FROM held JOIN df USING (term), stats),
    scored AS MATERIALIZED (SELECT query_id, id, round(sum(w), 6) AS score FROM weighed JOIN asked USING (term) GROUP BY query_id, id)
    SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1)::INT AS rank FROM scored)"""
CANDIDATES = f"(SELECT query_id, 0 AS list_ord, rank, id FROM {VECTOR} WHERE rank < 10 UNION ALL SELECT query_id, 1, rank, id FROM {BM25} WHERE rank < 10)"
FUSED = f"""(SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen)::INT AS fused_rank FROM
    (SELECT query_id, id, round(sum(1 / (60 + rank + 1)), 9) AS score, min(list_ord * 4294967296 + rank) AS first_seen FROM {CANDIDATES} GROUP BY ALL))"""


def vector_queries(t):
    """The stated query set: every vector whose id is divisible by 100, against all vectors."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def text_queries(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25(t, top=10):
    return R.bm25_of(t("documents"), text_queries(t), top)


def candidates(t):
    dense = R.vector_search(R.vector_index(t("embeddings")), vector_queries(t), 10).select("query_id", F.lit(0).alias("list_ord"), "rank", "id")
    return dense.unionByName(bm25(t).select("query_id", F.lit(1).alias("list_ord"), "rank", "id"))


query("sim_cosine", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda t, _: t("embeddings").join(t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 9).alias("cos"))
)


def kept_vectors(t, spark):
    """The vectors as an inverted file: built from those of odd ids, the others appended, read again from its folder."""
    path, v = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", t("embeddings")
    InvertedFile.build(v.where("vec_id % 2 = 1"), path).append(v.where("NOT (vec_id % 2 <=> 1)"))
    return InvertedFile(spark, path)


query("ret_vector_index", "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm FROM embeddings")(lambda t, s: kept_vectors(t, s).vectors().select("id", F.round("norm", 9).alias("norm")))
query("snk_vector", f"SELECT query_id, id, score, rank FROM {VECTOR} WHERE rank < 5")(lambda t, s: kept_vectors(t, s).query(vector_queries(t)))
query("ret_vector", f"SELECT query_id, id, score, rank FROM {VECTOR} WHERE rank < 5")(lambda t, _: R.vector_search(R.vector_index(t("embeddings")), vector_queries(t)).select("query_id", "id", "score", "rank"))
query("ret_bm25_index", f"SELECT term, id, dl, tf FROM {POST}")(lambda t, _: R.bm25_index(t("documents")).select("term", "id", "dl", "tf"))
query("ret_bm25", f"SELECT query_id, id, score, rank FROM {BM25} WHERE rank < 10")(lambda t, _: bm25(t).select("query_id", "id", "score", "rank"))
query("ret_rrf", f"SELECT query_id, id, score, fused_rank FROM {FUSED}")(lambda t, _: R.fuse(candidates(t)).select("query_id", "id", "score", "fused_rank"))
query("ret_top5", f"SELECT query_id, id, fused_rank FROM {FUSED} WHERE fused_rank <= 5")(lambda t, _: R.fuse(candidates(t)).where("fused_rank <= 5").select("query_id", "id", "fused_rank"))
query("ret_hybrid", f"SELECT query_id, id, score, fused_rank FROM {FUSED} WHERE fused_rank <= 5")(lambda t, _: R.hybrid(t("documents"), t("embeddings"), text_queries(t), vector_queries(t)).select("query_id", "id", "score", "fused_rank"))
MEANS = "(SELECT label AS id, list(m ORDER BY i) AS embedding, max(n) AS n FROM (SELECT label, i, round(avg(x), 6) AS m, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
RANKED = f"""(SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) - 1)::INT AS rank FROM
    (SELECT query_id, id, round(list_dot_product(embedding, q::DOUBLE[]) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6) AS score FROM {MEANS}, {VQ}))"""


def communities(t, asked):
    """A community is a label, its summary's vector the mean of its members; ties go to the later one."""
    each = t("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("embedding"))
    index = R.vector_index(means.select(F.col("label").alias("vec_id"), "embedding"))
    scored = R.scored(index, asked).withColumn("score", F.round("score", 6))
    return R.ranked(scored, "query_id", F.col("score").desc(), F.col("id").desc(), top=3).select("query_id", "id", "score", "rank")


query("ret_community", f"SELECT query_id, id, score, rank FROM {RANKED} WHERE rank < 3")(lambda t, _: communities(t, vector_queries(t)))


query("ret_community_fallback", "SELECT label, count(*) AS entity_count FROM embeddings GROUP BY label ORDER BY entity_count DESC, label LIMIT 3")(lambda t, _: t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("entity_count")).orderBy(F.col("entity_count").desc(), "label").limit(3))
query("sim_entity_rank", f"SELECT query_id, id, rank FROM {VECTOR} WHERE rank < 20")(lambda t, _: R.vector_search(R.vector_index(t("embeddings")), vector_queries(t), 20).select("query_id", "id", "rank"))
TOPK = "(SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"


def similar_edges(t, least):
    """src, dst, score: the three most similar others of each vector, over `least`."""
    rows = t("embeddings")
    found = R.nearest(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3)
    return found.where(F.col("score") > least).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")


query("sim_topk_edges", f"SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM {TOPK}) WHERE r <= 3 AND score > 0.3")(lambda t, _: similar_edges(t, 0.3))
query("g_similar_to", f"SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM {TOPK}) WHERE r <= 3 AND score > 0.5")(lambda t, _: similar_edges(t, 0.5))
query("ret_sources", "SELECT 'T' || (doc_id % 50) AS title, source AS category, min(doc_id) AS ord FROM documents GROUP BY 1, 2")(
    lambda t, _: R.sources(t("documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), (F.col("doc_id") % 50).cast("string"))).alias("title"), F.lit(None).cast("string").alias("file_name"), F.concat(F.lit("a/T"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt")).alias("file_path"), F.col("source").alias("category"))).select("title", "category", "ord")
)
query("ret_pool", "SELECT source, min(doc_id) AS ord FROM documents GROUP BY source")(lambda t, _: R.pool(t("documents").withColumnRenamed("doc_id", "ord"), "source"))
CONTEXT = "(SELECT conv_id AS query_id, CASE turn % 4 WHEN 0 THEN 'community' WHEN 1 THEN 'graph' WHEN 2 THEN 'vector' ELSE 'summary' END AS kind, turn AS ord, text, role AS source FROM conversations)"


def context(t):
    kind = F.element_at(F.array(*map(F.lit, ("community", "graph", "vector", "summary"))), (F.col("turn") % 4 + 1).cast("int"))
    return t("conversations").select(F.col("conv_id").alias("query_id"), kind.alias("kind"), F.col("turn").alias("ord"), "text", F.col("role").alias("source"))


query("ret_flatten", f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 'graph' THEN 1 WHEN 'vector' THEN 2 WHEN 'summary' THEN 3 ELSE 4 END, ord)::INT AS ord, text FROM {CONTEXT} WHERE text <> ''")(lambda t, _: R.flatten(context(t)))
query("ret_prompt", f"""SELECT query_id, concat_ws(chr(10) || chr(10), 'COMMUNITY:' || chr(10) || string_agg(CASE WHEN kind = 'community' THEN text END, chr(10) ORDER BY ord),
    'GRAPH:' || chr(10) || string_agg(CASE WHEN kind = 'graph' THEN text END, chr(10) ORDER BY ord), 'EXCERPTS:' || chr(10) || string_agg(CASE WHEN kind = 'vector' THEN '[' || source || '] ' || text END, chr(10) ORDER BY ord)) AS prompt
    FROM {CONTEXT} GROUP BY query_id UNION ALL SELECT -1, 'No relevant context found.'""")(lambda t, s: R.prompt(context(t), context(t).select("query_id").distinct().unionByName(s.createDataFrame([(-1,)], "query_id long"))))
query("ret_stats", "SELECT doc_id AS query_id, length(text) // 4 AS tokens, round((length(text) // 4) / (1 + doc_id % 5), 1) AS tps, round(least(1.0, (length(text) // 4 + length(lang || text) // 4) / 8192), 6) AS utilization FROM documents")(
    lambda t, _: R.statistics(t("documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), F.concat("lang", "text").alias("prompt"), (1 + F.col("doc_id") % 5).alias("seconds")))
)
query("ret_seeds", "SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT n_name FROM nation UNION ALL SELECT c_name FROM customer WHERE c_custkey % 2 = 0)")(
    lambda t, _: t("customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("name")).union(t("nation").select("n_name")).union(t("customer").where("c_custkey % 2 = 0").select("c_name")).distinct()
)
query("ret_web", f"SELECT query_id, ord, id FROM (SELECT query_id, fused_rank + 1000 AS ord, id FROM {FUSED} WHERE fused_rank <= 5 UNION ALL SELECT item_id, 0, -1 FROM benchmark)")(
    lambda t, _: R.fuse(candidates(t)).where("fused_rank <= 5").select("query_id", (F.col("fused_rank") + 1000).alias("ord"), "id").unionByName(text_queries(t).select("query_id", F.lit(0).alias("ord"), F.lit(-1).cast("long").alias("id")))
)

@query("g_embed_backfill", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 64 ELSE len(embedding) END::INT AS dim, vec_id % 2 = 0 AS filled FROM embeddings")
def g_embed_backfill(t, _):
    """Vectors that are missing (those of even ids are taken away) are embedded anew; the others stay."""
    held = t("embeddings").select("vec_id", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), F.when(F.col("vec_id") % 2 == 1, F.col("embedding")).alias("embedding"))
    filled = chunking.backfilled(held.withColumn("missing", F.col("embedding").isNull()))
    return filled.select("vec_id", F.size("embedding").alias("dim"), F.col("missing").alias("filled"))


@query("snk_bm25", f"SELECT query_id, id, score, rank FROM {BM25} WHERE rank < 10")
def snk_bm25(t, spark):
    """The sparse index kept as tables, loaded again and searched: the same hits as from the index in memory."""
    path = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    R.save_bm25(t("documents"), path)
    return R.bm25_search(*R.load_bm25(spark, path), text_queries(t), 10).select("query_id", "id", "score", "rank")


# ---- graph retrieval: similar entities, their edges, the chunks that mention them

FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_id) AS r FROM {EDGES}) WHERE r <= 10)"


def graph_evidence(t, asked):
    """An entity is a customer, its vector that of its number, the chunk that mentions it the document of that number."""
    hits = R.vector_search(R.vector_index(t("embeddings")), asked).select("query_id", "rank", F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"))
    mentions = t("documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("chunk"))
    return G.evidence(hits, edges(t), mentions, t("documents").select(F.col("doc_id").alias("chunk"), "text"))


def evidence_sql(vectors):
    return f"(SELECT query_id, rank, v.id, e.rel_type, e.dst, d.doc_id AS chunk, d.text FROM (SELECT query_id, rank, 'c' || id AS id FROM {vectors} WHERE rank < 5) v JOIN {FIRST} e ON e.src = v.id LEFT JOIN documents d ON 'c' || d.doc_id = v.id)"


query("ret_graph", f"SELECT query_id, rank, id, rel_type, dst, chunk, text FROM {evidence_sql(VECTOR)}")(lambda t, _: graph_evidence(t, vector_queries(t)))

# ---- the tools by name; a question's vector is that of its number

ITEMS = VECTOR.replace("WHERE vec_id % 100 = 0", "WHERE vec_id IN (SELECT item_id FROM benchmark)")
ITEMS_RANKED = RANKED.replace("WHERE vec_id % 100 = 0", "WHERE vec_id IN (SELECT item_id FROM benchmark)")
TOOLS = f"(SELECT item_id AS query_id, CASE WHEN {A_GENERIC} THEN 'community_search,summary_search' WHEN {A_GLOBAL} THEN 'summary_search,community_search,vector_search' ELSE 'vector_search,graph_search' END AS tools FROM (SELECT item_id, text AS q FROM benchmark))"


def tools(t):
    """name -> builder of query_id, rank, id for queries(query_id, text)."""
    vectors = lambda asked: t("embeddings").join(checked_broadcast(asked.select(F.col("query_id").alias("vec_id"))), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    named = lambda df: df.select("query_id", "rank", F.col("id").cast("string").alias("id"))
    first = t("documents").orderBy("doc_id").limit(2).select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("doc_id")) - 1).alias("rank"), F.col("doc_id").alias("id"))
    pages = t("pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    return {
        "vector_search": lambda asked: named(R.vector_search(R.vector_index(t("embeddings")), vectors(asked))),
        "keyword_search": lambda asked: named(R.bm25_of(t("documents"), asked, 5)),
        "graph_search": lambda asked: graph_evidence(t, vectors(asked)).select("query_id", "rank", F.concat_ws(" ", "id", "rel_type", "dst").alias("id")),
        "summary_search": lambda asked: named(asked.select("query_id").crossJoin(F.broadcast(first))),  # two rows
        "community_search": lambda asked: named(communities(t, vectors(asked))),
        "web_search": lambda asked: named(R.bm25_of(pages, asked, 5)),
    }


@query("ret_dispatch", f"""SELECT c.query_id, tool, rank, c.id FROM (SELECT query_id, 'vector_search' AS tool, 'vector_search' AS plan, rank, id::VARCHAR AS id FROM {ITEMS} WHERE rank < 5
    UNION ALL SELECT query_id, 'keyword_search', 'vector_search', rank, id::VARCHAR FROM {BM25} WHERE rank < 5 UNION ALL SELECT query_id, 'graph_search', 'graph_search', rank, concat_ws(' ', id, rel_type, dst) FROM {evidence_sql(ITEMS)}
    UNION ALL SELECT item_id, 'summary_search', 'summary_search', r, id::VARCHAR FROM benchmark, (SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INT AS r, doc_id AS id FROM documents ORDER BY doc_id LIMIT 2)
    UNION ALL SELECT query_id, 'community_search', 'community_search', rank, id::VARCHAR FROM {ITEMS_RANKED} WHERE rank < 3) c JOIN {TOOLS} p ON p.query_id = c.query_id AND contains(tools, plan)""")
def ret_dispatch(t, _):
    """Each question's plan names its tools; only these run for it, and each has rows of its own."""
    planned = text_queries(t).withColumn("tools", A.plan(F.col("text"))["tools"])
    # words are searched wherever vectors are
    planned = planned.withColumn("tools", F.when(F.contains("tools", F.lit("vector_search")), F.concat("tools", F.lit(",keyword_search"))).otherwise(F.col("tools")))
    return R.run_tools(planned, tools(t))[0]
