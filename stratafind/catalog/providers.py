"""Queries of what providers do: questions, extraction, answers, grading, research, kept stores and the ingestion loop."""

import itertools
import uuid

from pyspark.sql import Window, functions as F

from .. import providers as P
from ..common import delete, shared_folder
from ..functions import text as X
from ..operators import clean, extractors as E, files, graph as G, sets, stores
from ..plans import agent as A
from ..registry import query
from ..sources import web
from ..streaming import ingest
from .graph import DEGREE, EDGES, NODES, BOTH, edges, nodes
from .retrieval import BM25, TOPK, bm25, text_queries
from .text import decorated, paths, results, FILES, RESULTS, SQL_TEXT

MODEL = P.Rules()
N = "[\\p{L}\\p{N}_]{2,}"

# ---- questions

PARTS = "list_filter(list_transform(regexp_split_to_array(text, ' and |[;?]'), lambda p: trim(p, ' ')), lambda p: length(p) > 2)"
query("llm_decompose", f"SELECT item_id, unnest(CASE WHEN len({PARTS}) = 0 THEN [text] ELSE list_slice({PARTS}, 1, 3) END) AS sub_query FROM benchmark")(
    lambda t, _: t("benchmark").select("item_id", F.explode(MODEL.sub_queries(F.col("text"))).alias("sub_query"))
)
TURNS = "(SELECT *, " + ", ".join(f"coalesce(regexp_extract(lag(text, {k}) OVER (PARTITION BY conv_id ORDER BY turn), '[A-Z][a-z]+', 0), '') AS n{k}" for k in range(1, 5)) + " FROM conversations)"
NAME = "coalesce(nullif(n1, ''), nullif(n2, ''), nullif(n3, ''), nullif(n4, ''))"


@query("llm_coref_q", f"SELECT conv_id, turn, CASE WHEN {NAME} IS NULL THEN text ELSE regexp_replace(text, '(?i)\\b(it|they|this|that)\\b', {NAME}, 'g') END AS resolved FROM {TURNS}")
def llm_coref_q(t, _):
    by = Window.partitionBy("conv_id").orderBy("turn")
    told = t("conversations").withColumn("history", F.array(*[F.lag("text", k).over(by) for k in range(1, 5)]))
    return told.select("conv_id", "turn", MODEL.resolved(F.col("text"), F.col("history")).alias("resolved"))


query("llm_hyde", "SELECT item_id, text || chr(10) || chr(10) || 'An answer would mention: ' || array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]{6,}'), 1, 5), ', ') AS expanded FROM benchmark")(
    lambda t, _: t("benchmark").select("item_id", MODEL.hypothetical(F.col("text")).alias("expanded"))
)
CATEGORY = "CASE WHEN regexp_matches(lower(text), '[a-z]{4,}') THEN array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z]{4,}'), 1, 2), '_') ELSE 'general' END"
query("llm_category", f"SELECT doc_id, {CATEGORY} AS category FROM documents")(lambda t, _: t("documents").select("doc_id", MODEL.category(F.col("text")).alias("category")))
WINDOWS = "list_transform(range(0, (length(text) + 3999) // 4000), lambda i: replace(replace(replace(replace(substr(text, i * 4000 + 1, 4000), 'it''s', 'it is'), 'don''t', 'do not'), 'they''re', 'they are'), 'can''t', 'cannot'))"
query("cln_coref_llm", f"SELECT doc_id, array_to_string({WINDOWS}, '') AS text FROM (SELECT doc_id, replace(text, 'the ', 'it''s ') AS text FROM documents)")(
    lambda t, _: t("documents").select("doc_id", P.in_windows(F.replace("text", F.lit("the "), F.lit("it's ")), MODEL.rewritten).alias("text"))
)

# ---- extraction: chunks are documents

GROUP = lambda p, k: f"list_slice(regexp_extract_all(text, '{p}', {k}), 1, {P.TRIPLETS if p == P.TRIPLET else P.PAIRS})"
TRIPLETS = f"(SELECT doc_id, text, unnest(range(1, len({GROUP(P.TRIPLET, 1)}) + 1))::INT AS ord, unnest({GROUP(P.TRIPLET, 1)}) AS subject, upper(unnest({GROUP(P.TRIPLET, 2)})) AS relation, unnest({GROUP(P.TRIPLET, 3)}) AS object FROM documents)"
VERIFIED = f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM {TRIPLETS}) WHERE n <= {P.UNVERIFIED} OR length(object) > 2)"


def triplets(t, made):
    return t("documents").select("doc_id", "text", F.posexplode(made(F.col("text"))).alias("at", "e")).select("doc_id", "text", (F.col("at") + 1).alias("ord"), "e.*")


def confirmed(t):
    return triplets(t, lambda c: MODEL.triplets(c)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where((F.col("n") <= P.UNVERIFIED) | MODEL.holds(F.struct("object"))).drop("n")


query("llm_triplets", f"SELECT doc_id, ord, subject, relation, object FROM {TRIPLETS}")(lambda t, _: triplets(t, MODEL.triplets).drop("text"))
query("llm_freeform", f"SELECT doc_id, unnest(range(1, len({GROUP(P.PAIR, 1)}) + 1))::INT AS ord, unnest({GROUP(P.PAIR, 1)}) AS subject, 'RELATED_TO' AS relation, unnest({GROUP(P.PAIR, 2)}) AS object FROM documents")(
    lambda t, _: triplets(t, MODEL.pairs).drop("text")
)


class TripletWorker:
    """The rule for triplets as an object of a worker."""

    def load(self):
        import re

        self.pattern = re.compile(P.TRIPLET)

    def triplets(self, texts):
        return [[(m[1], m[2].upper(), m[3]) for m in itertools.islice(self.pattern.finditer(x), P.TRIPLETS)] for x in texts]


query("llm_triplets_workers", f"SELECT doc_id, ord, subject, relation, object FROM {TRIPLETS}")(
    lambda t, _: E.in_workers(t("documents").select(F.col("doc_id").alias("chunk"), "text"), TripletWorker(), "rules")[0].where("error IS NULL").select(F.col("chunk").alias("doc_id"), "ord", "subject", "relation", "object")
)
TURN = "conv_id || '-' || turn"
PATHS = {"schema": ("{t}", "upper({v})", "{o}", P.TRIPLET, P.TRIPLETS), "free_form": ("{t}", "'RELATED_TO'", "{v}", P.PAIR, P.PAIRS)}


def paths_sql(name):
    subject, relation, obj, pattern, most = PATHS[name]
    part = {k: f"unnest(list_slice(regexp_extract_all(text, '{pattern}', {g}), 1, {most}))" for k, g in (("t", 1), ("v", 2), ("o", 3))}
    number = f"unnest(range(1, len(list_slice(regexp_extract_all(text, '{pattern}'), 1, {most})) + 1))::INT"
    return f"SELECT {TURN} AS chunk, '{name}' AS extractor, {number} AS ord, {subject.format(**part)} AS subject, {relation.format(**part)} AS relation, {obj.format(**part)} AS object FROM conversations"


IMPLICIT = f"""SELECT chunk, 'implicit', (row_number() OVER (PARTITION BY chunk ORDER BY k))::INT, chunk, kind, dst FROM (
    SELECT {TURN} AS chunk, 1 AS k, 'SOURCE' AS kind, conv_id::VARCHAR AS dst FROM conversations UNION ALL SELECT {TURN}, 2, 'NEXT', lead({TURN}) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations
    UNION ALL SELECT {TURN}, 3, 'PREVIOUS', lag({TURN}) OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations) WHERE dst IS NOT NULL"""


@query("kg_extractors", f"{paths_sql('schema')} UNION ALL {paths_sql('free_form')} UNION ALL {IMPLICIT}")
def kg_extractors(t, _):
    """The whole list over the turns of conversations, each read once."""
    turns = t("conversations").select(F.col("conv_id").cast("string").alias("doc"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk"), F.col("turn").alias("ord"), "text")
    return E.extracted(turns, E.listed(MODEL, True, True))


query("llm_verify", f"SELECT doc_id, ord, subject, relation, object FROM {VERIFIED}")(
    lambda t, _: t("documents").select("doc_id", P.verified(F.transform(MODEL.triplets(F.col("text")), lambda x, i: x.withField("ord", i + F.lit(1))), MODEL).alias("v")).select("doc_id", F.explode("v").alias("e")).select("doc_id", "e.ord", "e.subject", "e.relation", "e.object")
)
GATE = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in A.TEMPORAL) + ")"
query("llm_temporal", f"SELECT doc_id, ord, CASE WHEN {GATE} THEN nullif(regexp_extract(text, '\\b(?:19|20)[0-9]{{2}}\\b'), '') END AS valid_from FROM {TRIPLETS}")(
    lambda t, _: triplets(t, MODEL.triplets).select("doc_id", "ord", F.when(A.temporal(F.col("text")), MODEL.since(F.col("text"))).alias("valid_from"))
)
NAMES = "(SELECT source AS category, word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT source, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS word FROM documents) GROUP BY ALL)"


def guardrails(t, least=1):
    words = t("documents").select(F.col("source").alias("category"), "doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("word"))
    counted = words.groupBy("category", "word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs")).where(F.col("docs") >= least)
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.col("n").desc(), "word"))).where("r <= 5")
    return best.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("entity_types")).withColumn("relationship_types", F.lit("RELATED_TO"))


RAILS = f"SELECT category, string_agg(word, ',' ORDER BY r) AS entity_types, 'RELATED_TO' AS relationship_types, @V AS version FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, word) AS r FROM {NAMES} WHERE docs >= @D) WHERE r <= 5 GROUP BY category"
query("llm_guardrails", RAILS.replace('@V', '1').replace('@D', '1'))(lambda t, _: guardrails(t).withColumn("version", F.lit(1)))
# a name that one document alone uses is no type; the version goes up by one
query("llm_optimize_gr", RAILS.replace('@V', '2').replace('@D', '2'))(lambda t, _: guardrails(t, 2).withColumn("version", F.lit(1) + F.lit(1)))


def stored(t, spark):
    """The documents' confirmed triplets as a kept graph, upserted twice."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    store = stores.GraphStore(spark, path)
    made = confirmed(t)
    told = made.select(F.col("doc_id").alias("chunk"), (F.col("doc_id") * 100 + F.col("ord")).alias("ord"), "subject", F.lit("Entity").alias("subject_type"), "relation", "object", F.lit("Entity").alias("object_type"))
    for part in (told.where("chunk % 2 = 0"), told):
        found, linked = A.build_knowledge(part)
        store.upsert_nodes(found.select("id", F.col("id").alias("name"), "type"))
        store.upsert_edges(linked.select("src", "relation", F.when(F.col("dst") != "", F.col("dst")).alias("dst")))
    return store


query("snk_graph", f"SELECT DISTINCT lower(subject) AS src, relation, lower(object) AS dst FROM {VERIFIED}")(lambda t, s: stored(t, s).edges().select("src", "relation", "dst"))
query("snk_graph_nodes", f"SELECT DISTINCT lower(unnest([subject, object])) AS id FROM {VERIFIED}")(lambda t, s: stored(t, s).nodes().select("id"))


SUMMARIES = "(SELECT doc_id AS id, doc_id AS insert_ord, array_to_string(list_slice(regexp_extract_all(text, '[^.!?]+[.!?]'), 1, 2), '') AS text FROM documents)"
summaries = lambda t: t("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("insert_ord"), A.lead(F.col("text")).alias("text"))
query("ret_summary_index", f"SELECT id, insert_ord, text FROM {SUMMARIES}")(lambda t, _: stores.SummaryIndex.build(summaries(t)).table)
query("ret_summary", f"SELECT item_id AS query_id, rank, id, s.text FROM benchmark, (SELECT (row_number() OVER (ORDER BY insert_ord) - 1)::INT AS rank, id, text FROM {SUMMARIES} ORDER BY insert_ord LIMIT 2) s")(
    lambda t, _: stores.SummaryIndex.build(summaries(t)).query(text_queries(t))
)


@query("snk_summary", f"SELECT id, insert_ord, text FROM {SUMMARIES}")
def snk_summary(t, spark):
    path = f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    stores.SummaryIndex.build(summaries(t)).write(path)
    return stores.SummaryIndex.read(spark, path).table


@query("adm_clear", "SELECT true AS was, false AS \"left\", true AS empty_again")
def adm_clear(t, spark):
    path = f"{shared_folder(spark)}/cleared-{uuid.uuid4().hex}"
    stores.SummaryIndex.build(summaries(t)).write(path)
    was = stores.clear(spark, path)
    return spark.createDataFrame([(was, stores.reachable(spark, path), not stores.clear(spark, path))], "was boolean, left boolean, empty_again boolean")


query("g_delete_all", f"SELECT (SELECT count(*) FROM {NODES}) AS before, 0::BIGINT AS after")(
    lambda t, s: nodes(t).agg(F.count(F.lit(1)).alias("before")).crossJoin(F.broadcast(emptied(t, s).agg(F.count(F.lit(1)).alias("after"))))
)


def emptied(t, spark):
    """The kept nodes after an overwrite with none."""
    path = f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
    nodes(t).write.parquet(path)
    nodes(t).limit(0).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


CHECKED = ("documents", "embeddings", "orders", "conversations")
query("adm_check", " UNION ALL ".join(f"SELECT '{n}' AS name, true AS reachable, count(*) AS rows FROM {n}" for n in CHECKED))(lambda t, s: stores.checked(s, {n: t(n) for n in CHECKED}))
query("snk_sse", "SELECT event_id, 'data: {\"type\":\"status\",\"event\":\"' || event_type || '\",\"id\":' || event_id || '}' || chr(10) || chr(10) AS event FROM events")(
    lambda t, _: t("events").select("event_id", F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("status").alias("type"), F.col("event_type").alias("event"), F.col("event_id").alias("id"))), F.lit("\n\n")).alias("event"))
)

# ---- answers

TOP = f"(SELECT query_id, rank, d.text FROM {BM25} b JOIN documents d ON d.doc_id = b.id WHERE rank < 3)"
LEAD = "'Based on the context:' || array_to_string(list_slice(regexp_extract_all(text, '[^.!?]+[.!?]'), 1, 2), '')"


def top_texts(t, n=3):
    return bm25(t, n).select("query_id", "rank", F.col("id").alias("doc_id")).join(t("documents").select("doc_id", "text"), "doc_id")


query("llm_answer", f"SELECT query_id, {LEAD} AS answer FROM {TOP} WHERE rank = 0")(lambda t, _: top_texts(t, 1).select("query_id", MODEL.answer(F.lit(""), F.col("text")).alias("answer")))
WORD = "nullif(regexp_extract(lower(q.text), '[a-z]{6,}'), '')"


@query("corrective_answer", f"""SELECT query_id, loops, {LEAD} AS answer FROM (SELECT query_id, text, rank AS loops, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN grounded THEN 0 ELSE 1 END, CASE WHEN grounded THEN rank ELSE -rank END) AS r
    FROM (SELECT t.*, coalesce(contains(lower(t.text), {WORD}), false) AS grounded FROM {TOP} t JOIN benchmark q ON q.item_id = t.query_id)) WHERE r = 1""")
def corrective_answer(t, _):
    """The answer is built anew from the next context until it is grounded, two more times at most; then the last one stands."""
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.nullif(F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0), F.lit("")).alias("word"))
    tried = top_texts(t).join(asked, "query_id").withColumn("grounded", F.coalesce(F.contains(F.lower("text"), F.col("word")), F.lit(False)))
    order = (F.when(F.col("grounded"), 0).otherwise(1), F.when(F.col("grounded"), F.col("rank")).otherwise(-F.col("rank")))
    best = tried.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("r = 1")
    return best.select("query_id", F.col("rank").alias("loops"), MODEL.answer(F.lit(""), F.col("text")).alias("answer"))


PROFILE = f"(SELECT n.name, b.rel_type, count(*) AS c FROM {BOTH} b JOIN {NODES} n ON n.id = b.src WHERE n.label = 'Nation' GROUP BY ALL)"
query("llm_entity_summary", f"SELECT name, name || ': ' || string_agg(rel_type || ' ' || c, '; ' ORDER BY rel_type) AS summary FROM {PROFILE} GROUP BY name")(
    lambda t, _: G.both_ways(edges(t)).join(nodes(t).where(F.get("labels", 0) == "Nation").select(F.col("id").alias("src"), "name"), "src").groupBy("name", "rel_type").agg(F.count(F.lit(1)).alias("c"))
    .groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_type", "c"))), lambda x: F.concat(x["rel_type"], F.lit(" "), x["c"].cast("string"))), "; ").alias("lines"))
    .select("name", F.concat("name", F.lit(": "), "lines").alias("summary"))
)

# ---- grading: an assistant's turn answers the turn before it, on the two turns before it

CASES = "(SELECT conv_id, turn, text AS answer, query, query || ' ' || coalesce(older, '') AS context FROM (SELECT *, lag(text) OVER w AS query, lag(text, 2) OVER w AS older FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND query IS NOT NULL)"
SET = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '{N}'))"
SHARE = lambda a, b: f"CASE WHEN len({SET(a)}) = 0 THEN 0.0 ELSE round(len(list_intersect({SET(a)}, {SET(b)})) / len({SET(a)}), 6) END"


def cases(t):
    by = Window.partitionBy("conv_id").orderBy("turn")
    told = t("conversations").withColumn("query", F.lag("text").over(by)).withColumn("older", F.lag("text", 2).over(by)).where("role = 'assistant' AND query IS NOT NULL")
    return told.select("conv_id", "turn", F.col("text").alias("answer"), "query", F.concat("query", F.lit(" "), F.coalesce("older", F.lit(""))).alias("context"))


query("llm_faithful", f"SELECT conv_id, turn, {SHARE('answer', 'context')} AS score FROM {CASES}")(lambda t, _: cases(t).select("conv_id", "turn", P.overlap(F.col("answer"), F.col("context")).alias("score")))
query("llm_relevancy", f"SELECT conv_id, turn, {SHARE('query', 'answer')} AS score FROM {CASES}")(lambda t, _: cases(t).select("conv_id", "turn", P.overlap(F.col("query"), F.col("answer")).alias("score")))


@query("snk_eval", f"SELECT count(*) AS total_cases, round(avg({SHARE('answer', 'context')}), 6) AS faithfulness, round(avg({SHARE('query', 'answer')}), 6) AS relevancy, count(*) AS details FROM {CASES}")
def snk_eval(t, spark):
    """The evaluation's report, summary and details as JSON lines, written and read again."""
    path = f"{shared_folder(spark)}/eval-{uuid.uuid4().hex}"
    detail = cases(t).select("conv_id", "turn", P.overlap(F.col("answer"), F.col("context")).alias("faithfulness"), P.overlap(F.col("query"), F.col("answer")).alias("relevancy"))
    detail.write.json(f"{path}/detail")
    kept = spark.read.schema(detail.schema).json(f"{path}/detail")
    kept.agg(F.count(F.lit(1)).alias("total_cases"), F.round(F.avg("faithfulness"), 6).alias("faithfulness"), F.round(F.avg("relevancy"), 6).alias("relevancy")).write.json(f"{path}/summary")
    summary = spark.read.schema("total_cases long, faithfulness double, relevancy double").json(f"{path}/summary")
    return summary.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("details"))))


# ---- research: a topic is a source, its results are its documents in order

FIRST10 = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10)"
first10 = lambda t: sets.first_per(t("documents"), "source", "doc_id", 10)
query("llm_research_qa", f"SELECT source AS topic, 'About ' || source || ': ' || string_agg(left(text, 40), ' | ' ORDER BY doc_id) AS answer FROM {FIRST10} GROUP BY source")(
    lambda t, _: first10(t).groupBy(F.col("source").alias("topic")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, 40).alias("h")))), lambda x: x["h"]), " | ").alias("h"))
    .select("topic", F.concat(F.lit("About "), "topic", F.lit(": "), "h").alias("answer"))
)
query("llm_research_analyze", "SELECT doc_id, 'Key point: ' || array_to_string(list_slice(regexp_extract_all(text, '[^.!?]+[.!?]'), 1, 1), '') AS analysis FROM documents")(
    lambda t, _: t("documents").select("doc_id", F.concat(F.lit("Key point: "), A.lead(F.col("text"), 1)).alias("analysis"))
)


@query("llm_terms", f"""SELECT topic, '["' || string_agg(word, '","' ORDER BY r) || '"]' AS terms FROM (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS r
    FROM (SELECT source AS topic, word, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS word FROM {FIRST10}) GROUP BY ALL)) WHERE r <= 5 GROUP BY topic""")
def llm_terms(t, _):
    words = first10(t).select(F.col("source").alias("topic"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word"))
    best = words.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.col("n").desc(), "word"))).where("r <= 5")
    return best.groupBy("topic").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"])).alias("terms"))


query("llm_expand", "SELECT topic, topic || ' ' || unnest(['history', 'methods', 'applications']) AS sub_topic FROM (SELECT DISTINCT source AS topic FROM documents)")(
    lambda t, _: t("documents").select(F.col("source").alias("topic")).distinct().select("topic", F.explode(F.transform(F.array(*map(F.lit, ("history", "methods", "applications"))), lambda s: F.concat("topic", F.lit(" "), s))).alias("sub_topic"))
)
PLANS = [(m, k, b, q) for m in ("deep", "wiki", "local", "arxiv") for k, (b, q) in enumerate(A.research_plan("{}", m))]
query("llm_research_plan", "SELECT r_name AS topic, mode, ord, backend, replace(q, '{}', r_name) AS query FROM region, (VALUES " + ", ".join(f"('{m}', {k}, '{b}', '{q}')" for m, k, b, q in PLANS) + ") v(mode, ord, backend, q)")(
    lambda t, _: t("region").select(F.col("r_name").alias("topic"), F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("ord"), F.lit(b).alias("backend"), F.replace(F.lit(q), F.lit("{}"), F.col("r_name")).alias("query")) for m, k, b, q in PLANS])))
)

# ---- web backends over a stub transport: the pages are the web

WEB = "(SELECT page_id AS ord, CASE WHEN page_id % 3 = 0 THEN 'https://en.wikipedia.org/wiki/P' || page_id % 50 ELSE url END AS link, 'Page ' || page_id || CASE WHEN page_id % 3 = 0 THEN ' - Wikipedia' ELSE '' END AS title FROM pages)"
transport = lambda t: web.stub_transport(t("pages"))
query("src_web_news", f"SELECT ord, link FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY ord) AS r FROM {RESULTS} WHERE source = 'news' AND link IS NOT NULL) WHERE r = 1")(
    lambda t, _: sets.first_of(results(t).where("source = 'news' AND link IS NOT NULL"), "link").select("ord", "link")
)
query("src_web_wikipedia", f"SELECT ord, link, regexp_replace(title, ' - Wikipedia$', '') AS title FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY ord) AS r FROM {WEB} WHERE contains(link, 'wikipedia.org')) WHERE r = 1")(
    lambda t, _: web.wikipedia(transport(t))
)
query("src_web_definitions", f"SELECT term, query, ord, link FROM (SELECT r_name AS term, r_name || ' definition meaning' AS query, ord, link, row_number() OVER (PARTITION BY r_name ORDER BY ord) AS r FROM region JOIN {WEB} ON ord % 7 = length(r_name || ' definition meaning') % 7) WHERE r <= 2")(
    lambda t, _: web.definitions(t("region").select(F.col("r_name").alias("term")), transport(t))
)
query("ret_arxiv", f"SELECT item_id AS query_id, ord, id, 'ArXiv' AS category FROM benchmark, (SELECT id, ord, row_number() OVER (ORDER BY ord) AS k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM {RESULTS} WHERE id IS NOT NULL) WHERE r = 1) a WHERE k <= 3")(
    lambda t, _: text_queries(t).select("query_id").crossJoin(F.broadcast(sets.first_of(results(t).where("id IS NOT NULL"), "id").orderBy("ord").limit(3).select("ord", "id"))).withColumn("category", F.lit("ArXiv"))
)
WAITED = {k: (sum(P.WAITS[: min(k + 1, 4)]), k < 4) for k in range(6)}
query("src_retry", "SELECT page_id, CASE page_id % 6 " + " ".join(f"WHEN {k} THEN {w}" for k, (w, _) in WAITED.items()) + " END AS waited, page_id % 6 < 4 AS succeeded FROM pages")(
    lambda t, _: t("pages").withColumn("c", P.retried((F.col("page_id") % 6).cast("int"))).select("page_id", "c.waited", "c.succeeded")
)
query("src_download", "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_\\s.-]', '_', 'g') || '.html' AS file_name, CASE WHEN page_id % 4 = 0 THEN 'exists' ELSE 'downloaded' END AS status FROM pages")(
    lambda t, _: web.downloads(t("pages").select("page_id", "url"), t("pages").where("page_id % 4 = 0").select("page_id"), "page_id").select("page_id", "file_name", "status")
)

# ---- the graph's refinement, in one chain

SIMILAR = f"SELECT src::VARCHAR, 'SIMILAR_TO', dst::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM {TOPK}) WHERE r <= 3 AND score > 0.3"


def refined(t):
    """Customers hold their market segment as a HAS_PROPERTY node before; orders' CONTAINS edges name the chunks that mention parts."""
    c = nodes(t).where("id LIKE 'c%'")
    made = c.select(F.concat(F.lit("x"), "id").alias("id"), F.concat(F.lit("Market Segment: "), F.col("props")["v"]).alias("name"), "labels", "props")
    held = c.select(F.concat(F.lit("h"), "id").alias("edge_id"), F.col("id").alias("src"), F.concat(F.lit("x"), "id").alias("dst"), F.lit("HAS_PROPERTY").alias("rel_type"), F.lit(None).cast("string").alias("valid_from"))
    return G.refined(nodes(t).unionByName(made), edges(t).unionByName(held), "CONTAINS", t("embeddings"))


query("g_refine", f"SELECT src, rel_type, dst FROM {EDGES} UNION ALL SELECT DISTINCT least(src, dst), 'MENTIONS', greatest(src, dst) FROM {EDGES} WHERE rel_type = 'CONTAINS' UNION ALL {SIMILAR}")(lambda t, _: refined(t)[1])
query("g_refine_nodes", f"SELECT id, name, '__Entity__,' || label AS labels, CASE WHEN label = 'Customer' THEN v END AS segment FROM {NODES}")(
    lambda t, _: refined(t)[0].select("id", "name", F.array_join("labels", ",").alias("labels"), F.try_element_at("props", F.lit("market_segment")).alias("segment"))
)


@query("cln_stream", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM (SELECT doc_id, " + SQL_TEXT + " AS text FROM documents)")
def cln_stream(t, spark):
    """Cleaning as a stream of documents, written as they come."""
    docs = t("documents")
    name, first = f"{shared_folder(spark)}/clean-{uuid.uuid4().hex}", docs.inputFiles()[0]
    source = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet" if "/documents.parquet/" not in first else "*.parquet").parquet(first.rsplit("/", 1)[0])
    out = decorated(source).select("doc_id", X.no_control(F.col("text")).alias("text"))
    out.writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(f"{name}/out")
