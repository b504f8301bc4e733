"""Queries of cleaning, identity, chunking, sources, sets and limits."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, clean, files, sets
from ..registry import query
from ..sources import html

# The documents hold few artefacts, so both sides put the same ones around every text.
BEFORE = "DRAFT copy\u0007\nPage 3 of 12\n[Page 2] kept\n- 3 -\n12 | P a g e\nX Copyright © 2020 gone\nthe T h e  r e s u l t en- \nvironment “x”…–—\n1.2.\nshort\nshort\nshort\nshort\n"
AFTER = "\nRunning head\n a b  \nRunning head\n\n\n\nRunning head \nRunning head\nAll Rights Reserved here\n internal use only\n\t "
SQL_TEXT = f"'{BEFORE.replace(chr(7), '')}' || text || '{AFTER}'".replace("DRAFT copy", "DRAFT copy' || chr(7) || '")


def decorated(docs):
    return docs.select("doc_id", F.concat(F.lit(BEFORE), "text", F.lit(AFTER)).alias("text"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def cleaning(name, fn, sql):
    query(name, f"SELECT doc_id, {sql} AS text FROM (SELECT doc_id, {SQL_TEXT} AS text FROM documents)" if sql else None)(lambda t, _: decorated(t("documents")).select("doc_id", fn(F.col("text")).alias("text")))


R = "regexp_replace({}, '{}', '{}', 'g')"
PAGES = R.format(R.format(R.format("{}", r"(?m)^[\-\s]*[Pp]age\s+\d+\s*(of\s+\d+)?[\-\s]*$", ""), r"(?m)^\s*\d+\s*\|\s*[Pp]\s*a\s*g\s*e\s*$", ""), r"(?m)^\s*-\s*\d+\s*-\s*$", "")
REPEATED = r"""(SELECT string_agg(line, chr(10) ORDER BY i) FROM (
    SELECT i, line, count(*) OVER (PARTITION BY s) AS n, s FROM (
        SELECT i, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i)))
    WHERE NOT (n >= 4 AND length(s) > 5))"""
cleaning("cln_control", X.no_control, R.format("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
cleaning("cln_dehyphen", X.dehyphenated, R.format("text", r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", r"\1\2"))
cleaning("cln_spaced", X.unspaced, None)
cleaning("cln_punct", X.plain_marks, "replace(replace(replace(replace(replace(replace(replace(text, '“', '\"'), '”', '\"'), '‘', ''''), '’', ''''), '…', '...'), '–', '-'), '—', '--')")
cleaning("cln_pagenum", X.no_page_numbers, PAGES.replace("{}", "text", 1))
cleaning("cln_legal", X.no_legal, R.format("text", r"(?i)(confidential|proprietary|all rights reserved|copyright\s+©?\s*\d{4})[^\n]*", ""))
cleaning("cln_draft", X.no_draft, R.format("text", r"(?i)\b(draft|do not distribute|internal use only)\b[^\n]*", ""))
cleaning("cln_emptynum", X.no_empty_numbers, R.format("text", r"(?m)^\s*(\d+\.)+\s*$", ""))
query("cln_repeated", f"SELECT doc_id, {REPEATED} AS text FROM (SELECT doc_id, {SQL_TEXT} AS text FROM documents)")(lambda t, _: clean.without_repeated_lines(decorated(t("documents"))))
cleaning("cln_ws", X.tidy_space, STRIP.format(R.format(R.format("text", r"(?m)[ \t\r\f\v]+$", ""), r"\n{3,}", r"\n\n").replace(r"'\n\n'", "chr(10) || chr(10)")))
query("cln_pipeline")(lambda t, _: clean.cleaned(decorated(t("documents"))))
query("cln_coref")(lambda t, s: chunking.resolve_pronouns(t("documents")).select("doc_id", "text"))


@query("agg_line_counts", r"SELECT doc_id, s AS line, count(*) AS n FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS s FROM documents) WHERE length(s) > 5 GROUP BY ALL HAVING count(*) >= 4")
def agg_line_counts(t, _):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("line", X.strip(F.col("line")))
    return lines.where(F.length("line") > 5).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


# ---- identity

PATH = "'./data/' || source || '/' || lang || '_my-doc ' || doc_id || '.v2.txt'"


def paths(docs):
    return docs.withColumn("path", F.concat(F.lit("./data/"), "source", F.lit("/"), "lang", F.lit("_my-doc "), F.col("doc_id").cast("string"), F.lit(".v2.txt")))


FILES = f"(SELECT *, {PATH} AS path, sha256(text) AS sha FROM documents)"
TRACKER = f"(SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE sha END AS sha FROM {FILES} WHERE doc_id % 5 <> 0)"


def current(docs):
    return files.hashed(paths(docs))


def tracker(docs):
    return current(docs).where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))


query("idn_sha_file", f"SELECT path, sha AS sha256 FROM {FILES}")(lambda t, _: current(t("documents")).select("path", "sha256"))
query("idn_changed", f"SELECT f.path, f.sha IS DISTINCT FROM k.sha AS changed FROM {FILES} f LEFT JOIN {TRACKER} k USING (path)")(lambda t, _: files.changed(current(t("documents")), tracker(t("documents"))).select("path", "changed"))
query("idn_dirty", f"SELECT f.path FROM {FILES} f LEFT JOIN {TRACKER} k USING (path) WHERE f.sha IS DISTINCT FROM k.sha")(lambda t, _: files.dirty(current(t("documents")), tracker(t("documents"))).select("path"))
query("idn_dirty_dir", f"SELECT f.path FROM {FILES} f LEFT JOIN {TRACKER} k USING (path) WHERE f.sha IS DISTINCT FROM k.sha AND (f.path LIKE '%.txt' OR f.path LIKE '%.pdf')")(lambda t, _: files.dirty(current(t("documents")), tracker(t("documents"))).where("path LIKE '%.txt' OR path LIKE '%.pdf'").select("path"))
query("idn_guardrail_regen", f"SELECT f.path FROM {FILES} f LEFT JOIN {TRACKER} k USING (path) WHERE f.sha IS NOT DISTINCT FROM k.sha AND source IN ('src1', 'src2', 'src3')")(
    lambda t, s: files.to_regenerate(current(t("documents")).withColumn("category", X.category(F.col("path"))), tracker(t("documents")), s.createDataFrame([("src1", "b"), ("src2", "b"), ("src3", "b"), ("src4", "a")], "category string, sha256 string"), s.createDataFrame([("src1", "a"), ("src2", "a"), ("src4", "a")], "category string, sha256 string")).select("path")
)
query("idn_summary_key", f"SELECT path, substr(sha256(path), 1, 24) AS summary_key FROM {FILES}")(lambda t, _: paths(t("documents")).select("path", F.substring(F.sha2("path", 256), 1, 24).alias("summary_key")))
query("idn_category", f"SELECT path, source AS category FROM {FILES} UNION ALL SELECT 'x', 'general'")(lambda t, s: paths(t("documents")).select("path").unionByName(s.createDataFrame([("x",)], "path string")).select("path", X.category(F.col("path")).alias("category")))
query("idn_title", f"SELECT path, upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || ' My Doc ' || doc_id || '.V2' AS title FROM {FILES}")(lambda t, _: paths(t("documents")).select("path", X.title(F.col("path")).alias("title")))
query("idn_entity_id", "SELECT DISTINCT p_name, lower(replace(p_name, ' ', '_')) AS id FROM part")(lambda t, _: t("part").select("p_name", X.entity_id(F.col("p_name")).alias("id")).distinct())
query("idn_exact_key", r"SELECT c_custkey, replace(lower(regexp_replace(' ' || c_name || chr(9), '^\s+|\s+$', '', 'g')), ' ', '_') AS key FROM customer")(lambda t, _: t("customer").select("c_custkey", X.exact_key(F.concat(F.lit(" "), "c_name", F.lit("\t"))).alias("key")))
query("idn_safe_topic", r"SELECT item_id, regexp_replace(text, '[^\p{L}\p{N}]', '_', 'g') AS topic FROM benchmark")(lambda t, _: t("benchmark").select("item_id", X.safe_topic(F.col("text")).alias("topic")))
query("idn_sanitize_fn", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_\s.-]', '_', 'g') AS name FROM pages")(lambda t, _: t("pages").select("page_id", X.safe_file_name(F.col("url")).alias("name")))
query("idn_dim_check", "SELECT len(embedding)::INT AS dim, count(*) AS n, len(embedding) = 64 AS fits FROM embeddings GROUP BY ALL")(lambda t, _: t("embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).withColumn("fits", F.col("dim") == 64))

# ---- chunks

query("chk_tokens", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS n_tokens FROM documents")(lambda t, _: t("documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens")))
query("chk_sections")(lambda t, _: chunking.sections(t("documents")).select("doc_id", "pos", "section", "page", "text"))
query("chk_title", "SELECT doc_id, 'Document Title: ' || source || chr(10) || chr(10) || text AS text FROM documents")(lambda t, _: t("documents").select("doc_id", chunking.with_title(F.col("text"), F.col("source")).alias("text")))
query("chk_prefix", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN '[Document Summary: ' || substr(text, 1, 40) || ']' || chr(10) || chr(10) ELSE '' END || text AS text FROM documents")(
    lambda t, _: t("documents").select("doc_id", chunking.with_summary(F.col("text"), F.when(F.col("n_chars") % 2 == 0, F.substring("text", 1, 40))).alias("text"))
)
query("chk_recursive")(lambda t, _: chunking.big_chunks(t("documents")).select("chunk_id", "doc_id", "ord", "section_title", "page_number", "text"))
query("chk_children")(lambda t, _: chunking.children(chunking.big_chunks(t("documents"))).select("chunk_id", "parent_id", "ord", "text"))
query("chk_sentence")(lambda t, _: chunking.sentence_chunks(t("documents"), 128, 16).select("doc_id", "ord", "text"))
query("chk_semantic")(lambda t, _: chunking.semantic_chunks(t("documents")).select("doc_id", "ord", "text"))
query("chk_agentic", r"""SELECT doc_id, CASE WHEN length(text) <= 1000 THEN length(text) WHEN instr(substr(text, 801, 400), chr(10)) > 0 THEN 800 + instr(substr(text, 801, 400), chr(10)) - 1 ELSE 1000 END::INT AS cut FROM documents""")(
    lambda t, _: t("documents").select("doc_id", chunking.split_place(F.col("text"), 1000).alias("cut"))
)

# ---- sources

query("src_html")(lambda t, _: html.sections(t("pages")).select("page_id", "pos", "level", "section_title", "html_title", "text"))
query("src_html_title", "SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")(lambda t, _: t("pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title")))
query("src_scrape")(lambda t, _: html.main_text(t("pages")).select("page_id", "file_name", "text"))
query("src_table_md", "SELECT '| ' || string_agg(n_name, ' | ' ORDER BY n_nationkey) || ' |' || chr(10) || '| ' || string_agg('---', ' | ') || ' |' || chr(10) || '| ' || string_agg('r' || n_regionkey, ' | ' ORDER BY n_nationkey) || ' |' AS md FROM nation")(
    lambda t, _: t("nation").groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("r"))
    .select(files.table_markdown(F.array(F.transform("r", lambda x: x["n_name"]), F.transform("r", lambda x: F.concat(F.lit("r"), x["n_regionkey"].cast("string"))))).alias("md"))
)
query("src_reading_order")(lambda t, _: files.reading_order(t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_extendedprice").alias("top"), F.col("l_quantity").alias("x0"), F.col("l_linenumber").cast("string").alias("text"))))
LISTED = f"(SELECT doc_id, {PATH} AS path FROM documents UNION ALL SELECT doc_id, 'a/' || doc_id || (CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.png' ELSE '.zip' END) FROM documents)"


def listed(t):
    d = t("documents")
    kinds = F.element_at(F.array(*map(F.lit, (".PDF", ".pdf", ".png", ".zip"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return paths(d).select("doc_id", "path").unionByName(d.select("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string"), kinds).alias("path")))


query("src_discover", f"SELECT path FROM {LISTED} WHERE regexp_matches(path, '[.](txt|pdf|docx|md)$')")(lambda t, _: files.discovered(listed(t)).select("path"))
query("src_dispatch", f"SELECT path, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.png' THEN 'image' WHEN lower(path) LIKE '%.txt' THEN 'text' ELSE 'default' END AS loader FROM {LISTED}")(lambda t, _: listed(t).select("path", files.loader(F.col("path")).alias("loader")))
query("src_scan_ingest", f"SELECT path FROM {LISTED} WHERE regexp_matches(lower(path), '[.](txt|pdf|png)$') AND doc_id % 4 <> 2 AND doc_id % 7 <> 0")(
    lambda t, _: files.to_ingest(
        listed(t).withColumn("sha256", F.sha2("path", 256)),
        listed(t).where("doc_id % 4 = 2").select("path", F.lit("done").alias("status")),
        listed(t).where("doc_id % 7 = 0").select("path", F.sha2("path", 256).alias("sha256")),
    ).select("path")
)

# ---- research results: pages stand for found links, some twice, some without a link

RESULTS = "(SELECT page_id AS ord, CASE WHEN page_id % 4 = 0 THEN 'id' || page_id % 40 END AS id, CASE WHEN page_id % 4 <> 3 THEN 'l' || page_id % 60 END AS link, CASE page_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'arxiv' ELSE 'news' END AS source FROM pages)"
DEDUP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(id, link) ORDER BY ord) AS rn FROM {RESULTS} WHERE coalesce(id, link) IS NOT NULL) WHERE rn = 1)"


def results(t):
    p, n = t("pages"), F.col("page_id")
    return p.select(
        n.alias("ord"), F.when(n % 4 == 0, F.concat(F.lit("id"), (n % 40).cast("string"))).alias("id"), F.when(n % 4 != 3, F.concat(F.lit("l"), (n % 60).cast("string"))).alias("link"),
        F.when(n % 3 == 0, "web").when(n % 3 == 1, "arxiv").otherwise("news").alias("source"),
    )


query("set_dedup_results", f"SELECT ord, id, link FROM {DEDUP}")(lambda t, _: sets.first_wins(results(t)).select("ord", "id", "link"))
query("src_arxiv", f"SELECT ord, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM {RESULTS} WHERE id IS NOT NULL) WHERE r = 1")(lambda t, _: sets.first_of(results(t).where("id IS NOT NULL"), "id").select("ord", "id"))
query("src_web", f"SELECT ord, link FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY ord) AS r FROM {RESULTS} WHERE link IS NOT NULL) WHERE r = 1")(lambda t, _: sets.first_of(results(t).where("link IS NOT NULL"), "link").select("ord", "link"))
query("set_combine", f"""WITH kept AS (SELECT * FROM {DEDUP} WHERE ord % 2 = 0), cur AS (SELECT * FROM {DEDUP} WHERE ord % 3 = 0)
    SELECT ord, id, link FROM kept UNION ALL SELECT ord, id, link FROM cur WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.link = cur.link) AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.id = cur.id)""")(
    lambda t, _: sets.combined(sets.first_wins(results(t)).where("ord % 2 = 0"), sets.first_wins(results(t)).where("ord % 3 = 0")).select("ord", "id", "link")
)
query("set_union_modes", f"SELECT source, count(*) AS n FROM {DEDUP} GROUP BY source")(
    lambda t, _: sets.first_wins(sets.union_modes(*[results(t).where(F.col("source") == s) for s in ("arxiv", "web", "news")])).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
)
query("agg_by_source", f"SELECT upper(substr(source, 1, 1)) || substr(source, 2) AS source, count(*) AS n, string_agg(coalesce(id, link), ',' ORDER BY ord) AS items FROM {DEDUP} GROUP BY source")(lambda t, _: sets.by_source(sets.first_wins(results(t))))
query("snk_report_md", f"SELECT '## ' || upper(substr(source, 1, 1)) || substr(source, 2) || chr(10) || string_agg('- ' || coalesce(id, link), chr(10) ORDER BY ord) AS section FROM {DEDUP} GROUP BY source")(lambda t, _: sets.report_sections(sets.first_wins(results(t))).select("section"))
query("snk_tree_report", f"SELECT string_agg('- ' || coalesce(id, link), chr(10) ORDER BY ord) AS section FROM (SELECT * FROM {DEDUP} ORDER BY ord LIMIT 10)")(lambda t, _: sets.tree_report(sets.first_wins(results(t))))
query("agg_files_by_cat", f"SELECT coalesce(c.category, 'general') AS category, count(*) AS n, min(path) AS first_path FROM {FILES} f LEFT JOIN (SELECT path, source AS category FROM {FILES} WHERE doc_id % 2 = 0) c USING (path) GROUP BY 1")(
    lambda t, _: sets.files_by_category(paths(t("documents")), paths(t("documents")).where("doc_id % 2 = 0").select("path", F.col("source").alias("category")))
)
STATUS = "(SELECT event_type AS path, ts, event_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'error' END AS status FROM events)"


def status_log(t):
    e = t("events")
    return e.select(F.col("user_id").cast("string").alias("path"), "ts", "event_id", F.element_at(F.array(*map(F.lit, ("pending", "processing", "done", "error"))), (F.col("event_id") % 4 + 1).cast("int")).alias("status"))


query("agg_status", f"SELECT status, count(*) AS n FROM {STATUS} GROUP BY status")(lambda t, _: status_log(t).groupBy("status").agg(F.count(F.lit(1)).alias("n")))
query("inc_state_machine", "SELECT path, status FROM (SELECT user_id::VARCHAR AS path, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'error' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")(
    lambda t, _: sets.latest(status_log(t), "path", "ts", "event_id").select("path", "status")
)
query("agg_eval", "SELECT count(*) AS cases, round(avg(quality), 6) AS faithfulness, round(avg(1 - toxic), 6) AS relevancy, round(avg(CASE WHEN doc_id % 2 = 0 THEN quality * 0.5 ELSE 0 END), 6) AS similarity, round(avg(doc_id % 7), 6) AS latency FROM labels")(
    lambda t, _: sets.evaluation(t("labels").select(F.col("quality").alias("faithfulness"), (1 - F.col("toxic")).alias("relevancy"), F.when(F.col("doc_id") % 2 == 0, F.col("quality") * 0.5).alias("similarity"), (F.col("doc_id") % 7).alias("latency")))
)
query("lim_sample5", f"SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY source ORDER BY path) AS r FROM {FILES}) WHERE r <= 5")(lambda t, _: sets.first_per(paths(t("documents")), "source", "path", 5).select("path"))
query("lim_budget", "SELECT doc_id, substr(text, 1, greatest(500, 3000 - before)) AS snippet FROM (SELECT doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before < 3000")(
    lambda t, _: sets.within_budget(t("documents"), "source", "doc_id", 3000, 500).select("doc_id", "snippet")
)
query("lim_history", "SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id")(lambda t, _: sets.last_turns(t("conversations")))
query("lim_grade_ctx", "SELECT conv_id, string_agg(substr(text, 1, 60), chr(10) || '---' || chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id")(
    lambda t, _: t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c")).select("conv_id", sets.capped(F.transform("c", lambda x: x["text"]), 6, 60).alias("context"))
)
query("srt_shortest", "SELECT p_name FROM (SELECT DISTINCT p_name FROM part) ORDER BY length(p_name), p_name LIMIT 10")(lambda t, _: t("part").select("p_name").distinct().orderBy(F.length("p_name"), "p_name").limit(10))
query("fn_scalars", """SELECT event_id, json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(epoch(ts))::BIGINT AS epoch_s, upper(event_type) AS up, left(event_type, 3) AS head,
    split_part(event_type, '_', 1) AS part, sha256(event_type) AS sha, round(value, 1) AS r, greatest(value, 0) AS g FROM events""")(
    lambda t, _: t("events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp("ts").alias("epoch_s"), F.upper("event_type").alias("up"), F.substring("event_type", 1, 3).alias("head"),
        F.get(F.split("event_type", "_", 2), 0).alias("part"), F.sha2("event_type", 256).alias("sha"), F.round("value", 1).alias("r"), F.greatest("value", F.lit(0.0)).alias("g"),
    )
)
query("fn_json_slice")(lambda t, _: t("benchmark").select("item_id", sets.largest_json(F.concat(F.lit("```json\n{\"a\": "), F.col("item_id").cast("string"), F.lit("}\n```"))).alias("json"), sets.parsed_flag(F.concat(F.lit('noise {"relevant": true, "reason": "ok"} tail')), "relevant").alias("flag")))
query("conv_crud", "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, min(CASE WHEN turn = 0 THEN left(text, 40) || CASE WHEN length(text) > 40 THEN '...' ELSE '' END END) AS title FROM conversations GROUP BY conv_id")(lambda t, _: sets.conversation_list(t("conversations")))
query("conv_retry", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1")(
    lambda t, _: sets.latest(t("conversations").where("role = 'user'"), "conv_id", "turn").select("conv_id", "turn", "text")
)
