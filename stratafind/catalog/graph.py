"""Queries of the property graph, entity resolution and communities."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G, resolve as E, sets
from ..registry import query

NODES = """(SELECT 'r' || r_regionkey AS id, r_name AS name, 'Region' AS label, r_regionkey::VARCHAR AS v FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation', n_regionkey::VARCHAR FROM nation
    UNION ALL SELECT 'c' || c_custkey, c_name, 'Customer', c_mktsegment FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'Supplier', s_nationkey::VARCHAR FROM supplier
    UNION ALL SELECT 'p' || p_partkey, p_name, 'Part', p_brand FROM part UNION ALL SELECT 'o' || o_orderkey, 'Order#' || o_orderkey, 'Order', o_orderstatus FROM orders)"""
EDGES = """(SELECT 'PART_OF:n' || n_nationkey || '>r' || n_regionkey AS edge_id, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS rel_type, NULL::VARCHAR AS valid_from FROM nation
    UNION ALL SELECT 'LOCATED_IN:c' || c_custkey || '>n' || c_nationkey, 'c' || c_custkey, 'n' || c_nationkey, 'LOCATED_IN', NULL FROM customer
    UNION ALL SELECT 'LOCATED_IN:s' || s_suppkey || '>n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'LOCATED_IN', NULL FROM supplier
    UNION ALL SELECT 'PLACED:c' || o_custkey || '>o' || o_orderkey, 'c' || o_custkey, 'o' || o_orderkey, 'PLACED', o_orderdate::DATE::VARCHAR FROM orders
    UNION ALL SELECT 'CONTAINS:o' || l_orderkey || '>p' || l_partkey || '#' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS', NULL FROM lineitem
    UNION ALL SELECT 'SUPPLIED_BY:p' || l_partkey || '>s' || l_suppkey || '#' || l_orderkey || '.' || l_linenumber, 'p' || l_partkey, 's' || l_suppkey, 'SUPPLIED_BY', NULL FROM lineitem)"""
BOTH = f"(SELECT * FROM {EDGES} UNION ALL SELECT edge_id, dst, src, rel_type, valid_from FROM {EDGES} WHERE src <> dst)"
DEGREE = f"(SELECT src AS id, count(*) AS degree FROM {BOTH} GROUP BY src)"

nodes = lambda t: G.from_star(t)[0]
edges = lambda t: G.from_star(t)[1]

query("g_nodes_fetch", f"SELECT id, name FROM {NODES} WHERE trim(name) <> ''")(lambda t, _: G.named(nodes(t)).select("id", "name"))
query("g_edges_fetch", f"SELECT edge_id, src, dst, rel_type, valid_from FROM {EDGES}")(lambda t, _: edges(t).select("edge_id", "src", "dst", "rel_type", "valid_from"))
query("g_nx_nodes", f"SELECT id FROM {NODES}")(lambda t, _: G.named(nodes(t)).select("id"))
query("g_nx_edges", f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, max_by(rel_type, edge_id) AS rel_type FROM {EDGES} WHERE src <> dst GROUP BY 1, 2")(lambda t, _: G.simple(nodes(t), edges(t)))
query("g_existing_entities", f"SELECT DISTINCT coalesce(name, label) AS entity FROM {NODES}")(lambda t, _: nodes(t).select(F.coalesce("name", F.get("labels", 0)).alias("entity")).distinct())
query("g_degree", f"SELECT id, degree FROM {DEGREE}")(lambda t, _: G.degrees(edges(t)))
query("g_rel_types", f"SELECT DISTINCT src AS id, rel_type FROM {BOTH}")(lambda t, _: G.both_ways(edges(t)).select(F.col("src").alias("id"), "rel_type").distinct())
HOP2 = f"""(WITH b AS MATERIALIZED {BOTH}, s AS (SELECT id FROM {NODES} WHERE name = (SELECT min(n_name) FROM nation)),
    h1 AS (SELECT s.id AS seed, b.dst AS id, b.edge_id, b.rel_type, b.valid_from FROM s JOIN b ON b.src = s.id),
    h2 AS (SELECT h1.seed, b.dst AS id, h1.rel_type || '>' || b.rel_type AS rel_type, h1.valid_from FROM h1 JOIN b ON b.src = h1.id AND b.edge_id <> h1.edge_id)
    SELECT DISTINCT seed, x.id, hop, x.rel_type AS rel_types, x.valid_from, n.name FROM (SELECT seed, id, 1 AS hop, rel_type, valid_from FROM h1 UNION ALL SELECT seed, id, 2, rel_type, valid_from FROM h2) x JOIN {NODES} n USING (id) WHERE x.id NOT IN (SELECT id FROM s))"""
seeds = lambda t: t("nation").agg(F.min("n_name").alias("name"))
query("g_nhop", f"SELECT seed, id, hop, rel_types, valid_from, name FROM {HOP2}")(lambda t, _: G.expand(nodes(t), edges(t), seeds(t), 2, None))
query("g_nhop_limited", f"SELECT seed, id, hop, rel_types, valid_from, name FROM {HOP2} WHERE hop = 1 ORDER BY hop, name, seed, rel_types LIMIT 20")(lambda t, _: G.expand(nodes(t), edges(t), seeds(t), 1, 20))
query("lim_profiles", f"SELECT '[' || CASE hop WHEN 1 THEN 'Direct' ELSE 'Related' END || '] ' || name || ' (' || rel_types || ')' AS line FROM {HOP2} ORDER BY hop, name, rel_types, id LIMIT 30")(
    lambda t, _: G.expand(nodes(t), edges(t), seeds(t), 2, None).orderBy("hop", "name", "rel_types", "id").limit(30)
    .select(F.concat(F.lit("["), F.when(F.col("hop") == 1, F.lit("Direct")).otherwise(F.lit("Related")), F.lit("] "), "name", F.lit(" ("), "rel_types", F.lit(")")).alias("line"))
)
query("ret_suggest", f"SELECT 'Tell me about ' || name AS suggestion FROM (SELECT name, row_number() OVER (ORDER BY degree DESC, name, id) AS r FROM {DEGREE} JOIN {NODES} USING (id)) WHERE r <= 4")(
    lambda t, _: G.degrees(edges(t)).join(G.named(nodes(t)), "id").orderBy(F.col("degree").desc(), "name", "id").limit(4).select(F.concat(F.lit("Tell me about "), "name").alias("suggestion"))
)

# supplier edges of parts with props: the stated material for merging
SUP = "(SELECT 'e' || lpad((l_orderkey * 10 + l_linenumber)::VARCHAR, 12, '0') AS edge_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'SUPPLIED_BY' ELSE 'SUPPLIED BY' END AS rel_type, l_quantity::INT::VARCHAR AS q FROM lineitem)"


def supplied(t):
    return t("lineitem").select(
        F.concat(F.lit("e"), F.lpad((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), 12, "0")).alias("edge_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.when(F.col("l_linenumber") % 2 == 0, "SUPPLIED_BY").otherwise("SUPPLIED BY").alias("rel_type"), F.create_map(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("props"),
    )


merged = lambda df: df.select("src", "dst", "rel_type", "edge_id", F.col("props")["q"].alias("q"))
query("g_merge_dup_edges", f"SELECT src, dst, rel_type, min(edge_id) AS edge_id, max_by(q, edge_id) AS q FROM {SUP} GROUP BY ALL")(lambda t, _: merged(G.merge_parallel(supplied(t))))
query("g_merge_types", f"SELECT src, dst, 'SUPPLIED_BY' AS rel_type, min(edge_id) AS edge_id, max_by(q, edge_id) AS q FROM {SUP} GROUP BY src, dst")(lambda t, _: merged(G.merge_parallel(supplied(t).withColumn("rel_type", F.lit("SUPPLIED_BY")))))
REMAP = "(SELECT 'p' || p_partkey AS dup, 'p' || (p_partkey - p_partkey % 5) AS canon FROM part WHERE p_partkey % 5 <> 0)"
remap = lambda t: t("part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("dup"), F.concat(F.lit("p"), (F.col("p_partkey") - F.col("p_partkey") % 5).cast("string")).alias("canon"))
query("g_move_edges", f"SELECT coalesce(canon, src) AS src, dst, rel_type, min(edge_id) AS edge_id, max_by(q, edge_id) AS q FROM {SUP} LEFT JOIN {REMAP} r ON src = dup GROUP BY 1, 2, 3")(lambda t, _: merged(G.move_edges(supplied(t), remap(t))))
PN = "(SELECT 'p' || p_partkey AS id, p_name AS name, p_brand AS v, p_partkey FROM part)"
part_nodes = lambda t: nodes(t).where("id LIKE 'p%'")
query("g_merge_props", f"SELECT coalesce(canon, id) AS id, max(CASE WHEN canon IS NULL THEN name END) AS name, max_by(v, (canon IS NOT NULL)::INT::VARCHAR || id) AS v FROM {PN} LEFT JOIN {REMAP} r ON id = dup GROUP BY 1")(lambda t, _: G.merge_props(part_nodes(t), remap(t)).select("id", "name", F.col("props")["v"].alias("v")))
query("er_merge", f"SELECT (SELECT count(DISTINCT coalesce(canon, id)) FROM {PN} LEFT JOIN {REMAP} r ON id = dup) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT coalesce(canon, src) AS s, dst, rel_type FROM {SUP} LEFT JOIN {REMAP} r ON src = dup)) AS n_edges")(
    lambda t, _: G.merge_props(part_nodes(t), remap(t)).agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(G.move_edges(supplied(t), remap(t)).agg(F.count(F.lit(1)).alias("n_edges"))))
)
query("er_exact", "SELECT replace(lower(p_name), ' ', '_') AS key, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")(lambda t, _: t("part").groupBy(X.exact_key(F.col("p_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1"))
query("er_canonical", f"SELECT cluster, id FROM (SELECT v AS cluster, id, row_number() OVER (PARTITION BY v ORDER BY 10 * coalesce(degree, 0) + 2 DESC, length(name), id) AS r FROM {NODES} LEFT JOIN {DEGREE} USING (id) WHERE label = 'Customer') WHERE r = 1")(
    lambda t, _: G.canonical(nodes(t).where("id LIKE 'c%'").select(F.col("props")["v"].alias("cluster"), "id"), nodes(t).join(G.degrees(edges(t)), "id", "left").select("id", "name", (10 * F.coalesce("degree", F.lit(0)) + F.size("props")).alias("score")))
)
query("er_semantic")(lambda t, _: E.star_clusters(t("embeddings").select(F.col("label").alias("block"), F.col("vec_id").alias("id"), F.lit("").alias("name"), "embedding"), 0.35))
query("er_lexical")(lambda t, _: E.star_clusters(t("part").select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.lit(1.0)).alias("embedding")), 0.85, "lexical"))
query("er_reltypes")(lambda t, s: E.star_clusters(supplied(t).select("rel_type").distinct().select(F.lit(0).alias("block"), F.col("rel_type").alias("id"), F.replace("rel_type", F.lit("_"), F.lit(" ")).alias("name"), F.array(F.lit(1.0)).alias("embedding")), 0.85, "lexical"))


def cleaned(t):
    """Parts and their suppliers' edges after a whole clean-up; the vectors of some parts are those of their number."""
    parts = part_nodes(t).withColumn("labels", F.array(F.lit("__Entity__"), F.col("props")["v"]))
    vectors = t("embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return G.cleanup(parts, supplied(t), lambda held: held.select("id").join(vectors, "id", "left_semi").join(vectors, "id"), 0.85)


query("er_cleanup")(lambda t, _: merged(cleaned(t)[1]))
query("er_cleanup_nodes")(lambda t, _: cleaned(t)[0].select("id", "name", F.array_join("labels", ",").alias("labels"), F.col("props")["v"].alias("v")))


query("g_mentions", f"SELECT DISTINCT least(src, dst) AS chunk, greatest(src, dst) AS entity, 'MENTIONS' AS rel_type FROM {EDGES} WHERE rel_type = 'CONTAINS'")(
    lambda t, _: edges(t).where("rel_type = 'CONTAINS'").select(F.least("src", "dst").alias("chunk"), F.greatest("src", "dst").alias("entity"), F.lit("MENTIONS").alias("rel_type")).distinct()
)


@query("g_has_property", "SELECT 'c' || c_custkey AS id, c_mktsegment AS segment, 'ab_1' AS other FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'c' || c_custkey, NULL, NULL FROM customer WHERE c_custkey % 2 = 1")
def g_has_property(t, _):
    c = nodes(t).where("id LIKE 'c%'")
    even = F.pmod(F.expr("cast(substring(id, 2) AS long)"), F.lit(2)) == 0
    p = c.where(even)
    made = [p.select(F.concat(F.lit(f"x{k}"), "id").alias("id"), name.alias("name"), "labels", "props") for k, name in enumerate((F.concat(F.lit("Market Segment!: "), F.col("props")["v"]), F.lit("Other : ab_1"), F.lit("no colon"), F.lit("Id: 7")))]
    held = [p.select(F.concat(F.lit(f"h{k}"), "id").alias("edge_id"), F.col("id").alias("src"), F.concat(F.lit(f"x{k}"), "id").alias("dst"), F.lit("HAS_PROPERTY").alias("rel_type")) for k in range(4)]
    all_nodes, all_edges = c, held[0]
    for x in made:
        all_nodes = all_nodes.unionByName(x)
    for x in held[1:]:
        all_edges = all_edges.unionByName(x)
    folded, _left = G.fold_properties(all_nodes, all_edges)
    get = lambda k: F.try_element_at("props", F.lit(k))
    return folded.select("id", get("market_segment").alias("segment"), get("other").alias("other"))


query("g_labels", f"SELECT id, '__Entity__,' || label AS labels FROM {NODES}")(lambda t, _: nodes(t).select("id", F.array_join(F.array_union(F.array(F.lit("__Entity__")), F.array(F.col("props")["kind"])), ",").alias("labels")))
query("g_category_stamp", f"SELECT id, CASE WHEN v IN ('BUILDING', 'O', '') THEN 'general' ELSE v END AS category FROM {NODES}")(lambda t, _: nodes(t).select("id", F.when(F.col("props")["v"].isin("BUILDING", "O", ""), F.lit("general")).otherwise(F.col("props")["v"]).alias("category")))
query("g_category_node", "SELECT 'c' || c_custkey AS src, 'cat:' || c_mktsegment AS dst, 'BELONGS_TO' AS rel_type FROM customer WHERE c_custkey % 3 <> 0")(
    lambda t, _: G.missing_members(
        nodes(t).where("id LIKE 'c%'").select(F.col("id").alias("src"), F.concat(F.lit("cat:"), F.col("props")["v"]).alias("dst")),
        t("customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("cat:"), "c_mktsegment").alias("dst"), F.lit("BELONGS_TO").alias("rel_type")), "BELONGS_TO",
    )
)
MEMBERS = "(SELECT 'n' || n_nationkey AS id, n_name AS name, n_regionkey AS community_id FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def members(t):
    n, s = t("nation"), t("supplier")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("community_id")).unionByName(
        s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("n_regionkey").alias("community_id"))
    )


query("g_stamp_community", f"SELECT n.id, coalesce(community_id, -1) AS community_id FROM {NODES} n LEFT JOIN {MEMBERS} m USING (id)")(lambda t, _: nodes(t).select("id").join(members(t).select("id", "community_id"), "id", "left").select("id", F.coalesce("community_id", F.lit(-1)).alias("community_id")))
query("com_sizes", f"SELECT community_id, count(*) AS n FROM {MEMBERS} GROUP BY 1 ORDER BY n DESC, community_id LIMIT 5")(lambda t, _: members(t).groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "community_id").limit(5))
query("com_members", f"SELECT a.community_id, e.src, e.dst, e.rel_type FROM {EDGES} e JOIN {MEMBERS} a ON a.id = e.src JOIN {MEMBERS} b ON b.id = e.dst AND a.community_id = b.community_id")(
    lambda t, _: edges(t).join(members(t).select(F.col("id").alias("src"), "community_id"), "src").join(members(t).select(F.col("id").alias("dst"), "community_id"), ["dst", "community_id"]).select("community_id", "src", "dst", "rel_type")
)
SUMMARY = f"(SELECT community_id, least(count(DISTINCT name), 50)::INT AS entity_count, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 10), ', ') AS key_entities FROM {MEMBERS} GROUP BY community_id HAVING count(*) >= 3)"


def summaries(t):
    """Fifty names of a community at most are gathered: the first ones, which are picked before."""
    sizes = members(t).groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    first = sets.first_per(members(t).select("community_id", "name").distinct(), "community_id", "name", 50)
    made = first.groupBy("community_id").agg(F.array_sort(F.collect_list("name")).alias("names")).join(sizes, "community_id")
    return made.select("community_id", F.size("names").alias("entity_count"), F.array_join(F.slice("names", 1, 10), ", ").alias("key_entities"))


def summary_text():
    return F.concat(F.lit("Community of "), F.col("entity_count").cast("string"), F.lit(" entities: "), F.substring("key_entities", 1, 200))


query("com_summary", f"SELECT community_id, entity_count, key_entities, 'Community of ' || entity_count || ' entities: ' || substr(key_entities, 1, 200) AS summary FROM {SUMMARY}")(lambda t, _: summaries(t).withColumn("summary", summary_text()))
query("com_docs", f"SELECT 'community_' || community_id AS doc_id, 'Community of ' || entity_count || ' entities: ' || substr(key_entities, 1, 200) AS text FROM {SUMMARY}")(lambda t, _: summaries(t).select(F.concat(F.lit("community_"), F.col("community_id").cast("string")).alias("doc_id"), summary_text().alias("text")))
query("g_all_summaries", f"SELECT community_id, entity_count, row_number() OVER (ORDER BY entity_count DESC, community_id)::INT AS ord FROM {SUMMARY}")(lambda t, _: G.numbered(summaries(t).select("community_id", "entity_count"), F.col("entity_count").desc(), "community_id"))
query("g_upsert_community", f"SELECT community_id, CASE WHEN community_id < 2 THEN entity_count ELSE 0 END AS entity_count FROM {SUMMARY}")(
    lambda t, _: G.upsert(summaries(t).select("community_id", F.lit(0).alias("entity_count")), summaries(t).where("community_id < 2").select("community_id", "entity_count"), "community_id")
)
query("g_member_of", f"SELECT id AS src, 'com' || community_id AS dst, 'MEMBER_OF' AS rel_type FROM {MEMBERS} WHERE community_id <> 0")(
    lambda t, _: G.missing_members(members(t).select(F.col("id").alias("src"), F.concat(F.lit("com"), F.col("community_id").cast("string")).alias("dst")), members(t).where("community_id = 0").select(F.col("id").alias("src"), F.lit("com0").alias("dst"), F.lit("MEMBER_OF").alias("rel_type")), "MEMBER_OF")
)
query("g_counts", f"SELECT (SELECT count(*) FROM {NODES}) AS n_nodes, (SELECT count(*) FROM {EDGES}) AS n_edges, (SELECT count(DISTINCT community_id) FROM {MEMBERS}) AS n_communities")(
    lambda t, _: nodes(t).agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(F.broadcast(edges(t).agg(F.count(F.lit(1)).alias("n_edges")))).crossJoin(F.broadcast(members(t).agg(F.countDistinct("community_id").alias("n_communities"))))
)
query("adm_stats", f"SELECT label, count(*) AS n FROM {NODES} GROUP BY label")(lambda t, _: nodes(t).groupBy(F.get("labels", 0).alias("label")).agg(F.count(F.lit(1)).alias("n")))
query("g_sanitize", "SELECT src, dst FROM (SELECT 'p' || l_partkey AS src, CASE WHEN l_linenumber > 1 THEN 's' || l_suppkey END AS dst FROM lineitem) WHERE dst IS NOT NULL")(
    lambda t, _: G.sanitized(t("lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("dst")))
)
# every edge type at once: the star schema hangs together through nations, so its parts are those of the regions
query("com_wcc", f"""WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT src, dst FROM {BOTH}), reach(node, root) AS (SELECT DISTINCT src, (SELECT min(src) FROM b) FROM b WHERE src = (SELECT min(src) FROM b) UNION SELECT b.dst, r.root FROM reach r JOIN b ON b.src = r.node)
    SELECT count(*) AS nodes, min(node) AS component FROM reach""")(lambda t, _: largest(G.components(edges(t).select(F.col("src").alias("a"), F.col("dst").alias("b")))))


def largest(found):
    """Size and name of the component of the smallest node."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.orderBy("component").limit(1).select("nodes", "component")


query("com_louvain")(lambda t, _: G.louvain(edges(t).select(F.col("src").alias("a"), F.col("dst").alias("b"))))
query("sim_jaccard_cat", """WITH s AS (SELECT c_nationkey AS cat, list(DISTINCT c_mktsegment) AS objects, list(DISTINCT (c_custkey % 7)::VARCHAR) AS rels FROM customer GROUP BY 1)
    SELECT * FROM (SELECT a.cat, b.cat AS other, round((len(list_intersect(a.objects, b.objects)) / len(list_distinct(list_concat(a.objects, b.objects))) + len(list_intersect(a.rels, b.rels)) / len(list_distinct(list_concat(a.rels, b.rels)))) / 2, 6) AS score FROM s a JOIN s b ON a.cat <> b.cat) WHERE score >= 0.3""")(
    lambda t, _: similar_categories(t("customer").groupBy(F.col("c_nationkey").alias("cat")).agg(F.collect_set("c_mktsegment").alias("objects"), F.collect_set((F.col("c_custkey") % 7).cast("string")).alias("rels")))
)


def similar_categories(sets, least=0.3):
    """cat, other, score: categories whose objects and relations overlap; pairs meet on a shared member, not in a cross join."""
    jaccard = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    held = sets.withColumn("m", F.explode(F.array_union(F.transform("objects", lambda x: F.concat(F.lit("o"), x)), F.transform("rels", lambda x: F.concat(F.lit("r"), x)))))
    pairs = held.select("cat", "m").join(held.select(F.col("cat").alias("other"), "m"), "m").where("cat <> other").select("cat", "other").distinct()
    both = pairs.join(sets, "cat").join(sets.select(F.col("cat").alias("other"), F.col("objects").alias("o2"), F.col("rels").alias("r2")), "other")
    return both.select("cat", "other", F.round((jaccard("objects", "o2") + jaccard("rels", "r2")) / 2, 6).alias("score")).where(F.col("score") >= least)
