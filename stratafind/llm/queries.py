"""The operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chunk_bpe, collinear, elkan_codes, feistel_pseudonyms, fuse_dedup, jump_sharding, line_crf, pivot_topk, secret_entropy, simhash_variants, spelling_automata, swap_packing, url_markov
from .oracles import LLOYD, SPELLING
from .common import table


def op1_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_entropy.scan_documents(table(spark, sf_dir, "documents"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_pseudonyms.pseudonymise_documents(table(spark, sf_dir, "documents"))


def op4_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(table(spark, sf_dir, "pages"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_documents(table(spark, sf_dir, "documents"), ids=False, text=False)


def op7_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collinear.passages(table(spark, sf_dir, "documents"))


def op8_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_variants.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_variants.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan_codes.coded(table(spark, sf_dir, "embeddings"))


def op12_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_spelling_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_automata.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_swap_packing, op2_secret_entropy, op3_feistel_pseudonyms, op4_url_markov, op5_line_crf, op6_chunk_bpe, op7_collinear_passages, op8_simhash_variants, op9_pivot_topk, op10_jump_shards, op11_elkan_codes, op12_fuse_dedup, op13_spelling_automata)}

ORACLE = {
    "op9_pivot_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_elkan_codes": LLOYD,
    "op12_fuse_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_spelling_automata": SPELLING,
}
