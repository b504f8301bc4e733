"""Indexes and rankers as tables: dense vectors, BM25, summaries, communities; fusion and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..common import against_all, checked_broadcast, cut_lineage
from ..functions import text as X

K1, B = 1.5, 0.75
RRF_K = 60


def ranked(scored: DataFrame, key: str, *order, top: int) -> DataFrame:
    """rank from 0 within key; a total order is asked for. The bare row number is limited: only so Spark prunes before the shuffle."""
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= top)
    return placed.withColumn("rank", F.col("rank") - 1)


def vector_index(vectors: DataFrame) -> DataFrame:
    """id, embedding, norm: the norm is stored once."""
    return vectors.select(F.col("vec_id").alias("id"), "embedding", F.sqrt(X.dot(F.col("embedding"), F.col("embedding"))).alias("norm"))


def scored(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score (cosine) of every query of queries(query_id, q) with every row."""
    asked = queries.select("query_id", "q", F.sqrt(X.dot(F.col("q"), F.col("q"))).alias("qn"))
    n = F.col("norm") * F.col("qn")
    both = against_all(asked, index).withColumn("score", F.when(n == 0, F.lit(0.0)).otherwise(X.dot(F.col("embedding"), F.col("q")) / n))
    return both.select("query_id", "id", "score")


def vector_search(index: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """query_id, id, score, rank for queries(query_id, q).

    Ids that are whole numbers and finite vectors of one length go by matrix products of blocks; rows and queries that are
    otherwise are scored one by one.
    """
    kinds = {c: dict(df.dtypes)[c] for df, c in ((index, "id"), (queries, "query_id"))}
    asked, dim = queries.select("query_id", "q"), queries.where(_finite("query_id", "q")).select(F.size("q")).head()
    if dim is None or not set(kinds.values()) <= {"tinyint", "smallint", "int", "bigint"}:
        found = scored(index, asked).withColumn("score", F.round("score", 9))
    else:
        even = lambda i, v: F.coalesce(_finite(i, v) & (F.size(v) == dim[0]), F.lit(False))
        rows, plain = index.where(even("id", "embedding")), asked.where(even("query_id", "q"))
        found = _of_blocks(rows.select("id", "embedding"), plain, top, True)
        found = found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("query_id", "id")], "score")
        odd = index.where(~even("id", "embedding")), asked.where(~even("query_id", "q"))
        for some, given in ((odd[0], asked), (rows, odd[1])):
            if some.head() is not None and given.head() is not None:
                found = found.unionByName(scored(some, given).withColumn("score", F.round("score", 9)))
    return ranked(found, "query_id", F.col("score").desc(), "id", top=top)


#: Rows and components of a block of vectors at most, rows of one at least; pairs of blocks where the rows are enough. A task
#: holds two blocks, and products of TILE vectors of each.
BLOCK, COMPONENTS, LEAST_BLOCK, PAIRS, TILE = 131072, 1 << 23, 1024, 48, (512, 2048)


def _grid(n: int, m: int, dim: int) -> tuple[int, int]:
    """Numbers of blocks for n rows and m queries of dim components. Up to the largest block they do not grow with the rows, so
    that what is shuffled, each row once for each block of the other side, grows as the rows do."""
    most, few = max(1, min(BLOCK, COMPONENTS // max(1, dim))), lambda x, at_least: max(1, min(x, -(-at_least // LEAST_BLOCK)))
    asks = few(round((PAIRS * m / max(1, n)) ** 0.5), m)
    return max(-(-n // most), few(-(-PAIRS // asks), n)), max(asks, -(-m // most))


def _finite(i: str, v: str) -> Column:
    """Whether id and vector are there, and the vector has finite components alone."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(i).isNotNull() & F.col(v).isNotNull() & fine


def _best(q, r, qi, ri, top: int, itself: bool):
    """Places in q and r, and scores, of the `top` best of r(ids ri, rising) for each of q: higher scores, then smaller ids.

    q and r are of length 1 or 0. Single precision rules out what is below a query's own best by more than its error can be; what
    is left is scored in double precision, and so is a tile of which much is left, as in a group of copies.
    """
    import numpy as np

    out, (q4, r4) = [], (x.astype("f4") for x in (q, r))
    # twice the bound of a sum of dim products of rounded components
    error = (q.shape[1] + 8) * 2.0**-23
    for a in range(0, len(q), TILE[0]):
        part, ids, n = q[a : a + TILE[0]], qi[a : a + TILE[0]], min(TILE[0], len(q) - a)
        row, at, score, floor = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.full(n, -np.inf)
        b = 0
        while b < len(r):
            # the first tiles are small: they find the floors
            end = min(len(r), b + min(TILE[1], 3 * b or 32 * top))
            screened = False
            if b:
                least = np.nextafter((floor + 4e-10 - error).astype("f4"), np.float32(-np.inf))
                hit = np.flatnonzero(q4[a : a + n] @ r4[b:end].T > least[:, None])
                screened = len(hit) <= n * (end - b) // 16
            if screened:
                i, j = np.divmod(hit, end - b)
                if not itself:
                    other = ids[i] != ri[b + j]
                    i, j = i[other], j[other]
                x = np.einsum("ij,ij->i", part[i], r[b + j])
            else:
                s = part @ r[b:end].T
                if not itself:
                    s[ids[:, None] == ri[None, b:end]] = -np.inf
                # what is below the first tile's own best need not be looked at
                least = np.partition(s, -top, axis=1)[:, -top] - 1e-9 if b == 0 and s.shape[1] > top else floor
                # a later row has a larger id: an equal score does not replace, and the product is exact to far less than this
                i, j = np.nonzero(s > np.maximum(least, floor + 4e-10)[:, None])
                x = s[i, j]
            if len(i):
                row, at, score = np.concatenate([row, i]), np.concatenate([at, j + b]), np.concatenate([score, np.round(x, 9) + 0.0])
                order = np.lexsort((at, -score, row))
                row, at, score = row[order], at[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                row, at, score = row[place < top], at[place < top], score[place < top]
                last = np.searchsorted(row, np.arange(n), "right") - 1
                full = np.bincount(row, minlength=n) >= top
                floor[full] = score[last[full]]
            b = end
        out.append((row + a, at, score))
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (zip(*out) if out else ((), (), ())))


def _of_blocks(vectors: DataFrame, queries: DataFrame, top: int, itself: bool) -> DataFrame:
    """query_id, id, score: of the rows of vectors(id, embedding) in each block the `top` best for each of queries(query_id, q).

    Both are dealt into blocks; each pair of blocks is a group of its own, whose two sides meet by the pair's numbers. Blocks
    are few and large, as each is sent to every block of the other side; components stay floats where they are. itself: whether a row
    counts for a query of its id. Ids are whole numbers, vectors finite.
    """
    import numpy as np

    (n, dim), (m, _) = ((x["n"], x["dim"] or 0) for x in (df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(c)).alias("dim")).first() for df, c in ((vectors, "embedding"), (queries, "q"))))
    rows, asks = _grid(n, m, dim)
    wide = lambda df, c: np.dtype("<f4") if dict(df.dtypes)[c] == "array<float>" else np.dtype("<f8")
    kinds = wide(queries, "q"), wide(vectors, "embedding")

    def blocks(df, i, v, count, kind):
        import pyarrow as pa

        def packed(table):
            ids = table.column("i").to_numpy()
            order = np.argsort(ids, kind="stable")
            held = table.column("v").combine_chunks()
            data = held.values.slice(held.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(kind, copy=False)[: len(ids) * table.column("dim")[0].as_py()].reshape(len(ids), -1)
            one = lambda x, t: pa.array([x], t)
            return pa.Table.from_arrays([one(table.column("block")[0].as_py(), pa.int32()), one(table.column("dim")[0].as_py(), pa.int32()), one(ids[order].tobytes(), pa.binary()), one(data[order].tobytes(), pa.binary())], names=["block", "dim", "ids", "data"])

        array = "array<float>" if kind.itemsize == 4 else "array<double>"
        dealt = df.select(F.col(i).cast("long").alias("i"), F.col(v).cast(array).alias("v"), F.size(v).alias("dim"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(count)).cast("int"))
        return dealt.groupBy("block", "dim").applyInArrow(packed, "block int, dim int, ids binary, data binary")

    def unit(ids, data, kind, dim):
        x = np.frombuffer(data, kind).reshape(len(ids), dim).astype(float)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def best(left, right):
        import pyarrow as pa

        got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            (qi, qd, dim), (ri, rd, _) = ([t.column(c)[0].as_py() for c in ("ids", "data", "dim")] for t in (left, right))
            qi, ri = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
            i, j, score = _best(unit(qi, qd, kinds[0], dim), unit(ri, rd, kinds[1], dim), qi, ri, top, itself)
            got = [qi[i], ri[j], score]
        return pa.Table.from_arrays([pa.array(x) for x in got], names=["query_id", "id", "score"])

    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = blocks(queries, "query_id", "q", asks, kinds[0]).withColumnRenamed("block", "mine").withColumn("other", every(rows))
    right = blocks(vectors, "id", "embedding", rows, kinds[1]).withColumnRenamed("block", "other").withColumn("mine", every(asks))
    pair = ["mine", "other", "dim"]
    # pairs cost much and weigh little: they are not to be put together by their bytes
    left, right = (x.repartition(2 * rows * asks, *pair) for x in (left, right))
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(best, "query_id long, id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """query_id, id, score, rank: the `top` most similar others of each query, by matrix products of blocks.

    Of vectors(vec_id, embedding) and queries(query_id, q) those without id or with components that are null or not finite take
    no part; vectors of other lengths are no neighbours. A row is no neighbour of a query of its id.
    """
    rows = vectors.select(F.col("vec_id").alias("id"), "embedding").where(_finite("id", "embedding"))
    asked = queries.select("query_id", "q").where(_finite("query_id", "q"))
    return ranked(_of_blocks(rows, asked, top, False), "query_id", F.col("score").desc(), "id", top=top)


def run_tools(planned: DataFrame, tools: dict) -> tuple[DataFrame, dict[str, str]]:
    """query_id, tool, rank, id of the tools that each query's plan names, and the errors of those that failed, by tool.

    planned(query_id, text, tools); tools: name -> builder(queries(query_id, text)) -> query_id, rank, id. Each tool is run to
    its end by itself, so that one that raises, while it is built or while it runs, drops out alone.
    """
    out, errors = None, {}
    for name, build in tools.items():
        asked = planned.where(F.array_contains(F.split("tools", ","), F.lit(name))).select("query_id", "text")
        try:
            found = cut_lineage(build(asked).select("query_id", F.lit(name).alias("tool"), "rank", "id"))
        except Exception as e:  # whatever it is: the other tools answer
            errors[name] = str(e)
            continue
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = planned.where("false").select("query_id", F.lit("").alias("tool"), F.lit(0).alias("rank"), F.lit("").alias("id"))
    return out, errors


def bm25_index(docs: DataFrame) -> DataFrame:
    """Postings term, id, tf, dl; texts are tokenised once and shuffled as terms alone."""
    tokens = docs.select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    return _each(tokens).where("term IS NOT NULL").groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _each(tokens: DataFrame) -> DataFrame:
    """id, dl, term of tokens(id, dl, t); a text without any has a null. A plain explode would have Spark ask first whether there
    are any, and so find them twice more."""
    return tokens.select("id", "dl", F.explode_outer("t").alias("term"))


def bm25_stats(docs: DataFrame) -> DataFrame:
    """n and mean length of the corpus: one row; only the count of tokens is taken from the texts."""
    return docs.select(F.size(X.tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def save_bm25(docs: DataFrame, path: str) -> None:
    """Persist the index: postings laid out by term, so that a search reads few row groups, and the corpus figures."""
    bm25_index(docs).repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    bm25_stats(docs).write.mode("overwrite").parquet(f"{path}/stats")


def load_bm25(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """postings, stats of a kept index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


def bm25_search(postings: DataFrame, stats: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """query_id, id, score, rank for queries(query_id, text). Only the query terms' postings are read on."""
    asked, numbers = _query_terms(queries)
    held = postings.join(numbers, "term").select("number", "id", "dl", "tf").repartition(_parts(stats.first()["n"]), "id")
    return _bm25_ranked(held, stats, asked, top)


def bm25_of(docs: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """What bm25_search finds in the index of docs, without that index: other terms than the queries' go before any shuffle."""
    asked, numbers = _query_terms(queries)
    tokens = docs.select(F.col("doc_id").alias("id"), X.tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    held = _each(tokens).join(numbers, "term").select("number", "id", "dl").repartition(_parts(docs.count()), "id")
    return _bm25_ranked(held.groupBy("number", "id", "dl").agg(F.count(F.lit(1)).alias("tf")), bm25_stats(docs), asked, top)


def _query_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, number of the queries' terms, and term, number: both for joins, broadcast where they are few."""
    terms = cut_lineage(queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")))
    numbers = cut_lineage(terms.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    return checked_broadcast(terms.join(numbers, "term").select("query_id", "number"), TERMS), checked_broadcast(numbers, TERMS)


#: Query terms, and pairs of query and term, up to which they are broadcast; documents whose scores a task sums.
TERMS, DOCS_PER_TASK = 100_000, 8192


def _parts(docs: int) -> int:
    return max(8, -(-docs // DOCS_PER_TASK))


def _bm25_ranked(held: DataFrame, stats: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """query_id, id, score, rank from held(number, id, dl, tf), which lies by id: a document's scores are summed where it lies."""
    df = held.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    few = asked.select("number").distinct().limit(TERMS + 1).count() <= TERMS
    # stats is a single row
    scored = held.join(F.broadcast(df) if few else df, "number").crossJoin(F.broadcast(stats)).withColumn("w", weight).join(asked, "number")
    return ranked(scored.groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score")), "query_id", F.col("score").desc(), "id", top=top)


def fuse(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of candidates(query_id, list_ord, rank, id): score, and fused_rank with ties to the first seen.

    A repeated item inside one list adds again, its first copy gives the payload.
    """
    seen = F.col("list_ord") * F.lit(1 << 32) + F.col("rank")
    fused = candidates.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank") + 1)), 9).alias("score"), F.min(seen).alias("first_seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first_seen")
    return fused.withColumn("fused_rank", F.row_number().over(order)).drop("first_seen")


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, top: int = 5) -> DataFrame:
    """Dense and sparse candidates, fused; the best `top` of each query."""
    dense = vector_search(vector_index(vectors), query_vectors, 10).select("query_id", F.lit(0).alias("list_ord"), "rank", "id")
    sparse = bm25_of(docs, queries, 10).select("query_id", F.lit(1).alias("list_ord"), "rank", "id")
    return fuse(dense.unionByName(sparse)).where(F.col("fused_rank") <= top)


def sources(nodes: DataFrame) -> DataFrame:
    """title, category of distinct sources: title falls back to the file name, then the stem; blanks go; first order wins."""
    stem = F.regexp_extract("file_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    title = F.coalesce("title", "file_name", stem)
    named = nodes.select("ord", title.alias("title"), F.coalesce("category", F.lit("General")).alias("category")).where("trim(title) <> ''")
    return named.groupBy("title", "category").agg(F.min("ord").alias("ord"))


def pool(bundles: DataFrame, key: str) -> DataFrame:
    """Order-preserving distinct values over bundles."""
    return bundles.groupBy(key).agg(F.min("ord").alias("ord"))


def flatten(context: DataFrame) -> DataFrame:
    """Non-empty texts, in the order graph, vector, summary, community: context(query_id, kind, ord, text)."""
    place = F.array_position(F.array(*map(F.lit, ("graph", "vector", "summary", "community"))), F.col("kind"))
    kept = context.where("text <> ''").withColumn("k", place)
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "ord"))).select("query_id", "ord", "text")


def prompt(context: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: sections of communities, graph and excerpts, or a note that nothing was found."""
    part = lambda kind, head: F.when(
        F.count(F.when(F.col("kind") == kind, 1)) > 0,
        F.concat(F.lit(f"{head}:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "line")))), lambda x: x["line"]), "\n")),
    )
    lined = context.withColumn("line", F.when(F.col("kind") == "vector", F.concat(F.lit("["), "source", F.lit("] "), "text")).otherwise(F.col("text")))
    made = lined.groupBy("query_id").agg(F.concat_ws("\n\n", part("community", "COMMUNITY"), part("graph", "GRAPH"), part("vector", "EXCERPTS")).alias("p"))
    return queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce(F.nullif("p", F.lit("")), F.lit("No relevant context found.")).alias("prompt"))


def statistics(answers: DataFrame, window: int = 8192) -> DataFrame:
    """tokens (a quarter of the characters), tokens a second and share of the context window."""
    tokens = (F.length("answer") / 4).cast("long")
    used = tokens + (F.length("prompt") / 4).cast("long")
    return answers.select("query_id", tokens.alias("tokens"), F.round(tokens / F.col("seconds"), 1).alias("tps"), F.round(F.least(F.lit(1.0), used / window), 6).alias("utilization"))
