"""Entity resolution over blocks of any size: similar pairs by bounds and filters, star clusters by rounds.

The rule is a greedy one. Blocks come in the order in which their labels first appear, nodes in the order of their ids. In a
block the first node that is not taken yet is a seed and takes the later ones that are like it (like the seed: the rule is not
transitive); whoever is in a cluster of two or more is left out of all later blocks.

Nothing here holds a block in one task. Pairs that are alike are found first: by cosine as products of tiles, of which those are
left out that the triangle inequality rules out, and by name as a join on the rarest parts of names that a pair over the
threshold must share. The greedy rule is then settled by rounds over these pairs: a node is a seed as soon as no earlier node
that is like it is open or a seed, is taken as soon as the first of these is a seed, and waits otherwise. The first open
node can always be settled, so the rounds end, with the clusters of the greedy pass. There are as many as the longest chain of
open nodes that wait for each other: few where ids do not follow likeness.

Nodes that agree in all that counts (labels, name, vector) are put together before and follow the first of them, so that a name
that many nodes bear makes no pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..common import Rounds, cut_lineage
from ..functions import text as X
from .ivf import _distances, _unit, fitted

GENERIC_LABELS = ("__Entity__", "__Node__")
UNLABELED = "__UNLABELED__"
#: Rows of a tile of vectors, and of a group of tiles, about; two groups and a product of two tiles are what a task holds.
TILE, GROUP = 2048, 8192


# ---- pairs by cosine


def tiles(vectors: DataFrame) -> DataFrame:
    """block, tile, dim, centre, radius, ids, data of vectors(block, id, v): unit vectors near each other, TILE rows at most."""
    c = fitted(vectors.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")))
    kinds = dict(vectors.dtypes)

    def place(batches):
        for b in batches:
            rows = b.column("v").to_pylist()
            near = np.zeros(len(rows), np.int64)
            fit = [i for i, v in enumerate(rows) if len(c) and len(v) == c.shape[1]]
            if fit:
                near[fit] = (_unit(np.array([rows[i] for i in fit], float)) @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near)], names=["block", "id", "v", "near"])

    placed = cut_lineage(vectors.select("block", "id", F.col("v").cast("array<double>").alias("v")).mapInArrow(place, f"block {kinds['block']}, id {kinds['id']}, v array<double>, near long").withColumn("dim", F.size("v")))
    chunks = placed.groupBy(F.col("block").alias("of"), F.col("dim").alias("dim2"), F.col("near").alias("near2")).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks"))
    same = F.col("block").eqNullSafe(F.col("of")) & (F.col("dim") == F.col("dim2")) & (F.col("near") == F.col("near2"))
    dealt = placed.join(chunks, same).select("block", "id", "v", "dim", "near", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"))

    def pack(table):
        v = _unit(np.array(table.column("v").to_pylist(), float))
        centre = v.mean(0)
        radius = float(_distances(v, centre[None]).max())
        row = {"block": table.column("block")[:1], "tile": pa.array([f"{table.column('near')[0]}.{table.column('chunk')[0]}"]), "dim": table.column("dim")[:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)), "data": pa.array([v.tobytes()], pa.binary())}
        return pa.table(row)

    return dealt.groupBy("block", "dim", "near", "chunk").applyInArrow(pack, f"block {kinds['block']}, tile string, dim int, centre array<double>, radius double, ids array<{kinds['id']}>, data binary")


def alike_vectors(vectors: DataFrame, threshold: float) -> DataFrame:
    """block, a, b (a < b) of vectors(block, id, v) in one block with a cosine of the threshold (over 0) or more.

    A block's tiles are dealt into groups of about GROUP rows, and each pair of groups meets in one place, which multiplies the
    tiles that the bounds do not exclude. So a row is sent once for each group of its block, and not for each tile.
    """
    if threshold <= 0:
        raise ValueError("a threshold over 0 is asked for")
    kinds = dict(vectors.dtypes)
    held = cut_lineage(tiles(vectors.where(F.exists("v", lambda x: x != 0))))
    apart = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    sizes = held.groupBy(F.col("block").alias("of"), F.col("dim").alias("dim2")).agg(F.ceil(F.sum(F.size("ids")) / GROUP).cast("int").alias("groups"))
    placed = held.join(sizes, F.col("block").eqNullSafe(F.col("of")) & (F.col("dim") == F.col("dim2"))).drop("of", "dim2").withColumn("mine", F.pmod(F.xxhash64("tile"), F.col("groups")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("block", "dim", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "centre", "radius", "ids", "data")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(batches)
        block, dim, lo, hi = (met.column(c)[0].as_py() for c in ("block", "dim", "lo", "hi"))
        sides = []
        for g in (lo, hi):
            t = met.filter(pc.equal(met.column("mine"), g))
            ids = t.column("ids").combine_chunks().flatten()
            data = [np.frombuffer(d.as_buffer()).reshape(-1, dim) for d in t.column("data")]
            sides.append((np.array(t.column("centre").to_pylist()), t.column("radius").to_numpy(), ids, data))
        (c1, r1, ids1, x), (c2, r2, ids2, y) = sides
        if not len(x) or not len(y):
            return
        near = _distances(c1, c2) - r1[:, None] - r2[None] <= apart
        sizes, starts = np.array([len(d) for d in y]), np.cumsum([0, *(len(d) for d in x)])
        places, y = np.arange(sizes.sum()), np.concatenate(y)
        for k, rows in enumerate(x):
            at = places[np.repeat(near[k], sizes)]
            if lo == hi:  # one side with itself: each pair once
                at = at[at > starts[k]]
            for n in range(0, len(at), TILE):
                some = at[n : n + TILE]
                i, j = np.nonzero(rows @ y[some].T >= threshold)
                i, j = i + starts[k], some[j]
                if lo == hi:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    one, two = ids1.take(pa.array(i)), ids2.take(pa.array(j))
                    turned = pc.greater(one, two)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(i), met.schema.field("block").type), pc.if_else(turned, two, one), pc.if_else(turned, one, two)], names=["block", "a", "b"])

    return sent.groupBy("block", "dim", "lo", "hi").applyInArrow(products, f"block {kinds['block']}, a {kinds['id']}, b {kinds['id']}")


# ---- pairs by name

# For names of together S characters of which M stand in matching blocks, the ratio is 2M/S. Two neighbouring blocks have an
# unmatched character between them, so there are no more than S - 2M + 1, and the names share M - (S - 2M + 1) = 3M - S - 1 pairs
# of neighbouring characters at least, and M single ones. At a ratio of t that is S(1.5t - 1) - 1 and St/2.


def name_candidates(names: DataFrame, threshold: float) -> DataFrame:
    """block, a, b (a < b), name_a, name_b: all pairs of names(block, id, name) that may reach the ratio, and few others."""
    t = threshold
    if not 0 < t <= 1:
        raise ValueError("a threshold over 0, of 1 at most, is asked for")
    rate = 1.5 * t - 1
    # together so long, two names share a pair of neighbours at least; shorter ones are met by single characters
    long = 2 / rate if rate > 0 else float("inf")
    size = F.length("name")
    least = 2 * size / (2 - t)  # together with the shortest partner
    grams = lambda n: F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(F.col("name"), i, F.lit(n)))
    schemes = []
    if rate > 0:
        need = F.ceil(F.greatest(least, F.lit(long)) * rate - 1 - 1e-9)
        schemes.append(names.where(size >= 2).select("block", "id", "name", F.lit("2:").alias("kind"), grams(2).alias("grams"), (size - 1 - need + 1).cast("int").alias("first")))
    short = names.where((size >= 1) & (size < F.lit(long))) if rate > 0 else names.where(size >= 1)
    schemes.append(short.select("block", "id", "name", F.lit("1:").alias("kind"), grams(1).alias("grams"), (size - F.ceil(size * t / (2 - t) - 1e-9) + 1).cast("int").alias("first")))
    schemes.append(names.where(size == 0).select("block", "id", "name", F.lit("0:").alias("kind"), F.array(F.lit("")).alias("grams"), F.lit(1).alias("first")))
    parts = schemes[0]
    for s in schemes[1:]:
        parts = parts.unionByName(s)
    # the k-th occurrence of a part in a name is a token of its own
    parts = parts.where("first > 0").select("block", "id", "name", "first", "kind", F.explode("grams").alias("gram")).groupBy("block", "id", "name", "first", "kind", "gram").agg(F.count(F.lit(1)).alias("n"))
    tokens = cut_lineage(parts.select("block", "id", "name", "first", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat("kind", "gram", F.lit("#"), k.cast("string")))).alias("token"), "kind"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    rare = tokens.join(often, "token").groupBy("block", "id", "name", "first", "kind").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("all"))
    index = cut_lineage(rare.select("block", "id", "name", F.explode(F.slice("all", 1, F.col("first"))).alias("x")).select("block", "id", "name", F.col("x.token").alias("token")))
    a = index.select("block", "token", F.col("id").alias("a"), F.col("name").alias("name_a"))
    b = index.select(F.col("block").alias("of"), F.col("token").alias("token_b"), F.col("id").alias("b"), F.col("name").alias("name_b"))
    m, n = F.length("name_a"), F.length("name_b")
    met = a.join(b, F.col("block").eqNullSafe(F.col("of")) & (F.col("token") == F.col("token_b")) & (F.col("a") < F.col("b")) & (2 * F.least(m, n) >= t * (m + n) - 1e-9))
    return met.select("block", "a", "b", "name_a", "name_b").distinct()


def alike_names(names: DataFrame, threshold: float) -> DataFrame:
    """block, a, b (a < b) of names(block, id, name) with difflib's ratio of the threshold or more, a's name first."""
    kinds = dict(names.dtypes)

    def judge(batches):
        import difflib

        for batch in batches:
            matcher, kept = difflib.SequenceMatcher(None), []
            for x, y in zip(batch.column("name_a").to_pylist(), batch.column("name_b").to_pylist()):
                shared = sum((Counter(x) & Counter(y)).values())
                ok = not x + y or 2.0 * shared / (len(x) + len(y)) >= threshold
                if ok:
                    matcher.set_seqs(x, y)
                    ok = matcher.ratio() >= threshold
                kept.append(ok)
            yield batch.select(["block", "a", "b"]).filter(pa.array(kept, pa.bool_()))

    return name_candidates(names, threshold).mapInArrow(judge, f"block {kinds['block']}, a {kinds['id']}, b {kinds['id']}")


# ---- stars


def stars(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """block, seed, id: the clusters that the greedy pass makes of entries(block, at, id, size) and pairs(block, a, b).

    at: place of the block among the blocks; size: how many nodes the entry stands for.
    """
    ends = pairs.select("block", F.col("a").alias("id")).unionByName(pairs.select("block", F.col("b").alias("id"))).distinct()
    held = entries.select("block", "at", "id", "size").join(ends.withColumn("paired", F.lit(True)).withColumnRenamed("block", "of").withColumnRenamed("id", "other"), F.col("block").eqNullSafe(F.col("of")) & (F.col("id") == F.col("other")), "left")
    # one without partners is a cluster only if it stands for several nodes
    states = Rounds(held.where("paired OR size > 1").select("block", "at", "id", "size", F.lit("open").alias("state"), F.lit(None).cast(dict(entries.dtypes)["id"]).alias("seed")))
    state = states.df
    several = state.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    lives = Rounds(pairs.select("block", "a", "b"))
    while state.where("state = 'open'").limit(1).count():
        by_first = state.select(F.col("block").alias("of"), F.col("id").alias("first"), F.col("state").alias("was"))
        still = state.where("state = 'open'").select(F.col("block").alias("of"), F.col("id").alias("later"))
        # who is taken or left out takes nobody, and who is settled is taken by nobody
        left = lives.df.select("block", "a", "b").join(still, F.col("block").eqNullSafe(F.col("of")) & (F.col("b") == F.col("later")), "left_semi")
        live = lives.put(left.join(by_first, F.col("block").eqNullSafe(F.col("of")) & (F.col("a") == F.col("first"))).where("was IN ('open', 'seed')").select("block", "a", "b", "was"))
        met = live.groupBy(F.col("block").alias("of"), F.col("b").alias("later")).agg(F.min(F.struct("a", "was")).alias("met"))
        free, out = F.lit(True), F.lit(False)
        if several:
            # a cluster of an earlier block leaves its members out; a block that is not through makes them wait
            took = state.where("state = 'taken'").select(F.col("block").alias("of"), F.col("seed").alias("first")).distinct().withColumn("takes", F.lit(True))
            waited = live.select(F.col("block").alias("of"), F.col("a").alias("first")).distinct().withColumn("waits", F.lit(True))
            same = F.col("block").eqNullSafe(F.col("of")) & (F.col("id") == F.col("first"))
            known = state.join(took, same, "left").drop("of", "first").join(waited, same, "left").drop("of", "first")
            clustered = (F.col("state") == "taken") | ((F.col("state") == "seed") & ((F.col("size") > 1) | F.col("takes").isNotNull()))
            alone = (F.col("state") == "out") | ((F.col("state") == "seed") & (F.col("size") == 1) & F.col("takes").isNull() & F.col("waits").isNull())
            before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
            now = known.withColumn("_out", F.coalesce(F.max(clustered).over(before), F.lit(False))).withColumn("_free", F.coalesce(F.min(alone).over(before), F.lit(True))).select("block", "at", "id", "size", "state", "seed", "_out", "_free")
            free, out = F.col("_free"), F.col("_out")
        else:
            now = state
        is_open, first = F.col("state") == "open", F.col("met")
        to = F.when(~is_open, F.col("state")).when(out, F.lit("out")).when(~free, F.lit("open")).when(first.isNull(), F.lit("seed")).when(first["was"] == "seed", F.lit("taken")).otherwise(F.lit("open"))
        now = now.join(met, F.col("block").eqNullSafe(F.col("of")) & (F.col("id") == F.col("later")), "left")
        state = states.put(now.select("block", "at", "id", "size", to.alias("state"), F.when(is_open & (to == "taken"), first["a"]).otherwise(F.col("seed")).alias("seed")))
    lives.last()
    # one seed with several nodes takes them all
    return states.last().where("state = 'taken' OR (state = 'seed' AND size > 1)").select("block", "id", F.coalesce("seed", "id").alias("seed"))


def _classes(nodes: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """The first node of each class, with its size; and id, first of all nodes."""
    key = F.struct(*by)
    keyed = nodes.withColumn("_key", key)
    first = cut_lineage(keyed.groupBy("_key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")))
    of = keyed.join(first.withColumnRenamed("_key", "_same"), F.col("_key").eqNullSafe(F.col("_same"))).select(F.col("id").alias("member"), "first")
    return first.select(F.col("first").alias("id"), "size", *[F.col("_key")[c].alias(c) for c in by]), of


def _members(found: DataFrame, of: DataFrame) -> DataFrame:
    """block, seed, id of all nodes, from the clusters of the classes' first ones."""
    return found.join(of, found["id"] == of["first"]).where("seed <> member").select("block", "seed", F.col("member").alias("id"))


def star_clusters(blocks: DataFrame, threshold: float, alike: str = "cosine") -> DataFrame:
    """seed, id: the stars of each block of blocks(block, id, name, embedding), by cosine of vectors or ratio of names."""
    by = "v" if alike == "cosine" else "name"
    rows = blocks.select("block", "id", F.lower(X.strip(F.col("name").cast("string"))).alias("name"), F.col("embedding").cast("array<double>").alias("v")).where(F.col(by).isNotNull())
    first, of = _classes(rows.select("block", "id", by), "block", by)
    first = cut_lineage(first)
    if by == "v":  # a vector of length zero is like none, not even its equal
        first = first.withColumn("size", F.when(F.exists("v", lambda x: x != 0), F.col("size")).otherwise(F.lit(1)))
    pairs = cut_lineage(alike_vectors(first.select("block", "id", "v"), threshold) if by == "v" else alike_names(first.select("block", "id", "name"), threshold))
    found = stars(first.select("block", F.col("block").alias("at"), "id", "size"), pairs)
    return _members(found, of).select("seed", "id")


def blocked(nodes: DataFrame) -> DataFrame:
    """id, block, at: a row for each label of nodes(id, labels) but the generic ones; at is where the label first appears."""
    own = F.filter("labels", lambda x: ~x.isin(*GENERIC_LABELS))
    each = nodes.select("id", F.posexplode(F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.array(F.lit(UNLABELED)))).alias("pos", "block")).groupBy("id", "block").agg(F.min("pos").alias("pos"))
    first = each.groupBy("block").agg(F.min(F.struct("id", "pos")).alias("at"))
    return each.select("id", "block").join(first, "block").select("id", "block", "at")


def clusters(nodes: DataFrame, threshold: float) -> DataFrame:
    """block, seed, id of nodes(id, name, labels, embedding): blocks by label, by cosine where all of a block have a vector, else by name."""
    rows = nodes.select("id", F.lower(X.strip(F.col("name"))).alias("name"), "labels", F.col("embedding").cast("array<double>").alias("v"))
    first, of = _classes(rows, "labels", "name", "v")
    first = cut_lineage(first)
    entries = cut_lineage(blocked(first.select("id", "labels")).join(first.select("id", "name", "v", "size"), "id"))
    whole = entries.groupBy("block").agg(F.min(F.col("v").isNotNull()).alias("whole"))
    entries = cut_lineage(entries.join(whole, "block"))
    pairs = alike_vectors(entries.where("whole").select("block", "id", "v"), threshold).unionByName(alike_names(entries.where("NOT whole").select("block", "id", "name"), threshold))
    lone = F.col("whole") & ~F.exists("v", lambda x: x != 0)
    found = stars(entries.select("block", "at", "id", F.when(lone, F.lit(1)).otherwise(F.col("size")).alias("size")), cut_lineage(pairs))
    return _members(found, of)
