"""Exact top-k search with a pivot table (operator 9).

Components become floor(64 * x). A further component, sqrt(M - |x|^2) for candidates (M: the largest squared norm) and 0
for queries, makes the largest inner product the smallest distance: d^2 = |q|^2 + M - 2 q.x. Distances of all candidates to
a number of pivots are computed once. Candidates lie in tiles by their nearest pivot and the distance to it, and the table
holds each tile's least and largest distance to every pivot: by the triangle inequality a query outside of that range is at
least as far from all of the tile, which bounds q.x from above. A query takes tiles in the order of that bound, in growing
steps, until the next bound is below the k-th best score: then nothing left can enter, and the result is exact.

Candidates are dealt into groups of bounded size, queries into blocks; each group holds its pivot table and meets every
block, and the k best of the groups are merged by a ranking window with a limit per group. Nothing is collected. The queries
of a block that take a tile are multiplied with it at once, in single precision where that holds every sum exactly.

Scores are whole numbers and exact at any size: vectors with components so large that a double no longer holds their products
are evaluated in Python's integers, whatever their bounds. A score beyond a long is reported as the nearest long, but ranked
by its exact value.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, nor do rows without id; a
repeated row is a candidate, and asks, as often as it occurs; rows of a query's own id are no candidates for it; vectors of
different lengths do not meet; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import groups_for, require

TOP = 20
QUERY_STEP = 20
SCALE = 64
PIVOTS = 24
#: Candidates of a group, and queries compared with it at once: bound a task's memory.
GROUP_ROWS = 32_768
BLOCK_QUERIES = 1024
#: Candidates of a tile. A query takes one tile first; each further step doubles.
TILE = 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of double: floor(scale * x) / scale, exact for a power of two) of the rows that take part."""
    # from 2**52 on a double is a whole number already
    part = lambda c: F.when(F.abs(c) < F.lit(float(1 << 52) / scale), F.floor(c * F.lit(float(scale))).cast("double") / F.lit(float(scale))).otherwise(c)
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return require(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(whole).select("vec_id", F.transform("embedding", lambda c: part(c.cast("double"))).alias("v"))


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """scale * v, as doubles where these are exact, else as Python's integers."""
    if not vectors.size or np.abs(vectors).max() < 2.0**52 / scale:
        return vectors * scale
    return np.array([[int(x * scale) if abs(x) < 2.0**52 / scale else int(x) * scale for x in v] for v in vectors.tolist()], dtype=object).reshape(vectors.shape)


def ordered_bytes(n: int) -> bytes:
    """Bytes that compare as the numbers do."""
    size = (abs(n).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(n).to_bytes(size, "big")
    return b"\1" + body if n >= 0 else b"\0" + bytes(255 - b for b in body)


class PivotTable:
    """Candidates of one length, with their distances to pivots chosen far from each other."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: int = PIVOTS):
        # components below this have inner products that a double holds exactly
        self.limit = (2.0**53 / max(1, vectors.shape[1])) ** 0.5
        huge = self._huge(vectors)
        self.huge = [(i, [int(x) for x in v]) for i, v in zip(ids[huge].tolist(), vectors[huge])]
        self.ids, v = ids[~huge], vectors[~huge].astype(np.float64)
        norms = np.einsum("ij,ij->i", v, v)
        self.most = float(norms.max(initial=0.0))
        wide = np.column_stack([v, np.sqrt(np.maximum(self.most - norms, 0.0))])
        held, table, near, at = [], [], None, 0
        for _ in range(min(pivots, len(v))):
            held.append(wide[at])
            table.append(self._distances(wide, wide[at]))
            near = table[-1] if near is None else np.minimum(near, table[-1])
            at = int(np.argmax(near))
        self.pivots, table = np.array(held).reshape(-1, wide.shape[1]), np.array(table).reshape(len(table), len(v))
        if len(v):
            order = np.lexsort((near, table.argmin(0)))
            self.ids, v, table = self.ids[order], v[order], table[:, order]
        starts = np.arange(0, len(v), TILE)
        self.tiles = [slice(i, i + TILE) for i in starts.tolist()]
        # by pivot and tile
        self.least = np.minimum.reduceat(table, starts, 1) if len(v) else table
        self.largest = np.maximum.reduceat(table, starts, 1) if len(v) else table
        self.flat, self.high = v, float(np.abs(v).max(initial=0.0))
        self.single = v.astype(np.float32) if self.high < 2.0**24 else v
        self.evaluated = 0

    def _huge(self, vectors: np.ndarray) -> np.ndarray:
        return np.array([max(map(abs, v), default=0) >= self.limit for v in vectors.tolist()], bool) if vectors.dtype == object else (np.abs(vectors) >= self.limit).any(1)

    @staticmethod
    def _distances(v, p):
        d = v - p
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, by query and tile; slack covers rounding."""
        q = np.column_stack([queries, np.zeros(len(queries))])
        norms = np.einsum("ij,ij->i", q, q)
        low = np.zeros((len(q), len(self.tiles)))
        for pivot, least, largest in zip(self.pivots, self.least, self.largest):
            d = self._distances(q, pivot)[:, None]
            np.maximum(low, np.maximum(least - d, d - largest), out=low)
        scale = norms[:, None] + self.most
        return (scale - low * low) / 2 + 1e-9 * scale + 0.5

    def search(self, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP):
        """query id, candidate id, score of the `top` best for each query."""
        return [(int(query_ids[n]), i, s) for n, i, s in zip(*(c if isinstance(c, list) else c.tolist() for c in self.best(query_ids, queries, top)))]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP):
        """Place of the query, candidate id, score of the `top` best for each query; scores are whole numbers, in Python's where a long may not hold them."""
        large = self._huge(queries)
        places, ids, scores = self._nearest(query_ids, np.where(large[:, None], 0, queries).astype(np.float64), ~large, top)
        if not self.huge and not large.any():
            return places, ids, scores.astype(np.int64)
        ends, out = np.searchsorted(places, np.arange(len(queries) + 1)), []
        for n, (qid, exact) in enumerate(zip(query_ids.tolist(), queries)):
            exactly = lambda v: sum(a * int(b) for a, b in zip(v, exact))
            found = [(-exactly(v), i) for i, v in self.huge if i != qid]
            if large[n]:  # bounds in doubles say nothing here
                found += [(-exactly([int(x) for x in v]), i) for i, v in zip(self.ids.tolist(), self.flat.tolist()) if i != qid]
            else:
                found += [(-int(s), i) for i, s in zip(ids[ends[n] : ends[n + 1]].tolist(), scores[ends[n] : ends[n + 1]].tolist())]
            out += [(n, i, -s) for s, i in sorted(found)[:top]]
        return [list(c) for c in zip(*out)] or [[], [], []]

    @staticmethod
    def _first(places, ids, scores, top):
        """The `top` best rows of each place, by place."""
        order = np.lexsort((ids, -scores, places))
        places, ids, scores = places[order], ids[order], scores[order]
        keep = np.arange(len(places)) - np.searchsorted(places, places) < top
        return places[keep], ids[keep], scores[keep]

    def _nearest(self, query_ids, queries, asked, top):
        """Place, id, score of the `top` best for the queries that are asked, which a double holds exactly."""
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = self.bounds(queries)
        order = np.argsort(-bound, 1, kind="stable")
        # sums below this are exact in single precision
        small = self.high * float(np.abs(queries).max(initial=0.0)) * max(1, queries.shape[1]) < 2.0**24
        q, x = (queries.astype(np.float32), self.single) if small else (queries, self.flat)
        kth, going, done, step = np.full(len(queries), -np.inf), np.flatnonzero(asked), 0, 1
        while done < len(self.tiles) and len(going):
            chosen = order[going, done : done + step]
            may = np.take_along_axis(bound[going], chosen, 1) >= kth[going, None]
            takes, tiles = np.repeat(going, chosen.shape[1])[may.ravel()], chosen[may]
            by = np.argsort(tiles, kind="stable")
            takes, tiles = takes[by], tiles[by]
            parts = [found]
            for n, tile in zip(np.split(takes, np.flatnonzero(np.diff(tiles)) + 1), np.unique(tiles).tolist()):
                rows = self.tiles[tile]
                ids, scores = self.ids[rows], q[n] @ x[rows].T
                self.evaluated += scores.size
                own, least = ids == query_ids[n, None], kth[n]
                if scores.shape[1] > top and np.isinf(least).any():  # no k-th best yet: that of the tile
                    scores[own] = -np.inf
                    least = np.maximum(least, np.partition(scores, -top, 1)[:, -top])
                at, to = np.nonzero((scores >= least.astype(scores.dtype)[:, None]) & ~own)
                part = n[at], ids[to], scores[at, to].astype(np.float64)
                parts.append(self._first(*part, top) if len(at) > 4 * top * len(n) else part)
            found = self._first(*map(np.concatenate, zip(*parts)), top)
            ends = np.searchsorted(found[0], np.arange(len(queries) + 1))
            full = ends[1:] - ends[:-1] >= top
            kth[full] = found[2][ends[1:][full] - 1]
            done, step = done + step, 2 * step
            if done < len(self.tiles):
                going = going[bound[going, order[going, done]] >= kth[going]]
        return found


def top_k(vectors: DataFrame, top: int = TOP, query_step: int = QUERY_STEP, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    v = quantised(vectors, scale).withColumn("dim", F.size("v"))
    groups = max(groups_for(require(vectors, "vec_id").count(), GROUP_ROWS), 2 * spark.sparkContext.defaultParallelism)
    held = v.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("times", F.lit(0).cast("long"))
    # every query visits every group: the stated query set against all rows, in blocks; equal rows ask once, and are answered each
    asked = v.where(F.pmod("vec_id", F.lit(query_step)) == 0).groupBy("vec_id", "v", "dim").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = held.unionByName(asked.select(*held.columns)).repartition(groups, "grp").sortWithinPartitions("grp", "dim", F.col("times") > 0, "vec_id")

    def search(batches):
        """A group's candidates come before its queries, group after group."""
        import pyarrow as pa

        def answer(table, waiting):
            cols = [[]] * 6
            if table is not None:
                numbers = whole_numbers(np.array([x for _, x, _ in waiting]).reshape(len(waiting), -1), scale)
                # by place, so that different vectors under one id are answered each
                asks = np.array([vec for vec, _, _ in waiting], np.int64)
                of = np.array([int(np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "<i8")[0]) for _, x, _ in waiting], np.int64)
                places, ids, scores = table.best(asks, numbers, top)
                near, exact = scores, [None] * len(scores)
                if isinstance(scores, list):
                    near = [max(-(2**63), min(2**63 - 1, s)) for s in scores]
                    exact = [ordered_bytes(s) if n != s or s == -(2**63) else None for n, s in zip(near, scores)]
                at = np.asarray(places, np.int64)
                cols = [asks[at], of[at], np.array([times for _, _, times in waiting], np.int64)[at], ids, near, exact]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.binary()) for k, c in enumerate(cols)], names=["query_id", "of", "times", "vec_id", "score", "exact"])

        now, ids, rows, table, waiting = None, [], [], None, []
        for b in batches:
            values, offsets = b.column(3).flatten().to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            for n, (grp, dim, times, vec) in enumerate(zip(*[b.column(i).to_pylist() for i in range(3)], b.column(4).to_pylist())):
                x = values[offsets[n] : offsets[n + 1]].copy()
                if (grp, dim) != now:
                    if waiting:
                        yield answer(table, waiting)
                    now, ids, rows, table, waiting = (grp, dim), [], [], None, []
                if not times:
                    ids.append(vec)
                    rows.append(x)
                    continue
                if table is None and ids:
                    table = PivotTable(np.array(ids, np.int64), whole_numbers(np.array(rows).reshape(len(rows), -1), scale), pivots)
                waiting.append((vec, x, times))
                if len(waiting) == BLOCK_QUERIES:
                    yield answer(table, waiting)
                    waiting = []
        if waiting:
            yield answer(table, waiting)

    found = dealt.select("grp", "dim", "times", "v", "vec_id").mapInArrow(search, "query_id long, of long, times long, vec_id long, score long, exact binary")
    best = Window.partitionBy("query_id", "of").orderBy(F.col("score").desc(), F.col("exact").desc_nulls_last(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")).drop("_")
