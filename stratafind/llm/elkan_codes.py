"""Vector codes by Elkan's form of Lloyd's algorithm (operator 11).

Vectors become whole numbers floor(SCALE * x) and are cut into PARTS equal parts; each part position has a codebook of ENTRIES
entries, refined in ROUNDS rounds. For every vector and part a table in the shared folder keeps the assigned entry, an upper
bound of the distance to it and a lower bound of the distance to each entry. When entries have moved, bounds follow by the way
moved; an entry is measured only if no bound rules it out by the triangle inequality, strictly: its lower bound is not above
the upper bound, and the way from the assigned entry to it is not above twice that. Whatever is measured is measured in whole
numbers, so that ties are true ties and go to the lower index. Bounds are whole numbers too, rounded to the safe side.

A round reads the last table once and writes the next; each task adds its sums by entry as one row, and Spark adds those. The
driver holds the codebooks alone: PARTS * ENTRIES entries.

Defined results: rows whose vector is null, or holds a null or a non-finite component, are dropped, as are vectors of another
length than that of the smallest vec_id that is kept; a length that PARTS does not divide is filled up with zeros; components
beyond LIMIT after scaling count as LIMIT; with fewer than ENTRIES rows a codebook has as many entries as rows; ties of vec_id
go by the vector; repeated rows each count and return; rows with null ids come first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint_dir, delete, require

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole-number components of up to 4,096 a vector whose squared distances, and sums over 10**10 rows, a long holds.
LIMIT = 1 << 26
#: Rows measured at once: bound a task's memory.
ROWS = 4096
#: Stored lower bounds are no larger; smaller ones are safe.
_MOST_STORED = (1 << 31) - 1


def _root(squares: np.ndarray) -> np.ndarray:
    """Whole part of the square root, exactly."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def _root_up(squares: np.ndarray) -> np.ndarray:
    r = _root(squares)
    return r + (r * r < squares)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


@dataclass
class Bounds:
    """Of one part of some rows: assigned entry, upper bound of its distance, lower bounds of all entries' distances."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def measured(cls, x: np.ndarray, book: np.ndarray) -> Bounds:
        d = _squares(x[:, None, :], book)
        code = d.argmin(1)
        return cls(code, _root_up(d[np.arange(len(x)), code]), _root(d))

    def shift(self, moved: np.ndarray) -> None:
        """Entries moved by at most so much each."""
        self.upper += moved[self.code]
        self.lower = np.maximum(self.lower - moved, 0)

    def reassign(self, x: np.ndarray, book: np.ndarray) -> int:
        """Assign to the nearest entries, ties to the lower index; how many distances that took."""
        between = _root(_squares(book[:, None, :], book))
        near = np.where(np.eye(len(book), dtype=bool), np.iinfo(np.int64).max, between).min(1)
        at = np.flatnonzero(2 * self.upper >= near[self.code])
        open_ = self._open(at, between)
        some = open_.any(1)
        at, open_ = at[some], open_[some]
        if not at.size:
            return 0
        mine = np.arange(len(at))
        own = _squares(x[at], book[self.code[at]])
        self.upper[at] = _root_up(own)
        self.lower[at, self.code[at]] = _root(own)
        open_ &= self._open(at, between)
        row, entry = np.nonzero(open_)
        d = _squares(x[at[row]], book[entry])
        self.lower[at[row], entry] = _root(d)
        all_ = np.full(open_.shape, np.iinfo(np.int64).max)
        all_[row, entry] = d
        all_[mine, self.code[at]] = own
        self.code[at] = best = all_.argmin(1)
        self.upper[at] = _root_up(all_[mine, best])
        return len(at) + len(row)

    def _open(self, at: np.ndarray, between: np.ndarray) -> np.ndarray:
        """Entries that no bound rules out, but for the assigned one."""
        upper = self.upper[at, None]
        found = (self.lower[at] <= upper) & (between[self.code[at]] <= 2 * upper)
        found[np.arange(len(at)), self.code[at]] = False
        return found


def whole_numbers(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, embedding of the rows that take part, and their length."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = require(vectors, "vec_id", "label", "embedding").where("size(embedding) > 0").where(finite)
    first = kept.orderBy("vec_id", "embedding").limit(1).collect()
    length = len(first[0]["embedding"]) if first else 0
    return kept.where(F.size("embedding") == length), length


def _scaled(flat: np.ndarray, length: int) -> np.ndarray:
    """(rows, PARTS, width) whole numbers."""
    v = np.clip(np.floor(flat.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(-1, length)
    return np.pad(v, ((0, 0), (0, -length % PARTS))).reshape(len(v), PARTS, -1)


def first_books(kept: DataFrame, length: int) -> np.ndarray:
    """(PARTS, entries, width): the parts of the smallest ids' vectors."""
    rows = kept.orderBy("vec_id", "embedding").limit(ENTRIES).collect()
    return _scaled(np.array([r["embedding"] for r in rows]).ravel(), length).transpose(1, 0, 2).copy()


def _binary(x: np.ndarray, kind: str):
    """One binary value a row."""
    import pyarrow as pa

    x = np.ascontiguousarray(x.reshape(len(x), -1), dtype=kind)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype="<i4") * x.strides[0]), pa.py_buffer(x)])


def _numbers(column, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def assigning(books: np.ndarray, moved: np.ndarray | None, length: int, last: bool):
    """mapInArrow function of one round; without moved, rows are vectors that have no bounds yet."""
    parts, entries, width = books.shape

    def run(batches):
        import pyarrow as pa

        sums, counts, measured = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64), 0
        rest = {"vec_id": pa.int64(), "label": None, "vector": pa.binary(), "code": pa.binary(), "upper": pa.binary(), "lower": pa.binary(), "error": pa.int64()}
        for whole in batches:
            rest["label"] = whole.schema.field("label").type
            for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                if moved is None:
                    x = _scaled(b.column("embedding").flatten().to_numpy(zero_copy_only=False), length)
                    states = [Bounds.measured(x[:, p], books[p]) for p in range(parts)]
                    measured += x.shape[0] * parts * entries
                else:
                    x = _numbers(b.column("vector"), "<i4", parts, width).astype(np.int64)
                    code, upper, lower = _numbers(b.column("code"), "u1", parts), _numbers(b.column("upper"), "<i8", parts), _numbers(b.column("lower"), "<i4", parts, entries)
                    states = [Bounds(code[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].astype(np.int64)) for p in range(parts)]
                    for p, s in enumerate(states):
                        s.shift(moved[p])
                        measured += s.reassign(x[:, p], books[p])
                code = np.stack([s.code for s in states], 1)
                if not last:
                    for p in range(parts):
                        np.add.at(sums[p], code[:, p], x[:, p])
                        counts[p] += np.bincount(code[:, p], minlength=entries)
                error = sum(_squares(x[:, p], books[p][code[:, p]]) for p in range(parts)) if last else np.zeros(len(x), np.int64)
                none = pa.nulls(len(x), pa.binary())
                columns = [b.column("vec_id"), b.column("label"), none if last else _binary(x, "<i4"), _binary(code, "u1"), none if last else _binary(np.stack([s.upper for s in states], 1), "<i8"), none if last else _binary(np.minimum(np.stack([s.lower for s in states], 1), _MOST_STORED), "<i4"), pa.array(error)]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(x), pa.int32()), *columns, pa.nulls(len(x), pa.list_(pa.int64()))], names=["kind", *rest, "sums"])
        if counts.any() or last:
            one = np.concatenate([sums.ravel(), counts.ravel(), [measured]])
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *(pa.nulls(1, t) for t in rest.values()), pa.array([one.tolist()], pa.list_(pa.int64()))], names=["kind", *rest, "sums"])

    return run


@dataclass(frozen=True)
class Codes:
    """rows: vec_id, label, code (one byte a part), error; books: (PARTS, entries, width); measured: distances taken in each pass."""

    rows: DataFrame
    books: np.ndarray
    measured: list[int]


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> Codes | None:
    """Fit the codebooks and assign every part. None if no row takes part."""
    spark = vectors.sparkSession
    kept, length = whole_numbers(vectors)
    if not length:
        return None
    books, moved, state, path, measured = first_books(kept, length), None, kept, None, []
    label = kept.schema["label"].dataType.simpleString()
    for k in range(rounds + 1):
        passed = state.mapInArrow(assigning(books, moved, length, k == rounds), f"kind int, vec_id long, label {label}, vector binary, code binary, upper binary, lower binary, error long, sums array<long>")
        before, path = path, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}-codes.parquet"
        passed.write.partitionBy("kind").option("compression", "zstd").parquet(path)
        if before:
            delete(spark, before)
        fields = [f for f in passed.schema if f.name not in ("kind", "sums")]
        state = spark.read.schema(passed.schema).parquet(path).where("kind = 0").select(*[f.name for f in fields])
        added = spark.read.schema(passed.schema).parquet(path).where("kind = 1").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        flat = np.array([r["x"] for r in sorted(added.collect())], np.int64)
        measured.append(int(flat[-1]))
        if k < rounds:
            sums, counts = flat[: books.size].reshape(books.shape), flat[books.size : -1].reshape(books.shape[:2])
            new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
            moved, books = _root_up(_squares(new, books)), new
    return Codes(state, books, measured)


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    done = encode(vectors)
    if done is None:
        none = require(vectors, "vec_id", "label").where("false")
        return none.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    sha = hashlib.sha256(",".join(map(str, done.books.ravel().tolist())).encode()).hexdigest()
    rows = done.rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    # a row a label and task is shuffled; a label with a third of the rows is split by the adaptive join
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
