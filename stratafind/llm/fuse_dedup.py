"""Exact deduplication against immutable snapshots that binary fuse filters screen (operator 12).

A snapshot is a batch's distinct texts, kept as a table bucketed by digest, and never changed. A static 3-wise binary fuse
filter (Graf and Lemire, 2022) over the digests that were new in it stands beside each part of a snapshot's digests. An incoming
batch is grouped by itself first: its equal texts become one arrival. Arrivals whose digest passes no filter are new, with
certainty, and nothing of a snapshot is read for them; those that pass meet the exact bucket of their digest, where texts are
compared byte by byte. Both tables are bucketed alike, so no text is shuffled for that.

Only digests are shuffled to the filters. Texts are shuffled once, after a task has put its equal ones together, so that a text
that a third of all rows hold arrives once a task. Filters have a bounded number of digests each, and arrivals are dealt in
further parts where a batch is larger than the snapshot. Should two texts share a digest, the bytes tell: every row of such a
digest is grouped by digest and text instead.

Defined results: null texts count as empty ones; texts are compared whole; rows with null ids count for group_size, but stay
only where no row of the group has an id; of rows repeated under one id one stays; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint_dir, cut_lineage, delete, groups_for, require

#: Digests under one filter, and arrivals that one task holds against it: bound a task's memory.
FILTER_KEYS, ARRIVALS = 1 << 17, 1 << 18
#: Batches the query deals its table into: the first becomes a snapshot, the next is screened by it.
BATCHES = 2
FILTER = "part long, seed long, segment long, segments long, slots binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key."""
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


@dataclass(frozen=True)
class FuseFilter:
    """Static set of 64-bit keys: every member passes, of other keys one in 65,536."""

    seed: int
    segment: int
    segments: int
    slots: np.ndarray

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots for each key, in neighbouring segments."""
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> FuseFilter:
        """Filter of distinct keys. Slots with one key left are peeled off round by round, all of a round at once."""
        n = max(2, len(keys))
        segment = min(1 << 18, max(4, 1 << int(math.log(n) / math.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(room / segment) - 2)
        size = (segments + 2) * segment
        for seed in range(1, 1000):
            h = _mixed(keys, seed)
            places = cls._places(h, segment, segments)
            degree = np.bincount(places.ravel(), minlength=size)
            held = np.zeros(size, np.int64)
            for row in places:
                np.bitwise_xor.at(held, row, np.arange(len(keys)))
            rounds, single = [], np.flatnonzero(degree == 1)
            while single.size:
                key, at = np.unique(held[single], return_index=True)
                rounds.append((key, single[at]))
                touched = places[:, key].ravel()
                np.subtract.at(degree, touched, 1)
                np.bitwise_xor.at(held, touched, np.tile(key, 3))
                touched = np.unique(touched)
                single = touched[degree[touched] == 1]
            if sum(len(k) for k, _ in rounds) == len(keys):
                break
        else:
            raise ValueError("keys of a filter are not distinct")
        slots, prints = np.zeros(size, np.uint16), cls._prints(h)
        for key, at in reversed(rounds):  # no key of a round touches the slot of another
            a, b, c = places[:, key]
            slots[at] = prints[key] ^ slots[a] ^ slots[b] ^ slots[c]
        return cls(seed, segment, segments, slots)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys, self.seed)
        a, b, c = self._places(h, self.segment, self.segments)
        return self.slots[a] ^ self.slots[b] ^ self.slots[c] == self._prints(h)


@dataclass(frozen=True)
class Snapshot:
    """entries: digest, texts (one, unless digests collide), keep_id, n, of a whole batch, in the catalog under a name;
    filters: of the digests new in it."""

    name: str
    entries: DataFrame
    filters: DataFrame
    parts: int

    def drop(self) -> None:
        spark = self.entries.sparkSession
        spark.sql(f"DROP TABLE {self.name}")
        delete(spark, f"{checkpoint_dir(spark)}/{self.name}")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digested(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, text, digest."""
    return require(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))


def grouped(batch: DataFrame) -> str:
    """A batch's own duplicates put together: one row a digest, in a table bucketed by it. Its name."""
    spark = batch.sparkSession
    found = batch.groupBy("digest").agg(F.collect_set("text").alias("texts"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    name = f"texts_{uuid.uuid4().hex}"
    # the grouping has dealt the rows by digest into as many parts, so that this shuffles nothing
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.bucketBy(buckets, "digest").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return name


def _key(digest: str = "digest"):
    return F.xxhash64(digest)


def filters(new: DataFrame, parts: int) -> DataFrame:
    """FILTER rows for the distinct digests, dealt into parts."""

    def build(part):
        import pyarrow as pa

        keys = np.unique(part.column("key").to_numpy().view(np.uint64))
        f = FuseFilter.of(keys)
        return pa.table({"part": pa.array([part.column("part")[0].as_py()], pa.int64()), "seed": pa.array([f.seed], pa.int64()), "segment": pa.array([f.segment], pa.int64()), "segments": pa.array([f.segments], pa.int64()), "slots": pa.array([f.slots.astype("<u2").tobytes()], pa.binary())})

    keyed = new.select(_key().alias("key")).distinct().select(F.pmod("key", F.lit(parts)).alias("part"), "key")
    return keyed.groupBy("part").applyInArrow(build, FILTER)


def screened(arrivals: DataFrame, snapshot: Snapshot, count: int) -> DataFrame:
    """The digests of arrivals that the snapshot's filters let pass: all that it holds, and few others."""
    deals = groups_for(count, snapshot.parts * ARRIVALS)
    asked = arrivals.select("digest", _key().alias("key")).select("digest", "key", F.pmod("key", F.lit(snapshot.parts)).alias("part"), F.pmod(F.xxhash64("key"), F.lit(deals)).alias("deal"))
    held = snapshot.filters.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))

    def test(asked, held):
        if not asked.num_rows or not held.num_rows:
            return asked.select(["digest"]).slice(0, 0)
        row = held.to_pylist()[0]
        f = FuseFilter(row["seed"], row["segment"], row["segments"], np.frombuffer(row["slots"], "<u2"))
        return asked.select(["digest"]).filter(f.passes(asked.column("key").to_numpy().view(np.uint64)))

    return asked.groupBy("part", "deal").cogroup(held.groupBy("part", "deal")).applyInArrow(test, f"digest {dict(arrivals.dtypes)['digest']}")


def matched(arrivals: DataFrame, positives: DataFrame, snapshot: Snapshot) -> DataFrame:
    """digest, same: whether the texts that arrive are those of the exact bucket, byte by byte. One row a digest that meets."""
    arrived = arrivals.select("digest", F.col("texts").alias("arrived")).join(positives, "digest", "left_semi")
    return arrived.join(snapshot.entries.select("digest", "texts"), "digest").select("digest", ((F.size("texts") == 1) & (F.array_sort("arrived") == F.array_sort("texts"))).alias("same"))


def ingest(batch: DataFrame, snapshots: list[Snapshot]) -> tuple[Snapshot, DataFrame]:
    """The batch (doc_id, text, digest) as the next snapshot, and digest, same of its arrivals that earlier ones hold."""
    name = grouped(batch)
    arrivals = batch.sparkSession.table(name)
    count = arrivals.count()
    met = [matched(arrivals, screened(arrivals, s, count), s) for s in snapshots]
    # a digest that passes two filters may stand in both tables, as owned by one and known to the other
    known = cut_lineage(reduce(DataFrame.unionByName, met).groupBy("digest").agg(F.min("same").alias("same"))) if met else arrivals.sparkSession.createDataFrame([], arrivals.select("digest").withColumn("same", F.lit(True)).schema)
    new = arrivals.select("digest").join(known, "digest", "left_anti") if met else arrivals.select("digest")
    parts = groups_for(count, FILTER_KEYS)
    return Snapshot(name, arrivals, cut_lineage(filters(new, parts)), parts), known


def groups_of(ingested: list[tuple[Snapshot, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """digest, keep_id, group_size over all snapshots, for digests of one text; and the digests that stand for several."""
    kept = [s.entries.select("digest", "keep_id", "n", (F.size("texts") > 1).alias("mixed")) for s, _ in ingested]
    owned = [kept[0], *(k.join(known, "digest", "left_anti") for k, (_, known) in zip(kept[1:], ingested[1:]))]
    added = [k.join(known, "digest").select("digest", "keep_id", "n", (F.col("mixed") | ~F.col("same")).alias("mixed")) for k, (_, known) in zip(kept[1:], ingested[1:])]
    found = cut_lineage(reduce(DataFrame.unionByName, owned + added).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max("mixed").alias("mixed")))
    return found.where("NOT mixed").drop("mixed"), found.where("mixed").select("digest")


def deduplicate(docs: DataFrame, batches: int = BATCHES, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (the digest): rows arrive in so many batches, each a snapshot for those after it."""
    rows = digested(docs, digest)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    ingested: list[tuple[Snapshot, DataFrame]] = []
    for k in range(batches):
        ingested.append(ingest(rows.where(batch == k), [s for s, _ in ingested]))
    groups, mixed = groups_of(ingested)
    for s, _ in ingested:  # the groups are stored by now
        s.drop()
    # rows of one id and digest travel as one
    found = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times")).join(groups, "digest")
    if not mixed.isEmpty():  # different texts under one digest: the bytes are the key
        some = rows.join(mixed, "digest", "left_semi")
        whole = some.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = some.groupBy("doc_id", "digest", "text").agg(F.count(F.lit(1)).alias("times")).join(whole, ["digest", "text"])
        found = found.unionByName(apart.select(*found.columns))
    one = found.select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return one.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
