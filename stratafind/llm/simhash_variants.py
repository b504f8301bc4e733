"""SimHash near-duplicates by deletion-variant signatures (operator 8).

Fingerprints that differ in at most `distance` = 4 of 64 bits agree, in one of three segments, up to a single bit. Each
distinct fingerprint is therefore indexed under every variant of a segment with one bit made a wildcard (64 in all); equal
variants meet in one sorted run and are verified on all 64 bits. A pair is accepted under one variant alone (the first
segment that differs by at most a bit, at the bit that differs, or the segment's first bit if none does), so no pair comes
twice. A run reports a spanning forest of its accepted pairs, not all of them, and runs beyond RUN members are dealt as
blocks, each two of which are compared in a task of their own: nothing is dropped, and no task holds more than two blocks.

Defined results: null, empty or blank text has fingerprint zero and links like any other; texts with fewer words than a
shingle are hashed whole; equal texts share a component; component_id is the smallest id reachable (null ids count last);
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage, sliced, to_python, written
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Bits of the three segments, from the lowest.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a run that one task compares; longer runs are split into blocks of this size.
RUN = 8192
#: Runs up to this size are compared pair by pair, all runs of a batch at once.
SMALL_RUN = 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.lower().split()
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    if n <= shingle:
        return [h(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [h(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return to_python(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _masks():
    """By variant: segment number, wildcard bit, mask of the bits that must be equal."""
    out = []
    for s, (low, bits) in enumerate(SEGMENTS):
        seg = ((1 << bits) - 1) << low
        out += [(s, p, seg & ~(1 << p)) for p in range(low, low + bits)]
    return out


_SEG = np.array([s for s, _, _ in _masks()])
_BIT = np.array([1 << p for _, p, _ in _masks()], dtype=np.uint64)
_FIRST = np.array([1 << SEGMENTS[s][0] for s, _, _ in _masks()], dtype=np.uint64)
_WHOLE = np.array([((1 << bits) - 1) << low for low, bits in SEGMENTS], dtype=np.uint64)


def _accepted(x, y, variant, distance):
    """Whether pairs link, and this variant is the one that reports them. Arrays of uint64; variant: array or number."""
    diff = x ^ y
    seg, bit = _SEG[variant], _BIT[variant]
    part = diff & _WHOLE[seg]
    ok = (np.bitwise_count(diff) <= distance) & ((part == bit) | ((part == 0) & (bit == _FIRST[variant])))
    for s in range(len(SEGMENTS) - 1):
        ok &= (seg <= s) | (np.bitwise_count(diff & _WHOLE[s]) >= 2)
    return ok


def _forest(f, g, variant, accept):
    """A spanning forest of the accepted pairs among f (g is None), or between f and g, as two arrays."""
    rest = np.arange(len(f) + (0 if g is None else len(g)))
    both = f if g is None else np.concatenate([f, g])
    left, right, todo = [], [], []
    while len(rest) or todo:
        if todo:
            i = todo.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
        if not len(rest):
            break
        hit = accept(both[i], both[rest], variant)
        if g is not None:
            hit &= (rest < len(f)) != (i < len(f))
        if hit.any():
            met = rest[hit]
            left.append(np.full(len(met), both[i]))
            right.append(both[met])
            todo += met.tolist()
            rest = rest[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that connect all fingerprints within `distance`, of distinct(fp)."""
    masks = np.array([m for _, _, m in _masks()], dtype=np.uint64)

    def index(batches):
        import pyarrow as pa

        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                key = (part[:, None] & masks).ravel()
                variant = np.tile(np.arange(64, dtype=np.int32), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(variant), pa.array(key.view(np.int64)), pa.array(np.repeat(part, 64).view(np.int64))], names=["variant", "key", "fp"])

    indexed = distinct.select("fp").mapInArrow(index, "variant int, key long, fp long")
    return meet(indexed, lambda x, y, variant: _accepted(x, y, variant, distance))


def meet(indexed: DataFrame, accept) -> DataFrame:
    """a, b: accepted pairs of fingerprints that share a variant and key: all of a small run, a spanning forest of others.

    accept(x, y, variant): which pairs of two arrays of uint64 link.
    """
    rows = "a long, b long, variant int, key long, block int, members binary"

    def batch_of(a, b, blocks=()):
        import pyarrow as pa

        n, m = len(a), len(blocks)
        v, k, c, data = zip(*blocks) if blocks else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*a.view(np.int64).tolist(), *[None] * m], pa.int64()), pa.array([*b.view(np.int64).tolist(), *[None] * m], pa.int64()),
                pa.array([*[None] * n, *v], pa.int32()), pa.array([*[None] * n, *k], pa.int64()), pa.array([*[None] * n, *c], pa.int32()), pa.array([*[None] * n, *data], pa.binary()),
            ],
            names=["a", "b", "variant", "key", "block", "members"],
        )

    def verify(batches):
        """Runs of equal (variant, key) come sorted; the last run of a batch waits for the next."""
        held = None  # variant, key, fp of the run not yet ended
        cut = 0  # blocks already cut from that run
        for b in _then_end(batches):
            if b is None:
                v, k, f = held if held is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))
                end = len(f)
            else:
                v, k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
                if held is not None:
                    v, k, f = (np.concatenate(p) for p in zip(held, (v, k, f)))
                if not len(f):
                    continue
                change = np.flatnonzero((v[1:] != v[:-1]) | (k[1:] != k[:-1]))
                end = int(change[-1]) + 1 if len(change) else 0
            starts = np.concatenate([[0], np.flatnonzero((v[1:end] != v[: end - 1]) | (k[1:end] != k[: end - 1])) + 1]) if end else np.zeros(0, int)
            sizes = np.diff(np.append(starts, end))
            blocks, a_out, b_out = [], [], []
            small = np.repeat(sizes <= SMALL_RUN, sizes)
            if cut and end:
                small[: sizes[0]] = False
            at = np.flatnonzero(small)
            for shift in range(1, SMALL_RUN):
                at = at[at + shift < end]
                at = at[(v[at] == v[at + shift]) & (k[at] == k[at + shift])]
                if not len(at):
                    break
                ok = at[accept(f[at], f[at + shift], v[at])]
                a_out.append(f[ok])
                b_out.append(f[ok + shift])
            big = np.flatnonzero(sizes > SMALL_RUN)
            if cut and end and 0 not in big:
                big = np.concatenate([[0], big])
            for r in big:
                members, start = f[starts[r] : starts[r] + sizes[r]], (cut if r == 0 else 0)
                for c, i in enumerate(range(0, len(members), RUN)):
                    x, y = _forest(members[i : i + RUN], None, int(v[starts[r]]), accept)
                    a_out.append(x)
                    b_out.append(y)
                    if start or len(members) > RUN:
                        blocks.append((int(v[starts[r]]), int(k[starts[r]]), start + c, members[i : i + RUN].tobytes()))
            if end:
                cut = 0
            held = (v[end:], k[end:], f[end:])
            while len(held[2]) >= 2 * RUN:  # of a run without end, full blocks leave at once
                x, y = _forest(held[2][:RUN], None, int(held[0][0]), accept)
                a_out.append(x)
                b_out.append(y)
                blocks.append((int(held[0][0]), int(held[1][0]), cut, held[2][:RUN].tobytes()))
                held, cut = tuple(p[RUN:] for p in held), cut + 1
            a = np.concatenate(a_out) if a_out else np.zeros(0, np.uint64)
            if len(a) or blocks:
                yield batch_of(a, np.concatenate(b_out), blocks) if a_out else batch_of(a, a, blocks)

    def across(batches):
        import pyarrow as pa

        for b in batches:
            for v, f, g in zip(*[b.column(i).to_pylist() for i in range(3)]):
                x, y = _forest(np.frombuffer(f, np.uint64), np.frombuffer(g, np.uint64), v, accept)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()), pa.array(y.view(np.int64), pa.int64())], names=["a", "b"])

    met = cut_lineage(indexed.repartition("variant", "key").sortWithinPartitions("variant", "key").mapInArrow(verify, rows))
    blocks = met.where("members IS NOT NULL").select("variant", "key", "block", "members")
    pairs = block_pairs(blocks, ["variant", "key"], ["members"]).select("variant", "members", "members2")
    return met.where("members IS NULL").select("a", "b").unionByName(pairs.mapInArrow(across, "a long, b long"))


def block_pairs(blocks: DataFrame, keys: list[str], held: list[str]) -> DataFrame:
    """Each two blocks of a key, with what they hold (the second's columns end in 2): a row of its own place for each pair.

    The pairs are listed on their numbers alone; what the blocks hold joins them by block, and the pairs are dealt one by one.
    """
    numbers = blocks.select(*keys, "block")
    listed = numbers.join(numbers.withColumnRenamed("block", "block2"), keys).where("block < block2")
    second = blocks.select(*keys, F.col("block").alias("block2"), *[F.col(c).alias(c + "2") for c in held])
    both = listed.join(blocks, [*keys, "block"]).join(second, [*keys, "block2"])
    return both.repartition(*keys, "block", "block2")


def _then_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every document."""
    marked = cut_lineage(fingerprints(docs, shingle))
    # distinct fingerprints: copies meet here, pre-aggregated, and are compared once
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _named(marked, nodes, components(links(nodes, distance)).withColumnRenamed("node", "fp"))


def _named(marked: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """marked(doc_id, fp) with the least document of each component; found(fp, root) has the fingerprints that have links.

    Roots are joined after their minimum was written, so that both sides come straight from a shuffle and a common root or a
    common fingerprint is split by the adaptive rule.
    """
    rooted = cut_lineage(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


#: Of pairs at the least similarity, the share that meet under some key.
MEET = 0.998
#: 64-bit words of a wide fingerprint at least; all but the first are cut into segments.
WIDE_WORDS = 32
#: Bits of a segment that are varied, one at a time: those decided by the fewest shingles.
VARIED = 4
#: Sets of up to this many shingles differ in up to FEW_BITS of the bits at 0.8 (ties of their counts), by enumeration.
FEW, FEW_BITS = 24, 0.19
#: Words that go with an index entry; pairs that meet and differ there by 4 deviations above FEW_BITS are chance.
NARROW_WORDS = 2
NARROW = int(64 * NARROW_WORDS * FEW_BITS + 4 * math.sqrt(64 * NARROW_WORDS * FEW_BITS * (1 - FEW_BITS)))
#: Deviations above the expected difference of wide fingerprints up to which pairs are verified on their shingles.
ROOM = 4
#: Texts of a cloud up to which each of its pairs is named; of larger ones the texts are named as one family.
PAIRED = 4
#: Shingles that a task holds of a family, or of each of two blocks of one; RUN texts at most.
BLOCK_SHINGLES = 1 << 21


def bit_difference(similarity: float) -> float:
    """Expected share of bits in which the fingerprints of sets of like size and this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@functools.cache
def segment_share(bits: int, similarity: float, shingles: int = 60, trials: int = 4000) -> float:
    """Share of pairs of sets of `shingles` at this similarity that share a key of a segment, from drawn bit counts."""
    r, both = np.random.default_rng(bits), round(2 * similarity * shingles / (1 + similarity))
    common = 2 * r.binomial(both, 0.5, (trials, bits)) - both
    a, b = (common + 2 * r.binomial(shingles - both, 0.5, (trials, bits)) - (shingles - both) for _ in "ab")
    keys = []
    for c in (a, b):
        value = ((c > 0) << np.arange(bits)).sum(1)
        least = np.argsort(np.abs(c), axis=1, kind="stable")[:, :VARIED]
        keys.append(np.concatenate([value[:, None], value[:, None] ^ 1 << least], 1))
    return float((keys[0][:, :, None] == keys[1][:, None, :]).any((1, 2)).mean())


def plan_segments(rows: int, similarity: float) -> tuple[int, int, int]:
    """Bits of a segment, segments, words: keys stay about as many as rows / 4, segments reach MEET at any count."""
    bits = max(20, math.ceil(math.log2(max(2, rows))) - 2)
    count = math.ceil(math.log(1 - MEET) / math.log(1 - segment_share(bits, similarity)))
    return bits, count, max(WIDE_WORDS, 1 + math.ceil(bits * count / 64))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, shingle), dtype="<u8"))


def set_name(h: np.ndarray) -> int:
    """The 64 bits that name a set of shingle hashes, as a signed long; zero for the empty one."""
    import xxhash

    name = xxhash.xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0
    return name - (1 << 64) if name >> 63 else name


def bit_counts(h: np.ndarray, words: int) -> np.ndarray:
    """Of a set of shingle hashes, how many have each of 64 * words bits, mixed from the hash."""
    counts, mix = np.zeros(64 * words, np.int64), np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):  # that many ones still fit a byte
        x = h[at : at + 255, None] + mix
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return counts


def wide_fingerprint(h: np.ndarray, words: int, bits: int, count: int) -> tuple[bytes, bytes]:
    """`words` 64-bit SimHash words of a set of shingle hashes, and the VARIED least certain bits of each of `count` segments."""
    counts = bit_counts(h, words)
    margin = np.abs(2 * counts[64 : 64 + bits * count] - len(h)).reshape(count, bits)
    least = np.argsort(margin, axis=1, kind="stable")[:, :VARIED].astype(np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").tobytes(), least.tobytes()


def _clouds(words, first=None):
    """Components (places) of two texts or more whose narrow words differ by at most NARROW bits; first: only pairs across
    this place count."""
    rest = np.arange(len(words))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        cloud = [*todo]
        while todo and len(rest):
            i = todo.pop()
            hit = np.bitwise_count(words[i] ^ words[rest]).sum(1, dtype=np.int64) <= NARROW
            if first is not None:
                hit &= (rest < first) != (i < first)
            if hit.any():
                met = rest[hit].tolist()
                todo += met
                cloud += met
                rest = rest[~hit]
        if len(cloud) > 1:
            yield np.sort(np.array(cloud))


def _candidates(indexed: DataFrame) -> DataFrame:
    """From indexed(key, name, w0, w1): a, b, sure (names of texts to be looked at together).

    Clouds of up to PAIRED texts give every pair within NARROW, which may still be told apart by wide fingerprints (sure is
    false); larger ones give their least name with each other one, so rows stay as many as their texts. Runs of more than RUN
    texts are cut into blocks, which meet each other as tasks of their own.
    """
    rows = "a long, b long, sure boolean, key long, block int, f binary, g binary"

    def batch_of(pairs, more):
        import pyarrow as pa

        a, b, sure = (np.concatenate([np.zeros(0, t), *[p[i] for p in pairs]]) for i, t in enumerate((np.int64, np.int64, bool)))
        n, m = len(a), len(more)
        k, c, f, g = zip(*more) if more else ((), (), (), ())
        none = [None]
        columns = (none * n + list(k), pa.int64()), (none * n + list(c), pa.int32()), (none * n + list(f), pa.binary()), (none * n + list(g), pa.binary())
        told = [pa.array(x.tolist() + none * m, t) for x, t in ((a, pa.int64()), (b, pa.int64()), (sure, pa.bool_()))]
        return pa.RecordBatch.from_arrays([*told, *[pa.array(*x) for x in columns]], names=["a", "b", "sure", "key", "block", "f", "g"])

    def of_block(name, words, pairs, first=None):
        for cloud in _clouds(words, first):
            if len(cloud) <= PAIRED:
                x, y = (cloud[i] for i in np.triu_indices(len(cloud), 1))
                ok = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int64) <= NARROW
                if first is not None:
                    ok &= (x < first) != (y < first)
                x, y = name[x[ok]], name[y[ok]]
                pairs.append((np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), bool)))
            else:
                own = np.sort(name[cloud])
                pairs.append((np.full(len(own) - 1, own[0]), own[1:], np.ones(len(own) - 1, bool)))

    def verify(batches):
        """Runs of equal keys come sorted; the last run of a batch waits for the next, full blocks of it leave at once."""
        k, n, w, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, NARROW_WORDS), np.uint64), 0
        for b in _then_end(batches):
            if b is not None:
                now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2 + NARROW_WORDS)]
                k, n, w = np.concatenate([k, now[0]]), np.concatenate([n, now[1]]), np.concatenate([w, np.stack(now[2:], 1).view(np.uint64)])
            change = np.flatnonzero(k[1:] != k[:-1]) + 1
            end = len(k) if b is None else int(change[-1]) if len(change) else 0
            starts = np.concatenate([[0], change[change < end]]).astype(int) if end else np.zeros(0, int)
            sizes = np.diff(np.append(starts, end)) if end else starts
            pairs, more = [], []
            large = sizes > PAIRED
            if cut and end:
                large[0] = True
            at = np.flatnonzero(np.repeat(~large, sizes))
            for shift in range(1, PAIRED):
                at = at[at + shift < end]
                at = at[k[at] == k[at + shift]]
                if not len(at):
                    break
                ok = at[np.bitwise_count(w[at] ^ w[at + shift]).sum(1, dtype=np.int64) <= NARROW]
                x, y = n[ok], n[ok + shift]
                pairs.append((np.minimum(x, y), np.maximum(x, y), np.zeros(len(ok), bool)))
            for r in np.flatnonzero(large):
                lo, hi, block = starts[r], starts[r] + sizes[r], cut if r == 0 else 0
                for i in range(lo, hi, RUN):
                    j = min(i + RUN, hi)
                    of_block(n[i:j], w[i:j], pairs)
                    if block or hi - lo > RUN:
                        more.append((int(k[lo]), block, n[i:j].tobytes(), w[i:j].tobytes()))
                    block += 1
            if end:
                cut = 0
            k, n, w = k[end:], n[end:], w[end:]
            while len(k) >= 2 * RUN:
                of_block(n[:RUN], w[:RUN], pairs)
                more.append((int(k[0]), cut, n[:RUN].tobytes(), w[:RUN].tobytes()))
                k, n, w, cut = k[RUN:], n[RUN:], w[RUN:], cut + 1
            if more or any(len(p[0]) for p in pairs):
                yield batch_of(pairs, more)

    def across(batches):
        for b in batches:
            for r in range(b.num_rows):
                f, g, x, y = (np.frombuffer(b.column(i)[r].as_py(), np.int64) for i in range(4))
                pairs = []
                of_block(np.concatenate([f, g]), np.concatenate([x, y]).view(np.uint64).reshape(-1, NARROW_WORDS), pairs, len(f))
                if any(len(p[0]) for p in pairs):
                    yield batch_of(pairs, [])

    met = cut_lineage(indexed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, rows))
    blocks = met.where("key IS NOT NULL").select("key", "block", "f", "g")
    pairs = block_pairs(blocks, ["key"], ["f", "g"]).select("f", "f2", "g", "g2")
    return met.where("key IS NULL").unionByName(pairs.mapInArrow(across, rows)).select("a", "b", "sure").where("a < b").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, fp, component_id: documents linked by a Jaccard similarity of their shingle sets of `similarity` or more.

    64 bits tell such pairs badly from others, so fingerprints are wide and cut into as many segments as let MEET of the
    pairs at the least similarity share a key: a segment's value, or a variant with one of its least certain bits changed.
    Pairs that meet are held against each other on the whole width, with ROOM; that only spares work: each link is verified on
    the two sets of shingle hashes, so no pair below `similarity` links.
    Texts that meet are first put into families, then each family is compared on its shingle sets in full: in one task, or
    block by block if it is large. So no pair that meets is lost, and rows grow with texts and not with pairs. A family in which
    hardly any two are alike costs the square of its size in time, not in memory.
    fp names the set of shingles (64-bit hash); texts of one set count as one. Null, empty and blank texts share the name zero;
    null ids count last; repeated rows give repeated results; an empty table gives no rows.
    """
    bits, count, words = plan_segments(docs.count(), similarity)
    limit, loose = (int(64 * words * p + ROOM * math.sqrt(64 * words * p * (1 - p))) for p in (bit_difference(similarity), max(FEW_BITS, bit_difference(similarity))))

    def close(apart, less, more):
        """Whether pairs may be alike, by their wide fingerprints and sizes of sets."""
        return (apart <= np.where(less <= FEW, loose, limit)) & (less >= similarity * more - 1e-9)

    def prints(batches):
        import pyarrow as pa

        for b in sliced(batches):
            sets = [shingle_set(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            made = [wide_fingerprint(h, words, bits, count) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([set_name(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), *[pa.array([m[i] for m in made], pa.binary()) for i in (0, 1)]],
                names=["doc_id", "fp", "n", "wide", "least_sure"],
            )

    def index(batches):
        import pyarrow as pa

        flips = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        used = -(-bits * count // 8)
        for b in sliced(batches):
            fp = b.column(0).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            whole = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(fp), -1)
            least = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(fp), count, VARIED)
            narrow = np.ascontiguousarray(whole[:, : 8 * NARROW_WORDS]).view(np.int64)
            cut = np.unpackbits(whole[:, 8 : 8 + used], axis=1, bitorder="little")[:, : bits * count].reshape(len(fp), count, bits)
            value = (cut * flips).sum(2, dtype=np.uint64) | np.arange(count, dtype=np.uint64) << np.uint64(bits)
            key = np.concatenate([value[:, :, None], value[:, :, None] ^ flips[least]], 2).view(np.int64).reshape(len(fp), -1)
            row = np.repeat(np.arange(len(fp)), key.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(fp[row]), *[pa.array(narrow[row, i]) for i in range(NARROW_WORDS)]], names=["key", "name", *(f"w{i}" for i in range(NARROW_WORDS))])

    def near(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u8").reshape(b.num_rows, -1) for i in (2, 3))
                n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                ok = pa.array(close(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), np.minimum(n, m), np.maximum(n, m)))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    marked = written(to_python(docs, "doc_id", "text").mapInArrow(prints, "doc_id long, fp long, n int, wide binary, least_sure binary"))
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("wide").alias("wide"), F.min("least_sure").alias("least_sure")))
    indexed = nodes.select("fp", "wide", "least_sure").mapInArrow(index, "key long, name long, " + ", ".join(f"w{i} long" for i in range(NARROW_WORDS)))
    met = cut_lineage(_candidates(indexed))
    side = lambda i, w, n: nodes.select(F.col("fp").alias(i), F.col("wide").alias(w), F.col("n").alias(n))
    told = met.where("NOT sure").join(side("a", "x", "n"), "a").join(side("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m")
    together = told.mapInArrow(near, "a long, b long").unionByName(met.where("sure").select("a", "b"))
    families = components(together).select(F.col("node").alias("name"), F.col("root").alias("family"))
    families = cut_lineage(families.join(nodes.select(F.col("fp").alias("name"), "least", "n"), "name"))
    held = _sets(docs, families.select("name", "least"), shingle)
    return _named(marked.select("doc_id", "fp"), nodes.select("fp", "least"), _verified(families, held, similarity))


def _alike(name: np.ndarray, side: np.ndarray, sets: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """name, root (least name) of the texts linked by a similarity of their sets; of two sides only pairs across them count.

    Each text that is reached is held against all those of fitting size that are not, so a pair goes unseen only if both are
    linked already.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]  # the empty set is like no other
    name, side, size, sets = name[order], side[order], size[order], [sets[i] for i in order]
    none = np.zeros(0, np.int64)
    if len(name) < 2:
        return none, none
    values, grams = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts, two, marked = ends - size, side.min() < side.max(), np.zeros(len(values), bool)
    # the texts that were open when last looked through, by size
    live, open_, at = np.ones(len(name), bool), np.arange(len(name)), 0
    now, now_start, now_size, left = grams, np.append(starts, len(grams)), size, len(name)
    names, roots = [], []
    while at < len(name):
        if not live[at]:
            at += 1
            continue
        todo, group = [at], [at]
        live[at], left = False, left - 1
        while todo and left:
            if 2 * left < len(open_):
                keep = live[open_]
                now, open_ = now[np.repeat(keep, now_size)], open_[keep]
                now_size = size[open_]
                now_start = np.concatenate([[0], np.cumsum(now_size)])
            i = todo.pop()
            lo = int(np.searchsorted(now_size, similarity * size[i] - 1e-6))
            hi = int(np.searchsorted(now_size, size[i] / similarity + 1e-6, "right"))
            if lo >= hi:
                continue
            own = grams[starts[i] : ends[i]]
            marked[own] = True
            both = np.add.reduceat(marked[now[now_start[lo] : now_start[hi]]], now_start[lo:hi] - now_start[lo], dtype=np.int64)
            marked[own] = False
            ok = live[open_[lo:hi]] & (both >= similarity * (size[i] + now_size[lo:hi] - both) - 1e-9)
            if two:
                ok &= side[open_[lo:hi]] != side[i]
            hit = open_[lo:hi][ok].tolist()
            live[hit], left = False, left - len(hit)
            todo += hit
            group += hit
        if len(group) > 1:
            names.append(name[group])
            roots.append(np.full(len(group), name[group].min()))
    return (np.concatenate(names), np.concatenate(roots)) if names else (none, none)


def _verified(families: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """fp, root of the texts of families(name, family, n) that are linked by the similarity of their sets, held(name, grams).

    A family of up to RUN texts and BLOCK_SHINGLES shingles is one group; a larger one is dealt into blocks, of which each one
    and each two are a group, and what these link is joined after. A text goes to as many groups as its family has blocks.
    """

    def run(batches):
        import pyarrow as pa

        def answer(parts):
            name, side = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            found = _alike(name, side, [s for p in parts for s in p[2]], similarity)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["fp", "root"])

        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            group = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            name, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            starts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1])
            for at, end in zip(starts, [*starts[1:], len(group)]):
                if held and tuple(group[at]) != now:
                    yield answer(held)
                    held = []
                now = tuple(group[at])
                # copied: a group that goes on does not keep its batches
                held.append((name[at:end].copy(), side[at:end].copy(), [np.frombuffer(x.as_buffer(), "<u8").copy() for x in b.column(5).slice(at, end - at)]))
        if held:
            yield answer(held)

    size = families.groupBy("family").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n").cast("long")).alias("shingles"))
    parts = F.greatest(F.ceil(F.col("texts") / RUN), F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    many = cut_lineage(size.select("family", parts.alias("parts")).where("parts > 1"))
    placed = families.join(many, "family", "left").select("name", "family", F.coalesce("parts", F.lit(1)).alias("parts"))
    block = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
    other = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = other.select("name", "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    told = sides.join(held, "name").select("family", "i", "j", "name", "side", "grams")
    groups = ["family", "i", "j"]
    found = cut_lineage(told.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, "fp long, root long"))
    if not many.head(1):
        return found
    return components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("fp"), "root")


def _sets(docs: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """name, grams (binary: the sorted shingle hashes) of asked(name, least), from the texts of their least documents."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            sets = [shingle_set(t or b"", shingle) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["name", "grams"])

    texts = to_python(docs, "doc_id", "text")
    ids = asked.select("least").distinct()
    wanted = texts.join(ids, texts["doc_id"].eqNullSafe(ids["least"]), "left_semi").select("text")
    made = wanted.mapInArrow(run, "name long, grams binary").join(asked.select("name"), "name", "left_semi")
    return written(made.dropDuplicates(["name"]))


def hexadecimal(fp):
    """The column fp as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
