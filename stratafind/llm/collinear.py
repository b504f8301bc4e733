"""Substring de-duplication by collinear chaining (operator 7).

Each document is read as lower-cased words. Seeds are hashes of its K-word windows below a limit (one in SPARSE), wherever
they stand, which do not depend on the words around them and so serve passages with changed words; and of its windows of
MIN_PART words the smallest of every WINNOW neighbours. A seed of MIN_PART words is a part that counts by itself, whichever
document it is matched with, and any two texts with WINNOW + MIN_PART - 1 equal words in a row share one: so no equal passage
is lost because its shorter windows first stood elsewhere, each in another place. Seeds meet in two steps: inside a map task's block of documents, each occurrence of a seed is matched with the seed's first place in the
smallest document of the block; then only the occurrences in that document go to the seed's bucket and are matched with its
first place in the smallest document of all. So links grow with the occurrences, a bucket receives a seed once for a block
however common it is, and every occurrence outside the first document is matched with an earlier document.
A short seed carries four bits of each of the AROUND words on both sides; a match whose words differ there on both sides is
chance.

Matches of two documents are ordered and chained: the score of a chain adds SEED for each match and takes GAP for each word
skipped on either side; the best predecessor of a match is a prefix maximum in a Fenwick tree over places of the other
document. Chains break at gaps of more than MAX_GAP words, and are then aligned word by word, between their matches and
outwards, which admits replaced, added and lost words: an equal word adds one, any other takes the price at which MIN_ALIKE
comes out even, and a part ends where the sum falls DROP below its best. Parts of one document that touch or overlap are
judged together, and those that come to MIN_WORDS are reported; so a passage whose parts first stood in different documents
is found as well. A chain whose words an earlier, longer one has covered is not aligned again.

Defined results: rows without id or text, and texts of fewer words than a part needs, take no part; equal ids are one
document; rows report the later document (larger id) and an earlier one where the passage stands; a passage repeated inside
one document alone is not reported; ties of chain scores go to the earlier match; repeated rows change nothing; an empty
table gives no rows; other columns are ignored. Places are word numbers from 0, ends exclusive. Passages whose runs of equal
words are all shorter than WINNOW + MIN_PART - 1 are found as soon as one of their equal windows of K words is a seed: with
every sixth word changed that leaves about one in fifty passages of 60 words unfound, and one in forty of 55. How rows are
dealt over tasks may decide which earlier document is named, not whether an equal passage is found.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_ROWS, cut_lineage, give_back, sliced, to_python, written

K = 5
WINNOW = 24
SPARSE = 3
MIN_WORDS = 50
#: An aligned part counts if it is this long (a multiple of K) and this alike.
MIN_PART = 20
MIN_ALIKE = 0.8
SEED, GAP = 16.0, 0.2
#: Words between two matches of a chain at most, on either side: bounds the alignment between them.
MAX_GAP = 40
#: Fall of an alignment's sum that ends a part between matches, and outwards of them.
DROP, DROP_OUT = 64, 24
#: Both sides of a chain are fetched with this margin, the earlier one in steps of STEP words (fewer different requests).
MARGIN, STEP = 64, 64
#: Words on each side of a seed of which it carries four bits each (AROUND bytes in all), and how many must agree on one side.
AROUND, AGREE = 4, 3
#: Seeds of a map task's block, and seeds of a bucket aimed at: bound the memory of a task, not the result.
BLOCK_SEEDS, BUCKET_SEEDS = 250_000, 250_000
#: Words whose hashes a worker keeps; the memo starts anew when full.
MEMO_WORDS = 250_000

_LAST = np.iinfo(np.int64).max
_LIMIT = -(2**63) + 2**64 // SPARSE


class _WordHashes(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def winnowed(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the smallest hash of every `window` neighbours."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, int)

    def slide(x, f):
        width, out = 1, x
        while 2 * width <= window:
            out = f(out[:-width], out[width:])
            width *= 2
        rest = window - width
        return f(out[: len(out) - rest], out[rest:]) if rest else out

    least = slide(hashes, np.minimum)
    pad = np.full(window - 1, np.iinfo(np.int64).min)
    return np.flatnonzero(slide(np.concatenate([pad, least, pad]), np.maximum) == hashes)


def seeds_of(texts: list[bytes], min_words: int = MIN_PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, hash, place and neighbours (AROUND words to the left, then to the right) of the texts' seeds."""
    if len(_hashes) > MEMO_WORDS:
        _hashes.clear()
    pad = max(WINNOW, AROUND + K)  # between texts, so that no window or neighbour is another text's
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        if len(w) >= min_words:
            sizes[i] = len(w)
            words += w
    total = len(words) + pad * (len(texts) + 1)
    starts = pad * np.arange(1, len(texts) + 1) + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = np.zeros(total, np.uint64)
    code[starts[of] + place] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = code[: total - K + 1].copy()
    for k in range(1, K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : total - K + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))).view(np.int64)
    whole = place + K <= np.repeat(sizes, sizes)
    valid = np.zeros(len(h), bool)
    valid[(starts[of] + place)[whole]] = True
    h[~valid] = _LAST
    at = np.flatnonzero((h < _LIMIT) & valid)
    nibble, around = code & np.uint64(15), np.zeros(len(at), np.uint64)
    for j in range(AROUND):
        around |= nibble[at - 1 - j] << np.uint64(4 * j)
        around |= nibble[at + K + j] << np.uint64(4 * (AROUND + j))
    # windows of MIN_PART words, of the hashes of the windows in them; nothing around them has to agree
    long = np.full(max(0, len(h) - MIN_PART + K), _LAST)
    inside = np.flatnonzero(valid[: len(long)] & valid[MIN_PART - K : MIN_PART - K + len(long)])
    x = np.full(len(inside), 0x51AFD7ED558CCD25, np.uint64)
    for k in range(0, MIN_PART, K):
        x = (x ^ h[inside + k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    long[inside] = x.view(np.int64)
    least = winnowed(long)
    least = least[long[least] != _LAST]
    at, seeds, around = np.concatenate([at, least]), np.concatenate([h[at], long[least]]), np.concatenate([around, np.zeros(len(least), np.uint64)])
    text = np.searchsorted(starts, at, "right") - 1
    return text, seeds, (at - starts[text]).astype(np.int32), around


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether neighbours agree in AGREE words on one side."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x1111111111111111)
    side = np.uint64((1 << 4 * AROUND) - 1)
    return np.minimum(np.bitwise_count(x & side), np.bitwise_count(x >> np.uint64(4 * AROUND))) <= AROUND - AGREE


def met(h, doc, pos, around):
    """Matches with the first place of each hash: doc, first, pos, first_pos; and the numbers of all places in first documents."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos, around = h[order], doc[order], pos[order], around[order]
    head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    of = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = doc != doc[of]
    ok = np.flatnonzero(later & _agree(around, around[of]))
    return (doc[ok], doc[of[ok]], pos[ok], pos[of[ok]]), order[~later]


_HEAD = struct.Struct("<qq??")


def seeds_as_bytes(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, around: np.ndarray) -> bytes:
    """Seeds column by column, documents from the smallest on, in as few bytes as these and the places take."""
    base = int(doc.min())
    wide, far = int(doc.max()) - base >= 1 << 32, int(pos.max()) >= 1 << 16
    from_base = doc.view(np.uint64) - np.uint64(base % (1 << 64))
    return b"".join([_HEAD.pack(len(h), base, wide, far), h.tobytes(), around.astype(f"<u{AROUND}").tobytes(), from_base.astype("<u8" if wide else "<u4").tobytes(), pos.astype("<u4" if far else "<u2").tobytes()])


def seeds_from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, base, wide, far = _HEAD.unpack_from(data)
    at, out = _HEAD.size, []
    for kind in ("<i8", f"<u{AROUND}", "<u8" if wide else "<u4", "<u4" if far else "<u2"):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * out[-1].itemsize
    h, around, doc, pos = out
    return h, (doc.astype(np.uint64) + np.uint64(base % (1 << 64))).view(np.int64), pos.astype(np.int32), around.astype(np.uint64)


def matches(docs: DataFrame, min_part: int = MIN_PART) -> DataFrame:
    """doc, first, pos, first_pos: occurrences of seeds, each with a place in an earlier document."""
    texts = to_python(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(4 * partitions, int(chars / 6 / SPARSE / BUCKET_SEEDS)).bit_length()
    link = np.dtype([("doc", "<i8"), ("first", "<i8"), ("pos", "<i4"), ("first_pos", "<i4")])

    def rows_of(parts, shape):
        out = np.empty(len(parts[0]), shape)
        for name, p in zip(shape.names, parts):
            out[name] = p
        return out

    def local(batches):
        """bucket, seeds (binary) or links (binary) of a block of documents."""
        import pyarrow as pa

        def flush(held):
            h, doc, pos, around = (np.concatenate(c) for c in zip(*held))
            found, go = met(h, doc, pos, around)
            bucket = (h[go].view(np.uint64) >> np.uint64(20)) & np.uint64(buckets - 1)
            order = np.argsort(bucket, kind="stable")
            (h, doc, pos, around), bucket = (c[go][order] for c in (h, doc, pos, around)), bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
            made = [seeds_as_bytes(h[a:b], doc[a:b], pos[a:b], around[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(h)))]
            linked = rows_of(found, link)
            chunks = [linked[a : a + 20_000] for a in range(0, len(linked), 20_000)]
            where = [*bucket[cuts].astype(np.int32).tolist(), *[int(c["doc"][0] * 31 + c["pos"][0]) % buckets for c in chunks]]
            return pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array([*made, *[None] * len(chunks)], pa.binary()), pa.array([*[None] * len(made), *[c.tobytes() for c in chunks]], pa.binary())], names=["bucket", "seeds", "links"]
            )

        held, size = [], 0
        for b in sliced(batches, SLICE_ROWS, _hashes):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            text, h, pos, around = seeds_of(b.column(1).cast(pa.binary()).to_pylist(), min_part)
            held.append((h, ids[text], pos, around))
            size += len(h)
            if size >= BLOCK_SEEDS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)
        give_back()

    def shared(batches):
        """Links of the blocks as they are; seeds of a bucket, which come one after another, matched with each other."""
        import pyarrow as pa

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "first", "pos", "first_pos"])

        def answer(held):
            return batch_of(met(*map(np.concatenate, zip(*map(seeds_from_bytes, held))))[0])

        now, held = None, []
        for b in batches:
            for bucket, seeds, links in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if links is not None:
                    data = np.frombuffer(links, link)
                    yield batch_of([data[n] for n in link.names])
                    continue
                if bucket != now and held:
                    yield answer(held)
                    held = []
                now = bucket
                held.append(seeds)
        if held:
            yield answer(held)
        give_back()

    blocks = texts.mapInArrow(local, "bucket int, seeds binary, links binary")
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "doc long, first long, pos int, first_pos int")


def chain(xs: list[int], ys: list[int]) -> list[list[int]]:
    """Chains of matches (numbers into xs, ys) by falling score; matches are sorted by xs. Each match is in one chain."""
    n = len(xs)
    score, parent = [0.0] * n, [-1] * n
    if all(a < b for a, b in zip(xs, xs[1:])) and all(a < b for a, b in zip(ys, ys[1:])):
        # in order on both sides: the match before is the best predecessor
        for m in range(n):
            gain = score[m - 1] - GAP * (xs[m] - xs[m - 1] + ys[m] - ys[m - 1]) if m else 0.0
            score[m], parent[m] = (SEED + gain, m - 1) if gain > 0 else (SEED, -1)
    else:
        _scored(xs, ys, score, parent)
    used, out = [False] * n, []
    for m in sorted(range(n), key=lambda m: (-score[m], m)):
        if used[m]:
            continue
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = parent[m]
        out.append(path[::-1])
    return out


def _scored(xs: list[int], ys: list[int], score: list[float], parent: list[int]) -> None:
    """Best score and predecessor of each match, from prefix maxima in a Fenwick tree over the ranks of ys."""
    n, rank = len(xs), {y: r for r, y in enumerate(sorted(set(ys)), 1)}
    size = len(rank)
    best: list[tuple[float, int]] = [(-1e300, -1)] * (size + 1)
    i = 0
    while i < n:
        same = i
        while same < n and xs[same] == xs[i]:
            same += 1
        for m in range(i, same):  # matches at one place cannot follow each other
            top, r = (-1e300, -1), rank[ys[m]] - 1
            while r > 0:
                top = max(top, best[r], key=lambda t: t[0])
                r &= r - 1
            gain = top[0] - GAP * (xs[m] + ys[m])
            score[m], parent[m] = (SEED + gain, top[1]) if gain > 0 else (SEED, -1)
        for m in range(i, same):
            value, r = score[m] + GAP * (xs[m] + ys[m]), rank[ys[m]]
            while r <= size:
                if value > best[r][0]:
                    best[r] = (value, m)
                r += r & -r
        i = same


def _broken(path: list[int], xs: list[int], ys: list[int]):
    """The chain's stretches without a gap of more than MAX_GAP words on either side."""
    at = 0
    for k in range(1, len(path)):
        if max(xs[path[k]] - xs[path[k - 1]], ys[path[k]] - ys[path[k - 1]]) > MAX_GAP + K:
            yield path[at:k]
            at = k
    yield path[at:]


def chains(matched: DataFrame) -> DataFrame:
    """doc, first, x0, lo, hi, anchors (binary: pairs of 32-bit word numbers): lo to hi is what is asked of the first document.

    Rows without first ask for lo to hi of the document itself, its chains' places with their margins, put together.
    """
    names = ["doc", "first", "x0", "lo", "hi", "anchors"]

    def run(batches):
        import pyarrow as pa

        def of_pair(doc, first, x, y):
            once = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            x, y = x[once].tolist(), y[once].tolist()
            for whole in chain(x, y):
                for path in _broken(whole, x, y):
                    a = np.array([[x[m], y[m]] for m in path], dtype="<i4")
                    lo, hi = max(0, int(a[0, 1]) - MARGIN), int(a[-1, 1]) + K + MARGIN
                    yield doc, first, int(a[0, 0]), lo - lo % STEP, hi + -hi % STEP, a.tobytes(), int(a[-1, 0]) + K

        def of_doc(found):
            out, lo, hi = [r[:6] for r in found], None, None
            for _, _, x0, _, _, _, x1 in sorted(found, key=lambda r: r[2]):
                a, b = max(0, x0 - MARGIN), x1 + MARGIN
                if hi is not None and a <= hi:
                    hi = max(hi, b)
                    continue
                if hi is not None:
                    out.append((found[0][0], None, None, lo, hi, None))
                lo, hi = a, b
            return [*out, (found[0][0], None, None, lo, hi, None)]

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        to_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=names)
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32)] * 2
        for b in _then_end(batches):
            if b is not None:
                held = [np.concatenate([a, b.column(i).to_numpy(zero_copy_only=False)]) for i, a in enumerate(held)]
            doc, first, x, y = held
            if b is None:
                end = len(doc)
            else:  # the last document waits for the next batch
                end = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
            cuts = np.flatnonzero(np.concatenate([[True], (doc[1:end] != doc[: end - 1]) | (first[1:end] != first[: end - 1])])) if end else np.zeros(0, int)
            rows, found = [], []
            for p, q in zip(cuts.tolist(), np.append(cuts[1:], end).tolist()):
                if found and found[0][0] != doc[p]:
                    rows += of_doc(found)
                    found = []
                found += of_pair(int(doc[p]), int(first[p]), x[p:q], y[p:q])
                if len(rows) > 5000:
                    yield to_batch(rows)
                    rows = []
            if found:
                rows += of_doc(found)
            if rows:
                yield to_batch(rows)
            held = [c[end:] for c in held]

    # a document's matches are bounded by its own seeds, whatever its passages' spread
    dealt = matched.repartition("doc").sortWithinPartitions("doc", "first", "pos", "first_pos")
    return dealt.mapInArrow(run, "doc long, first long, x0 int, lo int, hi int, anchors binary")


def _then_end(batches):
    yield from batches
    yield None


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in the bits of a number."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


_STEPS = tuple(s for d in (1, 2, 3) for s in ((d, d), (d, 0), (0, d)))


def _outward(a: list[bytes], b: list[bytes], i: int, j: int, step: int, price: float, least_i: int = 0, least_j: int = 0) -> tuple[int, int, int, float]:
    """Words gained on both sides, matches and sum from (i, j) on; replaced, added and lost words are stepped over."""
    x, y, hits, total = i, j, 0, 0.0
    best = (0, 0, 0, 0.0)
    while least_i <= x < len(a) and least_j <= y < len(b) and total > best[3] - DROP_OUT:
        if a[x] == b[y]:
            x, y, hits, total = x + step, y + step, hits + 1, total + 1
            if total > best[3]:
                best = (abs(x - i), abs(y - j), hits, total)
            continue
        for p, q in _STEPS:
            u, v = x + p * step, y + q * step
            if all(least_i <= u + k * step < len(a) and least_j <= v + k * step < len(b) and a[u + k * step] == b[v + k * step] for k in range(3)):
                break
        else:
            p = q = 1
        x, y, total = x + p * step, y + q * step, total - price * max(p, q)
    return best


def align(a: list[bytes], b: list[bytes], anchors: list[tuple[int, int]], alike: float = MIN_ALIKE) -> list[tuple[int, int, int, int, int]]:
    """x0, x1, y0, y1 and matched words of the parts of the alignment through the anchors, each at least `alike`."""
    price, out = alike / max(1e-9, 1 - alike), []

    def begin(x, y, floor_x, floor_y):
        gx, gy, hits, total = _outward(a, b, x - 1, y - 1, -1, price, floor_x, floor_y)
        return [x - gx, y - gy, x + K, y + K, hits + K, total + K]

    def close(best):
        x0, y0, i, j, n, _ = best
        gx, gy, hits, _ = _outward(a, b, i, j, 1, price)
        out.append((x0, i + gx, y0, j + gy, n + hits))

    now = begin(*anchors[0], 0, 0)
    best = list(now)
    for x, y in anchors[1:]:
        x0, y0, i, j, n, total = now
        if x >= i and y >= j:
            equal = common(a[i:x], b[j:y])
            total += equal - price * (max(x - i, y - j) - equal)
            if total < best[5] - DROP or total <= 0:
                close(best)
                now = begin(x, y, min(x, out[-1][1]), min(y, out[-1][3]))
                best = list(now)
                continue
            now = [x0, y0, x + K, y + K, n + equal + K, total + K]
        elif x - i == y - j:
            gain = max(0, x + K - i)  # overlaps on one diagonal
            now = [x0, y0, i + gain, j + gain, n + gain, total + gain]
        else:
            continue
        if now[5] >= best[5]:
            best = list(now)
    close(best)
    return out


_NAMES = ["doc_id", "source_doc_id", "start_word", "end_word", "source_start", "source_end", "n_match"]


def aligned(chained: DataFrame, docs: DataFrame, min_words: int, min_part: int, min_alike: float) -> DataFrame:
    """_NAMES and words_hash (of the later document's words) of the passages along the chains."""
    texts = to_python(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    own = F.col("first").isNull()
    # a popular place is asked for once
    requests = chained.select(F.coalesce("first", "doc").alias("id"), own.alias("own"), "lo", "hi").distinct()
    asked = requests.groupBy("id").agg(F.collect_list(F.struct("own", "lo", "hi")).alias("asked"))

    def slices(batches):
        import pyarrow as pa

        for b in sliced(batches):
            rows = []
            for i, asks, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                words = text.lower().split()
                rows += [(i, q["own"], q["lo"], q["hi"], b" ".join(words[q["lo"] : q["hi"]])) for q in asks]
            types = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names=["id", "own", "lo", "hi", "part"])

    cut = texts.join(asked, texts["doc_id"] == asked["id"]).select("id", "asked", "text").mapInArrow(slices, "id long, own boolean, lo int, hi int, part binary")
    parts = written(cut)

    def run(batches):
        """A document's own words come before its chains, document after document."""
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64())
        now, blocks, chained = None, [], []
        for b in _then_end(sliced(batches)):
            rows = []
            for r in zip(*[b.column(i).to_pylist() for i in range(5)]) if b is not None else [(None,) * 5]:
                if r[0] != now:
                    if chained:
                        rows += of_doc(now, blocks, chained, min_words, min_part, min_alike)
                    now, blocks, chained = r[0], [], []
                if r[0] is not None:
                    (blocks if r[1] is None else chained).append(r[1:])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types)], names=[*_NAMES, "words_hash"])

    given = parts.where("NOT own").select(F.col("id").alias("first"), "lo", "hi", "part")
    sides = chained.where(~own).join(given, ["first", "lo", "hi"]).select("doc", "first", "lo", "anchors", "part")
    selves = parts.where("own").select(F.col("id").alias("doc"), F.lit(None).cast("long").alias("first"), "lo", F.lit(None).cast("binary").alias("anchors"), "part")
    dealt = selves.unionByName(sides).repartition("doc").sortWithinPartitions("doc", F.col("first").asc_nulls_first(), "lo", "anchors")
    return dealt.mapInArrow(run, ", ".join(f"{c} {'long' if i < 2 else 'int'}" for i, c in enumerate(_NAMES)) + ", words_hash long")


def of_doc(doc: int, blocks, chained, min_words: int, min_part: int, min_alike: float) -> list[tuple]:
    """A document's rows; blocks: (first, lo, anchors, part) of its own words, chained: the same of its chains."""
    import xxhash

    blocks = sorted(((lo, part.split()) for _, lo, _, part in blocks), key=lambda b: b[0])
    starts, covered, found = [lo for lo, _ in blocks], [bytearray(len(w)) for _, w in blocks], []
    for first, ylo, anchors, part in sorted(chained, key=lambda c: (-len(c[2]), c[0], c[2])):
        at, other = np.frombuffer(anchors, "<i4").reshape(-1, 2).tolist(), None
        k = bisect_right(starts, at[0][0]) - 1
        xlo = starts[k]
        # texts under one id may differ: the block that holds the words counts
        while k >= 0 and starts[k] == xlo:
            words = blocks[k][1]
            a, b = at[0][0] - xlo, at[-1][0] + K - xlo
            if covered[k].find(0, a, b) < 0 and b <= len(words):
                break  # a longer chain has these words
            other = part.split() if other is None else other
            pairs = [(x - xlo, y - ylo) for x, y in at if x - xlo + K <= len(words) and words[x - xlo : x - xlo + K] == other[y - ylo : y - ylo + K]]
            if pairs:
                for x0, x1, y0, y1, n in align(words, other, pairs, min_alike):
                    if x1 - x0 >= min_part:
                        covered[k][x0:x1] = b"\1" * (x1 - x0)
                        found.append([x0 + xlo, x1 + xlo, first, y0 + ylo, y1 + ylo, n, k])
                break
            k -= 1
    found.sort()
    rows, island, end = [], [], -1
    for f in [*found, None]:
        if f is None or f[0] > end:
            if island and end - island[0][0] >= min_words:
                rows += island
            island, end = [], -1
        if f is not None:
            end = max(f[1], end)
            last = island[-1] if island else None
            if last and last[2] == f[2] and last[6] == f[6] and last[1] - last[4] == f[1] - f[4] and f[3] >= last[3] and f[1] > last[1]:
                last[5] += min(f[5], f[1] - last[1])  # goes on where the one before ends
                last[1], last[4] = f[1], f[4]
            elif not (last and last[2] == f[2] and f[1] <= last[1] and f[4] <= last[4] and f[3] >= last[3]):
                island.append(f)
    out = []
    for x0, x1, first, y0, y1, n, k in rows:
        h = xxhash.xxh3_64_intdigest(b" ".join(blocks[k][1][x0 - starts[k] : x1 - starts[k]]))
        out.append((doc, first, x0, x1, y0, y1, n, h - (1 << 64) if h >> 63 else h))
    return out


def found_in(docs: DataFrame, min_words: int = MIN_WORDS, min_part: int = MIN_PART, min_alike: float = MIN_ALIKE) -> DataFrame:
    """passages() and words_hash, the hash of the later document's words in the passage."""
    return aligned(cut_lineage(chains(matches(docs, min_part))), docs, min_words, min_part, min_alike)


def passages(docs: DataFrame, min_words: int = MIN_WORDS, min_part: int = MIN_PART, min_alike: float = MIN_ALIKE) -> DataFrame:
    """Repeated passages: doc_id, source_doc_id, start_word, end_word, source_start, source_end, n_match."""
    return found_in(docs, min_words, min_part, min_alike).select(_NAMES)


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """documents with their repeated passages cut out (an earlier one stays); those left blank go.

    With words_hash in `found`, a span is cut only from texts that hold its words there: texts under one id may differ. Rows
    with null id or text stay as they are, repeated rows are cut alike; n_chars, where there is such a column, follows the text.
    """
    hashed = F.col("words_hash") if "words_hash" in found.columns else F.lit(None).cast("long")
    spans = found.groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word", hashed.alias("words_hash")))).alias("spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else _cut(t, s) for t, s in zip(text, spans)], dtype=object)

    # the row is kept whole under one name, so that no column of it can clash
    rows = to_python(docs).select(F.struct("*").alias("row"))
    joined = rows.join(spans, F.col("row.doc_id") == F.col("of"), "left")
    hit = F.col("spans").isNotNull() & F.col("row.text").isNotNull()
    made = joined.select("row", hit.alias("hit"), cut(F.when(hit, F.col("row.text")), F.col("spans")).alias("left")).where("NOT hit OR length(left) > 0")
    text = F.when(F.col("hit"), F.col("left")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("hit"), F.length("left").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return made.select([new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def _cut(text: str, spans) -> str:
    import xxhash

    at, out, keep = 0, [], [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for s in spans:
        lo, hi, h = s["start_word"], s["end_word"], s["words_hash"]
        if hi > len(keep) or (h is not None and not pd.isna(h) and xxhash.xxh3_64_intdigest(b" ".join(text[a:b].encode().lower() for a, b in keep[lo:hi])) != h % (1 << 64)):
            continue
        a, b = keep[lo][0], keep[hi - 1][1]
        out.append(text[at : max(at, a)])
        at = max(at, b)
    left = "".join([*out, text[at:]])
    return left if left.strip(" \t\n\x0b\x0c\r") else ""
