"""Best-fit packing with swap-based local search (operator 1).

Documents become pieces of at most `capacity` tokens (end token included). Pieces are dealt evenly into groups of a bounded
number of pieces, each group is packed best-fit decreasing, and while a group holds more sequences than its lower bound any
two underfull ones exchange pieces: by moves, one-for-one and two-for-one exchanges, each of which raises the sum of squared
fills, so that the emptiest run empty. Where that ends above the bound it begins again from best fit in another order, STARTS
times in all. Sequences left well short of full are taken apart and packed again across groups, in ever fewer groups.

Defined results: null or empty text is one piece holding the end token alone; repeated rows are packed as often as they
occur; ties go to the earlier piece of the group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib

from pyspark.sql import DataFrame, functions as F

from .bpe import default_path, encoder
from .common import SLICE_ROWS, cut_lineage, groups_for, sliced, to_python

CAPACITY = 4096
END_ID = 1
#: Pieces of a packing group: bounds a task's memory and the search.
GROUP_PIECES = 32_768
#: Packings that the search begins from, and by how much sizes are varied for the order of further ones.
STARTS, SHUFFLE = 4, 0.3
#: Sequences below this share of the capacity are packed again across groups.
SEALED_SHARE = 0.995

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise and cut. One row per piece; token ids stay on the worker, only their checksum leaves it."""
    path = path or default_path()
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in sliced(batches, SLICE_ROWS, enc):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids = enc.encode(text or b"") + end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return to_python(docs, "doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int, order: list[float] | None = None) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that takes it. Bins hold item numbers. order: decreasing in this."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    by = order or lengths
    for i in sorted(range(len(lengths)), key=lambda i: (-by[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), capacity - n
            bins.append([i])
        if r:
            by_room[r].append(b)
            rooms |= 1 << r
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound of the bins: for each k, pieces over capacity - k need one each, those over half another, and what of the
    pieces from k on does not fit beside these needs more."""
    import numpy as np

    s = np.sort(np.asarray(lengths, np.int64))
    before, half = np.concatenate([[0], np.cumsum(s)]), int(np.searchsorted(s, capacity // 2, "right"))
    k = np.unique(np.concatenate([[0], s[:half]]))
    up_to = np.maximum(np.searchsorted(s, capacity - k, "right"), half)
    room = (up_to - half) * capacity - (before[up_to] - before[half])
    rest = before[half] - before[np.searchsorted(s[:half], k, "left")]
    return int((len(s) - half + np.maximum(0, -(-(rest - room) // capacity))).max(initial=0))


class Exchanges:
    """Bins of pieces, and the moves and exchanges between any two underfull ones that raise the sum of squared fills.

    One that brings d more tokens into bin A from bin B raises it if A ends fuller than B was. For each bin, fullest first, the
    exchange that fills it most is made, with whichever other bin, until none is left.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        import numpy as np

        self.size, self.capacity = np.asarray(lengths, np.int64), capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(self.size[b].sum()) for b in self.bins], np.int64)
        self.of = np.empty(len(self.size), np.int64)
        for k, b in enumerate(self.bins):
            self.of[b] = k
        self._sort()

    def _sort(self) -> None:
        """Pieces of underfull bins by bin and size."""
        import numpy as np

        items = np.flatnonzero(self.fill[self.of] < self.capacity)
        key = self.of[items] * (self.capacity + 1) + self.size[items]
        order = np.argsort(key, kind="stable")
        self.items, self.key = items[order], key[order]

    def best_for(self, a: int) -> tuple[int, tuple, tuple]:
        """Tokens that bin a gains at most, and pieces it takes from one other bin and gives back: one or two for none or one, or
        one for two."""
        import numpy as np

        room, fill = int(self.capacity - self.fill[a]), int(self.fill[a])
        items, size, of = self.items, self.size[self.items], self.of[self.items]
        other, theirs, place = of != a, self.fill[of], np.arange(len(items))
        best: tuple[int, tuple, tuple] = (0, (), ())

        def try_(gain, ok, take, give) -> bool:
            """Keep the largest gain; whether it fills the bin."""
            nonlocal best
            ok = ok & other & (gain > best[0]) & (gain <= room) & (fill + gain > theirs)
            if ok.any():
                k = int(np.argmax(np.where(ok, gain, -1)))
                best = int(gain[k]), take(k), give(k)
            return best[0] == room

        own = sorted(self.bins[a], key=lambda i: (int(self.size[i]), i))
        for back in [(), *((i,) for i in {int(self.size[i]): i for i in reversed(own)}.values())]:
            given = int(self.size[list(back)].sum()) if back else 0
            if try_(size - given, True, lambda k: (int(items[k]),), lambda k, back=back: back):
                return best
            # the largest second piece of the same bin that still fits
            second = np.searchsorted(self.key, of * (self.capacity + 1) + np.minimum(room + given - size, self.capacity), "right") - 1
            second = np.minimum(second, place - 1)
            there = np.maximum(second, 0)
            if try_(size + size[there] - given, (second >= 0) & (of[there] == of), lambda k, there=there: (int(items[k]), int(items[there[k]])), lambda k, back=back: back):
                return best
        if len(own) > 1:
            x, y = np.triu_indices(len(own), 1)
            sums, first = np.unique(self.size[own][x] + self.size[own][y], return_index=True)
            pair = np.searchsorted(sums, size - room)  # the smallest that makes room enough
            there = np.minimum(pair, len(sums) - 1)
            try_(size - sums[there], pair < len(sums), lambda k: (int(items[k]),), lambda k: (own[x[first[there[k]]]], own[y[first[there[k]]]]))
        return best

    def exchange(self, a: int, gain: int, take: tuple, give: tuple) -> None:
        b = int(self.of[take[0]])
        for pieces_, source, to in ((take, b, a), (give, a, b)):
            for i in pieces_:
                self.bins[source].remove(i)
                self.bins[to].append(i)
                self.of[i] = to
        self.fill[a] += gain
        self.fill[b] -= gain
        self._sort()

    def improve(self, least: int) -> list[list[int]]:
        """The bins that are left at a local optimum, or at the lower bound."""
        moved = True
        while moved:
            moved = False
            for a in (-self.fill).argsort(kind="stable").tolist():
                while 0 < self.fill[a] < self.capacity:
                    gain, take, give = self.best_for(a)
                    if not gain:
                        break
                    self.exchange(a, gain, take, give)
                    moved = True
                    if (self.fill > 0).sum() <= least:
                        return [b for b in self.bins if b]
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, starts: int = STARTS) -> list[list[int]]:
    """The fewest bins that exchanges come to, from these and from best fit in further orders; done at the lower bound."""
    least, r = least_bins(lengths, capacity), random.Random(len(lengths))
    best = [b for b in bins if b]
    for _ in range(starts):
        if len(best) <= least:
            break
        now = Exchanges(bins, lengths, capacity).improve(least)
        best = now if len(now) < len(best) else best
        bins = best_fit(lengths, capacity, [n * (1 + SHUFFLE * r.random()) for n in lengths])
    return best


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32)."""

    def of_group(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        at, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for b, items in enumerate(bins):
            place = 0
            for i in items:
                at[i], offset[i] = b, place
                place += lengths[i]
            for i in items:
                fill[i] = place
        return pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "grp")}, "bin": at, "offset": offset, "fill": fill})

    todo, n, done, turn = cut_lineage(pieces_df), None, None, 0
    n = todo.count()
    while True:
        k = groups_for(n, group_pieces)
        # monotonically_increasing_id is fixed here: todo was materialised
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(k)))
        packed = cut_lineage(dealt.groupBy("grp").applyInPandas(of_group, PIECES + ", grp long, bin long, offset long, fill long"))
        out = packed.withColumn("sequence_id", F.shiftleft(F.lit(turn).cast("long"), 56) + F.shiftleft("grp", 24) + F.col("bin"))
        sealed = F.col("fill") >= int(capacity * SEALED_SHARE)
        cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        left = packed.where(~sealed).count() if k > 1 else 0
        if k == 1 or groups_for(left, group_pieces) >= k:
            part = out.select(cols)
            return part if done is None else done.unionByName(part)
        part = out.where(sealed).select(cols)
        done = part if done is None else done.unionByName(part)
        todo, n, turn = packed.where(~sealed).select("doc_id", "piece", "start", "length", "ids_crc32"), left, turn + 1
        if not left:
            return done


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)
