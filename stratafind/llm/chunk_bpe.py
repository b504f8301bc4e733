"""BPE encoding with content-defined chunk reuse, and decoding (operator 6).

A rolling hash over the last 16 bytes cuts a text where the hash hits a fixed pattern, so equal passages give equal chunks
wherever they stand. A task encodes a chunk once and keeps it in a bounded store; a later document with that chunk takes
its ids from there. A chunk's ids are trusted only between its first and its last white space. Each join is repaired by
encoding the words around it anew with the library: the words cut by the join, and one whole word of each side whose ids are
known. If the new ids begin and end with the known ones, both sides agree and the middle is taken; else twice as many words
of both sides are taken, until they agree or a side has no more, and then the text is encoded whole.

Chunks are shared by the documents of a task. Sharing them among tasks would shuffle the texts themselves, which
takes longer than encoding them (see the README for figures).

Defined results: null text is the empty text (no ids, empty decoding); a text without white space is one seam; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .bpe import default_path, encoder
from .common import SLICE_ROWS, sliced, to_python

#: A cut on average every so many bytes (a power of two).
MEAN_CHUNK = 512
#: Bytes of chunks and ids a task keeps; the store starts anew when full.
STORE_BYTES = 48_000_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_stores: dict[str, "ChunkEncoder"] = {}


def cuts(data: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Places to cut, found from the 16 bytes before each; the hash of a window is built by doubling."""
    import numpy as np

    if len(data) < 32:
        return []
    h = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    factor = 0x01000193
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + h[:-width] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
    h ^= h >> np.uint32(16)
    return (np.flatnonzero((h & np.uint32(mean - 1)) == 0) + 1).tolist()


class ChunkEncoder:
    def __init__(self, path: str):
        self.words = encoder(path)
        self.store: dict[bytes, tuple[bytes, list[bytes], bytes, bytes] | None] = {}
        self.held = 0
        self.reused = 0
        self.fresh = 0
        self.widened = 0

    def chunk(self, chunk: bytes) -> tuple[bytes, list[bytes], bytes, bytes] | None:
        """Head up to the first white space, whole words, their ids, tail after the last one; None without white space."""
        if chunk in self.store:
            self.reused += 1
            return self.store[chunk]
        self.fresh += 1
        first = _SPACE.search(chunk)
        entry, size = None, 0
        if first is not None:
            last = max(chunk.rfind(c) for c in b" \t\n\r\x0b\x0c")
            middle = chunk[first.start() : last + 1]
            entry = (chunk[: first.start()], middle.split(), self.words.encode(middle), chunk[last + 1 :])
            size = len(entry[2]) + 2 * len(middle)
        if self.held > STORE_BYTES:
            self.store.clear()
            self.held = 0
        self.store[chunk] = entry
        self.held += 2 * len(chunk) + size + 300
        return entry

    def joined(self, left: list[bytes], seam: bytes, right: list[bytes]) -> bytes | None:
        """Ids of what a join has cut, from an encoding that agrees with the words on both sides; None if none does."""
        n = 1
        while True:
            before, after = left[-n:], right[:n]
            known = [self.words.encode(b" ".join(w)) for w in (before, after)]
            made = self.words.library(b" ".join([*before, seam, *after]))
            if len(made) >= len(known[0]) + len(known[1]) and made.startswith(known[0]) and made.endswith(known[1]):
                return made[len(known[0]) : len(made) - len(known[1])]
            self.widened += 1
            if n >= max(len(left), len(right)):
                return None
            n *= 2

    def encode(self, data: bytes) -> bytes:
        if not self.words.by_words:
            return self.words.library(data)
        out: list[bytes] = []
        left, seam, at = [], [], 0
        for cut in [*cuts(data), len(data)]:
            if cut == at:
                continue
            entry = self.chunk(data[at:cut])
            if entry is None:
                seam.append(data[at:cut])
            else:
                head, words, ids, tail = entry
                between = b"".join([*seam, head])
                # white space on both sides of the join leaves nothing cut
                repaired = self.joined(left, between, words) if between else b""
                if repaired is None:
                    return self.words.library(data)
                out += [repaired, ids]
                left, seam = words or left[-1:], [tail]
            at = cut
        if rest := b"".join(seam):
            repaired = self.joined(left, rest, [])
            if repaired is None:
                return self.words.library(data)
            out.append(repaired)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.words.decode(ids)

    def clear(self) -> None:
        """Forget all chunks and words."""
        self.store.clear()
        self.held = 0
        self.words.clear()


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _stores:
        _stores[path] = ChunkEncoder(path)
    return _stores[path]


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = True, text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with `ids` also the ids, with `text` the decoded text (both binary)."""
    path = path or default_path()

    def run(batches):
        import pyarrow as pa

        enc = chunk_encoder(path)
        for b in sliced(batches, SLICE_ROWS, enc):
            made, back = [], []
            for data in b.column(1).cast(pa.binary()).to_pylist():
                made.append(enc.encode(data or b""))
                back.append(enc.decode(made[-1]))
            cols = [
                b.column(0).cast(pa.int64()),
                pa.array([len(x) // 4 for x in made], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(made, pa.binary())], [*names, "ids"]
            if text:
                cols, names = [*cols, pa.array(back, pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids + ", decoded binary" * text
    return to_python(docs, "doc_id", "text").mapInArrow(run, schema)
