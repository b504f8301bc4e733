"""Structure-aware chunks. Work inside one document runs in Arrow batches; nothing here shuffles texts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


BIG, BIG_OVERLAP, SMALL, SMALL_OVERLAP = 512, 64, 256, 32
KEEP, RESPLIT = 1.1, 1.5
DIMENSIONS = 64
BATCH_ROWS, SLICE_ROWS = 1000, 100

_HEADING = re.compile(r"^(?:#{1,4}\s+.+|[A-Z][A-Z\s]{3,}$|\d+(?:\.\d+)*\.?\s+[A-Z].+)", re.M)
_PAGE = re.compile(r"\[Page (\d+)\]")
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)\s*")


def split_sections(text: str) -> list[tuple[str, str, int]]:
    """(text, section, page): segments between headings and page marks, each under the latest of both; headings go."""
    marks = sorted([(m.start(), m.end(), None, int(m[1])) for m in _PAGE.finditer(text)] + [(m.start(), m.end(), m[0].lstrip("# ").strip(), None) for m in _HEADING.finditer(text)], key=lambda x: x[0])
    if not marks:
        return [(text, "Preamble", 1)]
    out, section, page, at = [], "Preamble", 1, 0
    for start, end, title, number in [*marks, (len(text), len(text), None, None)]:
        if part := text[at:start].strip():
            out.append((part, section, page))
        section, page, at = title if title is not None else section, number if number is not None else page, end
    return out


def _each(df: DataFrame, fn, columns: list[str], schema: str) -> DataFrame:
    """Rows of fn(*values) for each row's columns. Whole texts come in Arrow batches of BATCH_ROWS, and of those SLICE_ROWS at a
    time are Python objects, so that a worker's memory does not follow its share of the table."""

    import pyarrow as pa

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")]

    def run(batches):
        for b in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            rows = [r for values in zip(*[c.to_pylist() for c in b.columns]) for r in fn(*values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [[]] * len(fields), fields)], names=[n for n, _ in fields])

    return df.select(*columns).mapInArrow(run, schema)


def sections(docs: DataFrame) -> DataFrame:
    return _each(docs, lambda i, t: [(i, k, *s) for k, s in enumerate(split_sections(t or ""))], ["doc_id", "text"], "doc_id long, pos int, text string, section string, page int")


def count_tokens(text: str) -> int:
    return len(text.split())


def sentences(text: str) -> list[str]:
    return [m[0] for m in _SENTENCE.finditer(text) if m[0].strip()]


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Greedy chunks of at most `size` words; a chunk starts with the last sentences of the one before, up to `overlap`."""
    units: list[str] = []
    for s in sentences(text):
        words = s.split()
        units += [s.strip()] if len(words) <= size else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
    out, now, n = [], [], 0
    for u in units:
        k = count_tokens(u)
        if now and n + k > size:
            out.append(" ".join(now))
            tail, held = [], 0
            for p in reversed(now):
                if held + count_tokens(p) > overlap or held + count_tokens(p) + k > size:
                    break
                tail, held = [p, *tail], held + count_tokens(p)
            now, n = tail, held
        now, n = [*now, u], n + k
    return out + [" ".join(now)] if now else out


def embed(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Deterministic default provider: signed hashing of words, unit norm."""
    v = np.zeros(dimensions)
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dimensions] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def split_semantic(text: str, percentile: float = 95.0) -> list[str]:
    """Cut where the distance of neighbouring sentence windows is over the text's percentile."""
    s = sentences(text)
    if len(s) < 3:
        return [text.strip()] if text.strip() else []
    e = np.array([embed(" ".join(s[max(0, i - 1) : i + 2])) for i in range(len(s))])
    gap = 1 - (e[1:] * e[:-1]).sum(1)
    cut = np.flatnonzero(gap > np.percentile(gap, percentile)) + 1
    return [p for a, b in zip([0, *cut], [*cut, len(s)]) if (p := "".join(s[a:b]).strip())]


def split_big(text: str, big: int = BIG, overlap: int = BIG_OVERLAP) -> list[str]:
    """Whole if near the size; else cut by meaning, parts still too long by sentences."""
    if count_tokens(text) <= KEEP * big:
        return [text]
    return [q for p in split_semantic(text) for q in ([p] if count_tokens(p) <= RESPLIT * big else pack_sentences(p, big, overlap))]


def big_chunks(docs: DataFrame) -> DataFrame:
    """chunk_id, doc_id, ord, section_title, page_number, text."""

    def of(i, text):
        n = 0
        for part, section, page in split_sections(text or ""):
            for chunk in split_big(part):
                yield f"{i}-{n}", i, n, section, page, chunk
                n += 1

    return _each(docs, of, ["doc_id", "text"], "chunk_id string, doc_id long, ord int, section_title string, page_number int, text string")


def children(big: DataFrame) -> DataFrame:
    """chunk_id, parent_id, ord, text: small chunks of each big one."""
    return _each(big, lambda p, t: [(f"{p}-{k}", p, k, c) for k, c in enumerate(pack_sentences(t, SMALL, SMALL_OVERLAP))], ["chunk_id", "text"], "chunk_id string, parent_id string, ord int, text string")


def sentence_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    return _each(docs, lambda i, t: [(i, k, c) for k, c in enumerate(pack_sentences(t or "", size, overlap))], ["doc_id", "text"], "doc_id long, ord int, text string")


def semantic_chunks(docs: DataFrame) -> DataFrame:
    return _each(docs, lambda i, t: [(i, k, c) for k, c in enumerate(split_semantic(t or ""))], ["doc_id", "text"], "doc_id long, ord int, text string")


def split_place(text: Column, target: int, reach: int = 200) -> Column:
    """First line end within `reach` of the target, else the target; the end for a text no longer than it."""
    near = F.instr(F.substring(text, target - reach + 1, 2 * reach), "\n")
    return F.when(F.length(text) <= target, F.length(text)).when(near > 0, near + F.lit(target - reach - 1)).otherwise(F.lit(target)).cast("int")


def with_title(text: Column, title: Column) -> Column:
    return F.concat(F.lit("Document Title: "), title, F.lit("\n\n"), text)


def with_summary(text: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("[Document Summary: "), summary, F.lit("]\n\n")), F.lit("")), text)


# Pronouns and the kinds of names they stand for, in the order in which these are looked for.
_PERSONAL = ("he", "him", "his", "himself", "she", "her", "hers", "herself")
_THINGS = ("it", "its", "itself")
_PLURAL = ("they", "them", "their", "theirs", "themselves")
_PRONOUNS = {**dict.fromkeys(_PERSONAL, ("PERSON",)), **dict.fromkeys(_THINGS, ("ORG", "GPE")), **dict.fromkeys(_PLURAL, ("ORG", "NORP", "PERSON"))}
#: Default recogniser's word lists: endings and beginnings that tell kinds of names.
_ORG = {"inc", "ltd", "corp", "company", "university", "institute", "bank", "group", "agency", "committee"}
_PERSON = {"mr", "mrs", "ms", "dr", "prof", "sir"}


def find_entities(tokens: list[str]) -> dict[int, tuple[int, str]]:
    """Runs of capitalised words inside sentences: start -> (end, kind)."""
    out, i = {}, 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and tokens[j][:1].isupper() and tokens[j].lower().strip(".") not in _PRONOUNS:
            j += 1
        if j > i and (i and not tokens[i - 1].strip()[-1:] in ".!?" or j - i > 1):
            words = {t.lower().strip(".,") for t in tokens[i:j]}
            out[i] = (j, "ORG" if words & _ORG else "PERSON" if words & _PERSON or j - i == 2 else "GPE")
        i = max(j, i + 1)
    return out


def replace_pronouns(text: str) -> str:
    """Pronouns become the last name of a fitting kind before them."""
    parts = re.split(r"(\w+(?:\.(?=\s*[A-Z]))?)", text)
    tokens = parts[1::2]
    found, last = find_entities(tokens), {}
    for i, t in enumerate(tokens):
        if i in found:
            end, kind = found[i]
            last[kind] = " ".join(tokens[i:end])
        elif (kinds := _PRONOUNS.get(t.lower())) and (name := next((last[k] for k in kinds if k in last), None)):
            parts[2 * i + 1] = name
    return "".join(parts)


def resolve_pronouns(docs: DataFrame) -> DataFrame:
    return _each(docs, lambda i, t: [(i, replace_pronouns(t or ""))], ["doc_id", "text"], "doc_id long, text string")


def backfilled(nodes: DataFrame) -> DataFrame:
    """nodes(text, embedding, ...) where a null embedding becomes that of the text, zeros for no text; others pass unchanged."""
    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else embed(x).astype("float32").tolist() for x in texts])

    wanted = F.when(F.col("embedding").isNull(), F.coalesce("text", F.lit("")))
    return nodes.withColumn("embedding", F.coalesce("embedding", of(wanted)))
