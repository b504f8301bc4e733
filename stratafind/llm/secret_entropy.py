"""Secret scan: key patterns and sliding-window entropy (operator 2), native.

Base spans come from three patterns. The method adds spans: what the base spans leave of the text is searched for runs of
WINDOW or more token characters. A window of that length slides over a run; the counts of its characters and of its character
classes follow from one leaving and one entering character per step, and so does its Shannon entropy. A window is hot at or
over the threshold of its class: hexadecimal digits of one letter case; lower case, upper case and digits together; or digits
and letters of one case without any other character (base 32 and 36). A run with hot windows yields the span from the first
one's start to the last one's end, unless it is on the allow list.

A text costs time in proportion to its length and spans: matches are listed once for each pattern and numbered by a fold in
blocks, counts are kept five bits each in a few long numbers, and whatever an inner function uses again is bound to a variable
of its own (`_let`), so that nothing is evaluated anew at each step.

Defined results: null text is empty (no spans, checksum of the empty string); texts are scanned whole; ties of spans at one
start go in the order assign, access, hex, entropy_hex, entropy_token; repeated rows give repeated results; an empty table
gives no rows; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import require

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
#: A run of these is maximal wherever it is found, so that the lengths asked for can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character at which a window of WINDOW characters counts as random, by class.
HEX_BITS, TOKEN_BITS, SINGLE_BITS = 3.0, 3.6, 3.6
#: A window of digits and letters of one case has this many of each at least.
SINGLE_LEAST = 2
#: Candidates that look random but are no secrets: plain numbers, UUIDs, digests named as such.
ALLOW = (
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?i:md5|sha1|sha256|sha384|sha512)[-_=]",
)
#: And those that consist of these alone: place holders, runs of the alphabet. No item begins another, so that each is found by
#: going on from the last one; a repeated alternation would be matched by recursion, as deep as the text is long.
ALLOW_MADE_OF = (
    r"\G(?i:example|placeholder|changeme|dummy|sample|your|my|insert|here|key|token|secret|api|test|x{4,}|[0-9_+/=-])",
    r"\G(?i:0?123456789|abcdefghij(?:klmnopqrstuvwxyz)?|[_+/=-])",
)
#: A path has two folders or more, and then a name.
FOLDER, FOLDERS, NAME = r"\G[A-Za-z]+[0-9]{0,2}/", r"^/?[^/]+/[^/]+/", r"^[A-Za-z0-9_-]*$"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_token")

SPAN = "struct<start:int,ord:int,kind:string,end:int,text:string>"
REGION = "struct<start:int,end:int>"
#: Items of a fold's block, and code points of a text's: bound what a step copies.
FOLD, CHUNK = 256, 1024
#: Counts of five bits to a long number.
PACKED = 12
_ONE_CASE = r"^(?:[0-9a-f]+|[0-9A-F]+)$"


def _let(value: Column, body) -> Column:
    """body(v) with v bound to the value, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _fold(items: Column, zero: Column, step, kind: str) -> Column:
    """What step(state, item) -> (state, array to add) adds along the items, in order; in blocks, so that no step copies it all."""

    def inner(acc: Column, x: Column) -> Column:
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["s"].alias("s"), _none(kind).alias("out")), inner)
        return _let(done, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        last = F.floor((F.size(xs) - F.lit(1)) / F.lit(FOLD)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * F.lit(FOLD) + F.lit(1), F.lit(FOLD)))
        start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(xs) == 0, _none(kind)).otherwise(F.flatten(F.aggregate(blocks, start, outer)["out"]))

    return _let(items, whole)


def _located(text: Column, pattern: str, order: int, value: int = 0, least: int = 0) -> Column:
    """array<SPAN> of a pattern's matches whose group `value` has `least` characters or more."""

    def walk(between: Column, found: Column, values: Column) -> Column:
        items = F.transform(found, lambda m, i: F.struct(F.length(F.element_at(between, i + F.lit(1))).alias("skip"), m.alias("m"), (F.length(F.element_at(values, i + F.lit(1))) >= F.lit(least)).alias("kept")))

        def add(at: Column, x: Column):
            start = at + x["skip"]
            end = start + F.length(x["m"])
            span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(KINDS[order]).alias("kind"), end.alias("end"), x["m"].alias("text"))
            return end, F.when(x["kept"], F.array(span)).otherwise(_none(SPAN))

        return _fold(items, F.lit(0), add, SPAN)

    matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    listed = _let(F.split(text, pattern, -1), lambda b: _let(matches(0), lambda m: walk(b, m, m) if not value else _let(matches(value), lambda v: walk(b, m, v))))
    return F.when(text.rlike(pattern), listed).otherwise(_none(SPAN))


def _regions(spans: Column) -> Column:
    """array<REGION>: spans, sorted by start, with overlapping ones put together."""
    closing = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(0).alias("ord"), F.lit("").alias("kind"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("text"))
    region = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def add(s: Column, x: Column):
        apart = x["start"] >= s["end"]
        now = F.when(apart, region(x["start"], x["end"])).otherwise(region(s["start"], F.greatest(s["end"], x["end"])))
        return now, F.when(apart & (s["end"] >= 0), F.array(region(s["start"], s["end"]))).otherwise(_none(REGION))

    return _fold(F.concat(spans, F.array(closing)), region(F.lit(-1), F.lit(-1)), add, REGION)


def _replaced(text: Column, regions: Column, mark) -> Column:
    """The text with each region replaced by mark(region)."""

    def pieces(chunks: Column, regions: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            i, j = F.floor(a / F.lit(CHUNK)).cast("int"), F.floor((b - F.lit(1)) / F.lit(CHUNK)).cast("int")
            at = lambda k: F.element_at(chunks, k + F.lit(1))
            inside = F.substr(at(i), a - i * F.lit(CHUNK) + F.lit(1), b - a)
            over = F.concat(F.substr(at(i), a - i * F.lit(CHUNK) + F.lit(1), F.lit(CHUNK)), F.array_join(F.slice(chunks, i + F.lit(2), j - i - F.lit(1)), ""), F.substr(at(j), F.lit(1), b - j * F.lit(CHUNK)))
            return F.when(a >= b, F.lit("")).when(i == j, inside).otherwise(over)

        ended = lambda i: F.when(i > 0, F.element_at(regions, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
        cut = F.transform(regions, lambda r, i: _let(ended(i), lambda before: F.concat(part(before, r["start"]), mark(r))))
        rest = _let(F.element_at(regions, -1)["end"], lambda a: _let(F.length(text), lambda n: part(a, n)))
        return F.array_join(F.concat(cut, F.array(rest)), "")

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(regions) == 0, text).otherwise(_let(chunks, lambda c: pieces(c, regions)))


def _coded(s: Column) -> Column:
    """For each character: word and shift of its count among the packed ones, and what it adds to the class counts.

    Class counts, five bits each from the lowest: digits, lower case, upper case, others, lower case after f, upper case after F.
    """

    def one(c: Column) -> Column:
        return _let(F.ascii(c), lambda a: _let(a - F.lit(43), lambda at: F.struct(
            F.floor(at / F.lit(PACKED)).cast("int").alias("w"), (F.lit(5) * F.pmod(at, F.lit(PACKED))).alias("sh"),
            F.when((a >= 48) & (a <= 57), F.lit(1)).when((a >= 97) & (a <= 102), F.lit(1 << 5)).when((a >= 103) & (a <= 122), F.lit((1 << 5) + (1 << 20)))
            .when((a >= 65) & (a <= 70), F.lit(1 << 10)).when((a >= 71) & (a <= 90), F.lit((1 << 10) + (1 << 25))).otherwise(F.lit(1 << 15)).cast("long").alias("adds"),
        )))

    return F.transform(F.split(s, ""), one)


def _hot_windows(s: Column) -> Column:
    """struct(first, last): starts (from 0) of the first and last hot window of a run; first is -1 if there is none.

    State: packed counts of the window's characters, sum of c*log2(c) in whole parts of 2**-32, class counts. Entropy is
    log2(W) - sum/W, so that a window is hot where the sum is small. A step touches the counts of two characters.
    """
    unit = 1 << 32
    clog = F.array(*[F.lit(0 if c < 2 else round(c * math.log2(c) * unit)).cast("long") for c in range(WINDOW + 2)])
    most = lambda bits: F.lit(int((math.log2(WINDOW) - bits) * WINDOW * unit) + 64).cast("long")
    words = (122 - 43) // PACKED + 1
    shifted = lambda x, by: F.call_function("shiftright", x, by).bitwiseAND(F.lit(31))
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)

    def hot(total: Column, classes: Column) -> Column:
        digits, lower, upper, others, past_f, past_F = (shifted(classes, F.lit(5 * k)) for k in range(6))
        one_case = (others == 0) & (digits > 0) & (((upper == 0) & (past_f == 0) & (lower > 0)) | ((lower == 0) & (past_F == 0) & (upper > 0)))
        mixed = (digits > 0) & (lower > 0) & (upper > 0)
        single = (others == 0) & (digits >= SINGLE_LEAST) & (((upper == 0) & (lower >= SINGLE_LEAST)) | ((lower == 0) & (upper >= SINGLE_LEAST)))
        return (one_case & (total <= most(HEX_BITS))) | (mixed & (total <= most(TOKEN_BITS))) | (single & (total <= most(SINGLE_BITS)))

    def step(clog: Column, codes: Column, st: Column, i: Column) -> Column:
        full = i > F.lit(WINDOW)

        def moved(enters: Column, leaves: Column) -> Column:
            held = lambda c: shifted(F.element_at(st["counts"], c["w"] + F.lit(1)), c["sh"]).cast("int")
            same = full & (enters["w"] == leaves["w"]) & (enters["sh"] == leaves["sh"])
            old = F.when(full, held(leaves)).otherwise(F.lit(1))  # a count of one weighs nothing
            new = held(enters) - F.when(same, F.lit(1)).otherwise(F.lit(0))
            at = lambda c: F.element_at(clog, c + F.lit(1))
            total = _let(old, lambda o: _let(new, lambda n: st["total"] + at(o - F.lit(1)) - at(o) + at(n + F.lit(1)) - at(n)))
            counts = F.transform(
                st["counts"],
                lambda c, j: c + F.when(j == enters["w"], one(enters["sh"])).otherwise(F.lit(0).cast("long")) - F.when(full & (j == leaves["w"]), one(leaves["sh"])).otherwise(F.lit(0).cast("long")),
            )
            classes = st["classes"] + enters["adds"] - F.when(full, leaves["adds"]).otherwise(F.lit(0).cast("long"))
            at_start = i - F.lit(WINDOW)
            return _let(F.struct(counts.alias("counts"), total.alias("total"), classes.alias("classes")), lambda x: _let((i >= F.lit(WINDOW)) & hot(x["total"], x["classes"]), lambda h: F.struct(
                x["counts"].alias("counts"), x["total"].alias("total"), x["classes"].alias("classes"),
                F.when(h & (st["first"] < F.lit(0)), at_start).otherwise(st["first"]).alias("first"),
                F.when(h, at_start).otherwise(st["last"]).alias("last"),
            )))

        return _let(F.element_at(codes, i), lambda e: _let(F.element_at(codes, F.greatest(i - F.lit(WINDOW), F.lit(1))), lambda o: moved(e, o)))

    start = F.struct(
        F.array(*[F.lit(0).cast("long")] * words).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("classes"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )
    slid = _let(clog, lambda g: _let(_coded(s), lambda codes: F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, lambda st, i: step(g, codes, st, i))))
    return _let(slid, lambda end: F.struct(end["first"].alias("first"), end["last"].alias("last")))


def allowed(s: Column) -> Column:
    """Whether a candidate is on the allow list."""
    found = s.rlike(FOLDERS) & F.regexp_replace(F.regexp_replace(s, "^/", ""), FOLDER, "").rlike(NAME)
    for p in ALLOW:
        found = found | s.rlike(p)
    for p in ALLOW_MADE_OF:
        found = found | (F.regexp_replace(s, p, "") == "")
    return found


def _entropy(text: Column) -> Column:
    """Added spans of a text from which the base spans are blanked out."""

    def random(r: Column) -> Column:
        s = r["text"]
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & ~allowed(s)

    def span(r: Column) -> Column:
        def named(w: Column) -> Column:
            order = F.when(r["text"].rlike(_ONE_CASE), F.lit(3)).otherwise(F.lit(4))
            kind = F.when(r["text"].rlike(_ONE_CASE), F.lit(KINDS[3])).otherwise(F.lit(KINDS[4]))
            start, end = r["start"] + w["first"], r["start"] + w["last"] + F.lit(WINDOW)
            inside = F.substr(r["text"], w["first"] + F.lit(1), w["last"] + F.lit(WINDOW) - w["first"])
            return F.when(w["first"] < 0, _none(SPAN)).otherwise(F.array(F.struct(start.alias("start"), order.alias("ord"), kind.alias("kind"), end.alias("end"), inside.alias("text"))))

        return _let(_hot_windows(r["text"]), named)

    return F.flatten(F.transform(F.filter(_located(text, CANDIDATE, 4), random), span))


def spans_of(text: Column) -> Column:
    """array<SPAN> of a text, by start and kind."""

    def added(t: Column, base: Column) -> Column:
        blank = lambda r: F.repeat(F.lit(" "), r["end"] - r["start"])
        rest = F.when(F.size(base) == 0, t).otherwise(_let(_regions(base), lambda g: _replaced(t, g, blank)))
        return _let(rest, lambda m: F.when(m.rlike(CANDIDATE), F.array_sort(F.concat(base, _entropy(m)))).otherwise(base))

    base = lambda t: F.array_sort(F.concat(_located(t, ASSIGN, 0, 2, ASSIGN_VALUE), _located(t, ACCESS, 1), _located(t, HEX, 2)))
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(base(t), lambda b: added(t, b)))


def scan(docs: DataFrame) -> DataFrame:
    """All columns of documents, and found: array<SPAN>, by start and kind. A column of the name `found` gives way."""
    return docs.withColumn("found", spans_of(docs["text"]))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s."""
    base = F.filter("found", lambda r: r["ord"] < 3)
    n = lambda k: F.size(F.filter("found", lambda r: r["ord"] == k)).cast("long")
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans are replaced as one. Null text stays null."""
    return _let(text, lambda t: _let(spans, lambda s: F.when(F.size(s) == 0, t).otherwise(_let(_regions(s), lambda g: _replaced(t, g, lambda r: F.lit(mark))))))


def scan_documents(docs: DataFrame) -> DataFrame:
    return digest(scan(require(docs, "doc_id", "text")))
