"""Cleaning, naming and token expressions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns that decide what is removed. Blanks are taken possessively and a line that follows blank ones is not
# tried again, so that long runs of blanks, numbers or letters cost time in proportion; no group is repeated by recursion.
_START = r"(?md)^(?:\G|(?<!\n[\-\s]{0,8}\n))"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE_NUMBERS = (_START + r"[\-\s]*+[Pp]age\s++\d+\s*(of\s++\d+)?[\-\s]*$", _START + r"\s*+\d+\s*+\|\s*+[Pp]\s*+a\s*+g\s*+e\s*$", _START + r"\s*+-\s*+\d+\s*+-\s*$")
LEGAL = r"(?i)(confidential|proprietary|all rights reserved|copyright\s++©?\s*+\d{4})[^\n]*"
DRAFT = r"(?i)\b(draft|do not distribute|internal use only)\b[^\n]*"
EMPTY_NUMBERS = _START + r"\s*+(?:\d++\.)++\s*$"
REPEATED_LINES, REPEATED_LENGTH = 4, 5
MARKS = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("…", "..."), ("–", "-"), ("—", "--"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")


def no_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def dehyphenated(c: Column) -> Column:
    """A word that a hyphen parts at a line's end is put together; the second half belongs to no further such word."""
    return F.regexp_replace(c, r"(?U)(?!\G)(?<=\w)-[\s&&[^\n]]*+\n\s*+(\w+)", "$1")


def unspaced(c: Column) -> Column:
    """Three or more single letters with single spaces between are one word.

    A space goes if it stands between two single letters of such a run: seen from the space, the run has a third letter on
    one side or the other.
    """
    ahead = r"(?<=\b[A-Za-z]) (?=[A-Za-z] [A-Za-z]\b)"
    behind = r"(?<=\b[A-Za-z] [A-Za-z]) (?=[A-Za-z]\b)"
    return F.regexp_replace(c, f"{ahead}|{behind}", "")


def plain_marks(c: Column) -> Column:
    for old, new in MARKS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def no_page_numbers(c: Column) -> Column:
    for p in PAGE_NUMBERS:
        c = F.regexp_replace(c, p, "")
    return c


def no_legal(c: Column) -> Column:
    return F.regexp_replace(c, LEGAL, "")


def no_draft(c: Column) -> Column:
    return F.regexp_replace(c, DRAFT, "")


def no_empty_numbers(c: Column) -> Column:
    return F.regexp_replace(c, EMPTY_NUMBERS, "")


def tidy_space(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


#: UTF-8 of the upper half of Latin-1 that was read as Latin-1: lead characters and, for each, what was there and what was meant.
TWICE = tuple((lead, tuple((lead + chr(b), chr(b + more)) for b in range(first, 0xC0))) for lead, first, more in (("\u00c2", 0xA1, 0), ("\u00c3", 0x80, 0x40)))


def unmangled(c: Column) -> Column:
    """Letters that were encoded twice are put right; texts without the lead characters are not touched."""
    fixed = c
    for _, chars in TWICE:
        for broken, meant in chars:
            fixed = F.replace(fixed, F.lit(broken), F.lit(meant))
    return F.when(c.rlike("[\u00c2\u00c3][\u0080-\u00bf]"), fixed).otherwise(c)


def category(path: Column, root: str = "./data") -> Column:
    """First folder under root, lower case, spaces as underscores; general for files right under it."""
    parts = F.split(F.regexp_replace(path, f"^{root.replace('.', '[.]')}/?", ""), "/")
    return F.when(F.size(parts) <= 1, F.lit("general")).otherwise(F.replace(F.lower(F.get(parts, 0)), F.lit(" "), F.lit("_")))


def titled(c: Column) -> Column:
    """Every letter after a non-letter in upper case, all others in lower case."""
    chars = F.split(c, "")
    return F.array_join(F.transform(chars, lambda x, i: F.when((i > 0) & F.coalesce(F.get(chars, i - F.lit(1)).rlike(r"\p{L}"), F.lit(False)), F.lower(x)).otherwise(F.upper(x))), "")


def title(path: Column) -> Column:
    """The file's stem, underscores and hyphens as spaces, titled."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return titled(F.translate(stem, "_-", "  "))


def entity_id(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def exact_key(name: Column) -> Column:
    return F.replace(F.lower(strip(name)), F.lit(" "), F.lit("_"))


def safe_topic(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def safe_file_name(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[^\w\s\.-]", "_"))


def tokens(c: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores; the class tries the plain ones first."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_\p{L}\p{N}]{2,}+"), F.lit(0))


def token_count(c: Column) -> Column:
    """Words between white space; the empty text has none."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def headings(c: Column) -> Column:
    """Ordered distinct headings: one to three # and a title, or capitals of 5 to 61 characters."""
    found = F.regexp_extract_all(c, F.lit(r"(?md)^(?:#{1,3}\s+.+|[A-Z][A-Z\s]{3,59}[A-Z])$"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda h: strip(F.regexp_replace(h, r"^[#\s]+", ""))))


def contains_any(c: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
