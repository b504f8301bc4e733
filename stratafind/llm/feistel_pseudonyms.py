"""Format-preserving pseudonyms by a keyed Feistel permutation (operator 3).

Values of fixed formats are found, validated (check digits, calendar, ranges) and replaced by another valid value of the
same format: the digits that carry information are read as a number below the format's size, permuted by a keyed Feistel
network on that range (walking the cycle until the result is in range), and written back with separators, prefix and check
digits renewed. The permutation depends on the key and the kind alone, so equal values stay equal in every document, and
different ones stay different; a day gets the same new day in whatever order it is written. Of an email address the local part
is replaced, its domain stays.

The key comes from the session's spark.stratafind.pseudonym.key or as a parameter; KEY stands in for it in tests and is known
to every reader of this file.

Defined results: null text stays null with no values; texts are read whole; overlapping candidates go to the earlier start,
then to the earlier kind in KINDS; text that fails validation is left alone; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re

from pyspark.sql import DataFrame

from .common import sliced, to_python

KEY = b"stratafind-pseudonyms"
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "date")
ROUNDS = 8

_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][ .-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})(?![0-9]|[./-][0-9])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{_PATTERNS[k]})" for k in KINDS))
#: A text without any of these holds no value; saves the search on most texts.
_HINT = re.compile(r"[0-9]|@")


def permute(value: int, size: int, kind: str, key: bytes = KEY) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            d = hashlib.blake2b(b"%d:%d:%d" % (r, size, right), key=key, person=kind.encode()[:16], digest_size=8 + half // 8).digest()
            left, right = right, left ^ int.from_bytes(d, "big") & mask
        value = left << half | right
        if value < size:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _refill(shape: str, chars: str) -> str:
    """Put chars in place of the letters and digits of shape."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _mixed(text: str, kind: str, key: bytes) -> str:
    """Permute letters and digits within their classes, as one mixed-radix number; other characters stay."""
    classes = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    places = [next(c for c in classes if x in c) for x in text if x.isascii() and x.isalnum()]
    value, size = 0, 1
    for c, x in zip(places, (x for x in text if x.isascii() and x.isalnum())):
        value, size = value * len(c) + c.index(x), size * len(c)
    value = permute(value, size, kind, key)
    out = []
    for c in reversed(places):
        value, i = divmod(value, len(c))
        out.append(c[i])
    return _refill(text, "".join(reversed(out)))


def _card(s: str, key: bytes) -> str | None:
    d = re.sub(r"[ -]", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[0] + f"{permute(int(d[1:-1]), 10 ** (len(d) - 2), f'card{len(d)}', key):0{len(d) - 2}d}"
    return _refill(s, body + luhn_digit(body))


def _iban(s: str, key: bytes) -> str | None:
    d = s.replace(" ", "")
    if not 15 <= len(d) <= 34 or _iban_check(d[:2], d[4:]) != d[2:4]:
        return None
    body = _mixed(d[4:], f"iban{d[:2]}", key)
    return _refill(s, d[:2] + _iban_check(d[:2], body) + body)


def _ssn(s: str, key: bytes) -> str | None:
    a, b, c = map(int, s.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    areas = 898  # 001 to 899 without 666
    v = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    v, c = divmod(permute(v, areas * 99 * 9999, "ssn", key), 9999)
    a, b = divmod(v, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


def _ip(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    v = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", key)
    return ".".join(map(str, v.to_bytes(4, "big")))


def _phone(s: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 8 <= len(d) <= 15:
        return None
    fixed = len(re.match(r"\+?([0-9]*)", s)[1]) if s.startswith("+") else 0
    rest = d[fixed:]
    lead = int(rest[0] != "0")  # a number that starts with 0 keeps that
    size = 9 * 10 ** (len(rest) - 1) if lead else 10 ** (len(rest) - 1)
    low = 10 ** (len(rest) - 1) if lead else 0
    return _refill(s, d[:fixed] + f"{permute(int(rest) - low, size, f'phone{d[:fixed]}/{len(rest)}', key) + low:0{len(rest)}d}")


def _date(s: str, key: bytes) -> str | None:
    """A day of the same century or so: days from 1900 to 2099 are permuted; the order of the parts is kept."""
    sep = s[4] if s[:4].isdigit() else s[2]
    parts = s.split(sep)
    if len(parts) != 3:
        return None
    if len(parts[0]) == 4:
        y, m, d = map(int, parts)
        order = "ymd"
    else:
        a, b, y = map(int, parts)
        (d, m, order) = (a, b, "dmy") if b <= 12 else (b, a, "mdy")
    if not 1900 <= y <= 2099 or not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(y, m)[1]:
        return None
    first, last = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
    # a date that reads both ways must stay so, and one that reads one way only, too; in all orders, so that a day stays linked
    same = lambda x: (x.day <= 12) == (d <= 12)
    v = datetime.date(y, m, d).toordinal() - first
    while True:
        v = permute(v, last - first + 1, "date", key)
        x = datetime.date.fromordinal(first + v)
        if same(x):
            break
    return sep.join({"y": f"{x.year:04d}", "m": f"{x.month:02d}", "d": f"{x.day:02d}"}[c] for c in order)


def _email(s: str, key: bytes) -> str | None:
    local, _, domain = s.rpartition("@")
    return _mixed(local, "email", key) + "@" + domain


_RULES = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "ip": _ip, "phone": _phone, "date": _date}


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The new text, and kind, start and end (code points of the old text) of what was replaced."""
    if not _HINT.search(text):
        return text, []
    out, spans, at, look = [], [], 0, 0
    while m := _FIND.search(text, look):
        # at one place several kinds may match; the first that validates counts
        for kind in KINDS:
            k = m if m.lastgroup == kind else re.compile(_PATTERNS[kind]).match(text, m.start())
            new = k and _RULES[kind](k[0], key)
            if new is not None and k:
                out += [text[at : k.start()], new]
                spans.append((kind, k.start(), k.end()))
                at = look = k.end()
                break
        else:
            look = m.start() + 1
    return ("".join([*out, text[at:]]) if spans else text), spans


def pseudonymise_documents(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, n_values, spans (kind:start:end of the old text, comma-joined), text (rewritten)."""
    named = docs.sparkSession.conf.get("spark.stratafind.pseudonym.key", None)
    key = key or (hashlib.blake2b(named.encode()).digest() if named else KEY)

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            rows = [pseudonymise(t, key) if t is not None else (None, []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array([len(s) for _, s in rows], pa.int64()),
                    pa.array([",".join(f"{k}:{i}:{j}" for k, i, j in s) for _, s in rows], pa.string()),
                    pa.array([t for t, _ in rows], pa.string()),
                ],
                names=["doc_id", "n_values", "spans", "text"],
            )

    return to_python(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_values long, spans string, text string")
