"""Pseudonyms held to validators and finders of their own: nothing valid is left, values stay linked, the rest is untouched."""

import datetime
import ipaddress
import re

from stratafind.llm import feistel_pseudonyms as P
from stratafind.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0 and len(set(digits)) > 1


def iban(s):
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn(s):
    return re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", s) is not None


def ip(s):
    try:
        return str(ipaddress.IPv4Address(s)) == s
    except ValueError:
        return False


def day(s):
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y"):
        try:
            d = datetime.datetime.strptime(s, form).date()
        except ValueError:
            continue
        return d if 1900 <= d.year <= 2099 else None
    return None


VALID = {"card": luhn, "iban": iban, "ssn": ssn, "ip": ip, "date": lambda s: day(s) is not None, "email": lambda s: s.count("@") == 1, "phone": lambda s: 8 <= sum(c.isdigit() for c in s) <= 15}
SHAPE = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0" * 10 + "a" * 26 + "A" * 26)


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    new_of, total = {}, 0
    for r in QUERIES["op3_feistel_pseudonyms"](spark, SF).collect():
        old, new, at, to = docs[r["doc_id"]], r["text"], 0, 0
        for kind, a, b in (x.rsplit(":", 2) for x in r["spans"].split(",") if x):
            a, b = int(a), int(b)
            assert new[to : to + a - at] == old[at:a]  # untouched between values
            to, at = to + a - at, b
            # an address may change its length, all other kinds keep theirs
            value, made = old[a:b], re.compile(r"\d+(\.\d+){3}").match(new, to)[0] if kind == "ip" else new[to : to + b - a]
            to, total = to + len(made), total + 1
            assert VALID[kind](value) and VALID[kind](made) and value != made
            assert kind in ("iban", "email", "ip") or made.translate(SHAPE) == value.translate(SHAPE)
            assert new_of.setdefault((kind, value), made) == made  # equal values stay equal
        assert new[to:] == old[at:]
        # finders of their own: whatever is valid lies inside a span
        spans = [(int(a), int(b)) for _, a, b in (x.rsplit(":", 2) for x in r["spans"].split(",") if x)]
        for kind, shape in (("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), ("card", r"(?<![\w -])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w -])"), ("email", r"(?<!\S)[a-z]+\.[a-z]+\d*@[a-z]+\.(?:com|org|net)\b"), ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")):
            for m in re.finditer(shape, old):
                assert not VALID[kind](m[0]) or any(a <= m.start() and m.end() <= b for a, b in spans), (kind, m[0])
    by_kind = {}
    for (kind, value), made in new_of.items():
        by_kind.setdefault(kind, []).append((re.sub(r"[ -]", "", value) if kind in ("card", "iban") else value, re.sub(r"[ -]", "", made) if kind in ("card", "iban") else made))
    assert total > 50 and all(len({m for _, m in set(v)}) == len(set(v)) for v in by_kind.values())  # different values stay different


def test_one_day_in_all_orders():
    made = {}
    for n in range(0, 73_000, 37):
        d = datetime.date.fromordinal(datetime.date(1900, 1, 1).toordinal() + n)
        forms = [f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}", f"{d:%d.%m.%Y}"] + ([f"{d:%m/%d/%Y}"] if d.day > 12 else [])
        new = {day(P.pseudonymise(f)[0]) for f in forms}
        assert len(new) == 1
        made[d] = new.pop()
    assert len(set(made.values())) == len(made)


def test_permutation_is_one():
    for size in (2, 3, 10, 97, 1000):
        for kind in ("a", "b"):
            assert sorted(P.permute(i, size, kind) for i in range(size)) == list(range(size))
    assert [P.permute(i, 1000, "a") for i in range(9)] != [P.permute(i, 1000, "a", b"other") for i in range(9)]
