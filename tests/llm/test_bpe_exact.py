"""The word memo against the library: letters, marks, joins, other tokenizer files."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stratafind.llm import bpe, chunk_bpe


def ids(t, text):
    return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_all_letters_and_marks_at_joins():
    t, e = Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.default_path())
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    for c in letters:
        for text in (f"{c}.", f"a{c}, b", f"{c}{c}?!", f"X{c}y'{c}", f"({c})"):
            assert e.encode(text.encode()) == ids(t, text), text
    for m in map(chr, range(33, 127)):
        for text in (f"word{m}", f"{m}Word", f"a{m}{m}b", f"İ{m}", f"don't{m}", f"it's{m}S"):
            assert e.encode(text.encode()) == ids(t, text), text
    for text in ("SANAYİ.", "bir SANAYİ, iki", "<|endoftext|>.", "a<|startoftext|>b!", "x" * 100_000, "ß.ﬁ,ŉ;"):
        assert e.encode(text.encode()) == ids(t, text)


def test_random_texts():
    t, e, c, r = Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.default_path()), chunk_bpe.chunk_encoder(bpe.default_path()), random.Random(1)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()] + list("abcdeABCDE") * 20 + ["İ"] * 40
    marks = list("""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~""") * 2 + ["’", "“", "̇", "́", " ", "…", "1", "٣", "漢", "Σ", "ς", " ", "\u0085", " ", " ", " ", "\n", "<|endoftext|>", "'s", "'S", "'LL"]
    for _ in range(1500):
        text = "".join(r.choice(letters if r.random() < 0.7 else marks) for _ in range(r.randrange(1, 400)))
        assert e.encode(text.encode()) == ids(t, text) and c.encode(text.encode()) == ids(t, text)


def test_full_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    t, e, r = Tokenizer.from_file(bpe.default_path()), bpe.MemoEncoder(bpe.default_path()), random.Random(2)
    for _ in range(200):
        text = " ".join(f"{r.choice('abc')}{r.choice('xyz') * r.randrange(9)}{r.choice(['', '.', ',;'])}" for _ in range(40))
        assert e.encode(text.encode()) == ids(t, text)


def test_other_tokenizer_files():
    """A file without the assumed parts goes to the library, there and back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e, c = Tokenizer.from_file(path), bpe.encoder(path), chunk_bpe.chunk_encoder(path)
    assert not e.by_words and bpe.encoder(bpe.default_path()).by_words
    for text in ("", "Two  spaces, and\nlines é 漢 ", "a " * 3000):
        for x in (e, c):
            assert x.encode(text.encode()) == ids(t, text)
            assert x.decode(ids(t, text)) == t.decode(t.encode(text, add_special_tokens=False).ids, skip_special_tokens=False).encode()
