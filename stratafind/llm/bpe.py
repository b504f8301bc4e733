"""Word-memo encoder over a public tokenizer file.

For a tokenizer whose pre-tokenizer drops white space and whose normalizer composes nothing across ASCII white space (ASSUMED;
the file is looked at), a text's ids are the ids of its white-space separated words, one after another. A bounded memo of
word -> ids (as little-endian unsigned 32-bit integers) thus gives exactly the library's ids. A word of Latin letters,
perhaps with ASCII marks behind it, is two pre-tokens; its letters go straight to the library's merges, everything else to
the whole tokenizer. Texts of any other tokenizer file go to the library as they are.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Words, and letter pre-tokens, kept by a worker; each starts anew when full. Bounds a worker's memory, not the result.
MEMO_WORDS = 450_000
#: Longer words are not kept.
MEMO_BYTES = 128

#: The parts of a tokenizer file on which the shortcuts rest.
ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Latin capital letter I with dot above: in small letters it is two characters, of which the second is no letter.
_DOTTED = "İ"


def _letters(word: bytes) -> str | None:
    """The word in small letters, if it is letters of the Latin blocks alone, on which all Unicode versions agree."""
    if word.isascii():
        return word.lower().decode() if word.isalpha() else None
    s = word.decode()
    return s.lower() if s.isalpha() and max(s) < "ɐ" and _DOTTED not in s else None


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """ids by word; unknown words are learned where they are looked up."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self.learn(word)
        if len(word) <= MEMO_BYTES:
            self[word] = ids
        return ids


_encoders: dict[str, "MemoEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class MemoEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        #: Whether the file has the parts that the memo rests on.
        self.by_words = all(held.get(k) == v for k, v in ASSUMED.items()) and held["model"].get("end_of_word_suffix") == "</w>" and not any(set(t["content"]) & set(" \t\n\x0b\x0c\r") or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"])
        self.special = [t["content"].encode() for t in held["added_tokens"]]
        self.joined = held.get("decoder") is None
        self.model = self.tokenizer.model
        self.table = dict(enumerate(byte_alphabet()))
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.letters: dict[bytes, bytes] = {}
        self.memo = _Memo(self._learn)
        self.names: list[bytes] | None = None

    def clear(self) -> None:
        """Forget all words."""
        self.memo.clear()
        self.letters.clear()

    def library(self, data: bytes) -> bytes:
        """The library's ids of a whole text."""
        return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, data: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return self.library(data)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, data.split()))

    def _learn(self, word: bytes) -> bytes:
        base = word.rstrip(_MARKS)
        ids = self.letters.get(base)
        if ids is None:
            small = _letters(base)
            if small is None or any(s in word for s in self.special):
                return self.library(word)
            ids = b"".join([self.as_bytes[t.id] for t in self.model.tokenize(small.encode().decode("latin-1").translate(self.table))])
            if len(base) <= MEMO_BYTES:
                if len(self.letters) > MEMO_WORDS:
                    self.letters.clear()
                self.letters[base] = ids
        # marks behind letters are a pre-token of their own
        return ids if len(base) == len(word) else ids + self.memo[word[len(base) :]]

    def decode(self, ids: bytes) -> bytes:
        """The library's decode, special tokens kept; for a file without a decoder, token strings joined by single spaces."""
        if not self.joined:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()
        if self.names is None:
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.names = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        return b" ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encoder(path: str) -> MemoEncoder:
    """This worker's encoder; operators clear it after each task, as workers live on."""
    if path not in _encoders:
        _encoders[path] = MemoEncoder(path)
    return _encoders[path]
