"""Encoding with the tokenizers library, word by word, with a bounded memo of the words met before.

A text is cut only where no token can stand across the cut, so the joined ids are those of the whole text. The ids are
packed as little-endian unsigned integers of 16 bits (32 for vocabularies that need it), ready to be joined, stored or sliced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from tokenizers import Tokenizer

MEMO = 1_000_000  # words, some 250 MB; the memo starts anew beyond, so a worker's memory is bounded
FEW = 200_000  # the same where a worker lives on beside other stages
MEMO_WORD = 48  # characters; longer words are encoded each time

#: White space by Unicode, beside blank and line end.
_OTHER_SPACE = "".join(map(chr, (0x09, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACE = f" \n{_OTHER_SPACE}"
#: A text with none of these has only single blanks and line ends as white space, and no mark of a literal piece.
_RARE = ("\x00", *_OTHER_SPACE, "  ", "\n\n", " \n", "\n ")
_RUNS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for Python alone
_WORDS = re.compile(f"[^{_SPACE}]+")


def byte_level_pieces(text: str) -> list[str]:
    """Keys of a byte-level tokenizer's pieces: "word" stands for " word", "\\nword" and "\\0word" for themselves without the mark."""
    if any(x in text for x in _RARE):
        return ["\x00" + run for run in _RUNS.findall(text)]
    pieces = text.replace("\n", " \n").split(" ")
    pieces[0] = "\x00" + pieces[0]
    return pieces


def byte_level_text(key: str) -> str:
    return key[1:] if key[:1] == "\x00" else key if key[:1] == "\n" else " " + key


def word_pieces(text: str) -> list[str]:
    """Pieces of a tokenizer that drops white space."""
    return _WORDS.findall(text) if any(x in text for x in _SEPARATORS) else text.split()


def _byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


_LETTERS = _byte_letters()
#: Keys whose pre-tokens are known, a line end, letters and marks, and that no tokenizer changes but for lower case; the model can have them directly.
_PLAIN = re.compile("(\n?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@[-`{-~]*)")


def _written(word: str) -> str:
    """A word of those letters as byte-level vocabularies write it."""
    return word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()])


class Memo(dict):
    """Keys to packed ids. A word in capitals or with marks after it is put together from what is known of the word itself."""

    def __init__(self, tokenizer: Tokenizer, kind: str | None, width: int, limit: int = MEMO) -> None:
        self.tokenizer, self.kind, self.limit = tokenizer, kind, limit
        self.tokenize = tokenizer.model.tokenize
        self.packed = [i.to_bytes(width, "little") for i in range(1 + max(tokenizer.get_vocab().values(), default=-1))]
        self.blank, self.unmarked = ("", "") if kind == "word" else (_LETTERS[32], "\x00")

    def _piece(self, written: str) -> bytes:
        """The ids of one pre-token, written as in the vocabulary."""
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(written)])

    def _ids(self, key: str) -> bytes:
        if m := _PLAIN.fullmatch(key):
            line, word, marks = m.groups()
            if self.kind == "word":
                word = word.lower()
            if line:
                known = self._piece(_LETTERS[10]) + self._piece(_written(word))
            else:
                known = self[word] if word != key else self._piece(self.blank + _written(word))
            return known + self[self.unmarked + marks] if marks else known
        packed = self.packed
        return b"".join([packed[i] for i in self.tokenizer.encode(key if self.kind == "word" else byte_level_text(key), add_special_tokens=False).ids])

    def __missing__(self, key: str) -> bytes:
        if key.islower() and key.isascii() and key.isalpha():  # most of them
            packed = self._piece(self.blank + key)
        else:
            packed = self._ids(key)
        if len(key) <= MEMO_WORD:
            if len(self) >= self.limit:
                self.clear()
            self[key] = packed
        return packed


#: The normaliser and pre-tokenizer of the two kinds of tokenizer whose words stand alone.
_LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
KINDS = {
    "byte_level": (None, _BYTES | {"use_regex": True}),
    "word": (_LOWER, {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]}),
}


class PackedEncoder:
    """The ids that the tokenizer of the file gives for whole texts. A text that holds one of its added tokens is encoded as a whole
    by the library, and so is every text where the file's normaliser and pre-tokenizer are not those of one of ``KINDS``."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        plain = not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        self.kind = next((k for k, v in KINDS.items() if plain and v == (spec.get("normalizer"), spec.get("pre_tokenizer"))), None)
        self.literals = [t["content"] for t in added]
        self.tokenizer = tokenizer
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.vocabulary = tokenizer.get_vocab_size()
        self.pieces = {"byte_level": byte_level_pieces, "word": word_pieces, None: None}[self.kind]
        self.memo = Memo(tokenizer, self.kind, self.width, memo)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind is None or any(x in text for x in self.literals):
            return b"".join([i.to_bytes(self.width, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))


@lru_cache(maxsize=2)
def packed_encoder(path: str, memo: int = MEMO) -> PackedEncoder:
    """One encoder and memo for all tasks of a Python worker."""
    return PackedEncoder(path, memo)
