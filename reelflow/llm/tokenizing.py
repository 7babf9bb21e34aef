"""Whole-text token ids of public vocabularies, cached by pre-token.

The ``tokenizers`` library decides every id.  A text is split into pre-tokens
by the vocabulary's own pattern, each distinct pre-token is encoded once by the
library, and its packed ids are reused.  The split is done here only for texts
whose characters behave alike in every Unicode version (below U+0250, without
the few exceptions named below); any other text, and any text that holds a
special string, goes through the library whole.  Null counts as empty.
"""

from __future__ import annotations

import json
import sys
from array import array

import regex

#: Pre-token patterns of the two vocabularies (fixed values of their files).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What the fast split leaves to the library: information separators, whose white-space class differs between
#: libraries, dotted capital I, whose lower case is two characters, and everything from U+0250 on.
ODD = regex.compile("[\x1c-\x1fİɐ-\U0010ffff]")

CACHE_ENTRIES = 1_000_000    # strings a cache of a worker keeps, about 200 MB
CACHE_CHARS = 32             # longer pre-tokens are encoded but not kept


def byte_characters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def plain(text: str) -> bool:
    """Whether the fast split equals the library's for this text."""
    if text.isascii():
        return not any(c in text for c in "\x1c\x1d\x1e\x1f")
    return ODD.search(text) is None


#: Beside single spaces and line ends between words, white space takes the vocabulary's own split.
RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f", "\x85", "\xa0", "\0")


class Cached(dict):
    """String -> its ids as packed little-endian uint32, made by ``make`` and kept while there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


def pack(ids) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4:
        raise RuntimeError("unsigned int is not four bytes here")
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TextIds:
    """Ids of whole texts for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, lower: bool, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lower = lower
        self.tokenize, self.shown = self.library.model.tokenize, byte_characters()
        self.findall = regex.compile(pattern).findall
        with open(path, encoding="utf-8") as f:
            self.special = tuple(t["content"] for t in json.load(f)["added_tokens"])
        self.pieces = Cached(self.merged)
        self.words = Cached(lambda word: b"".join(map(self.pieces.__getitem__, self.findall(word))))

    def merged(self, piece: str) -> bytes:
        """Ids of one pre-token by the library's merges."""
        return pack([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.shown))])

    def words_of(self, text: str) -> list[str] | None:
        """Strings that the pattern splits alike alone and in the text, or None.

        The white-space pattern looks ahead, so a text with runs of white space has none.  Elsewhere
        a single space belongs to the word behind it, and a single line end stands alone.
        """
        if self.lower:
            return text.lower().split()          # white space is no part of any pre-token
        if any(run in text for run in RUNS):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def whole(self, text: str) -> bool:
        """Whether the text must go through the library in one piece."""
        return not plain(text) or any(s in text for s in self.special)

    def ids(self, text: str | None) -> bytes:
        """Packed uint32 ids of the whole text."""
        if not text:
            return b""
        if self.whole(text):
            return pack(self.library.encode(text, add_special_tokens=False).ids)
        words = self.words_of(text)
        if words is None:
            return b"".join(map(self.pieces.__getitem__, self.findall(text)))
        return b"".join(map(self.words.__getitem__, words))


_LOADED: dict[tuple, TextIds] = {}


def text_ids(path: str, kind: str) -> TextIds:
    """One encoder per Python worker; ``kind`` is "byte" or "word"."""
    key = (path, kind)
    if key not in _LOADED:
        _LOADED[key] = TextIds(path, kind == "word", WORD_PATTERN if kind == "word" else BYTE_PATTERN)
    return _LOADED[key]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
