"""Token ids through the public tokenizers, with bounded caches of words and pieces."""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import regex

#: The pre-tokenizer pattern that the byte-level tokenizer file applies (fixed value).
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for the word-end tokenizer file (fixed value).
WORD_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Both for printable ASCII, where they give the same pieces, by a faster engine.
PLAIN_BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+| +(?![^ ])| +")
PLAIN_WORD_END = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^ A-Za-z0-9]+")
#: Words with the one blank before them; no piece of BYTE_LEVEL crosses their borders
#: as long as blanks and line feeds are the only white space.
WORDS = re.compile(r"[ \n]?[^ \n]+|[ \n]+(?=[ \n][^ \n])|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: What makes normalising more than lower-casing and splitting at blanks and line feeds.
BEYOND_LATIN = re.compile("[^\x00-\u024f]|[^\\S \n]")


def _byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b not in set(hidden) else chr(256 + hidden.index(b)) for b in range(256)]


LETTERS = _byte_letters()
SPELLED = dict(enumerate(LETTERS))


class _Cache(dict):
    """A dict that asks ``make`` for what it lacks and keeps short keys until full."""

    def __init__(self, make, most: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= self.longest and len(self) < self.most:
            self[key] = made
        return made


class Encoder:
    """Encodes whole texts to the ids that the tokenizers library gives them.

    Both files split a text into pieces that never influence each other, so
    the ids of a text are those of its pieces in order; pieces recur, hence
    the caches. The library's own model encodes every piece that is not
    cached. A text that holds the string of an added token, which the library
    cuts out first, is encoded whole, and so is every text where the file has
    another pre-tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.pieces = _Cache(self._piece)
        kind = str(self.tokenizer.pre_tokenizer)
        if kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind and self.tokenizer.normalizer is None:
            self.split, self.plain, self.encode = BYTE_LEVEL.findall, PLAIN_BYTE_LEVEL.findall, self._byte_level
        elif kind.startswith("Sequence") and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in kind and "Lowercase" in str(self.tokenizer.normalizer):
            self.split, self.plain, self.encode = WORD_END.findall, PLAIN_WORD_END.findall, self._word_end
        else:
            self.split, self.plain, self.encode = None, None, self._whole
        self.words = _Cache(self._word)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(SPELLED)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        parts = self.plain(word) if word.isascii() and word.isprintable() else self.split(word)
        if len(parts) == 1:  # kept as a word, so not as a piece, too
            return self._piece(parts[0])
        return b"".join(map(self.pieces.__getitem__, parts))

    def _byte_level(self, text: str) -> bytes:
        if OTHER_SPACE.search(text):
            return self._word(text)
        return b"".join(map(self.words.__getitem__, WORDS.findall(text)))

    def _word_end(self, text: str) -> bytes:
        if not BEYOND_LATIN.search(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return b"".join(map(self.words.__getitem__, self.tokenizer.normalizer.normalize_str(text).split(" ")))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(t in text for t in self.added):
            return self._whole(text)
        return self.encode(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
