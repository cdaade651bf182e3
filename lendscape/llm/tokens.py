"""Encoding whole texts with the tokenizers library, each distinct piece of a text once.

Both tokenizers cut a text into pieces before they merge, so a text's ids are those of its pieces one
after the other. Here a text is parted at white space into units; a worker keeps the ids of the units it has
met, cuts new ones into pieces by the tokenizer's own pattern, keeps those among them, and asks the
library's model for the pieces it has not met. Texts beyond Latin-1 are not cut finer than units; texts with
white space that the two libraries might see differently, and texts that spell a special token, are
encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
UNITS_KEPT = 400_000
# A word with the space before it; of longer white space all but the last, then that one.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# White space other than the ASCII kind, separators Python alone counts as such, joiners and marks; NUL is ours.
ODD = re.compile(r"[\x00\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
ODD_LATIN, BREAKS = "\x00\x1c\x1d\x1e\x1f\x85\xa0", "\t\n\v\f\r"
SPECIAL = "<|"
FIRST = "\0"
# The letters and numbers of Latin-1, and the tokenizers' patterns over them: fixed values.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


def in_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def odd(text: str, latin: bool) -> bool:
    """Whether a text has to be encoded whole. A search for single characters takes far less time than a pattern's."""
    if SPECIAL in text:
        return True
    return any(c in text for c in ODD_LATIN) if latin else ODD.search(text) is not None


def crowded(text: str) -> bool:
    """Whether a space follows white space, in a text that is not odd."""
    return "  " in text or any(c in text and f"{c} " in text for c in BREAKS)


class _Kept(dict):
    """What has been worked out; asks for what has not."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        self[key] = found = self.find(key)
        return found


class UnitEncoder:
    """Ids of units, joined. ``encode_piece`` gives the ids of a piece, ``cut`` cuts a unit into pieces.

    The two newest generations of units are kept, and one of pieces: memory stays bounded however many
    there are. Where pieces are ``units`` themselves, each its own only piece, they are kept among them:
    a word is worked out once, whether it stands alone or between marks. ``unit_of`` names the unit that is a
    piece and nothing else, where the two are not spelled alike.
    """

    def __init__(
        self,
        encode_piece: Callable[[str], list[int]],
        cut: Callable[[str], list[str]] | None = None,
        kept: int = UNITS_KEPT,
        units: bool = False,
        unit_of: Callable[[str], str] | None = None,
    ):
        self.cut, self.kept, self.units, self.unit_of = cut, kept, units, unit_of
        self.pieces = _Kept(lambda piece: array("I", encode_piece(piece)).tobytes())
        self.young, self.old = _Kept(self._learn), {}

    def _learn(self, unit: str) -> bytes:
        known = self.old.get(unit)
        if known is not None:
            return known
        if self.cut is None:
            return self.pieces.find(unit)
        parts = self.cut(unit)
        if not self.units:
            return b"".join(map(self.pieces.__getitem__, parts))
        if len(parts) == 1:
            return self.pieces.find(parts[0])
        return b"".join(map(self.young.__getitem__, map(self.unit_of, parts) if self.unit_of else parts))

    def encode(self, units: list[str]) -> np.ndarray:
        if len(self.young) > self.kept:
            self.young, self.old = _Kept(self._learn), self.young
        if len(self.pieces) > self.kept:
            self.pieces.clear()
        return np.frombuffer(b"".join(map(self.young.__getitem__, units)), np.uint32)


@cache
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others follow 255 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class TextEncoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    UNIT_OF = None

    def __init__(self, path: str, kept: int = UNITS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.latin = UnitEncoder(self._merge, self._cut, kept, units=True, unit_of=self.UNIT_OF)
        self.wide = UnitEncoder(self._whole, kept=kept // 4)

    def _merge(self, piece: str) -> list[int]:
        """A piece is merged by the library's model; nothing is left to cut or to normalise."""
        if piece.isascii() and piece.isprintable():  # all but the space are spelled alike in the byte-level alphabet
            return [t.id for t in self.model.tokenize(piece.replace(" ", self.letters[32]))]
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        latin = in_latin(text)
        if odd(text, latin):
            return np.asarray(self._whole(text), np.uint32)
        return self._of_units(text, latin)


def spaced_unit(piece: str) -> str:
    """The unit that is this piece alone: it names the space before it by leaving it out."""
    return piece[1:] if piece[0] == " " else FIRST + piece


class ByteEncoder(TextEncoder):
    """White space is part of the ids: a unit is a word with the space before it."""

    UNIT_OF = staticmethod(spaced_unit)

    def _cut(self, unit: str) -> list[str]:
        if unit.isascii() and unit.isalpha():  # a word is one piece
            return [f" {unit}"]
        return BYTE_PIECES.findall(unit[1:] if unit.startswith(FIRST) else f" {unit}")

    def _of_units(self, text: str, latin: bool) -> np.ndarray:
        if not latin or crowded(text):  # a space that does not stand alone goes with others
            return self.wide.encode(SPACED.findall(text))
        units = text.split(" ")
        units[0] = FIRST + units[0]
        return self.latin.encode(units)


class WordEncoder(TextEncoder):
    """White space only separates, and case is ignored."""

    def _merge(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isalnum():  # spelled alike in the byte-level alphabet
            return [t.id for t in self.model.tokenize(piece)]
        return super()._merge(piece)

    def _cut(self, unit: str) -> list[str]:
        return WORD_PIECES.findall(unit)

    def _of_units(self, text: str, latin: bool) -> np.ndarray:
        return self.latin.encode(text.lower().split()) if latin else self.wide.encode(text.split())


@cache
def byte_encoder(name: str = "byte_bpe_50k.json") -> ByteEncoder:
    """One per worker."""
    return ByteEncoder(public_tokenizers.path(name), kept=UNITS_KEPT * 3 // 2)


@cache
def word_encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    """One per worker."""
    return WordEncoder(public_tokenizers.path(name), kept=UNITS_KEPT // 2)
