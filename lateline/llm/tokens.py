"""Token ids of whole texts by the tokenizers library, asked once per distinct piece of text.

Both vocabularies cut a text before they merge: no token crosses a single space between two other characters, nor a
line break. So the ids of a text are the ids of its pieces in a row, and a worker keeps the ids of the pieces it has
seen (in a table of two halves). Pieces with two white spaces together go to the library unsplit.

Special tokens written in a text are one id each where ``special`` is set, as the library has it unless told otherwise; else
they are read like other text. They hold no white space, so a piece that holds one goes to the library, too.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

from .common import kept

KEPT = 500_000          # pieces a worker remembers
MARKS = 10_000            # runs of signs it remembers
SEGMENT = 1 << 20         # characters cut into pieces at a time
# Byte-level vocabularies show a byte as the character of its number where that prints, as one from 256 on elsewhere.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
# ASCII signs; behind letters they are a unit of their own, whatever their number. A special token holds letters between its signs.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DOUBLE = re.compile(r"\s\s")
_LONE = re.compile(r"(?<=\S) (?=\S)")


class _Pieces(dict):
    """Ids of pieces, found when first asked for. A full table becomes the older half, so pieces that come again stay and
    the many that occur once go."""

    def __init__(self, tokenizer, drops_white: bool, space: bool):
        self.tokenizer, self.drops_white, self.space = tokenizer, drops_white, space
        self.tokenize = tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}          # ids of signs behind a word

    def __missing__(self, p: str) -> bytes:
        ids = self.old.get(p)
        if ids is None:
            word = p.rstrip(_SIGNS)
            ids = self._word(word)
            if ids is None:
                ids = _ids(self.tokenizer, " " + p if self.space else p)
            elif len(word) < len(p):
                ids += self._mark(p[len(word):])
        self[p] = ids
        return ids

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters: one unit to the vocabulary's splitter, so the library's model takes it as it is."""
        if not word.isalpha():
            return None
        if not word.isascii():
            if max(word) >= "\u0130":
                return None
            word = (word.lower() if self.drops_white else word).encode().decode("latin-1").translate(_SHOWN)
        elif self.drops_white:
            word = word.lower()
        return array("I", [t.id for t in self.tokenize("\u0120" + word if self.space else word)]).tobytes()

    def _mark(self, signs: str) -> bytes:
        """Ids of signs after letters: a unit of their own."""
        ids = self.marks.get(signs)
        if ids is None:
            ids = _ids(self.tokenizer, signs)
            if len(self.marks) < MARKS:
                self.marks[signs] = ids
        return ids

    def of(self, pieces: list[str]) -> bytes:
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, pieces))


def _ids(tokenizer, piece: str) -> bytes:
    return array("I", tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()


class Encoder:
    """``drops_white`` says that the vocabulary gives white space no ids (and lower-cases)."""

    def __init__(self, path: str, drops_white: bool, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.drops_white = drops_white
        self.lead = _Pieces(self.tokenizer, drops_white, False)     # pieces at a line's start
        self.rest = _Pieces(self.tokenizer, drops_white, True)      # pieces after a space
        self.line = b"" if drops_white else _ids(self.tokenizer, "\n")

    def _segments(self, text: str) -> Iterator[str]:
        """Parts of a long text that start with the space or line break they were cut before."""
        at = 0
        while len(text) - at > SEGMENT:
            m = None
            for m in re.compile(r"(?<=\S)[ \n](?=\S)").finditer(text, at + SEGMENT - 4096, at + SEGMENT):
                pass
            if m is None:
                m = re.compile(r"(?<=\S)[ \n](?=\S)").search(text, at + SEGMENT)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts) -> Iterator[bytes]:
        """Ids of each text, as unsigned little-endian 32-bit numbers."""
        for text in texts:
            if not text:
                yield b""
            elif len(text) <= SEGMENT:
                yield self._part(text)
            else:
                yield b"".join(map(self._part, self._segments(text)))

    def _part(self, text: str) -> bytes:
        if self.drops_white:
            return self.lead.of(text.replace("\n", " ").split(" "))
        if _DOUBLE.search(text):
            first, *others = _LONE.split(text)
            return _ids(self.tokenizer, first) + self.rest.of(others)
        lead, rest, out = self.lead, self.rest, []
        for line in text.split("\n"):
            first, _, others = line.partition(" ")
            out.append(lead.of([first]) + rest.of(others.split(" ")) if _ else lead.of([first]))
        return self.line.join(out)


def encoder(path: str, drops_white: bool, special: bool = False) -> Encoder:
    """One encoder per worker process, until the worker does other work."""
    return kept((path, drops_white, special), lambda: Encoder(path, drops_white, special))
