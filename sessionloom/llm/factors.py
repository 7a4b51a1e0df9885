"""Relative Lempel-Ziv factors of word sequences against an indexed reference block."""

from __future__ import annotations

from collections.abc import Iterable


class Reference:
    """A block of reference text: its words, and all places of each phrase of `size` words.

    Phrases are looked up and compared as the words themselves, so that a factor
    is a true match whatever any hash says.
    """

    def __init__(self, size: int):
        self.size = size
        self.words: list[bytes | None] = []
        self.places: dict[bytes, list[int]] = {}

    def add(self, words: list[bytes]) -> None:
        """Appends words to the block; no match reaches over their end."""
        at = len(self.words)
        self.words += [*words, None]
        for i in range(len(words) - self.size + 1):
            self.places.setdefault(b" ".join(words[i : i + self.size]), []).append(at + i)

    def longest(self, words: list[bytes], start: int) -> tuple[int, int]:
        """The place in the block and the length of the longest match at `start`, the first of several; of length 0 under `size` words.

        Of the phrase's places only those that go on beyond the longest match so
        far are followed.
        """
        phrase = words[start : start + self.size]
        places = self.places.get(b" ".join(phrase), ()) if len(phrase) == self.size else ()
        best, most, block, left = 0, 0, self.words, len(words) - start
        for at in places:
            if most and (most == left or at + most >= len(block) or block[at + most] != words[start + most]):
                continue
            length = self.size
            while length < left and block[at + length] == words[start + length]:
                length += 1
            if length > most:
                best, most = at, length
        return best, most

    def parse(self, words: list[bytes]) -> list[tuple[int, int] | bytes]:
        """The greedy parse: longest factors (place, length) of at least `size` words, and single words where none fits."""
        out: list[tuple[int, int] | bytes] = []
        i = 0
        while i < len(words):
            at, length = self.longest(words, i)
            out.append((at, length) if length else words[i])
            i += length or 1
        return out

    def rebuild(self, parsed: Iterable[tuple[int, int] | bytes]) -> list[bytes]:
        """The words that `parse` was given."""
        out: list[bytes] = []
        for x in parsed:
            out += [x] if isinstance(x, bytes) else self.words[x[0] : x[0] + x[1]]
        return out

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Ranges of words that are covered by phrases of the block: the factors of the parse, and the phrases across their ends.

        Within a factor every phrase occurs; where there is none the parse has
        looked. What is left are phrases that start inside a factor and reach
        over its end: these are looked up, from the first on.
        """
        out: list[tuple[int, int]] = []
        at = 0
        for x in self.parse(words):
            if isinstance(x, bytes):
                at += 1
                continue
            begin, at = at, at + x[1]
            out.append((begin, at))
            i = at - self.size + 1
            while i < at:
                length = self.longest(words, i)[1]
                if length:
                    out.append((i, i + length))
                i += length - self.size + 1 if length else 1
        return out
