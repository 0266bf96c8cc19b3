"""Tokens of a masked source text, their brackets, and small steps over them that the grammars share."""

from __future__ import annotations

import re
from functools import cached_property

from lodestone.parse.source import Source

_TOKEN = re.compile(r""""[^"\n]*"?|'[^'\n]*'?|`[^`]*`?|[A-Za-z0-9_$]+|=>|::|\S""")
_PARTNER = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """``word[i]`` is the i-th token of the text without comments and string contents; past the end it is empty."""

    def __init__(self, src: Source):
        self.src = src
        spans = [m.span() for m in _TOKEN.finditer(src.bare)]
        self.start, self.end = [a for a, _ in spans], [b for _, b in spans]
        self.word = [src.bare[a:b] for a, b in spans] + [""]
        self.n = len(spans)

    @cached_property
    def _close(self) -> dict[int, int]:
        out: dict[int, int] = {}
        open_: list[int] = []
        for i, w in enumerate(self.word):
            if w in ("(", "[", "{"):
                open_.append(i)
            elif w in _PARTNER and open_ and self.word[open_[-1]] == _PARTNER[w]:
                out[open_.pop()] = i
        return out

    def at(self, i: int) -> str:
        return self.word[i] if 0 <= i < self.n else ""

    def name(self, i: int) -> str:
        """The identifier at i, else nothing."""
        w = self.at(i)
        return w if w and (w[0].isalpha() or w[0] in "_$") and w.isascii() else ""

    def is_text(self, i: int) -> bool:
        return self.at(i)[:1] in ('"', "'", "`") and len(self.at(i)) > 1

    def text(self, i: int) -> str:
        """What a string token holds in the source."""
        return self.src.text[self.start[i] + 1 : self.end[i] - 1]

    def slice(self, i: int, j: int) -> str:
        """The source from token i up to token j."""
        return self.src.text[self.start[i] : self.end[j - 1]] if i < j else ""

    def first_on_line(self, i: int) -> bool:
        return i == 0 or "\n" in self.src.bare[self.end[i - 1] : self.start[i]]

    def after(self, i: int) -> int | None:
        """The place behind the bracket that closes the one at i; none if it never closes."""
        j = self._close.get(i)
        return None if j is None else j + 1

    def skip_angles(self, i: int) -> int:
        """The place behind <...> at i, or i itself where there is none."""
        if self.at(i) != "<":
            return i
        depth = 0
        for j in range(i, self.n):
            depth += (self.word[j] == "<") - (self.word[j] == ">")
            if depth == 0:
                return j + 1
            if self.word[j] in (";", "{"):
                break
        return i

    def until_brace(self, i: int, one_line: bool = False, stop: str = ";") -> int | None:
        """The next { from i on, unless a token of ``stop`` (or the end of the line) comes first."""
        for j in range(i, self.n):
            if self.word[j] == "{":
                return j
            if self.word[j] in stop or (one_line and j > i and self.first_on_line(j)):
                return None
        return None

    def back(self, i: int, words: frozenset[str]) -> int:
        """The first of the tokens right before i that are all in ``words``."""
        while i > 0 and self.word[i - 1] in words:
            i -= 1
        return i

    def items(self, i: int, j: int) -> list[list[str]]:
        """Tokens i to j, parted at the commas outside of inner brackets."""
        out: list[list[str]] = [[]]
        k = i
        while k < j:
            if self.word[k] == ",":
                out.append([])
            else:
                out[-1].append(self.word[k])
            k += 1
        return [x for x in out if x]
