"""A source text with its comments and strings blanked, its brace pairs and its line numbers."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property

_TEXT = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?|" + r"`(?:\\.|[^`\\])*`?"
_SLASHED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|/|" + _TEXT, re.S)
_HASHED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*|" + _TEXT, re.S)
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]?|[^/\\\n\[])+/?")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,\[!&|?:;{}~^+\-*%<>]|\b(?:return|case|typeof|void|delete|in|instanceof|new))\s*\Z")


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


class Source:
    def __init__(self, text: str, hash_comments: bool = False):
        self.text, self.hash_comments = text, hash_comments
        self.lines = text.split("\n")

    @cached_property
    def _masked(self) -> tuple[str, str]:
        """(comments and template strings blank, all strings blank as well); both as long as the text."""
        code, bare, done = [], [], 0
        pattern = _HASHED if self.hash_comments else _SLASHED
        while m := pattern.search(self.text, done):
            at, token = m.start(), m[0]
            between = self.text[done:at]
            if token == "/":
                r = _REGEX.match(self.text, at) if _BEFORE_REGEX.search(self.text[max(0, at - 40) : at]) else None
                token = r[0] if r else token
                kept, hidden = token, token if len(token) == 1 else "/" + _blank(token[1:-1]) + token[-1]
            elif token[0] in "/#":
                kept = hidden = _blank(token)
            else:
                inner = token[1:-1] if len(token) > 1 and token[-1] == token[0] else token[1:]
                hidden = token[0] + _blank(inner) + token[1 + len(inner) :]
                kept = hidden if token[0] == "`" else token
            code += [between, kept]
            bare += [between, hidden]
            done = at + len(token)
        rest = self.text[done:]
        return "".join([*code, rest]), "".join([*bare, rest])

    @property
    def code(self) -> str:
        return self._masked[0]

    @property
    def bare(self) -> str:
        return self._masked[1]

    @cached_property
    def _pairs(self) -> dict[int, int]:
        out, open_ = {}, []
        for m in re.finditer("[{}]", self.bare):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                out[open_.pop()] = m.start()
        return out

    def closing(self, brace: int) -> int | None:
        """The place of the brace that closes the one at ``brace``."""
        return self._pairs.get(brace)

    @cached_property
    def _starts(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.text))]

    def line(self, place: int) -> int:
        """The number, from 1, of the line that holds a place."""
        return bisect_right(self._starts, max(0, place))

    def between(self, first: int, last: int) -> str:
        """Lines first to last, from 1."""
        return "\n".join(self.lines[first - 1 : last])
