"""Tokens of contract files: names, strings and marks with their places; comments and white space are left out."""

from __future__ import annotations

import re
from bisect import bisect_left

NAME, STRING, MARK = "name", "string", "mark"
PAIRS = {"(": ")", "{": "}", "[": "]"}


def lexer(comments: list[str], strings: list[str], quoted: list[str], name: str) -> re.Pattern:
    """A pattern for one token or comment, from the patterns of each sort; anything else that is no white space is a mark."""
    sorts = (("comment", comments), (STRING, strings), ("quoted", quoted), (NAME, [name]), (MARK, [r"\S"]))
    return re.compile("|".join(f"(?P<{sort}>{'|'.join(patterns)})" for sort, patterns in sorts if patterns), re.S)


class Tokens:
    """The tokens of a text in order, with the places of closing brackets.

    A list for each of their properties, of texts and numbers alone: most tokens are never asked for, least of all for their line.
    """

    def __init__(self, text: str, pattern: re.Pattern):
        self.text = text
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self.kinds: list[str] = []
        self.texts: list[str] = []  # names without their quotes, strings and marks as they stand
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.begins: list[bool] = []  # nothing but white space stands before it on its line
        last = -1  # the last character of the token or comment before
        for m in pattern.finditer(text):
            sort, (start, stop) = m.lastgroup, m.span()
            if sort != "comment":
                quoted = sort == "quoted"
                self.kinds.append(NAME if quoted else sort)
                self.texts.append(text[start + 1 : stop - 1] if quoted else m[0])
                self.starts.append(start)
                self.stops.append(stop)
                self.begins.append(last < 0 or "\n" in text[last:start])
            last = stop - 1
        self._closing: dict[int, int] | None = None

    def line(self, offset: int) -> int:
        """1-based."""
        return bisect_left(self.ends, offset) + 1

    def line_of(self, k: int) -> int:
        return self.line(self.starts[k])

    def __len__(self) -> int:
        return len(self.texts)

    def is_word(self, k: int, *words: str) -> bool:
        return 0 <= k < len(self.texts) and self.kinds[k] == NAME and self.texts[k].lower() in words

    def is_mark(self, k: int, mark: str) -> bool:
        return 0 <= k < len(self.texts) and self.kinds[k] == MARK and self.texts[k] == mark

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.texts) and self.kinds[k] == NAME

    def skip(self, k: int, *words: str) -> int:
        """The place behind the words, if all of them stand there; else the place itself."""
        return k + len(words) if all(self.is_word(k + i, w) for i, w in enumerate(words)) else k

    def closing(self, k: int) -> int | None:
        """The place of the bracket that closes the one at k; None if nothing does."""
        if self._closing is None:
            self._closing, open_ = {}, {mark: [] for mark in PAIRS}
            opens = {v: k for k, v in PAIRS.items()}
            for i, mark in enumerate(self.texts):
                if mark in PAIRS and self.kinds[i] == MARK:
                    open_[mark].append(i)
                elif mark in opens and self.kinds[i] == MARK and open_[opens[mark]]:
                    self._closing[open_[opens[mark]].pop()] = i
        return self._closing.get(k)

    def blank_above(self, k: int) -> int:
        """The first of the blank lines that stand directly above the token at k, or its own line: white space before a declaration is its own."""
        line = self.line_of(k)
        while line > 1:
            start = self.ends[line - 3] + 1 if line > 2 else 0
            if self.text[start : self.ends[line - 2]].strip():
                break
            line -= 1
        return line
