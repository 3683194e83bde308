"""A reader of the YAML that contracts are written in: block and flow mappings and sequences, all scalar styles, anchors.

Scalars are text (null is None); tags are dropped; several documents give the first.  What is not of
this form raises `ValueError`.
"""

from __future__ import annotations

import re

_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "e": "\x1b", "a": "\a", "v": "\v", "f": "\f", "_": "\xa0", "N": "\x85"}
_NULLS = ("", "~", "null", "Null", "NULL")


class _Line:
    __slots__ = ("indent", "text")

    def __init__(self, raw: str):
        self.text = raw.lstrip(" ")
        self.indent = len(raw) - len(self.text)


def _uncommented(text: str) -> str:
    """Up to a `#` that begins a comment outside quotes."""
    quote = ""
    for k, c in enumerate(text):
        if quote:
            if c == "\\" and quote == '"':
                continue
            if c == quote and not (quote == '"' and k and text[k - 1] == "\\"):
                quote = ""
        elif c in "\"'" and (k == 0 or text[k - 1] in " [{,:"):
            quote = c
        elif c == "#" and (k == 0 or text[k - 1] in " \t"):
            return text[:k].rstrip()
    return text.rstrip()


def _key_end(text: str) -> int:
    """Where the colon behind a mapping key stands; -1 if the text is no key."""
    if text[:1] in "\"'":
        close = _quote_end(text, 0)
        rest = text[close + 1 :].lstrip() if close > 0 else ""
        return len(text) - len(rest) if rest.startswith(":") and rest[1:2] in ("", " ", "\t") else -1
    if text[:1] in "[{|>@`%#" and not re.match(r"\{[^{}:]*\}[^:]*:", text):
        return -1
    m = re.search(r":(?=[ \t]|$)", text)
    return m.start() if m else -1


def _quote_end(text: str, at: int) -> int:
    """Where the quote that opens at `at` is closed; -1 if it is not."""
    quote, k = text[at], at + 1
    while k < len(text):
        if text[k] == "\\" and quote == '"':
            k += 1
        elif text[k] == quote:
            if quote == "'" and text[k + 1 : k + 2] == "'":
                k += 1
            else:
                return k
        k += 1
    return -1


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")

    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "xuU" and len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text[1:-1], flags=re.S)


def _open_flow(text: str) -> bool:
    """Whether a flow value or a quoted text goes on behind the end of the text."""
    depth, k = 0, 0
    while k < len(text):
        c = text[k]
        if c in "\"'" and (k == 0 or text[k - 1] in " [{,:"):
            k = _quote_end(text, k)
            if k < 0:
                return True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        k += 1
    return depth > 0


class Reader:
    def __init__(self, text: str):
        self.lines = [_Line(raw) for raw in text.split("\n")]
        self.at, self.anchors = 0, {}

    def _peek(self) -> _Line | None:
        """The next line that holds more than a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.text.strip() and not line.text.startswith("#") and not (line.indent == 0 and line.text[0] == "%"):
                return line
            self.at += 1
        return None

    def document(self):
        line = self._peek()
        if line and re.match(r"---(\s|$)", line.text):
            rest = _uncommented(line.text[3:].strip())
            self.at += 1
            if rest:
                return self._value(rest, -1)
        line = self._peek()
        return self._block(line.indent) if line else None

    def _block(self, indent: int):
        line = self._peek()
        if line is None or line.indent < indent or self._ends(line):
            return None
        if line.text == "-" or line.text.startswith("- "):
            return self._sequence(line.indent)
        if _key_end(_uncommented(line.text)) >= 0:
            return self._mapping(line.indent)
        self.at += 1
        return self._value(_uncommented(line.text), line.indent - 1)

    @staticmethod
    def _ends(line: _Line) -> bool:
        return line.indent == 0 and re.match(r"(?:---|\.\.\.)(\s|$)", line.text) is not None

    def _mapping(self, indent: int) -> dict:
        out: dict = {}
        while (line := self._peek()) and line.indent == indent and not self._ends(line):
            text = _uncommented(line.text)
            end = _key_end(text)
            if end < 0:
                if text.startswith("- ") or text == "-":
                    break
                raise ValueError(f"no key: {text[:60]}")
            key = text[:end].rstrip()
            key = _unquoted(key) if key[:1] in "\"'" else key
            self.at += 1
            value = self._value(text[end + 1 :].strip(), indent)
            if key == "<<" and isinstance(value, dict):
                out = value | out
            else:
                out[key] = value
        if (line := self._peek()) and line.indent > indent and not self._ends(line):
            raise ValueError(f"bad indentation: {line.text[:60]}")
        return out

    def _sequence(self, indent: int) -> list:
        out = []
        while (line := self._peek()) and line.indent == indent and (line.text == "-" or line.text.startswith("- ")) and not self._ends(line):
            rest = line.text[1:].lstrip(" ")
            inner = indent + len(line.text) - len(rest)
            if not rest or rest.startswith("#"):
                self.at += 1
                below = self._peek()
                out.append(self._block(below.indent) if below and below.indent > indent else None)
            elif rest == "-" or rest.startswith("- ") or _key_end(_uncommented(rest)) >= 0:
                # What follows the dash is a block of its own, as deep as it stands.
                self.lines[self.at] = _Line(" " * inner + rest)
                out.append(self._block(inner))
            else:
                self.at += 1
                out.append(self._value(_uncommented(rest), indent))
        return out

    def _value(self, text: str, indent: int):
        """The value that begins with `text` behind a key or dash of a line of this indentation."""
        anchor = None
        while m := re.match(r"(&\S+|!\S*)(?:\s+|$)", text):
            anchor = m[1][1:] if m[1][0] == "&" else anchor
            text = text[m.end() :]
        value = self._plain_value(text, indent)
        if anchor:
            self.anchors[anchor] = value
        return value

    def _plain_value(self, text: str, indent: int):
        if not text:
            below = self._peek()
            if below and not self._ends(below) and (below.indent > indent or (below.indent == indent and (below.text == "-" or below.text.startswith("- ")))):
                return self._block(below.indent)
            return None
        if m := re.match(r"([|>])([+-]?)(\d?)([+-]?)$", text):
            return self._scalar_block(m[1], m[2] or m[4], indent, int(m[3]) if m[3] else None)
        if text[0] == "*":
            if text[1:] not in self.anchors:
                raise ValueError(f"unknown alias {text[:60]}")
            return self.anchors[text[1:]]
        if text[0] in "[{\"'":
            while _open_flow(text):
                line = self._peek()
                if line is None:
                    raise ValueError(f"not closed: {text[:60]}")
                self.at += 1
                text += " " + _uncommented(line.text)
            value, end = self._flow(text, 0)
            if text[end:].strip():
                raise ValueError(f"text behind a value: {text[end:][:60]}")
            return value
        # Lines that stand deeper go on with a plain text.
        while (line := self._peek()) and line.indent > indent and not self._ends(line) and self.lines[self.at - 1].text.strip():
            more = _uncommented(line.text)
            if _key_end(more) >= 0:
                raise ValueError(f"a key inside a text: {more[:60]}")
            text += " " + more
            self.at += 1
        return None if text in _NULLS else text

    def _scalar_block(self, style: str, chomp: str, indent: int, deep: int | None) -> str:
        rows, own = [], None if deep is None else indent + deep
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.text:
                own = line.indent if own is None else own
                if line.indent < own or line.indent <= indent:
                    break
            rows.append("" if own is None else (" " * line.indent + line.text)[own:])
            self.at += 1
        body = len(rows)
        while body and not rows[body - 1]:
            body -= 1
        if style == "|":
            text = "\n".join(rows[:body])
        else:
            text = ""
            for k, row in enumerate(rows[:body]):
                folded = k and row and rows[k - 1] and row[0] != " " and rows[k - 1][0] != " "
                text += (" " if folded else "\n" if k and (not row or (rows[k - 1] and (row[0] == " " or rows[k - 1][0] == " "))) else "") + row
        end = "" if chomp == "-" else "\n" * (len(rows) - body + 1) if chomp == "+" else "\n"
        return text + end if text else ""

    def _flow(self, text: str, k: int):
        """(value, place behind it) of the flow value at k."""
        while k < len(text) and text[k] == " ":
            k += 1
        if k >= len(text):
            raise ValueError("a value is missing")
        if text[k] in "\"'":
            end = _quote_end(text, k)
            if end < 0:
                raise ValueError(f"not closed: {text[k:][:60]}")
            return _unquoted(text[k : end + 1]), end + 1
        if text[k] not in "[{":
            end = k
            while end < len(text) and text[end] not in ",[]{}" and not (text[end] == ":" and text[end + 1 : end + 2] in ("", " ", ",", "]", "}")):
                end += 1
            value = text[k:end].strip()
            if value.startswith("*"):
                return self.anchors.get(value[1:]), end
            return None if value in _NULLS else value, end
        is_map, close, k = text[k] == "{", "}" if text[k] == "{" else "]", k + 1
        found_map, found = {}, []
        while True:
            while k < len(text) and text[k] in " ,":
                k += 1
            if k >= len(text):
                raise ValueError("a bracket is not closed")
            if text[k] == close:
                return (found_map if is_map else found), k + 1
            key, after = self._flow(text, k)
            if after == k:
                raise ValueError(f"bad value: {text[k:][:60]}")
            k = after
            while k < len(text) and text[k] == " ":
                k += 1
            value = key
            if text[k : k + 1] == ":":
                k += 1
                while k < len(text) and text[k] == " ":
                    k += 1
                value, k = (None, k) if text[k : k + 1] in (",", close) else self._flow(text, k)
                if not is_map:
                    value = {key: value}
            if is_map:
                found_map[key] = value if value is not key else None
            else:
                found.append(value)


def load(text: str):
    return Reader(text).document()
