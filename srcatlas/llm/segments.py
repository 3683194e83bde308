"""Cutting texts where tokenizers always cut, and remembering what was learnt of each part.

A blank behind a character that is no white space begins a new token in both kinds of public
tokenizers: byte-level ones split words there before any merge, and a sentencepiece vocabulary in
which the mark of a blank never stands behind another character cannot merge across it.  Ids of a
text are then the ids of its parts end to end, and parts recur far more often than they are new.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: How sentencepiece writes a blank; a text that holds the mark itself is not cut.
MARK = "▁"
_CUT = re.compile(r"(?<=\S) ")
#: White space but blanks and line ends.
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Longer parts are not remembered.
LONGEST = 64
#: What Python needs for an entry beyond its characters and value.
ENTRY_BYTES = 200


def segments(text: str) -> list[str] | None:
    """The parts of a text, each without the blank before it; None for a text that must stay whole."""
    if not text or text.endswith(" ") or MARK in text:
        return None
    odd = text[0] == " " or "  " in text or "\n " in text or any(map(text.__contains__, _RARE))
    return _CUT.split(text) if odd else text.split(" ")


class Memo:
    """What `learn` says of parts, kept for about `limit` bytes of parts in use and as many of parts used before these."""

    def __init__(self, learn: Callable[[list[str]], Iterable], weigh: Callable[[object], int], limit: int = 40 << 20):
        self.learn, self.weigh, self.limit = learn, weigh, limit
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}
        self.held = 0

    def of(self, parts: set[str]) -> dict[str, object]:
        """A mapping that holds all of `parts`."""
        if self.held > self.limit:
            self.before, self.now, self.held = self.now, {}, 0
        new = parts - self.now.keys()
        back = new & self.before.keys()
        found = dict(zip(back, map(self.before.__getitem__, back)))
        fresh = list(new - back)
        found.update(zip(fresh, self.learn(fresh)) if fresh else ())
        long = [k for k in found if len(k) > LONGEST]
        whole = self.now | found if long else None
        for k in long:
            del found[k]
        self.now.update(found)
        self.held += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(self.weigh, found.values()))
        return whole or self.now


def cuts_at_blanks(path: str) -> bool:
    """Whether a sentencepiece model leaves texts as they are and has no piece in which a blank follows another character."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
    own = any(p.type == p.USER_DEFINED for p in model.pieces)
    return plain and not own and not model.trainer_spec.treat_whitespace_as_suffix and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)
