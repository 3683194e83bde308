"""Token ids of whole texts by a public tokenizer, for use inside tasks.

Words recur far more often than they are new, so each distinct whitespace-delimited piece is
encoded once per worker and its ids are looked up from then on.  Cuts are made only where the
tokenizer's own pre-tokenisation always cuts; a text with any other white space than blanks,
tabs and line ends is encoded whole, and so is a text that holds the string of a special token,
which the tokenizer cuts out before anything else.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from string import ascii_letters, ascii_lowercase

import numpy as np

#: Latin-1 letters, and ASCII marks without the apostrophe (it can bind to letters).
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]")
#: White space but blanks, tabs and line ends; each is looked for on its own, which is faster than a class of characters.
_ODD_SPACES = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of pieces remembered per worker, and as many of pieces that were in use before these.
CACHE_BYTES = 40 << 20
#: What Python needs for an entry beyond its ids and characters.
ENTRY_BYTES = 190
#: Characters of the longest piece that `Pieces` remember: longer ones hardly recur.
LONGEST_PIECE = 64
_WORKER: dict[str, "PieceEncoder"] = {}


class Pieces(dict):
    """Ids of pieces, learnt when first asked for, so that texts need no look at their pieces before."""

    def __init__(self, learn: Callable[[str], bytes], older: dict[str, bytes]):
        self.learn, self.older, self.held = learn, older, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.learn(piece)
        if len(piece) <= LONGEST_PIECE:
            self[piece] = ids
            self.held += ENTRY_BYTES + len(piece) + len(ids)
        return ids


class PieceEncoder:
    """Encodes texts to little-endian uint32 bytes, equal to the tokenizer's own result."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.special = re.compile("|".join(map(re.escape, special)), re.I) if special else None
        # What all of them begin with, before any letter: few texts hold it at all.
        self.sign = re.match(r"[^A-Za-z]*", os.path.commonprefix(special))[0]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        # Tokenizers that keep white space attach one blank to the word after it.
        self.keeps_space = self._ids("a b") != self._ids("a") + self._ids("b")
        self.lowers = self._ids("A") == self._ids("a")
        # Where a row of small letters is one word as it stands, new ones go to the model without the steps that come before it.
        self.model = None if self.keeps_space or not self.tok.pre_tokenizer or not self._is_word(ascii_lowercase) else self.tok.model
        # The same where words keep their blank: what the model gets for a blank and for each letter.
        self.signs = self._signs() if self.keeps_space else None
        self.tokenize = self.tok.model.tokenize
        if self.signs:
            self.cache = Pieces(self._one, self.older)
        # Letters and marks part where one ends and the other begins; what is neither stays whole.
        blank = " ?" if self.keeps_space else ""
        parts = [rf"{blank}[{_LETTERS}]+(?![^{_MARKS} \t\n\r])", rf"[{_MARKS}]+(?![^{_LETTERS} \t\n\r])", rf"{blank}[^ \t\n\r]+"]
        if self.keeps_space:
            parts += [r"[ \t\n\r]+(?![^ \t\n\r])", r"[ \t\n\r]"]
        self.pieces = re.compile("|".join(parts))
        self.words = re.compile(rf" ?[{_LETTERS}]+")
        # A mark of a single id that no other text yields tells joined pieces apart.
        marks = "\n" if self.keeps_space else "¶§•†‡¤°±£€"
        self.mark = next((m for m in marks if len(self._ids(m)) == 1), None)
        self.between = self.mark if self.keeps_space else f" {self.mark} "
        self.mark_id = self._ids(self.mark)[0] if self.mark else None

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _is_word(self, text: str) -> bool:
        """Whether the tokenizer hands this text to its model whole and unchanged."""
        normal = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        words = [word for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)]
        return words == [text] and [t.id for t in self.tok.model.tokenize(text)] == self._ids(text)

    def _signs(self) -> dict[int, str] | None:
        """What the model gets for a blank and for each letter; None if words of these do not come to it whole and sign by sign."""
        if self.tok.normalizer or not self.tok.pre_tokenizer:
            return None
        row = " " + "".join(c for c in map(chr, range(256)) if re.match(f"[{_LETTERS}]", c))
        signs, *words = [[word for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(x)] for x in (row, *row)]
        table = {ord(c): "".join(word) for c, word in zip(row, words)}
        whole = signs == [row.translate(table)] and all(table[ord(c)] == c for c in ascii_letters)
        return table if whole and [t.id for t in self.tok.model.tokenize(signs[0])] == self._ids(row) else None

    def _one(self, piece: str) -> bytes:
        """Ids of a piece; words go to the model without the steps that come before it."""
        if self.words.fullmatch(piece):
            ids = [t.id for t in self.tokenize(piece.replace(" ", self.signs[32]) if piece.isascii() else piece.translate(self.signs))]
        else:
            ids = self._ids(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _joined(self, text: str) -> bytes:
        """Ids of a text from those of its pieces; what is known becomes the older half once there is enough of it."""
        if self.cache.held > CACHE_BYTES:
            self.older = dict(self.cache)
            self.cache = Pieces(self._one, self.older)
        return b"".join(map(self.cache.__getitem__, self.pieces.findall(text)))

    def _each(self, pieces: list[str]) -> None:
        for piece, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False)):
            self.cache[piece] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        if self.model:
            tokenize = self.model.tokenize
            words = [x for x in new if x.isascii() and x.isalpha() and x.islower()]
            for x in words:
                ids = [t.id for t in tokenize(x)]
                self.cache[x] = struct.pack(f"<{len(ids)}I", *ids)
            new = [x for x in new if x not in self.cache]
        if self.mark_id is None:
            return self._each(new)
        plain = [x for x in new if self.mark not in x and not x.isspace()]
        rest = [x for x in new if self.mark in x or x.isspace()]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.tok.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(part) - 1:
                self._each(part)
                continue
            data, a = ids.tobytes(), 0
            for piece, b in zip(part, [*cuts.tolist(), len(ids)]):
                self.cache[piece] = data[4 * a : 4 * b]
                a = b + 1
        if rest:
            self._each(rest)

    def _whole(self, text: str) -> bool:
        return bool((self.special and self.sign in text and self.special.search(text)) or any(map(text.__contains__, _ODD_SPACES)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        whole = [bool(t) and self._whole(t) for t in texts]
        if self.signs:
            return [b"" if not t else np.array(self._ids(t), dtype="<u4").tobytes() if w else self._joined(t) for t, w in zip(texts, whole)]
        if self.lowers:  # Latin-1 letters have one lower-case form each
            texts = [t if w or not t or _BEYOND_LATIN.search(t) else t.lower() for t, w in zip(texts, whole)]
        cut = [None if w or not t else self.pieces.findall(t) for t, w in zip(texts, whole)]
        if self.held > CACHE_BYTES:
            self.older, self.cache, self.held = self.cache, {}, 0
        new = set().union(*[x for x in cut if x]) - self.cache.keys()
        known = new & self.older.keys()
        self.cache.update(zip(known, map(self.older.__getitem__, known)))
        if fresh := new - known:
            self._learn(list(fresh))
        self.held += ENTRY_BYTES * len(new) + sum(map(len, new)) + sum(map(len, map(self.cache.__getitem__, new)))
        get, out = self.cache.__getitem__, []
        for t, pieces in zip(texts, cut):
            if pieces is not None:
                out.append(b"".join(map(get, pieces)))
            else:
                out.append(np.array(self._ids(t), dtype="<u4").tobytes() if t else b"")
        return out


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this vocabulary; Python workers live on between tasks."""
    if path not in _WORKER:
        _WORKER[path] = PieceEncoder(path)
    return _WORKER[path]


def encode_rows(batch, text: str, path: str, rows: int = 256):
    """Yield (first row, list of id bytes) over slices of an Arrow batch, bounding memory."""
    enc, column = encoder(path), batch.column(text)
    for at in range(0, batch.num_rows, rows):
        yield at, enc.encode(column.slice(at, rows).to_pylist())
