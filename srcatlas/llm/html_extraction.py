"""Operator 4: main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks, the texts between tags of block elements.  A two-label chain
over the blocks (main text or not) scores features of the block's ancestors, the tags and the
words in class, id and role of all of them whatever the depth, features of its text, and label
changes.  It is trained by gradient ascent on labelled pages and decoded by Viterbi.

Labelled pages are those given as a table (html, labels: one of 0 or 1 for each leaf block in
page order), or, by default, `labelled_pages`, which are made by rule.  Ancestor features are
blanked on some pages in training, so that text features carry weight where a page lacks
telling markup.  At most `TRAIN_PAGES` pages are taken, those of the least hashes; every page
is extracted from its whole html, in time linear in its length: what the open ancestors add to
a block's score is kept as a running sum.

Defined cases: null or empty html gives an empty text; markup left open at the end counts as
closed there; a page of no main block gives an empty text; null ids are carried; rows that
repeat are extracted each on their own; extra columns are ignored; an empty table gives no
rows.  `<br>` is white space inside its block.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages

TRAIN_PAGES = 2000
FEATURES = 1 << 14
ROUNDS, RATE, DECAY = 120, 0.2, 1e-4
BLANK = 0.25
#: Weights of ancestors are summed in whole numbers of this size, so that sums come back exactly.
UNIT = 1 << 20

_NAME = re.compile(r"/?[a-zA-Z][\w:-]*")
#: A quote opens a value right behind an equals sign alone; elsewhere in a tag it is a character like others.
_STOP = re.compile(r"=[ \t\n\r\f]*+[\"']|>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPOKEN = re.compile(r"[a-z']+")
#: Elements whose content is no text of the page.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea iframe svg".split()}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data em font i img kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: Elements that a start tag closes if they are open in the same container; a paragraph by any other.
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: Words of people who speak to each other, in the languages of the tables.
TALK = frozenset(
    "i me my mine i'm i've im we you your yours u thanks thank thx agree disagree great nice love loved hate lol haha wow imo imho reply replied wrote says said comment comments author ago cheers sorry awesome totally bravo danke super toll finde ich mein merci accord je moi mon gracias acuerdo yo mi genial".split()
)
CONTAINERS = frozenset("html body div article section main nav aside header footer form ul ol dl table figure blockquote".split())


def pieces(page: str):
    """Yield (text, tag, attributes) in page order: a text, or a tag ('/x' if it ends x) and its attributes."""
    at, n, quoted = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], None, None
            return
        name = _NAME.match(page, lt + 1)
        if name is None and page[lt + 1 : lt + 2] not in ("!", "?"):
            yield page[at : lt + 1], None, None
            at = lt + 1
            continue
        if lt > at:
            yield page[at:lt], None, None
        if name is None:
            end, skip = (page.find("-->", lt + 4), 3) if page.startswith("<!--", lt) else (page.find(">", lt), 1)
            at = n if end < 0 else end + skip
            continue
        end = name.end()
        while quoted:
            stop = _STOP.search(page, end)
            if stop is None or stop[0] == ">":
                end = n if stop is None else stop.start()
                break
            close = page.find(stop[0][-1], stop.end())
            end = stop.end() if close < 0 else close + 1
        if not quoted or end >= n:
            # Quotes that leave no tag end say nothing; they are not looked at again on this page.
            quoted, end = False, page.find(">", name.end())
            if end < 0:
                end = n
        tag = name[0].lower()
        yield None, tag, page[name.end() : end]
        at = end + 1
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = n if close is None else close.end()


_SLOT: dict[str, int] = {}


def _slot(name: str) -> int:
    if name not in _SLOT:
        h = 1469598103934665603
        for c in name.encode():
            h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        if len(_SLOT) > 100_000:
            _SLOT.clear()
        _SLOT[name] = (h ^ (h >> 29)) % FEATURES
    return _SLOT[name]


class Ancestors:
    """The open elements, with the sum of the weights of their distinct features.

    Every step costs what is opened or closed, whatever the depth.
    """

    def __init__(self, weights: list[tuple[int, int]] | None = None):
        self.weights, self.held, self.sum = weights, {}, [0, 0]
        self.stack: list[tuple] = []
        self.opened = 0
        self.open: dict[str, int] = {}
        self.inline: dict[str, int] = {}  # open since the last block element
        self.near: dict[str, int] = {}  # open since the last container
        self.key = self.home = 0  # of the open elements, and of those down to the last container

    def push(self, tag: str, slots) -> None:
        self.stack.append((tag, slots, self.inline, self.near, self.key, self.home))
        self.key = hash((self.key, tag, slots))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in INLINE:
            self.inline[tag] = self.inline.get(tag, 0) + 1
        else:
            self.inline = {}
        if tag in CONTAINERS:
            self.near, self.home = {}, self.marked()
        else:
            self.near[tag] = self.near.get(tag, 0) + 1
        for s in slots:
            n = self.held.get(s, 0)
            self.held[s] = n + 1
            if not n and self.weights:
                a, b = self.weights[s]
                self.sum[0] += a
                self.sum[1] += b

    def pop(self) -> str:
        tag, slots, self.inline, self.near, self.key, self.home = self.stack.pop()
        self.open[tag] -= 1
        if tag in INLINE:
            self.inline[tag] -= 1
        if tag not in CONTAINERS:
            self.near[tag] -= 1
        for s in slots:
            n = self.held.pop(s) - 1
            if n:
                self.held[s] = n
            elif self.weights:
                a, b = self.weights[s]
                self.sum[0] -= a
                self.sum[1] -= b
        return tag

    def marked(self) -> int:
        """A number for this very element: equal elements beside each other have different ones."""
        self.opened += 1
        return self.opened

    def close(self, tags) -> None:
        """End the innermost of `tags` and all that is open inside it."""
        while self.pop() not in tags:
            pass


def leaf_blocks(page: str, weights: list[tuple[int, int]] | None = None) -> list[tuple]:
    """(text, own tag, place, is mostly link, ancestors, container) of each block with text, in page order.

    `place` is equal for blocks of equal ancestors, the container for those of one element; ancestors are
    their slots, or with `weights` the sums of these.
    """
    up, blocks = Ancestors(weights), []
    parts, linked, length = [], 0, 0

    def end():
        nonlocal parts, linked, length
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((text, up.stack[-1][0] if up.stack else "", up.key, linked * 2 > length, tuple(up.sum) if weights else tuple(up.held), up.home))
            parts, linked, length = [], 0, 0

    for text, tag, attributes in pieces(page):
        if text is not None:
            parts.append(text)
            n = len(text.strip())
            length += n
            linked += n if up.open.get("a") else 0
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in INLINE:
                if up.inline.get(tag):
                    up.close((tag,))
                continue
            end()
            if up.open.get(tag):
                up.close((tag,))
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            end()
        if tag in VOID or tag in RAW:
            continue
        if tag not in INLINE:
            shuts = CLOSES.get(tag, ("p",))
            if any(up.near.get(t) for t in shuts):
                up.close(shuts)
        names = {tag}
        if attributes:
            for a in _ATTRIBUTE.findall(attributes):
                names.update(_TOKEN.findall("".join(a).lower()))
        up.push(tag, tuple(sorted({_slot(f"in:{x}") for x in names})))
    end()
    return blocks


def text_slots(blocks) -> list[list[int]]:
    """Feature slots of each block's own text and of its place among the blocks."""
    out, n = [], len(blocks)
    headed = next((b[5] for b in blocks if b[1] in ("h1", "h2")), None)
    last = max((k for k, b in enumerate(blocks) if b[5] == headed), default=-1)
    for k, (text, own, place, linked, _, home) in enumerate(blocks):
        words = text.count(" ") + 1
        talk = sum(w in TALK for w in _SPOKEN.findall(text.lower()))
        where = "none" if headed is None else "with" if home == headed else "past" if k > last else "before"
        names = (
            "bias",
            f"own:{own}",
            f"words:{min(8, words.bit_length())}",
            f"link:{linked}",
            f"stop:{text[-1] in '.!?…:;'}",
            f"at:{min(4, k)}",
            f"left:{min(4, n - 1 - k)}",
            f"upper:{text.isupper()}",
            f"digit:{text[:1].isdigit()}",
            f"mark:{'©' in text}",
            f"bar:{'|' in text}",
            f"commas:{min(3, text.count(','))}",
            f"same:{k > 0 and place == blocks[k - 1][2]}",
            f"talk:{min(3, talk)}",
            f"talks:{talk * 8 > words}",
            f"shout:{text.count('!') > 1 or '!!' in text}",
            f"heading:{where}",
            f"heading:{where}:talk:{min(2, talk)}",
            f"heading:{where}:words:{min(8, words.bit_length())}",
        )
        out.append([_slot(x) for x in names])
    return out


def chain_gradient(score: np.ndarray, trans: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of labels y by the scores (pages, blocks, 2) and by the transitions; `on` tells blocks from padding."""
    longest = on.shape[1]
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for t in range(1, longest):
        step = score[:, t] + np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1])
        alpha[:, t] = np.where(on[:, t, None], step, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        after = score[:, t + 1] + beta[:, t + 1]
        step = np.logaddexp(trans[:, 0][None] + after[:, :1], trans[:, 1][None] + after[:, 1:])
        beta[:, t] = np.where(on[:, t + 1, None], step, 0.0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    gap = (np.eye(2)[y] - np.exp(alpha + beta - total[:, None, None])) * on[:, :, None]
    pair, both = np.zeros((2, 2)), on[:, 1:]
    np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    for a in (0, 1):
        for b in (0, 1):
            e = alpha[:, :-1, a] + trans[a, b] + score[:, 1:, b] + beta[:, 1:, b] - total[:, None]
            pair[a, b] -= np.exp(np.where(both, e, -np.inf)).sum()
    return gap, pair


def train(pages: list[tuple[list, list[int]]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights (features, 2), transitions (2, 2)) that maximise the likelihood of pages of (blocks, labels)."""
    rng, w, trans = np.random.default_rng(seed), np.zeros((FEATURES, 2)), np.zeros((2, 2))
    pages = [p for p in pages if p[1]]
    if not pages:
        return w, trans
    longest = max(len(y) for _, y in pages)
    y, on = np.zeros((len(pages), longest), dtype=np.int64), np.zeros((len(pages), longest), dtype=bool)
    cell, slot, above, page = [], [], [], []
    for k, (blocks, label) in enumerate(pages):
        y[k, : len(label)], on[k, : len(label)] = label, True
        for t, (block, own) in enumerate(zip(blocks, text_slots(blocks))):
            for more, up in ((block[4], True), (own, False)):
                cell += [k * longest + t] * len(more)
                slot += more
                above += [up] * len(more)
                page += [k] * len(more)
    cell, slot, above, page = np.array(cell), np.array(slot), np.array(above), np.array(page)
    gw, gt = np.full_like(w, 1e-8), np.full_like(trans, 1e-8)
    for _ in range(ROUNDS):
        blank = rng.random(len(pages)) < BLANK
        use = ~(above & blank[page])
        c, s = cell[use], slot[use]
        score = np.stack([np.bincount(c, weights=w[s, k], minlength=on.size) for k in (0, 1)], axis=1).reshape(*on.shape, 2)
        gap, pair = chain_gradient(score, trans, y, on)
        gap = gap.reshape(-1, 2)
        grad = np.stack([np.bincount(s, weights=gap[c, k], minlength=FEATURES) for k in (0, 1)], axis=1)
        grad, pair = grad / len(pages) - DECAY * w, pair / len(pages) - DECAY * trans
        gw += grad**2
        gt += pair**2
        w += RATE * grad / np.sqrt(gw)
        trans += RATE * pair / np.sqrt(gt)
    return w, trans


def viterbi(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label of each block."""
    n = len(score)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    back, best = np.zeros((n, 2), dtype=np.int64), score[0]
    for t in range(1, n):
        step = best[:, None] + trans
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + score[t]
    out = np.empty(n, dtype=np.int64)
    out[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


class Extractor:
    """Chain weights, ready to extract pages."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.trans, self.text = trans, w
        self.above = [tuple(x) for x in np.round(w * UNIT).astype(np.int64).tolist()]

    def labels(self, page: str) -> list[tuple[str, int]]:
        blocks = leaf_blocks(page, self.above)
        if not blocks:
            return []
        own = np.array(text_slots(blocks))
        score = self.text[own].sum(axis=1) + np.array([b[4] for b in blocks]) / UNIT
        return [(b[0], int(y)) for b, y in zip(blocks, viterbi(score, self.trans))]

    def main_text(self, page: str | None) -> str:
        return "\n\n".join(text for text, y in self.labels(page) if y) if page else ""


def fit(labelled: DataFrame | None = None, train_pages: int = TRAIN_PAGES) -> Extractor:
    """The chain of labelled pages (html string, labels array<int>), or of those made by rule."""
    if labelled is None:
        rows = labelled_pages()
    else:
        chosen = labelled.where("html IS NOT NULL AND labels IS NOT NULL").orderBy(F.xxhash64("html"), "html").limit(train_pages)
        rows = [(r.html, list(r.labels)) for r in chosen.select("html", "labels").toLocalIterator()]
    pages = [(leaf_blocks(page), label) for page, label in rows]
    for blocks, label in pages:
        if len(blocks) != len(label):
            raise ValueError(f"a page of {len(blocks)} leaf blocks has {len(label)} labels")
    return Extractor(*train(pages))


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", model: Extractor | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text): blocks labelled as main text, joined by blank lines."""
    at = pages.sparkSession.sparkContext.broadcast(model or fit(labelled))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = [at.value.main_text(page) for page in part.column("h").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("u"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    source = pages.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{url}` AS STRING) AS u", f"CAST(`{html}` AS STRING) AS h")
    return source.mapInArrow(run, "page_id long, url string, text string")
