"""Operator 3: secret scan with a random forest that removes false positives.

A scan proposes candidates: vendor key shapes, private key blocks, values given to names of any
length that hold a word such as token or password (to the end of their quotes, or to white space),
what such a word is said to be ("the password is ..."), passwords in addresses (user:pass@host), and
any long unbroken run of letters, digits and key marks.  Each is
described by its length, its character transitions (mean log probability under the transitions
of all texts), entropy, the share of it that the corpus's most frequent words cover, its
character kinds, the words beside it and its path.  Spark's random forest, trained on labelled
findings, keeps or drops it; its trees are applied inside the scan, so that texts are never
shuffled.

Labelled findings are those given as a table (text, start, length, path, label), at most
`LABELS` of them, those of the least hashes, or by default `labelled_findings`, which are made
by rule, with `hand_findings`, which were written and labelled by hand.  Word and transition counts are summed over all documents by Spark; what is broadcast
has a fixed size: a table of 256 x 256 transitions, `DICTIONARY` words and the trees.

Defined cases: null and empty texts have no findings; null doc_ids are carried; each repeated
row yields its own findings; without a path column all paths are empty; extra columns are ignored
by `find_secrets` and kept by `redact_secrets`; an empty table gives no rows; overlapping
candidates count once, by shape first, then by name; names and values have no length limit.  A value
without quotes ends at white space, at a quote or angle bracket, or before `,name=`.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .hand_findings import hand_findings
from .labelled_findings import labelled_findings
from .words import row_words

LABELS = 20_000
TREES, DEPTH = 32, 10
#: How often each finding labelled by hand stands among those made by rule.
HAND = 8
DICTIONARY = 5000
#: Numbers that the words before and behind a candidate are hashed to.
BEFORE, BEHIND = 24, 8
REPLACEMENT = "[SECRET]"

_SHAPES = (
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s+[A-Za-z0-9+/=]{20,})+)?"),
)
_NAMES = "token|secret|passwd|password|passphrase|pwd|api[_-]?key|access[_-]?key|auth[_-]?token|credential|private[_-]?key"
_NAMED = re.compile(_NAMES, re.I)
#: A name of any length with the mark that gives it a value; runs are taken whole, so that no text is looked at twice.
_ASSIGNED = re.compile(r"(?<![\w.\-])(?P<name>[\w.\-]++)[\"']?[ \t]*+(?:=>|:=|=|:)[ \t]*+")
_SAID = re.compile(rf"(?i)\b(?:{_NAMES}|api key|access key)\s++(?:is|was)\s*+:?\s*+|\b(?:use|with)\s++(?:the\s++)?(?:{_NAMES})\s++")
_IN_URL = re.compile(r"://[^\s/:@\"'<>]*+:(?P<value>[^\s/@\"'<>]++)@")
_QUOTED = re.compile(r"\"(?P<double>(?:[^\"\\\n]|\\.)++)\"|'(?P<single>(?:[^'\\\n]|\\.)++)'")
#: A value without quotes runs to white space, a quote or an angle bracket, or to the next name with a value.
_BARE = re.compile(r"<[^<>\s]++>|[^\s\"'<>]++")
_NEXT = re.compile(r"[,;&](?=[\w.\-]+[=:])")
_SHAPED = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _SHAPES))
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=@.\-])[A-Za-z0-9+/_\-]{20,}+={0,2}(?![A-Za-z0-9@])")
#: What every candidate needs; texts without it are passed over at once.
QUICK = r"(?i)AKIA|ASIA|gh[pousr]_|xox|k_live|k_test|eyJ|PRIVATE KEY|token|secret|pass|pwd|key|auth|credential|://|[A-Za-z0-9+/_\-]{20}"
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|\*{3}|test|^none$|^null$|^true$|^false$|\$\{|^<")
_URL = re.compile(r"(?i)https?:|www\.|\.com|\.org|/[a-z]+/")
KINDS = [n for n, _ in _SHAPES] + ["keyed", "said", "url", "long"]


class CorpusModel:
    """Character transitions and common words of all texts."""

    def __init__(self, transitions: np.ndarray, common: set[str]):
        self.common = common
        self.log = np.log((transitions + 0.5) / (transitions.sum(axis=1, keepdims=True) + 40))

    def transitions(self, value: str) -> float:
        low = np.frombuffer(value.lower().encode(), dtype=np.uint8)
        return float(self.log[low[:-1], low[1:]].mean()) if len(low) > 1 else 0.0

    def coverage(self, value: str) -> float:
        low, covered, k = value.lower(), 0, 0
        while k < len(low):
            n = next((n for n in range(min(16, len(low) - k), 2, -1) if low[k : k + n] in self.common), 0)
            covered, k = covered + n, k + max(1, n)
        return covered / max(1, len(low))


def corpus_model(docs: DataFrame) -> CorpusModel:
    """The model of all texts of `docs` (column t): one scan and one sum."""

    def run(batches):
        for batch in batches:
            pairs, held, spans, size = np.zeros(1 << 16, dtype=np.int64), [], [], 0
            for row, h, start, end, data in row_words(batch.column("t"), fold_case=True):
                low = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
                if len(low) > 1:
                    pairs += np.bincount(low[:-1].astype(np.int64) << 8 | low[1:], minlength=1 << 16)
                held.append(h)
                spans.append((data, start, end))
                size += len(h)
                if size > 1 << 19 or row + 1 == batch.num_rows:
                    _, at, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
                    first = np.cumsum([0] + [len(x) for x in held])
                    doc = np.searchsorted(first, at, side="right") - 1
                    words, times = [], []
                    for d, k, c in zip(doc.tolist(), (at - first[doc]).tolist(), n.tolist()):
                        text, a, b = spans[d]
                        if 2 < b[k] - a[k] < 32:
                            word = text[a[k] : b[k]].tobytes().decode("utf-8", "replace").lower()
                            if word.isalpha() and 2 < len(word) <= 16:
                                words.append(word)
                                times.append(c)
                    some = np.flatnonzero(pairs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([*words, *[None] * len(some)], pa.string()), pa.array([*[None] * len(words), *some.tolist()], pa.int32()), pa.array([*times, *pairs[some].tolist()], pa.int64())],
                        names=["word", "pair", "n"],
                    )
                    pairs[:], held, spans, size = 0, [], [], 0

    counts = save(docs.select("t").mapInArrow(run, "word string, pair int, n long").groupBy("word", "pair").agg(F.sum("n").alias("n")), "words")
    common = {r.word for r in counts.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()}
    table = np.zeros(1 << 16)
    for r in counts.where("pair IS NOT NULL").collect():  # at most 256 * 256 rows
        table[r.pair] = r.n
    return CorpusModel(table.reshape(256, 256), common)


def _value(text: str, at: int) -> tuple[int, int] | None:
    """The span of the value at a place: all within its quotes, or a run without the marks that end a sentence."""
    if quoted := _QUOTED.match(text, at):
        return quoted.span(quoted.lastgroup)
    bare = _BARE.match(text, at + (text[at : at + 1] in "\"'"))
    if bare is None:
        return None
    start, end = bare.span()
    if cut := _NEXT.search(text, start, end):
        end = cut.start()
    while end > start and text[end - 1] in ".,;:)]}`":
        end -= 1
    return (start, end) if end > start else None


def candidates(text: str):
    """(start, end, kind) of what might be a secret, in order and without overlaps.

    Known shapes come before values of telling names, those before values that are spoken of and those in
    addresses, and all before long runs of characters; the name of a value is no candidate itself.
    """
    found = [(*m.span(), m.lastgroup, m.start()) for m in _SHAPED.finditer(text)]
    for m in _ASSIGNED.finditer(text):
        if _NAMED.search(m["name"]) and (span := _value(text, m.end())):
            found.append((*span, "keyed", m.start()))
    found += [(*span, "said", m.start()) for m in _SAID.finditer(text) if (span := _value(text, m.end()))]
    found += [(*m.span("value"), "url", m.start()) for m in _IN_URL.finditer(text)]
    found += [(*m.span(), "long", m.start()) for m in _LONG.finditer(text)]
    # Each keeps the place from where its name begins, if no kind before it has taken some of that.
    taken: list[tuple[int, int]] = []
    out = []
    for kinds in (KINDS[: len(_SHAPES)], ["keyed"], ["said"], ["url"], ["long"]):
        more = []
        for start, end, kind, name in found:
            if kind not in kinds:
                continue
            k = bisect_right(taken, (start, len(text))) - 1
            if (k >= 0 and taken[k][1] > start) or (k + 1 < len(taken) and taken[k + 1][0] < end) or (more and more[-1][1] > start):
                continue
            out.append((start, end, kind))
            more.append((min(name, start), end))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(taken + more):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        taken = merged
    return sorted(out)


def _beside(word: list[str], n: int) -> int:
    """The number that a word beside a candidate is hashed to; -1 for none."""
    return zlib.crc32(word[0].lower().encode()) % n if word else -1


def describe(text: str, start: int, end: int, kind: str, path: str, model: CorpusModel) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    n, count = len(value), Counter(value)
    share = lambda f: sum(map(f, value)) / n
    sort = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    word_before = _beside(re.findall(r"([A-Za-z][\w-]*)\W*$", before), BEFORE)
    word_behind = _beside(re.findall(r"^\W*([A-Za-z][\w-]*)", after), BEHIND)
    return [
        n,
        model.transitions(value),
        -sum(c / n * math.log2(c / n) for c in count.values()),
        model.coverage(value),
        share(str.isdigit),
        share(str.isupper),
        share(str.islower),
        share(lambda c: c in "0123456789abcdef"),
        share(lambda c: not c.isalnum()),
        sum(a != b for a, b in zip(sort, sort[1:])) / n,
        float(bool(_NAMED.search(before))),
        float(bool(re.search(r"[=:]\s{0,3}[\"']?$", before))),
        float(value.isalpha() and (value.islower() or value.istitle())),
        float(" " in value),
        float(bool(re.search(r"[A-Za-z]", value) and re.search(r"[0-9]", value))),
        float(bool(re.search(r"[!#$%&*+?^~]", value))),
        float("(" in value or "[" in value or value.startswith(("/", "./", "$", "<", "{"))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)),
        model.coverage(before[-16:]),
        model.coverage(after[:16]),
        float(bool(_PLACEHOLDER.search(value))),
        float(bool(_URL.search(before[-12:] + value))),
        float(bool(re.search(r"(?i)test|example|sample|doc|lock", path))),
        *[float(KINDS.index(kind) == k) for k in range(len(KINDS))],
        *[float(word_before == k) for k in range(BEFORE)],
        *[float(word_behind == k) for k in range(BEHIND)],
    ]


class Forest:
    """The trees of a fitted random forest as arrays."""

    def __init__(self, model):
        self.trees = []
        for tree in model.trees:
            nodes: list[list] = []

            def walk(node):
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, 0.0])
                if node.numDescendants() == 0:
                    stats = node.impurityStats().stats()
                    total = sum(stats) or 1.0
                    nodes[at][4] = stats[1] / total if len(stats) > 1 else 0.0
                else:
                    split = node.split()
                    nodes[at][:2] = split.featureIndex(), split.threshold()
                    nodes[at][2] = walk(node.leftChild())
                    nodes[at][3] = walk(node.rightChild())
                return at

            walk(tree._java_obj.rootNode())
            self.trees.append([np.array(c) for c in zip(*nodes)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row falls into."""
        out = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                down = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(down, left[at], right[at]), at)
            out += value[at]
        return out / max(1, len(self.trees))


class Scanner:
    """Corpus model and forest: finds the secrets of a text."""

    def __init__(self, corpus: CorpusModel, forest: Forest):
        self.corpus, self.forest = corpus, forest

    def find(self, text: str, path: str):
        found = list(candidates(text))
        if not found:
            return []
        score = self.forest.scores(np.array([describe(text, *f, path, self.corpus) for f in found]))
        return [(*f, float(s)) for f, s in zip(found, score) if s >= 0.5]


def labelled_features(rows, corpus: CorpusModel):
    """(features, label) of the candidates that lie on a labelled finding (text, start, length, path, label)."""
    for text, start, length, path, label in rows:
        for a, b, kind in candidates(text):
            if a < start + length and b > start:
                yield describe(text, a, b, kind, path or "", corpus), int(label)


def fit_scanner(docs: DataFrame, text: str = "text", labels: DataFrame | None = None) -> Scanner:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    corpus = corpus_model(docs.select(F.col(f"`{text}`").cast("string").alias("t")))
    if labels is None:
        rows = labelled_findings() + hand_findings() * HAND
    else:
        columns = ["text", "start", "length", "path", "label"]
        rows = labels.where("text IS NOT NULL AND label IN (0, 1)").orderBy(F.xxhash64("text", "start"), "text", "start").limit(LABELS).select(*columns).toLocalIterator()
    findings = list(labelled_features(rows, corpus))
    weight = {y: len(findings) / max(1, sum(1 for _, z in findings if z == y)) for y in (0, 1)}
    if min(sum(1 for _, z in findings if z == y) for y in (0, 1)) == 0:
        raise ValueError("labelled findings must hold secrets and look-alikes that the scan proposes")
    frame = docs.sparkSession.createDataFrame([(Vectors.dense(x), float(y), weight[y]) for x, y in findings], ["features", "label", "weight"]).coalesce(2)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, weightCol="weight", minInstancesPerNode=2)
    return Scanner(corpus, Forest(forest.fit(frame)))


def _source(docs: DataFrame, text: str, path: str, key: str) -> DataFrame:
    place = F.col(f"`{path}`").cast("string") if path in docs.columns else F.lit("")
    return docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.coalesce(place, F.lit("")).alias("p"))


FINDINGS = "doc_id long, start long, length long, kind string, secret string, score double"


def find_secrets(
    docs: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id", scanner: Scanner | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """One row per secret: doc_id, start and length in code points, kind, secret, score."""
    at = docs.sparkSession.sparkContext.broadcast(scanner or fit_scanner(docs, text, labels))

    def run(batches):
        for batch in batches:
            keys, texts, paths = (batch.column(c) for c in ("k", "t", "p"))
            rows = []
            for i in range(batch.num_rows):
                t = texts[i].as_py()
                for start, end, kind, score in at.value.find(t, paths[i].as_py()):
                    rows.append((keys[i].as_py(), start, end - start, kind, t[start:end], score))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=["doc_id", "start", "length", "kind", "secret", "score"])

    return _source(docs, text, path, key).where(F.col("t").rlike(QUICK)).mapInArrow(run, FINDINGS)


def redact_secrets(
    docs: DataFrame, text: str = "text", path: str = "source", scanner: Scanner | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """All documents with all their columns, each secret replaced by `REPLACEMENT`."""
    at = docs.sparkSession.sparkContext.broadcast(scanner or fit_scanner(docs, text, labels))

    @F.pandas_udf("string")
    def clean(texts, paths):
        import pandas as pd

        out = []
        for t, p in zip(texts, paths):
            for start, end, *_ in reversed(at.value.find(t, p or "")) if t else ():
                t = t[:start] + REPLACEMENT + t[end:]
            out.append(t)
        return pd.Series(out, dtype=object)

    place = F.col(f"`{path}`").cast("string") if path in docs.columns else F.lit("")
    return docs.withColumn(text, clean(F.col(f"`{text}`").cast("string"), place))
