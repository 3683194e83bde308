"""Operator 7: removing long repeated passages by recompression.

A text is a sequence of word fingerprints.  In each round, maximal runs of one symbol become
one symbol, and then every pair of a left symbol and a right symbol (the side of a symbol is
a hashed bit of its round) becomes one symbol.  Names are 64-bit fingerprints of what they
stand for, so all tasks name equal runs and pairs alike without a shared dictionary.  With
each symbol goes its context, the words that its making depended on.  A symbol whose context
lies inside a window is made in the same way wherever the window's words occur, so equal
windows hold the same such interior symbols.

A window of `window` words is represented by its least and its greatest interior symbol, or by
its own fingerprint if it has none (inside a long run).  Spark finds the representatives that two
documents share; only windows of which both are shared are then verified, by fingerprints
of all their words, against the smallest document that holds them.

Defined cases: a null text has no words; texts shorter than a window lose nothing; documents
of equal words count as one class, whose larger ids lose all words if there is a window;
rows of a null doc_id are kept whole; extra columns are ignored; an empty table gives no
rows.  doc_id is the key: rows that repeat an id must repeat the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .words import U, mix, row_words, windows

WINDOW = 50
ROUNDS = 4
FAR = 1 << 40
#: Words handled together inside a task.
SLICE_WORDS = 1 << 18


def recompress(word: np.ndarray, edge: np.ndarray, rounds: int = ROUNDS):
    """(names, context starts, context ends) of the symbols left after some rounds.

    `edge` marks separators between documents: they never merge and no context crosses them.
    """
    name, start, end, fixed = word.copy(), np.arange(len(word)), np.arange(1, len(word) + 1), edge.copy()
    start[edge], end[edge] = -FAR, FAR
    for r in range(rounds):
        # Runs: the symbols next to a run decide where it ends.
        same = (name[1:] == name[:-1]) & ~fixed[1:] & ~fixed[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        size = np.diff(np.concatenate((first, [len(name)])))
        left, right = _shifted(start, end)
        lo = np.minimum(np.minimum.reduceat(start, first), np.minimum(left[0][first], right[0][first + size - 1]))
        hi = np.maximum(np.maximum.reduceat(end, first), np.maximum(left[1][first], right[1][first + size - 1]))
        name = np.where(size > 1, mix(name[first] ^ mix(size.astype(U), 900 + r), 901 + r), name[first])
        start, end, fixed = np.where(fixed[first], start[first], lo), np.where(fixed[first], end[first], hi), fixed[first]
        # Pairs: a left symbol before a right one always merges.
        side = (mix(name.copy(), 700 + r) & U(1)).astype(bool)
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = ~side[:-1] & side[1:] & ~fixed[:-1] & ~fixed[1:]
        second = np.concatenate(([False], joins[:-1]))
        # A symbol left alone depends on the neighbour that it did not merge with.
        left, right = _shifted(start, end)
        alone_lo = np.minimum(start, np.where(side, left[0], right[0]))
        alone_hi = np.maximum(end, np.where(side, left[1], right[1]))
        partner = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
        new_name = np.where(joins, mix(name * U(0x9E3779B97F4A7C15) ^ name[partner], 702 + r), name)
        new_lo = np.where(joins, np.minimum(start, start[partner]), np.where(fixed, start, alone_lo))
        new_hi = np.where(joins, np.maximum(end, end[partner]), np.where(fixed, end, alone_hi))
        keep = ~second
        name, start, end, fixed = new_name[keep], new_lo[keep], new_hi[keep], fixed[keep]
    return name[~fixed], start[~fixed], end[~fixed]


def _shifted(lo: np.ndarray, hi: np.ndarray):
    """Contexts of the symbols on the left and on the right; the ends of all lie outside."""
    left = np.concatenate(([-FAR], lo[:-1])), np.concatenate(([FAR], hi[:-1]))
    right = np.concatenate((lo[1:], [-FAR])), np.concatenate((hi[1:], [FAR]))
    return left, right


def _laid(best, n: int, name: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """The least or greatest name over each of n places, names lying on intervals [a, b) of at most `longest` places.

    An interval is two blocks of the largest power of two in it; blocks hand on to their halves.
    """
    none = U(0) if best is np.maximum else ~U(0)
    size = b - a
    level = int(longest).bit_length() - 1
    above = np.full(n, none, dtype=U)
    while True:
        width = 1 << level
        mine = (size >= width) & (size < 2 * width)
        best.at(above, a[mine], name[mine])
        best.at(above, b[mine] - width, name[mine])
        if level == 0:
            return above
        level -= 1
        below = above.copy()
        half = 1 << level
        below[half:] = best(below[half:], above[: n - half] if n > half else above[:0])
        above = below


def representatives(docs: list[np.ndarray], window: int = WINDOW):
    """For documents of word fingerprints: both representatives and the fingerprint of each window."""
    sep = np.array([0], dtype=U)
    flat = np.concatenate([x for d in docs for x in (sep, d)] + [sep])
    edge = np.zeros(len(flat), dtype=bool)
    at = np.cumsum([0] + [len(d) + 1 for d in docs])
    edge[at] = True
    name, lo, hi = recompress(flat, edge)
    own = windows(flat, window)
    inside = (lo >= 0) & (hi <= len(flat)) & (hi - lo <= window)
    name, a, b = name[inside], np.maximum(hi[inside] - window, 0), np.minimum(lo[inside] + 1, len(own))
    some = b > a
    name, a, b = name[some], a[some], b[some]
    low = _laid(np.minimum, len(own), name, a, b, window)
    high = _laid(np.maximum, len(own), name, a, b, window)
    bare = low > high  # no interior symbol
    low[bare] = high[bare] = mix(own[bare], 55)
    for k, d in enumerate(docs):
        part = slice(at[k] + 1, at[k] + 1 + max(0, len(d) - window + 1))
        yield low[part], high[part], own[part]


def _slices(batch, window):
    """Yield lists of (row, word fingerprints) of rows that have a window."""
    held, size = [], 0
    for row, h, *_ in row_words(batch.column("t")):
        if len(h) >= window:
            held.append((row, h))
            size += len(h)
            if size > SLICE_WORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def passages(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, d1, d2, names): digest of the word sequence and distinct representatives."""

    def run(batches):
        for batch in batches:
            for held in _slices(batch, window):
                rows = [r for r, _ in held]
                digest = [
                    np.array([(mix(h.copy(), s) * mix(np.arange(len(h), dtype=U), s + 1)).sum(dtype=U) for _, h in held], dtype=U).view(np.int64)
                    for s in (201, 203)
                ]
                names = [np.unique(np.concatenate((low, high))).view(np.int64) for low, high, _ in representatives([h for _, h in held], window)]
                offsets = np.cumsum([0] + [len(x) for x in names], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(pa.array(rows)), *map(pa.array, digest), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(names)))],
                    names=["doc_id", "d1", "d2", "names"],
                )

    return docs.mapInArrow(run, "doc_id long, d1 long, d2 long, names array<long>")


def shared_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, at, w): position and fingerprint of windows whose representatives are both in `shared`."""

    def run(batches):
        for batch in batches:
            lists = batch.column("shared")
            for held in _slices(batch, window):
                for (row, _), (low, high, own) in zip(held, representatives([h for _, h in held], window)):
                    wanted = np.asarray(lists[row].values, dtype=np.int64).view(U)
                    at = np.flatnonzero(np.isin(low, wanted) & np.isin(high, wanted))
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), batch.column("k")[row].as_py(), dtype=np.int64)), pa.array(at.astype(np.int32)), pa.array(own[at].view(np.int64))],
                            names=["doc_id", "at", "w"],
                        )

    return docs.mapInArrow(run, "doc_id long, at int, w long")


def _removed(n: int, at, window: int) -> np.ndarray:
    delta = np.zeros(n + 1, dtype=np.int32)
    at = np.asarray(at, dtype=np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, np.minimum(at + window, n), -1)
    return np.cumsum(delta[:-1]) > 0


def strip_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words left, joined by one blank."""
    source = docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t")
    # Both joins with texts below take this same input, so Spark deals texts once and reads that shuffle twice.
    keyed = source.where("k IS NOT NULL")
    found = save(passages(keyed, window), "passages")
    same = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = found.join(same, ["d1", "d2"]).where("doc_id > first").select(F.col("doc_id").alias("k")).distinct()
    copies = save(copies, "copies")
    names = found.join(copies, found.doc_id == copies.k, "left_anti").select("doc_id", F.explode("names").alias("name"))
    names = names.where("name IS NOT NULL AND doc_id IS NOT NULL").repartition("name")  # one shuffle for the sums and the join
    shared = names.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("name")
    wanted = names.join(shared, "name").groupBy(F.col("doc_id").alias("k")).agg(F.collect_set("name").alias("shared"))
    # Dealt by window once: the sums and the join below ask for the same columns and rows, and read that one shuffle.
    held = shared_windows(keyed.join(wanted, "k"), window).where("w IS NOT NULL AND doc_id IS NOT NULL").repartition("w")
    # The test of `from` always holds: it makes the sums read the join's columns, so that both read one shuffle.
    ends = held.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("at").alias("from"))
    least = ends.where("lo < hi AND from >= 0").select("w", "lo")
    cut = held.join(least, "w").where("doc_id > lo").groupBy(F.col("doc_id").alias("k")).agg(F.collect_set("at").alias("at"))
    marks = cut.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("at", F.lit(None).cast("array<int>")).withColumn("copy", F.lit(True)))

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            cols = [batch.column(c) for c in ("k", "t", "at", "copy")]
            for i in range(batch.num_rows):
                k, t, at, copy = cols[0][i].as_py(), cols[1][i], cols[2][i], cols[3][i].as_py()
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                n = len(words)
                if copy:
                    words = []
                elif at.is_valid:
                    gone = _removed(n, at.values, window)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((k, n, n - len(words), b" ".join(words)))
                size += len(rows[-1][3])
                if size > 4 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, ty) for x, ty in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                        names=["doc_id", "n_words", "n_removed", "kept"],
                    )
                    rows, size = [], 0

    unkeyed = source.where("k IS NULL").selectExpr("k", "t", "CAST(NULL AS ARRAY<INT>) AS at", "CAST(NULL AS BOOLEAN) AS copy")
    marked = keyed.join(marks, "k", "left").select("k", "t", "at", "copy").unionByName(unkeyed)
    out = marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
