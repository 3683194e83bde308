"""Splitting large texts into overlapping chunks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices

SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters of chunks handed back to Spark at once.
FLUSH = 2 << 20


def base_spans(text: str, limit: int, start: int = 0, stop: int | None = None, level: int = 0):
    """Yield (start, stop) of pieces of at most `limit` characters, end to end.

    Parts between separators are packed while they fit.  A part that is too long by itself closes
    the piece before it and is split by the next separator on its own: its pieces never merge
    with what stands before or behind it.
    """
    stop = len(text) if stop is None else stop
    separator = SEPARATORS[level]
    if stop - start <= limit or not separator:
        for at in range(start, stop, limit):
            yield at, min(at + limit, stop)
        return
    open_, at = start, start
    while at < stop:
        found = text.find(separator, at, stop)
        end = stop if found < 0 else found + len(separator)
        if end - open_ > limit and at > open_:
            yield open_, at
            open_ = at
        if end - at > limit:
            yield from base_spans(text, limit, at, end, level + 1)
            open_ = end
        at = end
    if open_ < stop:
        yield open_, stop


def chunk_spans(text: str, size: int = 150_000, overlap: int = 8_000) -> list[tuple[int, int]]:
    """(start, stop) of each chunk; each after the first begins with the tail of the piece before it."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if len(text) <= size:
        return [(0, len(text))]
    base = list(base_spans(text, size - overlap))
    return base[:1] + [(max(before, start - overlap), stop) for (before, _), (start, stop) in zip(base, base[1:])]


def split_text(text: str, size: int = 150_000, overlap: int = 8_000) -> list[str]:
    return [text[a:b] for a, b in chunk_spans(text, size, overlap)]


def line_offsets(text: str, chunks: Iterable[str]) -> list[int]:
    """Lines before each chunk, by searching it from half a chunk behind the last find: repeated text may give an earlier line."""
    ends, cursor, out = [m.start() for m in re.finditer("\n", text)], 0, []
    for body in chunks:
        at = text.find(body, cursor)
        if at < 0:
            at = text.find(body)
        if at >= 0:
            cursor = at + max(1, len(body) // 2)
        out.append(bisect_left(ends, max(at, 0)))
    return out


CHUNKS = "repo_id string, rel_path string, chunk_index int, chunks int, body string, line_offset int, char_start int"


def chunk_files(files: DataFrame, size: int = 150_000, overlap: int = 8_000) -> DataFrame:
    """Chunks of each file; texts that fit stay in Spark, only longer ones go to Python."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    short = files.where(F.length("text") <= size).select(
        "repo_id", "rel_path", F.lit(0).alias("chunk_index"), F.lit(1).alias("chunks"), F.col("text").alias("body"), F.lit(0).alias("line_offset"), F.lit(0).alias("char_start")
    )

    def run(batches):
        import pyarrow as pa

        string, number = pa.string(), pa.int32()
        types = [string, string, number, number, string, number, number]
        names = CHUNKS.replace(",", "").split()[::2]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                rows, held = [], 0
                for repo, path, text in zip(*(part.column(c).to_pylist() for c in ("repo_id", "rel_path", "text"))):
                    spans = chunk_spans(text, size, overlap)
                    for k, ((a, b), line) in enumerate(zip(spans, line_offsets(text, (text[a:b] for a, b in spans)))):
                        rows.append((repo, path, k, len(spans), text[a:b], line, a))
                        held += b - a
                        if held > FLUSH:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    long = files.where(F.length("text") > size).select("repo_id", "rel_path", "text").mapInArrow(run, CHUNKS)
    return short.unionByName(long)
