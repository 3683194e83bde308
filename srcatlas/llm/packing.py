"""Operator 9: sum-of-squares online packing of documents into fixed windows.

Each input partition packs its own documents in scan order, so nothing is shuffled, a lost
task is redone alone and gives the same sequences, and no counter is shared.  A document's
full windows go out at once; its remainder is placed into the fill level that minimises the
sum of squared counts of partly filled windows.  A level spans a `LEVELS`-th of a window: with
a level for every single token most windows would never meet their match.  A piece may run
over the end of a window by less than a level; it is then cut there, the window goes out full,
and what is left over is placed as a piece of its own.  So only the windows still open at the
end of a partition, about two for each level, are poured together and cut anew, which leaves at
most one short sequence per partition, padded to a power of two.

Defined cases: a null text is an empty document of the end id alone; a null doc_id is carried
through; repeated rows are packed each on their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encode_rows

WINDOW = 2048
LEVELS = 16
#: Sequence ids of one partition lie below this distance from the next partition's.
PARTITION_STRIDE = 1 << 40

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, padded_length long"
)


class SumOfSquares:
    """Level array of open windows; `level[h]` stacks (fill, items) of windows whose fill lies in the h-th span."""

    def __init__(self, window: int, levels: int = LEVELS):
        self.window, self.span = window, max(1, -(-window // levels))
        self.level: list[list[tuple[int, list]]] = [[] for _ in range(-(-window // self.span))]

    def choose(self, size: int) -> int:
        """The level whose last window takes a piece of `size` at the least sum of squares; -1 for a new window.

        A window that leaves level h lowers the sum by 2 * count - 1, and raises that of the level it
        comes to by 2 * count + 1; a window that is full counts nowhere.  Of equal levels the fullest wins,
        and an open window before a new one.
        """
        level, span, window = self.level, self.span, self.window
        best, gain = -1, 2 * len(level[size // span]) + 1
        for h, held in enumerate(level):
            if not held:
                continue
            fill = held[-1][0] + size
            if fill >= window + span:
                break
            to = fill // span
            change = 1 - 2 * len(held)
            if fill < window:
                change = 0 if to == h else change + 2 * len(level[to]) + 1
            if change <= gain:
                best, gain = h, change
        return best

    def place(self, key, start: int, ids: bytes, total: int):
        """Put a piece of less than a window; yields the items of each window that it fills."""
        while ids:
            size = len(ids) // 4
            h = self.choose(size)
            fill, items = self.level[h].pop() if h >= 0 else (0, [])
            take = min(size, self.window - fill)
            items.append((key, start, ids[: 4 * take], total))
            if fill + take == self.window:
                yield items
            else:
                self.level[(fill + take) // self.span].append((fill + take, items))
            start, ids = start + take, ids[4 * take :]

    def rest(self) -> list[list]:
        """The items of the open windows, fullest first."""
        return [items for held in reversed(self.level) for _, items in sorted(held, key=lambda x: -x[0])]


def pack_stream(documents, window: int = WINDOW):
    """Yield (sequence, offset, padded length, doc key, start, ids, doc tokens) for (key, id bytes) pairs."""
    packer, sequence = SumOfSquares(window), 0

    def laid(items, padded):
        offset = 0
        for key, start, ids, total in items:
            yield sequence, offset, padded, key, start, ids, total
            offset += len(ids) // 4

    for key, ids in documents:
        total = len(ids) // 4
        full = total - total % window
        for at in range(0, full, window):
            yield from laid([(key, at, ids[4 * at : 4 * (at + window)], total)], window)
            sequence += 1
        if total > full:
            for done in packer.place(key, full, ids[4 * full :], total):
                yield from laid(done, window)
                sequence += 1
    current, filled = [], 0
    for key, start, ids, total in (x for items in packer.rest() for x in items):
        while ids:
            take = min(window - filled, len(ids) // 4)
            current.append((key, start, ids[: 4 * take], total))
            filled, start, ids = filled + take, start + take, ids[4 * take :]
            if filled == window:
                yield from laid(current, window)
                sequence, current, filled = sequence + 1, [], 0
    if current:
        yield from laid(current, min(window, 1 << (filled - 1).bit_length()))


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Pieces of token sequences: `ids` are little-endian unsigned 32-bit token ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        base = TaskContext.get().partitionId() * PARTITION_STRIDE

        def documents():
            for batch in batches:
                keys = batch.column("k").to_pylist()
                for at, encoded in encode_rows(batch, "t", tokenizer):
                    for k, ids in zip(keys[at:], encoded):
                        yield k, ids + end

        rows: list[tuple] = []
        size = 0

        def flush():
            seq, off, pad, k, start, ids, total = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(k, pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(total, pa.int64()),
                    pa.array([base + x for x in seq], pa.int64()),
                    pa.array(off, pa.int64()),
                    pa.array(pad, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"],
            )

        for row in pack_stream(documents(), window):
            rows.append(row)
            size += len(row[5])
            if size > 4 << 20:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t").mapInArrow(run, PIECES)
