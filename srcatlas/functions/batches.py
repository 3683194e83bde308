"""Parts of Arrow batches that bound what a Python worker holds."""

from __future__ import annotations

#: Bytes of texts turned into Python strings at once, unless a single one is longer.
SLICE = 2 << 20


def slices(batch, text: str, size: int = SLICE):
    """Yield the batch in order as parts without copies: each holds rows with up to `size` bytes of `text`, or one row."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        n = n or 0
        if k > start and held + n > size:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
