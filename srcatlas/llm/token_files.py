"""Operator 10: token ids in fixed-width bit-packed files, written and read by Spark tasks.

Documents are range-partitioned by id and sorted; each task streams one shard file to the
shared folder and reports one manifest row.  A shard holds blocks of `BLOCK` ids, each id in
the fewest bits that hold the vocabulary, then a footer with document and block offsets.  A
reader maps the footer and unpacks only the blocks that a document touches.

Layout: blocks | doc ids int64 | doc starts uint64 (one more than documents) | block offsets
uint64 (one more than blocks) | footer of 6 uint64: documents, ids, blocks, bits, ids a block,
magic.  Numbers are little-endian; bits of a block run from the lowest upwards.

Defined cases: a null text is the end id alone; null doc ids come first and are kept; repeated
ids are written each on their own, in order of their texts (null first); an empty table gives an empty manifest; other columns are
ignored.  A shard's name holds the attempt that wrote it and the manifest names the shards of
the attempts that counted, so a repeated or speculative task harms nothing: what a lost
attempt left behind is never read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_root, save
from .tokens import encode_rows

BLOCK = 4096
MAGIC = 0x31545942544B4E54
FOOTER = struct.Struct("<6Q")
NO_ID = -(1 << 63)


def width(vocabulary: int) -> int:
    """Fewest bits that hold ids below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(raw.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    raw = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = raw
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Streams documents into one shard; holds one block and the offsets."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.docs, self.starts, self.blocks = [], [0], [0]
        self.waiting, self.held = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= 64 * BLOCK:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK
        for at in range(0, stop, BLOCK):
            data = pack_bits(ids[at : min(at + BLOCK, stop)], self.bits)
            self.out.write(data)
            self.blocks.append(self.blocks[-1] + len(data))
        self.waiting, self.held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._blocks(last=True)
        self.out.write(np.array(self.docs, dtype="<i8").tobytes())
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.out.write(FOOTER.pack(len(self.docs), self.starts[-1], len(self.blocks) - 1, self.bits, BLOCK, MAGIC))


class ShardReader:
    """Random access to the documents of a shard through its offsets."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, self.n_ids, blocks, self.bits, self.block, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        tail = size - FOOTER.size - 8 * (n + n + 1 + blocks + 1)
        offsets = self._at(tail, 8 * (n + n + 1 + blocks + 1))
        self.doc_ids = np.frombuffer(offsets, dtype="<i8", count=n)
        self.starts = np.frombuffer(offsets, dtype="<u8", count=n + 1, offset=8 * n).astype(np.int64)
        self.offsets = np.frombuffer(offsets, dtype="<u8", count=blocks + 1, offset=8 * (2 * n + 1)).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard, reading only the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        a, b = start // self.block, (stop - 1) // self.block + 1
        data, base = self._at(self.offsets[a], int(self.offsets[b] - self.offsets[a])), self.offsets[a]
        parts = [
            unpack_bits(data[self.offsets[k] - base : self.offsets[k + 1] - base], min(self.block, self.n_ids - k * self.block), self.bits)
            for k in range(a, b)
        ]
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]

    def documents(self, step: int = 1 << 18):
        """Yield (index, doc id, start, ids bytes), reading about `step` ids at a time."""
        k = 0
        while k < len(self.doc_ids):
            stop = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + step, side="right")) - 1)
            ids, base = self.ids(self.starts[k], self.starts[stop]), self.starts[k]
            for i in range(k, stop):
                yield i, int(self.doc_ids[i]), int(self.starts[i]), ids[self.starts[i] - base : self.starts[i + 1] - base].tobytes()
            k = stop


MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write_token_files(
    docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Write shards in ascending `key` order; returns the manifest (one row per shard)."""
    folder = folder or f"{checkpoint_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    end, bits = np.array([end_id], dtype="<u4").tobytes(), width(vocabulary)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        writer = out = None
        for batch in batches:
            keys = batch.column("k").to_pylist()
            for at, encoded in encode_rows(batch, "t", tokenizer):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path)
                    writer = ShardWriter(out, bits)
                for k, ids in zip(keys[at:], encoded):
                    writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": task.partitionId(), "path": path, "n_docs": len(writer.docs), "n_ids": writer.starts[-1]}],
                schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    ordered = (
        docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t").repartitionByRange("k").sortWithinPartitions("k", "t")
    )
    manifest = save(ordered.mapInArrow(run, MANIFEST), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; `start` counts the ids of all before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard only
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(row["path"]) as source:
                    rows, size = [], 0
                    for _, doc, start, ids in ShardReader(source).documents():
                        rows.append((None if doc == NO_ID else doc, row["base"] + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names)

    def _batch(rows, names):
        doc, start, n, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=names
        )

    # A task for each shard: the manifest's few bytes would else come together in one.
    return based.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
