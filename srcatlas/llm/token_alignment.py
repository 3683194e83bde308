"""Operator 12: alignment of two tokenizers' vocabularies through inverted pair bitmaps.

Each document is encoded by both tokenizers; byte offsets at which tokens of both end cut it into
groups, and every token of the first (A) is linked to every token of the second (B) in its group.
One task pass over the texts writes, side by side in one saved table,

* a row for each document: its place (block, slot), token, group and link counts, and its groups;
* the postings: for each block of at most `SLOTS` documents and each linked id pair, compressed
  bitmaps of the documents that hold it.  Plane 0 has every document that holds the pair; plane k
  has those where bit k-1 of the pair's links beyond the first is set, and weighs 2^(k-1).

Blocks hold different documents, so OR-merging a pair's bitmaps lays them side by side and the
popcount of the merged bitmap is the sum of theirs: the counts of pairs are one pre-aggregated
sum over postings, and link counts are the weighted sum over all planes.  Each posting then takes
its pair's count, and the highest count of its A id, back to the documents in its bitmap.

A pair has a few rows in each block, however many documents hold it, so no key is hot; a block is
the unit that one task adds up, and it is bounded in documents and links.

Defined cases: a text that is null, empty or not given back byte for byte by the tokens of both has
no tokens: zeros and the empty string.  A row is a document: repeated rows count each.  An empty table
gives no rows.  Null ids are kept.  Columns but `key` and `text` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .segments import MARK, Memo, cuts_at_blanks, segments

#: Documents of a block, and the links after which a block is closed early.
SLOTS, BLOCK_LINKS = 8192, 6_000_000
#: Bytes of a bitmap that is not a list of slots; a list as long would hold this many slots.
BITS, MOST_LISTED = SLOTS // 8, SLOTS // 16
#: Pairs are a * 2^ID_BITS + b; ids lie below 2^ID_BITS.
ID_BITS, SLOT_BITS = 24, 13
#: Groups of more links than this are counted by distinct ids instead of link by link.
WIDE = 4096
#: Characters aligned at once.
SLICE = 2 << 20
_WORKER: dict[tuple[str, str], "TwoTokenizers"] = {}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary: printable characters stand for themselves, the others for those from 256 on."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a sentencepiece vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace(MARK, " ").encode() for k, x in enumerate(names)]


def written(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids below n, from the left, with one place more; and how many each has."""
    ids, width = np.arange(n), len(str(n - 1))
    sizes = sum((ids >= 10**k).astype(np.int64) for k in range(1, width)) + 1
    digits = np.zeros((n, width + 1), dtype=np.uint8)
    for k in range(width):
        digits[:, k] = ids // 10 ** np.maximum(sizes - 1 - k, 0) % 10 + ord("0")
    return digits, sizes


class TwoTokenizers:
    """Ids of blank+text by A and of text by B, equal to the libraries' own, where both give back its bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.bytes_a, self.bytes_b = byte_level_tokens(path_a), piece_tokens(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cuts = cuts_at_blanks(path_b)
        self.memo = Memo(self._learn, lambda v: 0 if v is None else len(v[0]) + len(v[1]) + 120, 120 << 20)
        self.digits, self.sizes = written(max(len(self.bytes_a), len(self.bytes_b)))

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, dtype="<u4"), np.array(self.b.encode(text), dtype="<u4")

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        a, b = self._ids(text)
        data = b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == data and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == data
        return (a.tobytes(), b.tobytes()) if same else None

    def _learn(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Parts are encoded many at a time, with blanks between them, and cut apart where a token of each ends."""
        out: dict[str, tuple[bytes, bytes] | None] = {}
        plain = [x for x in parts if x and not x[0].isspace() and not x[-1].isspace()]
        for at in range(0, len(plain), 1024):
            some = plain[at : at + 1024]
            found = self._whole(" ".join(some))
            if found is None:
                continue
            a, b = (np.frombuffer(x, dtype="<u4") for x in found)
            stops = np.cumsum([1 + len(x.encode()) for x in some])
            ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
            to_a, to_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
            if (ends_a[to_a] != stops).any() or (ends_b[to_b] != stops).any():
                continue
            i = j = 0
            for part, k, m in zip(some, (4 * (to_a + 1)).tolist(), (4 * (to_b + 1)).tolist()):
                out[part] = (found[0][i:k], found[1][j:m])
                i, j = k, m
        return [out[x] if x in out else self._whole(x) for x in parts]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """(ids of A, ids of B) as little-endian uint32, None where a text has no tokens."""
        cut = [segments(t) if t and self.cuts else None for t in texts]
        known = self.memo.of(set().union(*[p for p in cut if p])).__getitem__
        out = []
        for text, parts in zip(texts, cut):
            if parts is None:
                out.append(self._whole(text) if text else None)
                continue
            found = list(map(known, parts))
            out.append(None if None in found else (b"".join([x for x, _ in found]), b"".join([x for _, x in found])))
        return out


def _tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    if (path_a, path_b) not in _WORKER:
        _WORKER[path_a, path_b] = TwoTokenizers(path_a, path_b)
    return _WORKER[path_a, path_b]


class Groups:
    """The groups of documents laid end to end; both streams of tokens cover the same bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, per_a: np.ndarray, per_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
        self.a, self.b, self.documents = a, b, len(per_a)
        ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        at = np.searchsorted(ends_b, ends_a)
        cut_a = ends_b[at] == ends_a
        cut_b = np.zeros(len(b), dtype=bool)
        cut_b[at[cut_a]] = True
        self.group_a, self.group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        self.stop_a, self.stop_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        self.n_a, self.n_b = np.diff(self.stop_a, prepend=0), np.diff(self.stop_b, prepend=0)
        self.of = np.repeat(np.arange(self.documents), per_a)[cut_a]
        self.n_groups = np.bincount(self.of, minlength=self.documents)
        self.n_links = np.zeros(self.documents, dtype=np.int64)
        np.add.at(self.n_links, self.of, self.n_a * self.n_b)
        self.per_a, self.per_b = per_a, per_b

    def digests(self, digits: np.ndarray, sizes: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups, written `a1,a2|b1;a3|b2,b3`; `digits` and `sizes` as of `written`."""
        n = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + (self.stop_b - self.n_b)[self.group_a]
        place_b = np.arange(len(self.b)) + self.stop_a[self.group_b]
        ids, behind = np.empty(n, dtype=np.int64), np.full(n, ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        behind[place_a[self.stop_a - 1]], behind[place_b[self.stop_b - 1]] = ord("|"), ord(";")
        rows, size = digits[ids], sizes[ids]
        rows[np.arange(n), size] = behind
        flat = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(size + 1)))[np.concatenate(([0], np.cumsum(self.per_a + self.per_b)))].tolist()
        return [hashlib.sha256(flat[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of all links; a pair of a document may come more than once."""
        wide = self.n_a * self.n_b > WIDE
        times = np.where(wide, 0, self.n_b)[self.group_a]
        a = np.repeat(self.a, times).astype(np.int64)
        within = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        b = self.b[np.repeat((self.stop_b - self.n_b)[self.group_a], times) + within]
        document = np.repeat(self.of[self.group_a], times)
        found = [(document, a << ID_BITS | b, np.ones(len(a), dtype=np.int64))]
        for g in np.flatnonzero(wide).tolist():
            ids_a, times_a = np.unique(self.a[self.stop_a[g] - self.n_a[g] : self.stop_a[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.stop_b[g] - self.n_b[g] : self.stop_b[g]], return_counts=True)
            pairs = (ids_a.astype(np.int64)[:, None] << ID_BITS | ids_b.astype(np.int64)).ravel()
            found.append((np.full(len(pairs), self.of[g]), pairs, (times_a[:, None] * times_b).ravel()))
        return tuple(np.concatenate(x) for x in zip(*found))


def bitmaps(slots: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A compressed bitmap for each run of ascending slots: a list of 16-bit slots, or `BITS` bytes of bits where that is no longer."""
    dense = sizes >= MOST_LISTED
    taken = np.where(dense, BITS, 2 * sizes)
    offsets = np.concatenate(([0], np.cumsum(taken)))
    if not dense.any():
        data = slots.astype("<u2")
    else:
        data = np.zeros(offsets[-1] // 2, dtype="<u2")
        starts = np.cumsum(sizes) - sizes
        listed = np.repeat(~dense, sizes)
        to = np.repeat(offsets[:-1] // 2 - starts, sizes) + np.arange(len(slots))
        data[to[listed]] = slots[listed]
        raw = data.view(np.uint8)
        for k in np.flatnonzero(dense).tolist():
            bits = np.zeros(SLOTS, dtype=np.uint8)
            bits[slots[starts[k] : starts[k] + sizes[k]]] = 1
            raw[offsets[k] : offsets[k + 1]] = np.packbits(bits, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def slots_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots end to end, how many each bitmap holds) of compressed bitmaps."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    dense = sizes == BITS
    if not dense.any():
        return data.view("<u2").astype(np.int64), sizes // 2
    rows = np.flatnonzero(dense)
    bits = np.unpackbits(data[np.repeat(dense, sizes)].reshape(-1, BITS), axis=1, bitorder="little")
    which, slots = np.nonzero(bits)
    sizes = sizes // 2
    sizes[rows] = np.bincount(which, minlength=len(rows))
    out = np.empty(sizes.sum(), dtype=np.int64)
    from_bits = np.repeat(dense, sizes)
    out[from_bits], out[~from_bits] = slots, data[np.repeat(~dense, np.diff(offsets))].view("<u2")
    return out, sizes


INDEX = "block long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, plane int, n_docs int, docs binary"
_SCHEMA = pa.schema(
    [("block", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
    + [("groups_sha256", pa.string()), ("pair", pa.int64()), ("plane", pa.int32()), ("n_docs", pa.int32()), ("docs", pa.binary())]
)


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) for f in _SCHEMA], schema=_SCHEMA)


class Block:
    """Up to `SLOTS` documents of a task: their rows at once, their postings when the block is closed."""

    def __init__(self, number: int):
        self.number, self.size, self.held = number, 0, 0
        self.keys, self.times = [], []

    @property
    def full(self) -> bool:
        return self.size >= SLOTS or self.held >= BLOCK_LINKS

    def add(self, ids: list, encoded: list[tuple[bytes, bytes] | None], two: TwoTokenizers) -> pa.RecordBatch:
        n = len(ids)
        pairs = [x or (b"", b"") for x in encoded]
        a, b = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in zip(*pairs))
        per_a, per_b = (np.array([len(x) // 4 for x in side]) for side in zip(*pairs))
        found = Groups(a, b, per_a, per_b, two.len_a, two.len_b)
        document, pair, times = found.links()
        key = pair << SLOT_BITS | (document + self.size)
        if (times == 1).all():
            key, times = np.unique(key, return_counts=True)
        else:
            key, at = np.unique(key, return_inverse=True)
            once, times = times, np.zeros(len(key), dtype=np.int64)
            np.add.at(times, at, once)
        self.keys.append(key)
        self.times.append(times)
        self.held += len(key)
        rows = _rows(
            n, block=np.full(n, self.number), slot=np.arange(self.size, self.size + n), doc_id=ids, n_a=per_a, n_b=per_b,
            n_groups=found.n_groups, n_links=found.n_links, groups_sha256=found.digests(two.digits, two.sizes),
        )
        self.size += n
        return rows

    def postings(self):
        """Rows (pair, plane, n_docs, docs) of the block, a batch for each plane."""
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys)
        pairs, slots, more = keys[order] >> SLOT_BITS, keys[order] & (SLOTS - 1), times[order] - 1
        for plane in range(int(more.max(initial=-1)).bit_length() + 1 if len(more) else 0):
            chosen = (more >> plane - 1 & 1).astype(bool) if plane else slice(None)
            own, held = pairs[chosen], slots[chosen]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            sizes = np.diff(first, append=len(own))
            for at in range(0, len(first), 1 << 17):
                k = slice(at, at + (1 << 17))
                low, n = first[k][0], sizes[k]
                yield _rows(len(n), block=np.full(len(n), self.number), pair=own[first[k]], plane=np.full(len(n), plane), n_docs=n, docs=bitmaps(held[low : low + n.sum()], n))


def index_pairs(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents (where `pair` is null) and postings of their pairs, saved."""

    def run(batches):
        two, numbered = _tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(numbered)
        for batch in batches:
            ids, column, at = batch.column("k").to_pylist(), batch.column("t"), 0
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and stop - at < SLOTS - block.size and (stop == at or size + lengths[stop] <= SLICE):
                    size += lengths[stop]
                    stop += 1
                yield block.add(ids[at:stop], two.encode(column.slice(at, stop - at).to_pylist()), two)
                at = stop
                if block.full:
                    yield from block.postings()
                    numbered += 1
                    block = Block(numbered)
        if block.size:
            yield from block.postings()

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return save(rows.mapInArrow(run, INDEX), "pair-index")


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, id_a, id_b, n_docs, n_links, best): documents and links of each pair of the corpus, and whether no pair of its A id is in more documents."""
    weight = F.when(F.col("plane") == 0, 1).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    pairs = index.where("pair IS NOT NULL").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n_docs")).otherwise(0)).alias("n_docs"), F.sum(F.col("n_docs") * weight).alias("n_links")
    )
    pairs = pairs.select("pair", F.expr(f"shiftright(pair, {ID_BITS})").alias("id_a"), (F.col("pair") % (1 << ID_BITS)).alias("id_b"), "n_docs", "n_links")
    highest = pairs.groupBy("id_a").agg(F.max("n_docs").alias("highest"))
    return pairs.join(highest, "id_a").select("pair", "id_a", "id_b", "n_docs", "n_links", (F.col("n_docs") == F.col("highest")).alias("best"))


def document_scores(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, slot, n_best, count_sum): every posting gives its pair's count to the documents of its bitmap, by the links of its plane."""
    scored = index.where("pair IS NOT NULL").select("pair", "block", "plane", "docs").join(counts.select("pair", F.col("n_docs").alias("count"), "best"), "pair").drop("pair")

    def run(batches):
        block, best, total = None, np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)

        def result():
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], names=["block", "slot", "n_best", "count_sum"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block").to_numpy()
            plane, count, is_best = batch.column("plane").to_numpy(), batch.column("count").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
            weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if blocks[i] != block:
                    if block is not None:
                        yield result()
                    block = int(blocks[i])
                    best[:], total[:] = 0, 0
                slots, sizes = slots_of(batch.column("docs").slice(i, j - i))
                np.add.at(total, slots, np.repeat(weight[i:j] * count[i:j], sizes))
                np.add.at(best, slots, np.repeat(np.where(is_best[i:j], weight[i:j], 0), sizes))
        if block is not None:
            yield result()

    return scored.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, slot int, n_best long, count_sum long")


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    index = index_pairs(docs, path_a, path_b, text, key)
    scores = document_scores(index, pair_counts(index))
    zero = F.lit(0).cast("long")
    rows = index.where("pair IS NULL").select("block", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scores, ["block", "slot"], "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
