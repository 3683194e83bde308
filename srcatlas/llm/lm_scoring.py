"""Operator 6: stupid-backoff scores of all documents under the bigram counts of all others.

Words are told apart by 63-bit fingerprints, whatever their number.  The table of word counts
is a plain aggregation; at most `VOCABULARY` of the most frequent words are broadcast.  The table of bigram
counts is partitioned by a hash of the bigram into buckets.  Documents are then exploded into
their distinct bigrams, dealt by the same hash and joined to the count table bucket by bucket,
and what the bigrams score is summed per document.  Rows travel as packed arrays, one for each
bucket and slice of documents, so that counting and joining run on whole columns.

Hot keys: a bigram that makes up a `HOT`-th or more of all is counted like the others, but its
count is broadcast (there are at most `HOT` such bigrams) and it is scored where its document
is read.  A bucket's count table is read before its exploded rows, which pass one array at a
time, so a task holds the distinct bigrams of a bucket and never all rows of a key.  Words that
are not broadcast are joined to the word counts by their fingerprints; only rows that need such
a count take part in that.

A document is scored by what all other documents hold: a bigram that occurs elsewhere scores
its count there over that of its first word there; any other backs off to `BACKOFF` times the
share that the word's count elsewhere, at least one, has in all words of the corpus.  Scores are
base-10 logarithms, summed per document.

Defined cases: null and wordless texts score 0 over 0 words; the first word of a text follows
a start symbol, which is counted once a document; null doc_ids are left out; rows that repeat an
id are scored each on their own and added up; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .words import U, mix, row_words

VOCABULARY = 1 << 19
HOT = 1 << 18
BACKOFF = 0.4
#: Words handled together inside a task, and words of the corpus for each bucket of bigrams.
SLICE_WORDS, BUCKET_WORDS = 1 << 19, 1 << 21
RARE = U(1 << 63)
#: Places of broadcast words take this many bits, and bigrams of two such words five bytes.
BITS = U(20)
#: Rows of a bucket: its count table, then bigrams of broadcast words, of rarer ones, and what documents score by themselves.
TABLE, COMMON, RARER, SCORED = 0, 1, 2, 3

ROW = "bucket int, kind int, key binary, docs binary, rows binary, n binary, own binary, first binary, second binary"
_NAMES = [x.split()[0] for x in ROW.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * (len(_NAMES) - 2)]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, types)], names=_NAMES)


def _bytes(x: np.ndarray, dtype) -> bytes:
    return x.astype(dtype, copy=False).tobytes()


def _array(value, dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=dtype)


def _small(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the greatest."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _counts(value, n: int) -> np.ndarray:
    data = value.as_buffer()
    return np.frombuffer(data, dtype=f"<u{data.size // max(1, n)}", count=n).astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _five(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _keys(value, kind: int) -> np.ndarray:
    data = _array(value, np.uint8)
    if kind != COMMON:
        return data.view(U).copy()
    wide = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    wide[:, :5] = data.reshape(-1, 5)
    return wide.view("<u8").ravel()


def rare_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.copy(), 5) ^ second, 6) | RARE


def _slices(batches):
    """Yield (batch, rows, fingerprints, row index of each word) for runs of rows of about `SLICE_WORDS` words."""
    for batch in batches:
        rows, held, size = [], [], 0
        for row, h, *_ in row_words(batch.column("t"), fold_case=True):
            rows.append(row)
            held.append(h >> U(1))
            size += len(h)
            if size > SLICE_WORDS or row + 1 == batch.num_rows:
                yield batch, np.array(rows), np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
                rows, held, size = [], [], 0


def word_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for _, _, h, _ in _slices(batches):
            word, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("t").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Pairs:
    """The distinct bigrams of a slice; `of` names the bigram that each word ends.

    `first` and `second` are a broadcast word's place from 1 (0 is the start symbol), or a rarer
    word's fingerprint with the highest bit set.
    """

    def __init__(self, h: np.ndarray, doc: np.ndarray, vocabulary: np.ndarray):
        words, self.word = np.unique(h, return_inverse=True)
        spot = np.searchsorted(vocabulary, words)
        spot[spot == len(vocabulary)] = 0
        known = vocabulary[spot] == words if len(vocabulary) else np.zeros(len(words), dtype=bool)
        code = np.where(known, (spot + 1).astype(U), words | RARE)
        self.before = np.concatenate(([-1], self.word))[: len(h)]
        self.before[np.concatenate(([True], doc[1:] != doc[:-1]))[: len(h)]] = -1
        width = len(words) + 1
        pair, self.of, self.n = np.unique((self.before + 1) * width + self.word, return_inverse=True, return_counts=True)
        self.first, self.second = np.concatenate((np.zeros(1, dtype=U), code))[pair // width], code[pair % width]
        rare = (self.first >= RARE) | (self.second >= RARE)
        self.key = np.where(rare, rare_key(self.first, self.second), (self.first << BITS) | self.second)
        self.n_words = len(words)


def _by_bucket(key: np.ndarray, buckets: int):
    """Yield (bucket, COMMON or RARER, ascending positions of its keys of that sort)."""
    place = (mix(key.copy(), 9) % U(buckets)).astype(np.int64) * 2 + (key >= RARE)
    order = np.argsort(place, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        if len(at):
            bucket, rare = divmod(int(place[at[0]]), 2)
            yield bucket, RARER if rare else COMMON, at


def bigram_table(docs: DataFrame, vocabulary, buckets: int, hot_count: int) -> DataFrame:
    """A row for each bucket: its bigrams that occur twice or more (`key`, `n`), and again those of `hot_count` or more (`docs`, `rows`)."""

    def count(batches):
        for _, _, h, doc in _slices(batches):
            pairs = Pairs(h, doc, vocabulary.value)
            rows = [
                {"bucket": b, "kind": kind, "key": _five(pairs.key[at]) if kind == COMMON else _bytes(pairs.key[at], U), "n": _small(pairs.n[at])}
                for b, kind, at in _by_bucket(pairs.key, buckets)
            ]
            if rows:
                yield _batch(rows)

    def total(batches):
        bucket, keys, counts, size = None, [], [], 0

        def merge():
            nonlocal keys, counts, size
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            keys, counts, size = [key], [n], 0
            return key, n

        def done():
            key, n = merge()
            several, hot = n > 1, n >= hot_count
            return _batch([{"bucket": bucket, "kind": TABLE, "key": key[several].tobytes(), "n": n[several].tobytes(), "docs": key[hot].tobytes(), "rows": n[hot].tobytes()}])

        for batch in batches:
            for b, kind, k, n in zip(*(batch.column(x) for x in ("bucket", "kind", "key", "n"))):
                if b.as_py() != bucket:
                    if keys:
                        yield done()
                    bucket, keys, counts, size = b.as_py(), [], [], 0
                keys.append(_keys(k, kind.as_py()))
                counts.append(_counts(n, len(keys[-1])))
                size += len(keys[-1])
                # Merged often enough to hold little more than the distinct bigrams.
                if size > max(1 << 20, len(keys[0])):
                    merge()
        if keys:
            yield done()

    dealt = docs.select("t").mapInArrow(count, ROW).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(total, ROW)


def pair_scores(c, n, first, own_first, second, own_second, count: np.ndarray, total: int) -> np.ndarray:
    """What bigrams of broadcast words score, for counts c in the corpus of which n in the document; `count` is by place, 0 the start."""
    there = c > n
    before = np.maximum(count[first.astype(np.int64)] - own_first, 1)
    alone = np.maximum(count[second.astype(np.int64)] - own_second, 1)
    return n * np.where(there, np.log10(np.maximum(c - n, 1)) - np.log10(before), np.log10(BACKOFF / max(1, total)) + np.log10(alone))


def exploded(docs: DataFrame, vocabulary, counts, hot, buckets: int, total: int) -> DataFrame:
    """Rows of `ROW`: the distinct bigrams of documents by bucket, and what their hot bigrams score."""

    def run(batches):
        words, (keys, times), have = vocabulary.value, hot.value, counts.value
        for batch, rows, h, doc in _slices(batches):
            pairs, ids = Pairs(h, doc, words), batch.column("k").to_numpy()[rows]
            n_words = np.bincount(doc, minlength=len(rows))
            # How often a document holds each of its words, and the one before each.
            _, at, held = np.unique(doc * pairs.n_words + pairs.word, return_inverse=True, return_counts=True)
            own = held[at]
            own_before = np.where(pairs.before < 0, 1, np.concatenate(([1], own))[: len(own)])
            _, at, n = np.unique(doc * len(pairs.key) + pairs.of, return_index=True, return_counts=True)
            doc, pair, own, own_before = doc[at], pairs.of[at], own[at], own_before[at]
            key = pairs.key[pair]
            spot = np.searchsorted(keys, key)
            spot[spot == len(keys)] = 0
            is_hot = keys[spot] == key if len(keys) else np.zeros(len(key), dtype=bool)
            k = np.flatnonzero(is_hot & (key < RARE))
            gain = pair_scores(times[spot[k]], n[k], pairs.first[pair[k]], own_before[k], pairs.second[pair[k]], own[k], have, total)
            scores = np.bincount(doc[k], weights=gain, minlength=len(rows))
            out = [{"bucket": int(ids[0] % buckets), "kind": SCORED, "docs": _bytes(ids, np.int64), "rows": _bytes(n_words, np.int64), "n": _bytes(scores, np.float64)}]
            rest = np.flatnonzero(~is_hot | (key >= RARE))
            for b, kind, at in _by_bucket(key[rest], buckets):
                at = rest[at]
                start = np.flatnonzero(np.concatenate(([True], doc[at][1:] != doc[at][:-1])))
                names = {"key": _five(key[at])} if kind == COMMON else {"first": pairs.first[pair[at]].tobytes(), "second": pairs.second[pair[at]].tobytes()}
                counts_of = {"rows": _small(np.diff(np.append(start, len(at)))), "n": _small(n[at]), "own": _small(np.concatenate((own_before[at], own[at])))}
                out.append({"bucket": b, "kind": kind, "docs": _bytes(ids[doc[at[start]]], np.int64), **names, **counts_of})
            yield _batch(out)

    return docs.mapInArrow(run, ROW)


SCORES = {"doc_id": pa.int64(), "n_words": pa.int64(), "s": pa.float64(), "word": pa.int64(), "n": pa.int64(), "own": pa.int64(), "hit": pa.bool_()}


def _scores(**columns) -> pa.RecordBatch:
    size = len(columns["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in SCORES.items()], names=list(SCORES))


def joined(rows: DataFrame, counts, total: int) -> DataFrame:
    """(doc_id, n_words, s) of what is scored, and (doc_id, word, n, own, hit) of what needs the count of a rarer word."""

    def run(batches):
        have, bucket, key, times = counts.value, None, np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        for batch in batches:
            column = {c: batch.column(c) for c in _NAMES}
            for i in range(batch.num_rows):
                value = lambda c, dtype: _array(column[c][i], dtype)  # noqa: B023, E731
                if column["bucket"][i].as_py() != bucket:
                    bucket, key, times = column["bucket"][i].as_py(), np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
                kind = column["kind"][i].as_py()
                if kind == TABLE:
                    key, times = value("key", U).copy(), value("n", np.int64).copy()
                    continue
                docs = value("docs", np.int64)
                if kind == SCORED:
                    yield _scores(doc_id=docs, n_words=value("rows", np.int64), s=value("n", np.float64))
                    continue
                if kind == COMMON:
                    mine = _keys(column["key"][i], kind)
                    first, second = mine >> BITS, mine & U((1 << 20) - 1)
                else:
                    first, second = value("first", U), value("second", U)
                    mine = rare_key(first, second)
                size, n = _counts(column["rows"][i], len(docs)), _counts(column["n"][i], len(mine))
                own_first, own_second = _counts(column["own"][i], 2 * len(mine)).reshape(2, -1)
                c = n
                if len(key):
                    spot = np.searchsorted(key, mine)
                    spot[spot == len(key)] = 0
                    c = np.where(key[spot] == mine, times[spot], n)
                hit = c > n
                asked = np.where(hit, first, second)
                waits = asked >= RARE
                s = pair_scores(c, n, np.where(first < RARE, first, U(0)), own_first, np.where(second < RARE, second, U(0)), own_second, have, total)
                # A rarer word's count is still to come: only the other part of the sum is known.
                s[waits] = (n * np.where(hit, np.log10(np.maximum(c - n, 1)), np.log10(BACKOFF / max(1, total))))[waits]
                yield _scores(doc_id=docs, s=np.add.reduceat(s, np.cumsum(size) - size))
                if waits.any():
                    own = np.where(hit, own_first, own_second)[waits]
                    yield _scores(doc_id=np.repeat(docs, size)[waits], word=(asked[waits] & ~RARE).view(np.int64), n=n[waits], own=own, hit=hit[waits])

    schema = "doc_id long, n_words long, s double, word long, n long, own long, hit boolean"
    return rows.mapInArrow(run, schema)


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and counts of the most frequent words, at most `most` of them.

    Words are counted by eighths of an octave of their frequency, a few hundred rows, and all words
    from the lowest eighth on that still fits are taken: nothing is sorted and no task sends more.
    """
    octave = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in sorted(counts.groupBy(octave.alias("o")).count().collect(), key=lambda r: -r.o):
        held += r["count"]
        if held > most:
            break
        least = r.o
    top = counts.where(octave >= least if least is not None else F.lit(False)).toArrow()
    words = top["word"].to_numpy().view(U)
    order = np.argsort(words)
    return words[order], top["n"].to_numpy()[order]


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, log10_score, log10_per_word)."""
    context = docs.sparkSession.sparkContext
    source = docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t").where("k IS NOT NULL")
    counts = save(word_counts(source), "words")
    total, n_docs = int(counts.agg(F.sum("n")).first()[0] or 0), source.count()
    words, times = frequent_words(counts, min(vocabulary, (1 << 20) - 2))
    at, have = context.broadcast(words), context.broadcast(np.concatenate(([n_docs], times)))
    buckets = max(4, -(-total // BUCKET_WORDS))
    table = save(bigram_table(source, at, buckets, max(2, -(-total // HOT))), "bigrams")
    found = table.select("docs", "rows").toArrow()  # at most HOT bigrams in all
    keys = np.concatenate([np.zeros(0, dtype=U), *[_array(x, U) for x in found["docs"]]])
    times = np.concatenate([np.zeros(0, dtype=np.int64), *[_array(x, np.int64) for x in found["rows"]]])
    order = np.argsort(keys)
    rows = exploded(source, at, have, context.broadcast((keys[order], times[order])), buckets, total)
    none = F.lit(None).cast("binary")
    dealt = rows.unionByName(table.withColumns({"docs": none, "rows": none})).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    scored = save(joined(dealt, have, total), "scores")
    plain = scored.where("word IS NULL").select("doc_id", "n_words", "s")
    rarer = scored.where("word IS NOT NULL").join(counts.withColumnRenamed("n", "c"), "word")
    part = F.col("n") * F.log10(F.greatest(F.col("c") - F.col("own"), F.lit(1))) * F.when(F.col("hit"), -1).otherwise(1)
    out = plain.unionByName(rarer.select("doc_id", F.lit(0).cast("long").alias("n_words"), part.alias("s")))
    out = out.groupBy("doc_id").agg(F.sum(F.coalesce("n_words", F.lit(0))).alias("n_words"), F.sum("s").alias("log10_score"))
    return out.withColumn("log10_per_word", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))
