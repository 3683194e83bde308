"""Operator 13: token counts from a cache keyed by digests of content and tokenizer version.

A text's content is digested where it is read; digests are joined to stored counts, and only the
distinct contents without one are encoded and appended to the cache.  Texts travel in one shuffle, to
the task that encodes them, and only one row of each content is encoded; joins are on digests.

The cache is a folder of Parquet files for each tokenizer version: the version is the digest of the
vocabulary file and of the library's name and release, so another file or another release never
answers for this one.  Appending is one Spark write: what a lost attempt leaves is never seen, rows
that two runs append of the same content agree, and a run that stopped halfway leaves counts that
hold.

Defined cases: a null text is an empty one and has no tokens; equal contents are encoded once, whatever
their ids; repeated rows come back as often as they came; null ids are kept; an empty table gives no
rows and an empty cache; columns but `key` and `text` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_root, join_classes, save
from .segments import Memo, cuts_at_blanks, segments

COUNTS = "digest binary, n_tokens long"
#: Characters encoded at once.
SLICE = 4 << 20
_WORKER: dict[str, Callable[[list[str]], list[int]]] = {}


def tokenizer_version(path: str) -> str:
    """Digest of what decides about ids: the vocabulary file, the library and its release."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """The worker's function from texts to their numbers of tokens; Python workers live on between tasks."""
    if path not in _WORKER:
        _WORKER[path] = _piece_counter(path) if path.endswith(".model") else _json_counter(path)
    return _WORKER[path]


def _json_counter(path: str) -> Callable[[list[str]], list[int]]:
    from .tokens import encoder

    return lambda texts: [len(ids) // 4 for ids in encoder(path).encode(texts)]


def _piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    whole = lambda texts: list(map(len, model.encode(texts, num_threads=1))) if texts else []
    if not cuts_at_blanks(path):
        return whole
    memo = Memo(whole, lambda n: 0)

    def count(texts: list[str]) -> list[int]:
        parts = [segments(t) for t in texts]
        known = memo.of(set().union(*[p for p in parts if p]))
        rest = iter(whole([t for t, p in zip(texts, parts) if p is None]))
        return [next(rest) if p is None else sum(map(known.__getitem__, p)) for p in parts]

    return count


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of every content that the cache knows for this tokenizer version, once each."""
    path = f"{cache}/{tokenizer_version(tokenizer)}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _content(text: str):
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def learn_counts(docs: DataFrame, keys: DataFrame, tokenizer: str, cache: str, text: str = "text", key: str = "doc_id") -> None:
    """Encode the contents of `docs` that the cache lacks, once each, and append their counts.

    `keys` holds (id, digest) of the same rows.  One id stands for each missing content, so that copies
    of a text are spread over tasks by their ids and dropped there.
    """
    missing = keys.groupBy("digest").agg(F.min("id").alias("id")).join(stored_counts(docs.sparkSession, cache, tokenizer), "digest", "left_anti")
    texts = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("id"), _content(text).alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))
    once = texts.join(missing, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.min("t").alias("t")).select("digest", "t")

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            digests, column, at = batch.column("digest"), batch.column("t"), 0
            lengths = pa.compute.binary_length(column).to_pylist()
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and (stop == at or size + lengths[stop] <= SLICE):
                    size += lengths[stop]
                    stop += 1
                n = count(column.slice(at, stop - at).to_pylist())
                yield pa.RecordBatch.from_arrays([digests.slice(at, stop - at), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
                at = stop

    once.mapInArrow(run, COUNTS).write.mode("append").parquet(f"{cache}/{tokenizer_version(tokenizer)}")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; `cache` lives on between runs, by default in the shared folder."""
    spark = docs.sparkSession
    cache = cache or f"{checkpoint_root(spark)}/token-counts"
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), _content(text).alias("t"))
    keys = save(
        rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.octet_length("t").cast("long").alias("n_bytes"), F.unhex(F.sha2("t", 256)).alias("digest")), "token-keys"
    )
    learn_counts(docs, keys.select("id", "digest"), tokenizer, cache, text, key)
    classes = keys.groupBy("digest").agg(F.count("*").alias("rows")).join(stored_counts(spark, cache, tokenizer), "digest")
    counted = join_classes(keys, classes, ["digest"], "rows", keys.count())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
