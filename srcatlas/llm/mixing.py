"""Operator 1: soft-membership mixing of documents to target domain weights.

A classifier fitted on labelled rows (logistic regression on the hashed words and runs of marks
of a text) gives each document a posterior over domains.
Projected gradient then fits nonnegative document rates r so that for each domain d the
expected tokens sum(r * tokens * p_d) meet their target in the least-squares sense, starting
from r = 1.  A step is taken in the metric of the domains' own second moments, so documents of
any length converge alike.  A rate is a function of the document's posterior and the list of
past steps, so each iteration is one aggregation over all documents to a few numbers, and
nothing about single documents reaches the driver.  Targets are never lowered: scarce domains are
repeated as often as it takes, and a fit outside the tolerance warns of what was wanted and reached.

The classifier is fitted on at most `TRAIN_DOCS` labelled documents, those of the least hashes
of their ids; everything else covers all documents.

Defined cases: null and empty texts count 0 tokens and get the bias alone; null doc_ids are kept;
a label row without document is ignored; without any labelled document all posteriors are
even; rows that repeat are rated each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save
from .words import U, hash_words, mix as scramble, text_slices

TRAIN_DOCS = 6000
BUCKETS = 1 << 18
#: ASCII marks; everything else but white space belongs to words.
_MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
#: Training: rounds of gradient descent, their rate and momentum, decay, and documents that a feature must occur in.
ROUNDS, RATE, MOMENTUM, DECAY, LEAST_DOCS = 200, 20.0, 0.9, 1e-6, 8
#: Domains of the labels table and the weights aimed at.
DOMAINS = ("poor", "good", "toxic")
TARGETS = (0.04, 0.95, 0.01)
#: Tokens wanted, as a multiple of those needed to keep the domain of the largest weight whole.
BUDGET = 1.1
STEPS, TOLERANCE = 40, 1e-4


def domain_of(labels: DataFrame) -> DataFrame:
    """(k, domain) of labelled documents; rows of a null id or quality are ignored."""
    domain = F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).cast("int")
    return labels.select(F.col("doc_id").cast("long").alias("k"), domain.alias("domain")).where("k IS NOT NULL AND domain IN (0, 1, 2)")


def features(column: pa.Array):
    """Yield (row, number of words, distinct feature slots) of each text of an Arrow column."""
    for first, offsets, data in text_slices(column):
        for k in range(len(offsets) - 1):
            text = data[offsets[k] : offsets[k + 1]]
            marks = _MARK[text]
            words = hash_words(np.where(marks, np.uint8(32), text), fold_case=True)[0]
            runs = hash_words(np.where(marks, text, np.uint8(32)))[0]
            slots = np.concatenate((words & U(BUCKETS - 1), scramble(runs.copy(), 3) & U(BUCKETS - 1)))
            yield first + k, len(hash_words(text)[0]), np.unique(slots).astype(np.int64)


def train(rows: list[np.ndarray], domain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights (domains, buckets), bias) of slots that occur in enough documents; NaN marks all others.

    A document's slots count by the root of their number, so that long texts stay soft.
    """
    k, n = len(DOMAINS), len(rows)
    weights, bias = np.full((k, BUCKETS), np.nan), np.zeros(k)
    if n == 0:
        return weights, bias
    slot, row = np.concatenate(rows), np.repeat(np.arange(n), [len(x) for x in rows])
    often = np.bincount(slot, minlength=BUCKETS) >= min(LEAST_DOCS, max(1, n // 50))
    slot, row = slot[often[slot]], row[often[slot]]
    names, at = np.unique(slot, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))[row]
    by_slot = np.argsort(at, kind="stable")
    row_of, value_of = row[by_slot], value[by_slot]
    row_cut, slot_cut = np.flatnonzero(np.diff(row, prepend=-1)), np.flatnonzero(np.diff(at[by_slot], prepend=-1))
    w, dw, db, want = np.zeros((k, len(names))), np.zeros((k, len(names))), np.zeros(k), np.eye(k)[domain]
    for _ in range(ROUNDS):
        score = np.zeros((n, k)) + bias
        if len(names):
            for d in range(k):
                score[row[row_cut], d] += np.add.reduceat(w[d, at] * value, row_cut)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        gap = p / p.sum(axis=1, keepdims=True) - want
        for d in range(k if len(names) else 0):
            dw[d] = MOMENTUM * dw[d] - RATE * (np.add.reduceat(gap[row_of, d] * value_of, slot_cut) / n + DECAY * w[d])
            w[d] += dw[d]
        db = MOMENTUM * db - gap.mean(axis=0)
        bias = bias + db
    weights[:, names] = w
    return weights, bias


def fit_domains(source: DataFrame, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias, trained on the features of at most `train_docs` labelled documents."""
    sample = labelled.groupBy("k").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("k"), "k").limit(train_docs)

    def run(batches):
        for batch in batches:
            domain = batch.column("domain").to_numpy()
            for row, _, slots in features(batch.column("t")):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("k")[row].as_py()]), pa.array([int(domain[row])], pa.int32()), pa.array([slots.astype(np.int32).tobytes()])], names=["k", "domain", "slots"]
                )

    found = source.join(F.broadcast(sample), "k").select("k", "domain", "t").mapInArrow(run, "k long, domain int, slots binary").toPandas()
    found = found.sort_values(["k", "slots"])  # the order of rows must not tell in the sums
    return train([np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in found["slots"]], found["domain"].to_numpy())


def posterior(slots: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    w = weights[:, slots]
    w = w[:, ~np.isnan(w[0])]
    score = bias + w.sum(axis=1) / max(1.0, np.sqrt(w.shape[1]))
    score = np.exp(score - score.max())
    return score / score.sum()


def posteriors(source: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(doc_id, tokens, p): tokens are words, p one posterior for each domain."""
    at = source.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        w, base = at.value
        for batch in batches:
            n, p = np.zeros(batch.num_rows, dtype=np.int64), np.zeros((batch.num_rows, len(base)))
            for row, words, slots in features(batch.column("t")):
                n[row], p[row] = words, posterior(slots, w, base)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n), lists], names=["doc_id", "tokens", "p"])

    return source.mapInArrow(run, "doc_id long, tokens long, p array<double>")


def _rate(steps: list[list[float]], domains: int) -> Column:
    """The rate after the given steps: r <- max(0, r - sum_d step_d p_d), from r = 1; plain arithmetic, which Spark compiles."""
    r = F.lit(1.0)
    for s in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.lit(float(s[d])) * F.col("p")[d] for d in range(domains)), F.lit(0.0)))
    return r


def fit_rates(table: DataFrame, targets=TARGETS, budget: float = BUDGET) -> Column:
    """Rate of each document of `posteriors` as a column over its p."""
    k = len(targets)
    mass = [F.sum(F.col("tokens") * F.col("p")[d]).alias(f"s{d}") for d in range(k)]
    first = table.agg(*mass).first()
    have = np.array([x or 0.0 for x in first])
    main = int(np.argmax(targets))
    want = np.array(targets) * have[main] / targets[main] * budget
    steps: list[list[float]] = []
    for step in range(STEPS + 1):
        r = _rate(steps, k)
        terms = [F.sum(F.col("r") * F.col("tokens") * F.col("p")[d]).alias(f"s{d}") for d in range(k)]
        # Second moments over the documents that can still move.
        terms += [F.sum(F.when(F.col("r") > 0, F.col("tokens") * F.col("p")[a] * F.col("p")[b]).otherwise(0.0)).alias(f"m{a}{b}") for a in range(k) for b in range(k)]
        row = [x or 0.0 for x in table.withColumn("r", r).agg(*terms).first()]
        gap, moment = np.array(row[:k]) - want, np.array(row[k:]).reshape(k, k)
        if np.abs(gap).max() <= TOLERANCE * max(1.0, want.sum()):
            break
        if step == STEPS:
            warnings.warn(f"mixing misses its targets: tokens wanted {want.tolist()}, reached {row[:k]}", stacklevel=2)
            break
        ridge = 1e-6 * max(1e-9, np.trace(moment)) * np.eye(k)
        steps.append(np.linalg.solve(moment + ridge, gap).tolist())
    return _rate(steps, k)


def mix(
    docs: DataFrame, labels: DataFrame, targets=TARGETS, budget: float = BUDGET, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate) of every document."""
    source = docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t")
    weights, bias = fit_domains(source, domain_of(labels))
    table = save(posteriors(source, weights, bias), "posteriors")
    rate = fit_rates(table, targets, budget)
    return table.select("doc_id", "tokens", *[F.col("p")[d].alias(f"p_{name}") for d, name in enumerate(DOMAINS)], rate.alias("rate"))


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies of a document: its rate rounded up or down by a hash of its id."""
    u = F.pmod(F.xxhash64(F.lit(4711), key), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + u).cast("int")


def mixed_documents(
    docs: DataFrame, labels: DataFrame, targets=TARGETS, budget: float = BUDGET, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The documents, each as often as its rate says, with all their columns.

    Rates are computed again in the scan that emits the rows, so no text is shuffled.
    """
    source = docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t")
    weights, bias = fit_domains(source, domain_of(labels))
    rate = fit_rates(save(posteriors(source, weights, bias), "posteriors"), targets, budget)
    at = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("array<double>")
    def judged(column):
        import pandas as pd

        return pd.Series([posterior(slots, *at.value) for _, _, slots in features(pa.array(column, pa.string()))])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judged(F.col(f"`{text}`").cast("string")).alias("p"))
    n = copies_of(rate, F.col(f"row.`{key}`"))
    return row.withColumn("n", n).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
