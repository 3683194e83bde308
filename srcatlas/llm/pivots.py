"""Operator 2: embedding near-duplicates through a pivot-permutation index.

Random Gaussian directions serve as pivots.  Each vector is described by its `NEAREST` pivots
in order.  Inverted lists hold the vectors of which a pivot is among the first `LISTED`; the
pivots that two members of a list share among all `NEAREST` are counted, and only pairs that
share `SHARED` or more are verified, by cosine in double precision.

Equal vectors are one class and go through the lists once.  A list is cut into blocks of about
`BLOCK` vectors and compared block against block, so a pivot that holds a third of all vectors
is spread over many tasks.  A pair that shares several lists counts in that of the smallest
pivot only.  A task returns for each vector the number of its links in that tile and the
smallest member reachable over the tile's links, so rows grow with vectors and tiles and never
with pairs.

Pivots grow with the square root of the vectors, from `MIN_PIVOTS` up to `MAX_PIVOTS`; they are
the only thing broadcast.  They do not depend on the vectors: the products of a pair with a
pivot are normal with the pair's cosine as correlation, so the chance that it shares pivots
follows from its cosine and the number of pivots alone, however dense the group that it lies
in.  Every vector is indexed.

Defined cases: null vectors, zero vectors, and those with null or non-finite components link
with nothing, like those of another length than most; rows of a null vec_id are carried through
unlinked; vec_id is the key: rows that repeat one get the same result and are no links of each
other, and of different vectors under one id that of the least digest counts; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_classes, save
from .words import U, mix

NEAREST, LISTED, SHARED = 16, 8, 4
MIN_PIVOTS, MAX_PIVOTS = 64, 32_768
BLOCK = 4096
#: Rows of a tile compared at once, and columns that pivots are hashed to for counting.
STRIP, COLUMNS = 256, 256
SEED = 4711


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; rows of zeros or with non-finite components become NaN."""
    x = x.astype(np.float64)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


def described(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """(vec_id, d1, d2, x, near): digest and bytes of each valid vector, and its nearest pivots, nearest first."""
    at = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        base = at.value
        size = base.shape[1]
        salts = mix(np.arange(2 * size, dtype=U), 31).reshape(2, size) | U(1)
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), size), False))
            # As many rows at once as keep their products with all pivots within 16 MB.
            step = min(2048, max(16, (1 << 21) // len(base)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size) + 0.0
                u = unit(x)
                good = np.isfinite(u).all(axis=1) & np.isfinite(x).all(axis=1)
                if not good.any():
                    continue
                x, u = x[good], u[good]
                product, k = u @ base.T, min(nearest, len(base))
                near = np.argpartition(-product, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(product, near, axis=1), axis=1, kind="stable"), axis=1)
                bits = mix(x.astype(np.float64).view(U).copy(), 30)
                d1, d2 = ((mix(bits * salt, 32)).sum(axis=1, dtype=U).view(np.int64) for salt in salts)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k").filter(pa.array(good)), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in x], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(near.astype(np.int32).ravel()))],
                    names=["vec_id", "d1", "d2", "x", "near"],
                )

    return vectors.where("k IS NOT NULL").mapInArrow(run, "vec_id long, d1 long, d2 long, x binary, near array<int>")


class Forest:
    """Sets of indices joined edge by edge, the smallest index of a set as its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tolist() != self.root.tolist():
                self.root = up


def tile_links(threshold: float, shared: int, listed: int, dtype: str):
    """Function of one tile: rows (p, i, j, block, vec_id, copies, x, near) to (vec_id, n, other)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", ignore_index=True)
        p, i, j = (int(frame[c].iloc[0]) for c in ("p", "i", "j"))
        ids, copies, block = (frame[c].to_numpy() for c in ("vec_id", "copies", "block"))
        x = unit(np.frombuffer(b"".join(frame["x"]), dtype=dtype).reshape(len(frame), -1))
        near = np.stack(frame["near"].to_numpy())
        # Counts over hashed pivots are never below the true ones, so no pair is lost by them.
        has = np.zeros((len(frame), COLUMNS), dtype=np.float32)
        np.add.at(has, (np.arange(len(frame))[:, None], (mix(near.astype(U), 3) % U(COLUMNS)).astype(np.int64)), 1.0)
        first = near[:, :listed]
        names, local = np.unique(first[first < p], return_inverse=True)
        lower = None  # which smaller pivots list a vector, for tiles full of links
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        n, forest = np.zeros(len(frame), dtype=np.int64), Forest(len(frame))
        x_right, has_right = x[right].T.copy(), has[right].T.copy()
        for at in range(0, len(left), STRIP):
            rows = left[at : at + STRIP]
            chosen = has[rows] @ has_right >= shared
            if i == j:
                chosen &= right[None, :] > rows[:, None]
            r, c = np.nonzero(chosen)
            if len(r) * 8 > chosen.size:
                fits = (x[rows] @ x_right)[r, c] >= threshold
            else:
                fits = np.einsum("ij,ij->i", x[rows[r]], x[right[c]]) >= threshold
            r, c = r[fits], c[fits]
            # A pair that a smaller pivot lists too belongs to the tile of that one.
            if len(r) * 32 > chosen.size and len(names) <= 1024:
                if lower is None:
                    lower = np.zeros((len(frame), max(1, len(names))), dtype=np.float32)
                    lower[np.nonzero(first < p)[0], local] = 1.0
                mine = (lower[rows] @ lower[right].T)[r, c] == 0
            else:
                mine = np.ones(len(r), dtype=bool)
                for k in range(0, len(r), 1 << 16):
                    a, b = first[rows[r[k : k + (1 << 16)]]], first[right[c[k : k + (1 << 16)]]]
                    mine[k : k + (1 << 16)] = ~((a[:, :, None] == b[:, None, :]) & (a < p)[:, :, None]).any(axis=(1, 2))
            a, b = rows[r[mine]], right[c[mine]]
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            forest.join(a, b)
        some = n > 0
        return pd.DataFrame({"vec_id": ids[some], "n": n[some], "other": ids[forest.root[some]]})

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, nearest: int = NEAREST, shared: int = SHARED, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    kind = vectors.select(F.col(f"`{vector}`")).schema[0].dataType.elementType.typeName()
    kind, dtype = ("float", "<f4") if kind == "float" else ("double", "<f8")
    source = vectors.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{vector}` AS ARRAY<{kind}>) AS v")
    # Lengths of the vectors that can link; the most frequent one counts.
    valid = source.where("k IS NOT NULL AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(v, c -> c <> 0)")
    lengths = valid.groupBy(F.size("v").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), "length").first()
    if most is None:
        return source.select(F.col("k").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    m = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 * most["count"] ** 0.5)))
    pivots = np.random.default_rng(SEED).normal(size=(m, most["length"]))
    found = save(described(source, pivots, nearest), "vectors")
    one = found.groupBy("vec_id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("vec_id", "d.*")
    classes = one.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = found.join(classes, (found.vec_id == classes.rep) & (found.d1 == classes.d1) & (found.d2 == classes.d2)).select("vec_id", "copies", "x", "near")
    reps = save(reps.dropDuplicates(["vec_id"]), "classes")
    lists = reps.withColumn("p", F.explode(F.slice("near", 1, LISTED)))
    blocks = lists.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # at most MAX_PIVOTS rows
    placed = lists.join(F.broadcast(blocks), "p").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "p", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "vec_id", "copies", "x", "near"
    )
    linked = save(tiles.groupBy("p", "i", "j").applyInPandas(tile_links(threshold, shared, LISTED, dtype), "vec_id long, n long, other long"), "tiles")
    component = connected_components(linked.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    counts = linked.groupBy("vec_id").agg(F.sum("n").alias("n"))
    named = classes.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    named = save(named.select("d1", "d2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component")), "named")
    result = join_classes(one, named, ["d1", "d2"], "copies", most["count"]).select("vec_id", "n", "component")
    out = source.select(F.col("k").alias("vec_id")).join(result, "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
