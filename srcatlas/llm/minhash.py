"""Operator 5: near-duplicates by fast similarity sketching, banding and exact verification.

Each document's shingle set is thrown into `COORDINATES` bins in rounds: in round i every
shingle lands in one hashed bin with a value of i plus a fraction, and a bin keeps its least
value.  Rounds stop once all bins are filled; after `COORDINATES` rounds, round
`COORDINATES + b` puts every shingle into bin b, so every coordinate of a non-empty set is
filled.  Coordinates then agree with probability equal to the Jaccard similarity J, and the
share of agreeing ones concentrates about J as for independent samples.

Documents with equal sets form classes first, by 128 bits of digest and the size of the set (as
sure as the 64-bit fingerprints that all sets consist of); only class representatives go on.
Bands of coordinates give buckets.  In a bucket, members are compared
with one leader, the member that shares most buckets.  Members of a bucket that are not then
in one component are compared across components, but for pairs whose sizes exclude a link
and those whose `COORDINATES` one-bit coordinates estimate J more than five standard
deviations below the threshold.  Buckets are cut into tiles of blocks for that, and a tile gives
no more links than it has members.  Every link is confirmed on the full sets.

Defined cases: null and wordless texts have an empty set and link with nothing; fewer than
`words` words make one shingle; equal texts always share a class; rows of a null doc_id are
left out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_classes, save
from .words import U, mix, row_words, shingles

COORDINATES = 1024
BANDS, ROWS = 24, 5
#: Tasks that the set of a document may go to, and members of a bucket compared in one tile with as many others.
SALTS, BLOCK = 16, 512
FILLED = U(0xFFFFFFFFFFFFFFFF)


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t coordinates for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    doc, item = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    out = np.full(len(sets) * t, FILLED, dtype=U)
    for i in range(2 * t):
        x = mix(item.copy(), 1000 + i)
        bins = ((x >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else np.full(len(item), i - t)
        np.minimum.at(out, doc * t + bins, (U(i) << U(32)) | (x & U(0xFFFFFFFF)))
        open_docs = (out.reshape(-1, t) == FILLED).any(axis=1)
        left = open_docs[doc]
        if not left.any():
            break
        doc, item = doc[left], item[left]
    return out.reshape(-1, t)


def _bands(rows: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), BANDS), dtype=U)
    for b in range(BANDS):
        x = np.full(len(rows), b, dtype=U)
        for j in range(ROWS):
            x = mix(x ^ rows[:, b * ROWS + j], j)
        out[:, b] = x
    return out


def _bits(rows: np.ndarray) -> np.ndarray:
    return np.packbits((mix(rows.copy(), 7) & U(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


SKETCHES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits array<long>"


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.int64, copy=False).ravel()))


def document_sketches(docs: DataFrame, words: int, text: str, key: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys, held = batch.column("k"), []

            def flush():
                sets = [s for _, s in held]
                rows = np.zeros((len(held), COORDINATES), dtype=U)
                some = [k for k, s in enumerate(sets) if len(s)]
                if some:
                    rows[some] = sketch([sets[k] for k in some])
                n = np.array([len(s) for s in sets], dtype=np.int64)
                digest = [np.array([mix(s.copy(), seed).sum(dtype=U) for s in sets], dtype=U).view(np.int64) for seed in (101, 102)]
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([r for r, _ in held])), pa.array(n), *map(pa.array, digest), _lists(_bands(rows).view(np.int64)), _lists(_bits(rows))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "bits"],
                )

            for row, h, *_ in row_words(batch.column("t"), fold_case=True):
                held.append((row, shingles(h, words)))
                if len(held) == 256:
                    yield flush()
                    held = []
            if held:
                yield flush()

    return docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t").where("k IS NOT NULL").mapInArrow(run, SKETCHES)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): sorted 64-bit fingerprints as bytes."""

    def run(batches):
        for batch in batches:
            keys, rows, size = batch.column("k"), [], 0
            for row, h, *_ in row_words(batch.column("t"), fold_case=True):
                rows.append((row, shingles(h, words).tobytes()))
                size += len(rows[-1][1])
                if size > 8 << 20 or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array([r for r, _ in rows])), pa.array([s for _, s in rows], pa.binary())], names=["doc_id", "shingles"]
                    )
                    rows, size = [], 0

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The set of a goes once to each of its pairs; that of b, which thousands may be compared with,
    goes once to each of `SALTS` tasks instead of travelling on every pair.
    """
    deal = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    first = pairs.join(sets.withColumnRenamed("doc_id", "a"), "a").select("b", deal.alias("salt"), "a", "shingles")
    second = pairs.select("b", deal.alias("salt")).distinct().join(sets.withColumnRenamed("doc_id", "b"), "b").select("b", "salt", F.col("shingles").alias("other"))

    def linked(frames):
        import pandas as pd

        held, y = None, None
        for frame in frames:
            keep = []
            for b, x, other in zip(frame["b"], frame["shingles"], frame["other"]):
                if b != held:
                    held, y = b, np.frombuffer(other, dtype=U)
                x = np.frombuffer(x, dtype=U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": frame["a"][keep], "b": frame["b"][keep]})

    return first.join(second.hint("merge"), ["b", "salt"]).select("a", "b", "shingles", "other").mapInPandas(linked, "a long, b long")


def tile_links(percent: int, most: int):
    """Function of one tile of a bucket: rows (i, j, block, band, doc_id, component, n_shingles, bits, bands, shingles) to links (a, b).

    Pairs of members in different components are looked at if sizes and bits allow a link and no
    earlier band puts them into one bucket too; a pair that earlier links of the tile have joined
    need not be.  What comes back joins each member to the smallest that it is linked with over the
    tile, so rows grow with the members and never with the pairs.
    """

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("doc_id", ignore_index=True)
        i, j, band = (int(frame[c].iloc[0]) for c in ("i", "j", "band"))
        ids, block, component, size = (frame[c].to_numpy() for c in ("doc_id", "block", "component", "n_shingles"))
        bits, bands = (np.stack(frame[c].to_numpy()).view(U) for c in ("bits", "bands"))
        sets = [np.frombuffer(x, dtype=U) for x in frame["shingles"]]
        _, first, of = np.unique(component, return_index=True, return_inverse=True)
        root = first[of].tolist()

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links = []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            open_ = component[rows][:, None] != component[right][None, :]
            if i == j:
                open_ &= rows[:, None] < right[None, :]
            least, greatest = np.minimum(size[rows][:, None], size[right][None, :]), np.maximum(size[rows][:, None], size[right][None, :])
            open_ &= 100 * least >= percent * greatest
            r, c = np.nonzero(open_)
            for k in range(0, len(r), 1 << 16):
                a, b = rows[r[k : k + (1 << 16)]], right[c[k : k + (1 << 16)]]
                near = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most
                near &= ~(bands[a, :band] == bands[b, :band]).any(axis=1)
                for x, y in zip(a[near].tolist(), b[near].tolist()):
                    u, v = find(x), find(y)
                    if u != v:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            root[max(u, v)] = min(u, v)
                            links.append((ids[x], ids[y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (it is its component's smallest id)."""
    all_docs = save(document_sketches(docs, words, text, key), "sketches")
    filled = all_docs.where("n_shingles > 0")
    classes = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Only a class's smallest id goes on: one row for each class, whatever the number of its copies.
    reps = filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "bands", "bits")
    member = reps.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = save(member.join(sizes, "bucket"), "members")
    reach = member.groupBy("doc_id").agg(F.sum("size").alias("reach"))
    lead = F.max(F.struct("reach", (-F.col("doc_id")).alias("id"), "n_shingles"))
    leaders = member.join(reach, "doc_id").groupBy("bucket").agg(lead.alias("l"))
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    star = (
        member.join(leaders, "bucket")
        .select(F.col("doc_id").alias("a"), (-F.col("l.id")).alias("b"), F.col("n_shingles").alias("na"), F.col("l.n_shingles").alias("nb"))
        .where(f"a <> b AND {fits}")
        .select("a", "b")
        .distinct()
    )
    star = save(star, "pairs")
    # Sets of all members of buckets, for the star and for the tiles below.  Texts are dealt by id at every size of
    # the tables, never the ids to all tasks.
    wanted = member.select(F.col("doc_id").alias("k")).distinct()
    source = docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS k", f"CAST(`{text}` AS STRING) AS t")
    sets = save(shingle_sets(source.join(wanted.hint("merge"), "k", "left_semi"), words).dropDuplicates(["doc_id"]), "sets")
    links = save(confirmed(star, sets, percent), "links")
    component = save(connected_components(links), "components")

    # What the leaders left open: members of one bucket in different components.
    placed = member.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("bucket", "size")
    # One-bit coordinates differ with probability (1 - J) / 2.
    p = (1 - percent / 100) / 2
    most = int(np.ceil(COORDINATES * p + 5 * np.sqrt(COORDINATES * p * (1 - p))))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    opened = placed.drop("size").join(split, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    opened = opened.join(reps.select("doc_id", "bits", "bands"), "doc_id").join(sets, "doc_id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = opened.select("bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "band", "doc_id", "component", "n_shingles", "bits", "bands", "shingles")
    more = save(tiles.groupBy("bucket", "i", "j").applyInPandas(tile_links(percent, most), "a long, b long"), "links")
    if not more.isEmpty():
        # The components found stand for their members; only what joins two of them is new.
        for side in "ab":
            found = component.select(F.col("node").alias(side), F.col("component").alias("to"))
            more = more.join(found, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        joined = save(connected_components(more), "components").toDF("component", "to")
        named = component.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        component = named.unionByName(joined.join(component.select("component"), "component", "left_anti").toDF("node", "component"))
    named = save(
        classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(
            "d1", "d2", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id")
        ),
        "classes",
    )
    total = all_docs.count()
    rows = all_docs.select("doc_id", "n_shingles", "d1", "d2")
    return (
        join_classes(rows.where("n_shingles > 0"), named, ["d1", "d2", "n_shingles"], "copies", total)
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, **args) -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns.

    Documents of a null id are kept, as nothing says that they are copies.
    """
    key = args.get("key", "doc_id")
    gone = near_duplicates(docs, percent, **args).where(~F.col("kept")).select(F.col("doc_id").alias(key))
    return docs.join(gone, key, "left_anti")
