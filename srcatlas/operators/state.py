"""Content-addressed state: lookup, pruning, upserts, digests and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fingerprint

KEY = ["repo_id", "rel_path"]
SECTION = ["repo_id", "section_id"]


def lookup_extraction(files: DataFrame, state: DataFrame) -> DataFrame:
    """Adds `hit`: same path and same, non-empty fingerprint."""
    known = state.where("fingerprint <> ''").select(*KEY, "fingerprint", F.lit(True).alias("hit")).distinct()
    return files.join(known, [*KEY, "fingerprint"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def prune_state(state: DataFrame, files: DataFrame) -> DataFrame:
    return state.join(files.select(*KEY), KEY, "left_semi")


def count_pruned(state: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that pruning drops, per repository."""
    return state.join(files.select(*KEY), KEY, "left_anti").groupBy("repo_id").agg(F.count("*").alias("removed"))


def forget(state: DataFrame, keys: DataFrame, key=("repo_id", "rel_path")) -> DataFrame:
    return state.join(keys.select(*key), list(key), "left_anti")


def upsert_state(state: DataFrame, rows: DataFrame, key=("repo_id", "rel_path")) -> DataFrame:
    return forget(state, rows, key).unionByName(rows, allowMissingColumns=True)


def lookup_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.groupBy("repo_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def _digest(parts: Column) -> Column:
    return fingerprint(F.array_join(parts, "\u0001"))


def notes_hash(notes: DataFrame) -> DataFrame:
    """Digest of each section's note contents with their places in the order (file, chunk, seq).

    Notes are hashed first; digests are gathered in up to 4096 groups of files, by the file's own
    hash, and then the digests of the groups: a section may hold any number of notes.
    """
    sources = F.array_join(
        F.transform(
            F.coalesce("sources", F.array().cast("array<struct<file:string,line_start:int,line_end:int,fingerprint:string>>")),
            lambda s: F.concat_ws("\u0002", s["file"], F.coalesce(s["line_start"].cast("string"), F.lit("")), F.coalesce(s["line_end"].cast("string"), F.lit("")), F.coalesce(s["fingerprint"], F.lit(""))),
        ),
        "\u0001",
    )
    file = F.coalesce("file", F.lit(""))
    one = fingerprint(F.concat_ws("\u0001", file, F.coalesce("summary", F.lit("")), F.coalesce("finding", F.lit("")), sources))
    group = F.substring(F.sha2(file, 256), 1, 3)
    rows = notes.select(*SECTION, group.alias("g"), F.struct(file.alias("file"), F.coalesce("chunk", F.lit(0)).alias("chunk"), "seq", one.alias("h")).alias("n"))
    parts = rows.groupBy(*SECTION, "g").agg(_digest(F.transform(F.sort_array(F.collect_list("n")), lambda x: x["h"])).alias("d"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("g", "d"))), lambda x: x["d"])
    return parts.groupBy(*SECTION).agg(_digest(whole).alias("notes_hash"))


def upstream_hash(upstream: DataFrame) -> DataFrame:
    """Digest of (section_id, body) pairs per derivative section, by id."""
    pair = F.struct("upstream_id", fingerprint(F.col("body")).alias("h"))
    return upstream.groupBy("repo_id", "section_id").agg(
        _digest(F.transform(F.sort_array(F.collect_list(pair)), lambda x: F.concat(x["upstream_id"], F.lit("\u0002"), x["h"]))).alias("upstream_hash")
    )


def scope_hash(include: Column, exclude: Column) -> Column:
    return fingerprint(F.concat(F.array_join(F.sort_array(include), "\u0001"), F.lit("\u0002"), F.array_join(F.sort_array(exclude), "\u0001")))


def _spine(tables: list[DataFrame], ids: tuple[str, ...]) -> DataFrame:
    """Every repository of the tables with every one of a few section ids."""
    repos = tables[0].select("repo_id")
    for t in tables[1:]:
        repos = repos.union(t.select("repo_id"))
    return repos.distinct().select("repo_id", F.explode(F.array(*map(F.lit, ids))).alias("section_id"))


def aggregation_fresh(live: DataFrame, state: DataFrame, primary: tuple[str, ...]) -> DataFrame:
    """Per repository: every primary section has an entry whose hash is the live one ('' for no notes)."""
    both = _spine([live, state], primary).join(live.select(*SECTION, F.col("notes_hash").alias("live")), SECTION, "left").join(state.select(*SECTION, "notes_hash"), SECTION, "left")
    return both.groupBy("repo_id").agg(F.bool_and(F.coalesce(F.col("notes_hash") == F.coalesce("live", F.lit("")), F.lit(False))).alias("fresh"))


def derivation_fresh(upstream: DataFrame, state: DataFrame, derived: tuple[str, ...], review: bool = False) -> DataFrame:
    """Per repository: every derivative section has an entry of the live upstream hash ('' for none), under review a revised one."""
    both = _spine([upstream, state], derived).join(upstream.select(*SECTION, F.col("upstream_hash").alias("live")), SECTION, "left").join(state.select(*SECTION, "upstream_hash", "revised"), SECTION, "left")
    same = F.coalesce(F.col("upstream_hash") == F.coalesce("live", F.lit("")), F.lit(False))
    return both.groupBy("repo_id").agg(F.bool_and(same & F.col("revised") if review else same).alias("fresh"))


def can_short_circuit(stats: DataFrame, scope: DataFrame, prior: DataFrame, aggregation: DataFrame, derivation: DataFrame) -> DataFrame:
    """Per repository of `stats`: no file needed a model, the scope is that of the last run, and all stored sections are fresh."""
    out = stats.select("repo_id", "files_seen", "cache_hits", "specialized_files")
    for table, was, now in ((scope, "scope_hash", "scope"), (prior, "scope_hash", "prior"), (aggregation, "fresh", "aggregated"), (derivation, "fresh", "derived")):
        out = out.join(table.select("repo_id", F.col(was).alias(now)), "repo_id", "left")
    seen = (F.col("files_seen") > 0) & (F.col("cache_hits") + F.col("specialized_files") == F.col("files_seen"))
    return out.select("repo_id", F.coalesce(seen & (F.col("scope") == F.col("prior")) & F.col("aggregated") & F.col("derived"), F.lit(False)).alias("short_circuit"))
