"""How a section changed since its stored state, and what an edit makes of its claims."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import CLAIMS, claims_with_sources, numbered

KEY = ["repo_id", "section_id"]


def section_change_counts(state: DataFrame, live: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Decision per section from one row per id (`id`) of the stored state and of the live notes.

    Added and removed count places, unchanged counts distinct ids.  Ids are counted by section and joined
    by id, so a section may have any number of them.  `churn` is the share of changed places of all live
    ones; without live ones it is 1 if anything was removed.
    """
    key = [*KEY, "id"]
    was = state.groupBy(*key).agg(F.count("*").alias("cached"))
    both = live.groupBy(*key).agg(F.count("*").alias("now")).join(was, key, "full_outer")
    sums = both.groupBy(*KEY).agg(
        F.bool_or(F.col("id") == "").alias("blank"),
        F.sum(F.coalesce("cached", F.lit(0))).alias("cached"),
        F.sum(F.coalesce("now", F.lit(0))).alias("total"),
        F.sum(F.when(F.col("cached").isNull(), F.col("now")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("now").isNull(), F.col("cached")).otherwise(0)).alias("less"),
        F.count_if(F.col("cached").isNotNull() & F.col("now").isNotNull()).alias("same"),
    )
    fresh, blank = F.col("cached") == 0, F.col("blank")
    out = sums.select(
        *KEY,
        (fresh | blank).alias("anew"),
        F.when(fresh | blank, F.col("total")).otherwise(F.col("more")).cast("int").alias("added"),
        F.when(fresh, 0).when(blank, F.col("cached")).otherwise(F.col("less")).cast("int").alias("removed"),
        F.when(fresh | blank, 0).otherwise(F.col("same")).cast("int").alias("unchanged_count"),
        F.col("total").cast("int").alias("total_live"),
    )
    changed = F.col("added") + F.col("removed")
    decision = (
        F.when(F.col("anew"), "rewrite").when(changed == 0, "unchanged").when(F.col("total_live") == 0, "rewrite")
        .when(changed / F.greatest("total_live", F.lit(1)) <= threshold, "surgical").otherwise("rewrite")
    )
    churn = F.when(F.col("total_live") == 0, F.when(F.col("removed") > 0, 1.0).otherwise(0.0)).otherwise(changed / F.col("total_live"))
    return out.select(*KEY, decision.alias("decision"), "added", "removed", "unchanged_count", "total_live", churn.alias("churn"))


def changed_places(state: DataFrame, live: DataFrame) -> DataFrame:
    """(repo_id, section_id, change, place, id): the live places whose ids are new and the stored ones whose ids are gone.

    Both tables have a row for each place: `place` and `id`.  Where either side has a blank id, all places
    of both have changed; where nothing was stored, all live ones are new.  Places stay rows: a section
    may have any number of them, and each is joined by its id.
    """
    key = [*KEY, "id"]
    blank = state.where("id = ''").select(*KEY).unionByName(live.where("id = ''").select(*KEY)).distinct().withColumn("blank", F.lit(True))

    def lacking(rows: DataFrame, other: DataFrame, change: str) -> DataFrame:
        known = other.select(*key).distinct().withColumn("known", F.lit(True))
        found = rows.select(*KEY, F.col("place").cast("int").alias("place"), "id").join(known, key, "left").join(blank, KEY, "left")
        return found.where("known IS NULL OR blank").select(*KEY, F.lit(change).alias("change"), "place", "id")

    return lacking(live, state, "added").unionByName(lacking(state, live, "removed"))


def diff_notes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Notes added (with text) and removed (by id) between two states of a section."""
    key = [*KEY, "finding_id"]
    added = now.join(before.select(*key), key, "left_anti").select(*key, "finding", F.lit("added").alias("change"))
    removed = before.join(now.select(*key), key, "left_anti").select(*key, F.lit(None).cast("string").alias("finding"), F.lit("removed").alias("change"))
    return added.unionByName(removed)


def merge_surgical_edit(claims: DataFrame, removed: DataFrame, new_claims: DataFrame, added_notes: DataFrame) -> DataFrame:
    """Claims that an edit leaves, followed by its new ones, numbered from 1.

    `claims` are the stored ones (claim_idx, text, sources), `removed` 1-based indices of these (others
    are ignored), `new_claims` (claim_idx, text, note_indices) refer to `added_notes` (note_no counts
    the added notes of the section alone).
    """
    kept = claims.join(removed.select(*KEY, "claim_idx"), [*KEY, "claim_idx"], "left_anti").select(*KEY, F.lit(0).alias("part"), "claim_idx", "text", "sources")
    new = claims_with_sources(new_claims, added_notes).select(*KEY, F.lit(1).alias("part"), "claim_idx", "text", "sources")
    rows = kept.unionByName(new).withColumnRenamed("claim_idx", "was").withColumn("range", F.floor(F.col("was") / CLAIMS))
    return numbered(rows, KEY, ["was"], ["part", "range"], "claim_idx").select(*KEY, "claim_idx", "text", "sources")


def resolve_contradictions(contradictions: DataFrame, notes: DataFrame) -> DataFrame:
    """Contradictions (c_idx, summary, positions of text and note_indices) with sources in place of indices; they replace stored ones."""
    place = F.struct("c_idx", "p_idx").alias("claim_idx")
    sides = contradictions.select(*KEY, "c_idx", "summary", F.posexplode("positions").alias("p_idx", "p"))
    found = claims_with_sources(sides.select(*KEY, place, F.col("p.text").alias("text"), F.col("p.note_indices").alias("note_indices")), notes)
    rows = found.select(*KEY, F.col("claim_idx.c_idx").alias("c_idx"), F.struct(F.col("claim_idx.p_idx").alias("p_idx"), "text", "sources").alias("p"))
    sides = rows.groupBy(*KEY, "c_idx").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: F.struct(p["text"].alias("text"), p["sources"].alias("sources"))).alias("positions"))
    return contradictions.select(*KEY, "c_idx", "summary").join(sides, [*KEY, "c_idx"], "left")


def section_path(sections: DataFrame, live: DataFrame, state: DataFrame, changes: DataFrame, answers: DataFrame) -> DataFrame:
    """What becomes of each section, and whether it is stored.

    `sections` has (repo_id, section_id) of all primary sections, `live` their notes_hash where there
    are notes, `state` the stored notes_hash, `changes` the decision for each, `answers` (request, ok)
    what came of an edit or a rewrite.  A failed edit falls back to a rewrite, a failed rewrite to the
    raw findings, which are not stored; a section whose ids have not changed is shown again with its
    old digest left in place, so that a later run still refreshes its citations.
    """
    ok = answers.groupBy(*KEY).agg(F.bool_or((F.col("request") == "edit") & F.col("ok")).alias("edited"), F.bool_or((F.col("request") == "rewrite") & F.col("ok")).alias("rewritten"))
    rows = sections.select(*KEY).join(live.select(*KEY, "notes_hash"), KEY, "left").join(state.select(*KEY, F.col("notes_hash").alias("was")), KEY, "left")
    rows = rows.join(changes.select(*KEY, "decision"), KEY, "left").join(ok, KEY, "left")
    path = (
        F.when(F.col("notes_hash").isNull(), "empty").when(F.col("was") == F.col("notes_hash"), "cached").when((F.col("decision") == "unchanged") & F.col("was").isNotNull(), "unchanged")
        .when((F.col("decision") == "surgical") & F.col("was").isNotNull() & F.coalesce("edited", F.lit(False)), "edited").when(F.coalesce("rewritten", F.lit(False)), "rewritten").otherwise("fallback")
    )
    rows = rows.withColumn("path", path).withColumn("stored", F.col("path").isin("empty", "edited", "rewritten"))
    kept = F.when(F.col("stored"), F.coalesce("notes_hash", F.lit(""))).otherwise(F.col("was"))
    return rows.select(*KEY, "path", "stored", kept.alias("stored_hash"))


# Fixed texts of sections without an answer and without notes.
FAILED = "_Aggregation failed for **{title}** ({error}). Raw notes preserved below._"
EMPTY = "_No findings were extracted for **{title}** during the last walk._"


def _filled(text: str, **columns):
    """A text with columns in place of its names in braces."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[columns[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def empty_body(title, description):
    return F.concat(_filled(EMPTY, title=title), F.lit("\n\n> Brief: "), description, F.lit("\n"))


def fallback_lines(notes: DataFrame, failed: DataFrame, sections: DataFrame) -> DataFrame:
    """The lines, in order of line_no, that stand for a section whose rewrite failed: head, brief and its raw findings.

    `failed` has (repo_id, section_id, error), `notes` note_no, file and finding; every line is a row.
    """
    named = failed.select(*KEY, F.coalesce("error", F.lit("")).alias("error")).join(F.broadcast(sections.select("section_id", "title", "description")), "section_id")
    head = F.array(_filled(FAILED, title=F.col("title"), error=F.col("error")), F.lit(""), F.concat(F.lit("> Brief: "), "description"), *map(F.lit, ("", "", "## Raw findings", "")))
    heads = named.select(*KEY, F.posexplode(head).alias("at", "line")).select(*KEY, (F.col("at") - 7).cast("long").alias("line_no"), "line")
    line = F.concat(F.lit("- **"), F.coalesce("file", F.lit("?")), F.lit("** — "), F.coalesce("finding", F.lit("")))
    return heads.unionByName(notes.join(failed.select(*KEY), KEY, "left_semi").select(*KEY, F.col("note_no").cast("long").alias("line_no"), line.alias("line")))


def write_back(paths: DataFrame, state: DataFrame, answers: DataFrame, sections: DataFrame) -> DataFrame:
    """What a run leaves behind of each section: (path, body, shown, in_state, notes_hash, stored_body).

    `paths` comes from `section_path`, `state` has notes_hash and body, `answers` (request, ok, body) what
    came of edits and rewrites.  `body` is what is shown (null for a fallback, which is shown as lines);
    the state takes the new digest and body of sections that are stored and keeps all others as they were.
    """
    ok = answers.where("ok").groupBy(*KEY).agg(F.max(F.when(F.col("request") == "edit", F.col("body"))).alias("edit"), F.max(F.when(F.col("request") == "rewrite", F.col("body"))).alias("rewrite"))
    rows = paths.join(state.select(*KEY, F.col("notes_hash").alias("was"), F.col("body").alias("old")), KEY, "left").join(ok, KEY, "left").join(F.broadcast(sections.select("section_id", "title", "description")), "section_id")
    body = (
        F.when(F.col("path") == "empty", empty_body(F.col("title"), F.col("description"))).when(F.col("path").isin("cached", "unchanged"), F.col("old"))
        .when(F.col("path") == "edited", F.col("edit")).when(F.col("path") == "rewritten", F.col("rewrite"))
    )
    known = F.col("was").isNotNull()
    return rows.select(
        *KEY, "path", body.alias("body"), (F.col("stored") | known).alias("in_state"),
        F.when(F.col("stored"), F.col("stored_hash")).otherwise(F.col("was")).alias("notes_hash"), F.when(F.col("stored"), body).otherwise(F.col("old")).alias("stored_body"),
    )
