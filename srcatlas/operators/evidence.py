"""Claims and their numbered sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.scalar import collapse, render_ref, strip
from .markers import annotated, missing

KEY = ["repo_id", "section_id"]


SOURCES = "array<struct<file:string,line_start:int,line_end:int,fingerprint:string>>"
#: Claims whose first references are ordered in one task.
CLAIMS = 10_000


def note_refs(file: Column, sources: Column) -> Column:
    """The references of a note: its sources, or its file where it has none."""
    none = F.lit(None).cast("int")
    bare = F.array(F.struct(file.alias("file"), none.alias("line_start"), none.alias("line_end"), F.lit("").alias("fingerprint")))
    return F.when(F.size(F.coalesce(sources, F.array().cast(SOURCES))) > 0, sources).when(F.coalesce(file, F.lit("")) != "", bare).otherwise(F.array().cast(SOURCES))


def resolve_claim_sources(claims: DataFrame, numbered_notes: DataFrame) -> DataFrame:
    """One row per source of a claim: 1-based note indices to references; out of range is ignored."""
    asked = claims.select(*KEY, "claim_idx", F.posexplode("note_indices").alias("at", "note_no"))
    notes = numbered_notes.select(*KEY, "note_no", note_refs(F.col("file"), F.col("sources")).alias("refs"))
    rows = asked.join(notes, [*KEY, "note_no"]).select(*KEY, "claim_idx", "at", F.posexplode("refs").alias("ref_at", "source"))
    at = F.col("source")
    return coalesce_refs(rows.select(*KEY, "claim_idx", F.struct("at", "ref_at").alias("seq"), "source", render_ref(at["file"], at["line_start"], at["line_end"]).alias("ref")))


def coalesce_refs(rows: DataFrame) -> DataFrame:
    """First-seen references of each claim."""
    first = [F.min_by("source", "seq").alias("source")] if "source" in rows.columns else []
    return rows.groupBy(*KEY, "claim_idx", "ref").agg(F.min("seq").alias("seq"), *first)


def claims_with_sources(claims: DataFrame, numbered_notes: DataFrame) -> DataFrame:
    """The claims (claim_idx, text, note_indices) with the references that their notes give, in first-seen order."""
    refs = resolve_claim_sources(claims, numbered_notes).groupBy(*KEY, "claim_idx").agg(F.sort_array(F.collect_list(F.struct("seq", "source"))).alias("r"))
    out = claims.select(*KEY, "claim_idx", "text").join(refs, [*KEY, "claim_idx"], "left")
    return out.select(*KEY, "claim_idx", "text", F.coalesce(F.transform("r", lambda x: x["source"]), F.array().cast(SOURCES)).alias("sources"))


def numbered(rows: DataFrame, key: list[str], order: list[str], ranges: list[str], name: str) -> DataFrame:
    """`rows` with their 1-based place among all of their `key` in `order`.

    Rows are ordered within the ranges that the columns `ranges` (the coarse part of the order) tell apart;
    the ranges are counted before each other, so that a key may have any number of rows.
    """
    ahead = Window.partitionBy(*key).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*key, *ranges).agg(F.count("*").alias("_n")).select(*key, *ranges, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).cast("int").alias("_before"))
    own = F.row_number().over(Window.partitionBy(*key, *ranges).orderBy(*order))
    return rows.withColumn(name, own).join(before, [*key, *ranges]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def number_sources(claim_refs: DataFrame) -> DataFrame:
    """Source numbers by first appearance over the section's claims, counted over ranges of `CLAIMS` claims."""
    first = claim_refs.groupBy(*KEY, "ref").agg(F.min(F.struct("claim_idx", "seq")).alias("first")).withColumn("range", F.floor(F.col("first.claim_idx") / CLAIMS))
    return numbered(first, KEY, ["first", "ref"], ["range"], "number").select(*KEY, "ref", "number")


def annotate_claims(claim_refs: DataFrame, numbers: DataFrame) -> DataFrame:
    """The marker of each claim: its source numbers in order."""
    rows = claim_refs.join(numbers, [*KEY, "ref"]).groupBy(*KEY, "claim_idx").agg(F.sort_array(F.collect_set("number")).alias("n"))
    return rows.select(*KEY, "claim_idx", F.array_join(F.transform("n", lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "").alias("marker"))


def _refs(sources: Column) -> Column:
    return F.transform(F.coalesce(sources, F.array().cast(SOURCES)), lambda s: render_ref(s["file"], s["line_start"], s["line_end"]))


#: Place of contradictions behind all claims when sources are numbered.
BEHIND = 1 << 40
MARKED = StructType([StructField("body", StringType()), StructField("beside", ArrayType(BooleanType()))])


@F.pandas_udf(MARKED)
def annotate_body(body: pd.Series, claims: pd.Series, flat: pd.Series, flat_claims: pd.Series) -> pd.DataFrame:
    """The body with its claims' markers, and for each claim whether it stands beside the body.

    `claims` holds (text, marker) with stripped texts in order; `flat` and `flat_claims` are the body and the
    texts with their white space collapsed.
    """
    rows = zip(body, claims, flat, flat_claims)
    out = [(annotated(b, [(c["text"], c["marker"]) for c in cs]), missing(f, list(fs))) for b, cs, f, fs in rows]
    return pd.DataFrame(out, columns=["body", "beside"])


CONFLICTS = "_The walker found disagreements across files. Migration teams should resolve these before re-implementation._"


def _sides(contradictions: DataFrame) -> DataFrame:
    """(c_idx, summary, p_idx, text, sources): the positions of contradictions; p_idx is null where there is none."""
    rows = contradictions.select(*KEY, F.col("c_idx").cast("long").alias("c_idx"), "summary", F.posexplode_outer("positions").alias("p_idx", "p"))
    return rows.select(*KEY, "c_idx", "summary", "p_idx", F.col("p.text").alias("text"), F.col("p.sources").alias("sources"))


def render_sections(bodies: DataFrame, claims: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(repo_id, section_id, document): marked body, supporting claims, conflicts and sources; empty parts are left out.

    `claims` has claim_idx, text and sources, `contradictions` c_idx, summary and positions of text and
    sources.  Sources are numbered once (W6) and their numbers joined to the references; a section is
    gathered only as the lines of its document, which is what its reader reads.
    """
    sides = _sides(contradictions)
    each = F.posexplode(_refs(F.col("sources"))).alias("n", "ref")
    refs = lambda df, place, at: df.select(*KEY, place.alias("claim_idx"), at.alias("p"), each).select(*KEY, "claim_idx", F.struct("p", "n").alias("seq"), "ref")
    claim = F.col("claim_idx").cast("long")
    of_claims = refs(claims, claim, F.lit(0))
    of_sides = refs(sides.where("p_idx IS NOT NULL"), F.col("c_idx") + BEHIND, F.col("p_idx"))
    numbers = number_sources(of_claims.unionByName(of_sides))

    first = of_claims.groupBy(*KEY, "claim_idx", "ref").agg(F.min("seq").alias("seq")).join(numbers, [*KEY, "ref"])
    marks = first.groupBy(*KEY, "claim_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "number"))), lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("]"))), "").alias("marker"))
    said = claims.select(*KEY, claim.alias("claim_idx"), F.coalesce("text", F.lit("")).alias("text")).join(marks, [*KEY, "claim_idx"], "left")
    one = F.struct("claim_idx", strip(F.col("text")).alias("text"), F.coalesce("marker", F.lit("")).alias("marker"), collapse(F.col("text")).alias("flat"))
    held = said.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("claims"))

    brackets = F.concat(F.lit(" ("), F.array_join(F.transform(_refs(F.col("sources")), lambda r: F.concat(F.lit("`"), r, F.lit("`"))), ", "), F.lit(")"))
    line = F.concat(F.lit("  - "), strip(F.coalesce("text", F.lit(""))), F.when(F.size(F.coalesce("sources", F.array().cast(SOURCES))) > 0, brackets).otherwise(""))
    against = sides.groupBy(*KEY, "c_idx").agg(
        F.first("summary").alias("summary"), F.transform(F.sort_array(F.collect_list(F.when(F.col("p_idx").isNotNull(), F.struct("p_idx", line.alias("line"))))), lambda x: x["line"]).alias("lines")
    )
    conflict = F.struct("c_idx", F.concat(F.array(F.lit(""), F.concat(F.lit("- **"), strip(F.coalesce("summary", F.lit(""))), F.lit("**"))), "lines").alias("lines"))
    conflicts = against.groupBy(*KEY).agg(F.flatten(F.transform(F.sort_array(F.collect_list(conflict)), lambda x: x["lines"])).alias("conflicts"))
    entry = F.struct("number", F.concat(F.col("number").cast("string"), F.lit(". `"), "ref", F.lit("`")).alias("line"))
    sources = numbers.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["line"]).alias("sources"))

    rows = bodies.select(*KEY, F.coalesce("body", F.lit("")).alias("body"))
    for part in (held, conflicts, sources):
        rows = rows.join(part, KEY, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"conflicts": F.coalesce("conflicts", none), "sources": F.coalesce("sources", none)})
    marked = annotate_body("body", F.transform("claims", lambda c: F.struct(c["text"].alias("text"), c["marker"].alias("marker"))), collapse(F.col("body")), F.transform("claims", lambda c: c["flat"]))
    plain = rows.where("claims IS NULL").withColumns({"said": F.col("body"), "beside": none})
    with_claims = rows.where("claims IS NOT NULL").withColumn("m", marked)
    aside = F.filter(F.zip_with("claims", "m.beside", lambda c, lacks: F.when(lacks & (c["marker"] != ""), F.concat(F.lit("- "), c["text"], F.lit(" "), c["marker"]))), lambda x: x.isNotNull())
    with_claims = with_claims.withColumns({"said": F.col("m.body"), "beside": aside}).drop("m")
    rows = plain.unionByName(with_claims).withColumn("said", strip(F.col("said")))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.array(*map(F.lit, head)), lines)).otherwise(none)
    lines = F.concat(
        F.when(F.col("said") != "", F.array("said")).otherwise(none),
        part(("", "## Supporting claims"), "beside"),
        part(("", "## Conflicts in source", CONFLICTS), "conflicts"),
        part(("", "## Sources"), "sources"),
    )
    return rows.select(*KEY, strip(F.array_join(lines, "\n")).alias("document"))
