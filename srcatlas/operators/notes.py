"""Findings to notes: valid sections, de-duplication, running summaries, numbers, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import absolute_line, render_ref, strip

FILE = ["repo_id", "rel_path"]
#: Fixed section ids: primary ones, and derivative ones with what they derive from.
PRIMARY = ("domains", "intent", "capabilities", "external_dependencies", "integrations", "cross_cutting", "entities", "hard_specifications")
DERIVED = {
    "personas": ("capabilities", "intent", "entities", "integrations"),
    "user_stories": ("personas", "capabilities", "entities"),
    "diagrams": ("domains", "entities", "integrations"),
}


def sections(spark: SparkSession) -> DataFrame:
    rows = [(k, s, "primary") for k, s in enumerate(PRIMARY)] + [(len(PRIMARY) + k, s, "derivative") for k, s in enumerate(DERIVED)]
    return spark.createDataFrame(rows, "ord int, section_id string, tier string")


def lineage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, u, k) for s, ups in DERIVED.items() for k, u in enumerate(ups)], "section_id string, upstream_id string, ord int")


def filter_valid_sections(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("section_id").isin(*PRIMARY))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """First of equal stripped findings of a file's section, by chunk and position."""
    w = Window.partitionBy(*FILE, "section_id", strip(F.col("finding"))).orderBy("chunk_index", "pos")
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def running_summary(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy(*FILE).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("summary_so_far", F.coalesce(F.last(F.nullif("summary", F.lit("")), ignorenulls=True).over(w), F.lit("")))


def cacheable_files(chunk_results: DataFrame) -> DataFrame:
    """Files of which some chunk succeeded and none failed."""
    return chunk_results.groupBy(*FILE).agg(F.bool_and("ok").alias("all_ok"), F.count_if("ok").alias("chunks_processed")).where("all_ok AND chunks_processed > 0").drop("all_ok")


def number_notes(notes: DataFrame, name: str = "note_no") -> DataFrame:
    """1-based place of a note in its section, in order of file, chunk and finding.

    Notes are counted by file first, so that what one task orders is a section's files or a file's notes.
    """
    key = ["repo_id", "section_id", "file"]
    ahead = Window.partitionBy("repo_id", "section_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = notes.groupBy(*key).agg(F.count("*").alias("_n")).select(*key, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).cast("int").alias("_before"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("chunk", F.lit(0)), "seq"))
    return notes.withColumn(name, own).join(before, key).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


NOTE = ("repo_id", "section_id", "file", "summary", "finding", "sources", "extractor", "chunk", "chunks", "seq")


def apply_extraction(files: DataFrame, chunk_results: DataFrame, findings: DataFrame) -> DataFrame:
    """Notes of the findings that came with chunks that succeeded.

    `files` has kind and fingerprint, `chunk_results` chunk_index, chunks, line_offset, summary and ok,
    `findings` chunk_index, pos, section_id, finding, line_start and line_end within the chunk.  Findings
    outside the primary sections and repeated ones go; lines become those of the file; the summary is
    the last one up to the chunk; chunk numbers are kept where a file has several chunks.
    """
    done = running_summary(chunk_results.where("ok"))
    rows = findings.join(done.select(*FILE, "chunk_index", "chunks", "line_offset", "summary_so_far"), [*FILE, "chunk_index"])
    rows = dedupe_findings(filter_valid_sections(rows)).join(files.select(*FILE, "kind", "fingerprint"), FILE)
    source = F.struct(
        F.col("rel_path").alias("file"),
        absolute_line(F.col("line_start"), F.col("line_offset")).cast("int").alias("line_start"),
        absolute_line(F.col("line_end"), F.col("line_offset")).cast("int").alias("line_end"),
        "fingerprint",
    )
    several = F.col("chunks") > 1
    return rows.select(
        "repo_id", "section_id", F.col("rel_path").alias("file"), F.col("summary_so_far").alias("summary"), "finding", F.array(source).alias("sources"),
        F.concat(F.lit("llm:"), "kind").alias("extractor"), F.when(several, F.col("chunk_index")).cast("int").alias("chunk"), F.when(several, F.col("chunks")).cast("int").alias("chunks"), F.col("pos").cast("long").alias("seq"),
    )


def replay_cached(hits: DataFrame) -> DataFrame:
    """Notes of stored findings (`summary`, `findings` of section_id, finding and sources) of files that have not changed."""
    none = F.lit(None).cast("int")
    rows = filter_valid_sections(hits.select(*FILE, "summary", F.posexplode("findings").alias("pos", "f")).select(*FILE, "summary", "pos", "f.*"))
    return rows.select(
        "repo_id", "section_id", F.col("rel_path").alias("file"), "summary", "finding", "sources", F.lit("cache").alias("extractor"), none.alias("chunk"), none.alias("chunks"), F.col("pos").cast("long").alias("seq")
    )


def union_notes(*branches: DataFrame) -> DataFrame:
    """The notes of all branches (model, contracts, stored) as one table."""
    out = branches[0].select(*NOTE)
    for b in branches[1:]:
        out = out.unionByName(b.select(*NOTE))
    return out


def findings_of_state(notes: DataFrame) -> DataFrame:
    """Notes back to what the state keeps of each file: its findings in order."""
    item = F.struct(F.coalesce("chunk", F.lit(0)).alias("c"), "seq", "section_id", "finding", "sources")
    rows = notes.groupBy("repo_id", F.col("file").alias("rel_path")).agg(F.sort_array(F.collect_list(item)).alias("f"))
    return rows.select(*FILE, F.transform("f", lambda x: F.struct(x["section_id"].alias("section_id"), x["finding"].alias("finding"), x["sources"].alias("sources"))).alias("findings"))


def section_request_lines(numbered: DataFrame, sections: DataFrame) -> DataFrame:
    """The lines of the request that asks for a section, in order of line_no: head, notes by number, end.

    One row for each line, so that a section may have any number of notes; `sections` has title and description.
    """
    per = numbered.groupBy("repo_id", "section_id").agg(F.count("*").alias("n")).join(F.broadcast(sections), "section_id")
    head = (
        F.concat(F.lit("## Section: "), "title", F.lit(" (id: "), "section_id", F.lit(")")), F.lit(""), F.lit("### Brief"), F.col("description"), F.lit(""),
        F.concat(F.lit("### Notes from "), F.col("n").cast("string"), F.lit(" file(s) — referenced by 1-based index in `source_indices`")),
    )
    heads = per.select("repo_id", "section_id", F.posexplode(F.array(*head)).alias("at", "line")).select("repo_id", "section_id", (F.col("at") - len(head)).cast("long").alias("line_no"), "line")
    refs = F.array_join(F.transform("sources", lambda s: render_ref(s["file"], s["line_start"], s["line_end"])), ", ")
    role = F.when(F.coalesce("summary", F.lit("")) == "", "").otherwise(F.concat(F.lit(" (file role: "), "summary", F.lit(")")))
    where = F.when(F.coalesce(F.size("sources"), F.lit(0)) > 0, refs).otherwise(F.coalesce("file", F.lit("?")))
    line = F.concat(F.lit("["), F.col("note_no").cast("string"), F.lit("] "), where, role, F.lit(": "), F.coalesce("finding", F.lit("")))
    return heads.unionByName(numbered.select("repo_id", "section_id", F.col("note_no").cast("long").alias("line_no"), line.alias("line")))


# Fixed texts of the request that edits a section.
BODY_HEAD = "### Current section body (preserve unchanged paragraphs verbatim)"
PART_HEADS = {
    "A": "### Added findings ({n}) — index against new_claims.source_indices",
    "R": "### Removed findings ({n}) — these no longer have source support; revise or drop the prose that depended on them",
    "C": "### Cached claims ({n}) — index into removed_claim_indices to drop any whose evidence is gone",
}
NO_ROWS = "_(none)_"
EDIT_END = "Edit the body to integrate the added findings and revise around the removed ones. Preserve unchanged paragraphs verbatim. Return SurgicalEdit per the schema."


def delta_request_lines(bodies: DataFrame, sections: DataFrame, added: DataFrame, removed: DataFrame, claims: DataFrame) -> DataFrame:
    """The lines of the requests that edit sections, in order of (part, line_no): head and body, then added notes (A), removed ids (R) and stored claims (C).

    `bodies` (repo_id, section_id, body) holds the sections that are edited, `sections` title and
    description, `added` note_no, file, summary and finding, `removed` no and finding_id, `claims`
    claim_idx and text.  Each list counts by numbers of its own and says so where it is empty.  Every line
    is a row (the body is one), so that a section may have any number of them.
    """
    key = ["repo_id", "section_id"]
    asked = bodies.select(*key, F.coalesce("body", F.lit("")).alias("body"))
    ids = asked.select(*key)
    role = F.when(F.coalesce("summary", F.lit("")) == "", "").otherwise(F.concat(F.lit(" (file role: "), "summary", F.lit(")")))
    texts = {
        "A": (added, "note_no", F.concat(F.coalesce("file", F.lit("?")), role, F.lit(": "), F.coalesce("finding", F.lit("")))),
        "R": (removed, "no", F.concat(F.lit("(cached finding id "), "finding_id", F.lit(")"))),
        "C": (claims, "claim_idx", F.coalesce("text", F.lit(""))),
    }

    def lines(table: DataFrame, part: int, *line) -> DataFrame:
        rows = F.posexplode(F.array(*line)).alias("line_no", "line")
        return table.select(*key, F.lit(part).alias("part"), rows).withColumn("line_no", F.col("line_no").cast("long"))

    named = asked.join(F.broadcast(sections), "section_id")
    head = (F.concat(F.lit("## Section: "), "title", F.lit(" (id: "), "section_id", F.lit(")")), F.lit(""), F.lit("### Brief"), F.col("description"), F.lit(""), F.lit(BODY_HEAD), F.lit("```markdown"), strip(F.col("body")), F.lit("```"), F.lit(""))
    out = lines(named, 0, *head)
    for k, (mark, (table, number, text)) in enumerate(texts.items()):
        own = table.join(ids, key, "left_semi")
        said = own.select(*key, F.lit(2 * k + 2).alias("part"), F.col(number).cast("long").alias("line_no"), F.concat(F.lit(f"[{mark}"), F.col(number).cast("string"), F.lit("] "), text).alias("line"))
        counted = ids.join(own.groupBy(*key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("string"))
        before, behind = PART_HEADS[mark].split("{n}")
        title = F.concat(F.lit(before), "n", F.lit(behind))
        # A blank line ends the list before this one.
        start = (F.lit(""), title) if k else (title,)
        out = out.unionByName(lines(counted.where("n <> '0'"), 2 * k + 1, *start)).unionByName(lines(counted.where("n = '0'"), 2 * k + 1, *start, F.lit(NO_ROWS))).unionByName(said)
    return out.unionByName(lines(ids, 2 * len(texts) + 1, F.lit(""), F.lit(EDIT_END)))


def extraction_requests(chunks: DataFrame, neighbors: DataFrame) -> DataFrame:
    return chunks.join(neighbors, FILE, "left").select(*FILE, "chunk_index", "chunks", "char_start", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"), "body")


def extraction_stats(routed: DataFrame, notes: DataFrame, chunk_results: DataFrame, failed: DataFrame) -> DataFrame:
    """Per repository the eight counters of a run but that by kind.

    `routed` has a row for each readable file, `failed` (repo_id, rel_path) those whose contract reader
    failed: they are skipped, not specialised, and so are files of a single chunk that failed and left no note.
    """
    by = ["repo_id"]
    one = F.lit(1).cast("long")
    files = routed.join(failed.select(*FILE, F.lit(True).alias("failed")), FILE, "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    with_notes = notes.groupBy("repo_id", F.col("file").alias("rel_path")).agg(F.count("*").alias("n"))
    chunks = chunk_results.groupBy(*FILE).agg(F.count_if("ok").alias("done"), F.max("chunks").alias("chunks"))
    files = files.join(with_notes, FILE, "left").join(chunks, FILE, "left")
    special = F.col("route").startswith("specialized:")
    lost = (F.col("route") == "model") & (F.col("chunks") == 1) & (F.col("done") == 0) & F.col("n").isNull()
    return files.groupBy(*by).agg(
        F.sum(one).alias("files_seen"),
        F.count("n").alias("files_with_findings"),
        F.sum(F.coalesce("n", F.lit(0))).alias("findings_total"),
        F.count_if((special & F.col("failed")) | F.coalesce(lost, F.lit(False))).alias("files_skipped"),
        F.sum(F.coalesce("done", F.lit(0))).alias("chunks_processed"),
        F.count_if(F.col("route") == "cache").alias("cache_hits"),
        F.count_if(special & ~F.col("failed")).alias("specialized_files"),
    )


def files_by_kind(routed: DataFrame) -> DataFrame:
    return routed.groupBy("repo_id", "kind").agg(F.count("*").alias("files"))
