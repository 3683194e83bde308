"""Registered queries of what is read and written: file corpora, notes, states and section documents, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import notes as no
from ..sources import files as sf_
from .catalog import FID, FILES, FP, NOTES, corpus, documents_as_notes, read

SECTION = ["repo_id", "section_id"]


def _folder(spark, name: str) -> str:
    return f"{sf_.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s1_read_files(spark, sf):
    """Every document's text as lines of files in a folder of its source, read back as files: bytes and characters of each folder."""
    root = _folder(spark, "corpus")
    read(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(root)
    files = sf_.with_text(sf_.read_files(spark, root, "corpus"))
    folder = F.substring_index("rel_path", "/", 1)
    return files.where(~X.file_name(F.col("rel_path")).startswith("_")).groupBy(folder.alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(F.length("text")).alias("chars"))


def s3_notes_roundtrip(spark, sf):
    """Notes appended in two writes by repository and section, and read again."""
    notes = documents_as_notes(spark, sf).select(*SECTION, "file", "finding", "seq")
    path = _folder(spark, "notes")
    for half in (notes.where("length(finding) % 2 = 0"), notes.where("finding IS NULL OR length(finding) % 2 = 1")):
        sf_.write_notes(half, path)
    back = sf_.read_notes(spark, path, "repo_id string, section_id string, file string, finding string, seq long, ts timestamp")
    return back.select(*SECTION, "file", "seq", F.sha2("finding", 256).alias("finding_sha256"), F.col("ts").isNotNull().alias("stamped"))


def s4_state_roundtrip(spark, sf):
    """All scopes of the state, each saved twice (the second time from what was loaded) and loaded again."""
    root, notes = _folder(spark, "state"), documents_as_notes(spark, sf)
    ids = notes.select(*SECTION, X.finding_id(F.col("file"), F.col("section_id"), F.col("finding")).alias("id"))
    tables = {
        "extraction": corpus(spark, sf).select("repo_id", F.col("rel_path").alias("key"), X.fingerprint(F.col("text")).alias("value")),
        "aggregation": ids.groupBy(*SECTION).agg(F.max("id").alias("value")).withColumnRenamed("section_id", "key"),
        "derivation": ids.groupBy("repo_id").agg(F.min("id").alias("value")).withColumn("key", F.lit("personas")),
        "scope": ids.groupBy("repo_id").agg(F.count("*").cast("string").alias("value")).withColumn("key", F.lit(None).cast("string")),
    }
    schema, out = "repo_id string, key string, value string", None
    for scope, table in tables.items():
        sf_.save_state(table.select("repo_id", "key", "value"), root, scope)
        sf_.save_state(sf_.load_state(spark, root, scope, schema).withColumn("value", F.concat("value", F.lit("!"))), root, scope)
        rows = sf_.load_state(spark, root, scope, schema).select(F.lit(scope).alias("scope"), "repo_id", "key", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def s5_write_sections(spark, sf):
    """The documents of all sections, written and read again: bodies are the greatest findings, sections without notes get a placeholder."""
    taxonomy = no.sections(spark).withColumns({"title": F.upper("section_id"), "description": F.concat(F.lit("All of "), "section_id")})
    bodies = documents_as_notes(spark, sf).groupBy(*SECTION).agg(F.coalesce(F.max("finding"), F.lit("")).alias("body"))
    path = _folder(spark, "sections")
    sf_.write_sections(sf_.section_documents(bodies, taxonomy, [*no.PRIMARY, *no.DERIVED]), path)
    return spark.read.parquet(path).select(*SECTION, F.sha2("document", 256).alias("document_sha256"))


QUERIES = {f.__name__: f for f in (s1_read_files, s3_notes_roundtrip, s4_state_roundtrip, s5_write_sections)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES = {
    "s1_read_files": "SELECT 'source=' || source AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, sum(length(regexp_replace(coalesce(text, '') || chr(10), '\\r\\n?', chr(10), 'g')))::BIGINT AS chars FROM documents GROUP BY 1",
    "s3_notes_roundtrip": NOTES + "SELECT repo_id, section_id, file, seq, sha256(finding) AS finding_sha256, true AS stamped FROM notes",
    "s4_state_roundtrip": FILES
    + f""", notes AS ({NOTES.split("notes AS (", 1)[1].rstrip().removesuffix(")")}), ids AS (SELECT repo_id, section_id, {FID} AS id FROM notes)
  SELECT 'extraction' AS scope, repo_id, rel_path AS key, {FP} || '!' AS value FROM files UNION ALL SELECT 'aggregation', repo_id, section_id, max(id) || '!' FROM ids GROUP BY ALL
  UNION ALL SELECT 'derivation', repo_id, 'personas', min(id) || '!' FROM ids GROUP BY ALL UNION ALL SELECT 'scope', repo_id, NULL, count(*) || '!' FROM ids GROUP BY ALL""",
    "s5_write_sections": NOTES
    + f""", ids AS (SELECT unnest(['domains', 'intent', 'capabilities', 'external_dependencies', 'integrations', 'cross_cutting', 'entities', 'hard_specifications', 'personas', 'user_stories', 'diagrams']) AS section_id),
  b AS (SELECT repo_id, section_id, coalesce(max(finding), '') AS body FROM notes GROUP BY ALL)
  SELECT r.repo_id, i.section_id, sha256('# ' || upper(i.section_id) || chr(10) || chr(10) || coalesce(trim(body, {_BLANKS}) || chr(10), '_Not yet populated. Run `srcatlas walk` to fill this section._' || chr(10) || chr(10) || '> All of ' || i.section_id || chr(10))) AS document_sha256
  FROM (SELECT DISTINCT repo_id FROM notes) r CROSS JOIN ids i LEFT JOIN b ON b.repo_id = r.repo_id AND b.section_id = i.section_id""",
}
