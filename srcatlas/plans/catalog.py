"""Registered queries of the repository-analysis operators, and their SQL.

The tables stand for source corpora: a document is a file of the repository `source`, a
conversation turn is a chunk of a file, and notes are findings of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import chunking, delta, evidence, files as fo, imports as io, notes as no, report as ro, state as so

EXTS = [".py", ".js", ".ts", ".go", ".sql", ".md", ".proto", ".yaml"]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """files(repo_id, rel_path, text, size, doc_id): every document as a source file."""
    folder = F.when(F.col("doc_id") % 10 == 3, "node_modules/").when(F.col("doc_id") % 10 == 4, "migrations/").otherwise("")
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    imports = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("from m"), (F.col("doc_id") + 40).cast("string"), F.lit(" import x\n"))).when(
        F.col("doc_id") % 8 == 1, F.concat(F.lit("import y from './m"), (F.col("doc_id") + 40).cast("string"), F.lit("';\n"))
    ).otherwise(F.lit(""))
    body = F.coalesce("text", F.lit(""))
    return read(spark, sf, "documents").select(
        F.col("source").alias("repo_id"),
        F.concat("lang", F.lit("/"), folder, F.lit("m"), F.col("doc_id").cast("string"), ext).alias("rel_path"),
        F.concat(imports, body).alias("text"),
        F.octet_length(F.concat(imports, body)).cast("long").alias("size"),
        "doc_id",
    )


FILES = """WITH files AS (SELECT source AS repo_id, doc_id,
  lang || '/' || CASE doc_id % 10 WHEN 3 THEN 'node_modules/' WHEN 4 THEN 'migrations/' ELSE '' END || 'm' || doc_id ||
  CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.go' WHEN 4 THEN '.sql' WHEN 5 THEN '.md' WHEN 6 THEN '.proto' ELSE '.yaml' END AS rel_path,
  CASE doc_id % 8 WHEN 0 THEN 'from m' || (doc_id + 40) || ' import x' || chr(10) WHEN 1 THEN 'import y from ''./m' || (doc_id + 40) || ''';' || chr(10) ELSE '' END || coalesce(text, '') AS text
  FROM documents)
"""
KIND = """CASE doc_id % 8 WHEN 4 THEN CASE WHEN doc_id % 10 = 4 THEN 'migration' ELSE 'sql' END WHEN 6 THEN 'protobuf' WHEN 5 THEN 'other' WHEN 7 THEN 'other'
  ELSE CASE WHEN doc_id % 10 = 4 THEN 'migration' ELSE 'application_code' END END"""
STRIPPED = "length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"


def former_state(files: DataFrame) -> DataFrame:
    """A former run: every fifth file had another name then, and every seventh another content."""
    fp = X.fingerprint(F.col("text"))
    path = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old/"), "rel_path")).otherwise(F.col("rel_path"))
    return files.select("repo_id", path.alias("rel_path"), F.when(F.col("doc_id") % 7 == 0, F.reverse(fp)).otherwise(fp).alias("fingerprint"))


def walk_changed_by_kind(spark, sf):
    """Which files changed since the last run, by kind: F1 F2 F3 X1 F4 J3 F5."""
    files = corpus(spark, sf)
    # The text is read once: all that later steps need is taken here, and the text goes no further.
    live = fo.filter_near_empty(fo.filter_size(fo.filter_ignored(files, own_rules=False)))
    slim = live.select("repo_id", "rel_path", X.fingerprint(F.col("text")).alias("fingerprint"), fo.kind(F.col("rel_path"), F.col("text")).alias("kind"))
    routed = fo.route(so.lookup_extraction(slim, former_state(files)))
    return routed.groupBy("repo_id", "kind", "route").agg(F.count("*").alias("files"))


def f1_f2_f3_live_files(spark, sf):
    return fo.filter_near_empty(fo.filter_size(fo.filter_ignored(corpus(spark, sf), own_rules=False))).select("repo_id", "rel_path", "size")


def f1_repository_rules(spark, sf):
    """The files that stay where repositories have a .gitignore, with rules that bring files back; one repository in three has none.

    Its rules: a suffix with exceptions by name and by wildcard, a directory at the root, one anywhere, a default that is lifted,
    and an exception below an ignored directory, which brings nothing back.
    """
    files = corpus(spark, sf).select("repo_id", "rel_path", "size")
    number = F.regexp_extract("repo_id", r"(\d+)$", 1).cast("int")
    rules = F.array_join(F.array(
        F.lit("# rules"), F.lit("*.go"), F.lit("!m*3.go"), F.lit("/de/"), F.lit("!de/m9.md"), F.lit("migrations/"), F.lit("!node_modules/"), F.lit("m[0-4]*.ts"), F.lit("**/m1?.md"), F.concat(F.lit("*.py\n!m"), number.cast("string"), F.lit("*.py")),
    ), "\n")
    ignores = files.select("repo_id").distinct().where(number % 3 != 0).select("repo_id", rules.alias("text"))
    return fo.filter_ignored(files, own_rules=ignores).select("repo_id", "rel_path", "size")


def f4_classify(spark, sf):
    return fo.classify(corpus(spark, sf)).groupBy("repo_id", "kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def x1_fingerprints(spark, sf):
    return corpus(spark, sf).select("repo_id", "rel_path", X.fingerprint(F.col("text")).alias("fingerprint"))


def a1_summarize_tree(spark, sf):
    tree = fo.summarize_tree(fo.filter_ignored(corpus(spark, sf), own_rules=False))
    return tree.select("repo_id", "dir", "depth", "file_count", "total_bytes", F.array_join(F.transform("extensions", lambda x: F.concat(x["ext"], F.lit("="), x["n"].cast("string"))), ",").alias("extensions"))


def x7_j1_j2_import_edges(spark, sf):
    return io.import_edges(corpus(spark, sf))


def a9_module_index(spark, sf):
    return io.module_index(corpus(spark, sf))


def a6_w4_neighbors(spark, sf):
    files = corpus(spark, sf)
    near = io.nearest_neighbors(files.select("repo_id", "rel_path"), io.import_edges(files))
    return near.select("repo_id", "rel_path", F.array_join("neighbors", ",").alias("neighbors"))


def j4_j5_upsert_state(spark, sf):
    """The state after a run: what is out of scope goes, what is new or changed is put in."""
    now = corpus(spark, sf).select("repo_id", "rel_path", X.fingerprint(F.col("text")).alias("fingerprint"))
    state = former_state(corpus(spark, sf))
    kept = so.prune_state(state, now)
    changed = so.lookup_extraction(now, kept).where("NOT hit").drop("hit")
    return so.upsert_state(kept.withColumn("written", F.lit("before")), changed.withColumn("written", F.lit("now")))


def j4_pruned(spark, sf):
    files = corpus(spark, sf)
    return so.count_pruned(former_state(files), files)


def a8_lookup_counts(spark, sf):
    files = corpus(spark, sf)
    return so.lookup_counts(so.lookup_extraction(files.select("repo_id", "rel_path", X.fingerprint(F.col("text")).alias("fingerprint")), former_state(files)))


def _turns(spark, sf):
    return read(spark, sf, "conversations").select(
        (F.col("conv_id") % 10).cast("string").alias("repo_id"), F.col("conv_id").cast("string").alias("rel_path"), F.col("turn").alias("chunk_index"), "role", "text"
    )


def w1_dedupe_findings(spark, sf):
    t = _turns(spark, sf).select("repo_id", "rel_path", "chunk_index", F.lit(0).alias("pos"), F.lit("intent").alias("section_id"), F.col("text").alias("finding"))
    return no.dedupe_findings(no.filter_valid_sections(t)).groupBy("repo_id").agg(F.count("*").alias("findings"), F.sum("chunk_index").alias("chunk_sum"))


def w2_running_summary(spark, sf):
    t = _turns(spark, sf).withColumn("summary", F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("")))
    return no.running_summary(t).select("rel_path", "chunk_index", "summary_so_far")


def a3_cacheable_files(spark, sf):
    return no.cacheable_files(_turns(spark, sf).withColumn("ok", F.length("text") % 5 != 0)).select("repo_id", "rel_path", "chunks_processed")


def documents_as_notes(spark, sf):
    """Every document as a note, its whole text as the finding."""
    ids = F.array(*map(F.lit, no.PRIMARY))
    return read(spark, sf, "documents").select(
        F.col("source").alias("repo_id"),
        F.element_at(ids, (F.col("doc_id") % 8 + 1).cast("int")).alias("section_id"),
        F.concat(F.lit("f"), (F.col("doc_id") % 300).cast("string")).alias("file"),
        F.lit("role").alias("summary"),
        F.col("text").alias("finding"),
        F.lit(None).cast("array<struct<file:string,line_start:int,line_end:int,fingerprint:string>>").alias("sources"),
        F.lit(None).cast("int").alias("chunk"),
        F.col("doc_id").alias("seq"),
    )


NOTES = """WITH notes AS (SELECT source AS repo_id, doc_id AS seq, 'f' || (doc_id % 300) AS file, text AS finding, CASE doc_id % 8
  WHEN 0 THEN 'domains' WHEN 1 THEN 'intent' WHEN 2 THEN 'capabilities' WHEN 3 THEN 'external_dependencies' WHEN 4 THEN 'integrations'
  WHEN 5 THEN 'cross_cutting' WHEN 6 THEN 'entities' ELSE 'hard_specifications' END AS section_id FROM documents)
"""


def _note_ids(spark, sf):
    """Notes by the digest of their finding: texts go no further."""
    return documents_as_notes(spark, sf).withColumn("id", X.finding_id(F.col("file"), F.col("section_id"), F.col("finding"))).select("repo_id", "section_id", "file", "chunk", "seq", "id")


def _altered(ids, every: int):
    """The ids of another run, in which every so manyth note read otherwise."""
    return F.when(F.col("seq") % every == 0, F.reverse(ids)).otherwise(ids)


def w3_x2_number_notes(spark, sf):
    return no.number_notes(_note_ids(spark, sf)).select("repo_id", "section_id", "note_no", "seq", F.col("id").alias("finding_id"))


def j6_section_change(spark, sf):
    n = _note_ids(spark, sf)
    return delta.section_change_counts(n.withColumn("id", _altered(F.col("id"), 9)), n)


def j6_changed_places(spark, sf):
    """Which notes of a section are new and which stored ones are gone, by place and id."""
    n = no.number_notes(_note_ids(spark, sf)).withColumn("place", F.col("note_no") - 1)
    return delta.changed_places(n.withColumn("id", _altered(F.col("id"), 9)), n)


def j11_diff_notes(spark, sf):
    """The whole text of every note that was added, by its digest."""
    n = documents_as_notes(spark, sf).withColumn("id", X.finding_id(F.col("file"), F.col("section_id"), F.col("finding")))
    run = lambda every: n.select("repo_id", "section_id", "finding", _altered(F.col("id"), every).alias("finding_id"))
    changed = delta.diff_notes(run(9), run(13))
    return changed.select("repo_id", "section_id", "finding_id", "change", F.sha2("finding", 256).alias("finding_sha256"))


def a4_coverage(spark, sf):
    return ro.coverage(documents_as_notes(spark, sf))


def x3_notes_hash(spark, sf):
    return so.notes_hash(documents_as_notes(spark, sf))


def w6_number_sources(spark, sf):
    n = documents_as_notes(spark, sf)
    refs = n.select("repo_id", "section_id", F.col("seq").alias("claim_idx"), F.lit(0).alias("seq"), F.col("file").alias("ref"))
    return evidence.number_sources(evidence.coalesce_refs(refs))


def j9_claim_sources(spark, sf):
    """Each note a claim that refers to itself, the next note and one out of range."""
    numbered = no.number_notes(_note_ids(spark, sf)).withColumn("sources", F.lit(None).cast(evidence.SOURCES))
    claims = numbered.select("repo_id", "section_id", F.col("note_no").alias("claim_idx"), F.lit("").alias("text"), F.array(F.col("note_no"), F.col("note_no") + 1, F.lit(0)).alias("note_indices"))
    found = evidence.claims_with_sources(claims, numbered)
    return found.select("repo_id", "section_id", "claim_idx", F.array_join(F.transform("sources", lambda x: x["file"]), ",").alias("refs"))


def m7_review_outcome(spark, sf):
    lab = read(spark, sf, "labels").select(
        (F.col("doc_id") % 10).cast("string").alias("repo_id"), F.col("doc_id").cast("string").alias("section_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("round"), "doc_id", "quality"
    )
    none = F.array().cast("array<string>")
    c = lab.select("repo_id", "section_id", "round", (F.col("doc_id") % 10 + F.col("round") * (F.col("quality") * 2 - 1)).alias("score"), none.alias("unsupported_claims"), F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.array(F.lit("gap"))).alias("gaps"))
    return ro.review_outcome(c).groupBy("revise", "accepted").agg(F.count("*").alias("n"))


def a5_section_report(spark, sf):
    """Bodies are the least findings of the sections; a section's critique comes from the labels of its documents."""
    notes = documents_as_notes(spark, sf)
    key = ["repo_id", "section_id"]
    bodies = notes.groupBy(*key).agg(F.concat(F.when(F.max("seq") % 5 == 0, "Not yet populated. ").otherwise(""), F.min("finding")).alias("body"))
    labelled = notes.join(read(spark, sf, "labels").select(F.col("doc_id").alias("seq"), "quality"), "seq")
    none = F.array().cast("array<string>")
    text = F.concat(F.lit("the section says nothing of the files after the first ones, among them "), F.col("n").cast("string"))
    critiques = labelled.groupBy(*key).agg(F.count("*").alias("n"), F.sum("quality").alias("good")).select(
        *key, (F.col("good") % 11).cast("long").alias("score"),
        F.when(F.col("n") % 3 == 0, F.array(text)).otherwise(none).alias("gaps"),
        F.when(F.col("n") % 3 <= 1, F.array(text)).otherwise(none).alias("unsupported_claims"),
    )
    return ro.section_report(notes, [*no.PRIMARY, *no.DERIVED], ro.coverage(notes), bodies, critiques)


def u1_chunk_text(spark, sf):
    """Each file put together again from its chunks by their places, and whether all chunks are in bounds."""
    c = chunking.chunk_files(corpus(spark, sf), 2000, 100)
    before = F.lag(F.col("char_start") + F.length("body"), 1, 0).over(Window.partitionBy("repo_id", "rel_path").orderBy("chunk_index"))
    c = c.withColumn("more", F.substring("body", before - F.col("char_start") + 1, F.length("body")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "more"))), lambda x: x["more"]), "")
    return c.groupBy("repo_id", "rel_path").agg(F.sha2(whole, 256).alias("text_sha256"), (F.max(F.length("body")) <= 2000).alias("within"))


QUERIES = {
    f.__name__: f
    for f in (
        walk_changed_by_kind, f1_f2_f3_live_files, f1_repository_rules, f4_classify, x1_fingerprints, a1_summarize_tree, x7_j1_j2_import_edges, a9_module_index, a6_w4_neighbors,
        j4_j5_upsert_state, j4_pruned, a8_lookup_counts, w1_dedupe_findings, w2_running_summary, a3_cacheable_files, w3_x2_number_notes, j6_section_change, j6_changed_places, j11_diff_notes,
        a4_coverage, x3_notes_hash, w6_number_sources, j9_claim_sources, m7_review_outcome, a5_section_report, u1_chunk_text,
    )
}

LIVE = f"doc_id % 10 <> 3 AND octet_length(encode(text)) <= 2000000 AND {STRIPPED} >= 64"
FP = "substring(sha256(text), 1, 12)"
STATE = f"state AS (SELECT repo_id, CASE WHEN doc_id % 5 = 0 THEN 'old/' || rel_path ELSE rel_path END AS rel_path, CASE WHEN doc_id % 7 = 0 THEN reverse({FP}) ELSE {FP} END AS fingerprint FROM files)"
EDGES = """edges AS (SELECT a.repo_id, a.rel_path AS src, b.rel_path AS dst FROM files a JOIN files b ON a.repo_id = b.repo_id AND b.doc_id = a.doc_id + 40
  WHERE a.doc_id % 8 = 0 OR (a.doc_id % 8 = 1 AND regexp_replace(a.rel_path, '[^/]*$', '') = regexp_replace(b.rel_path, '[^/]*$', '')))"""
FID = "CASE WHEN coalesce(finding, '') = '' THEN '' ELSE substring(sha256(file || '::' || section_id || '::' || finding), 1, 12) END"
ORACLES = {
    "walk_changed_by_kind": FILES
    + f", {STATE}, live AS (SELECT f.*, {KIND} AS kind, {FP} AS fp FROM files f WHERE {LIVE}), routed AS (SELECT live.repo_id, kind, CASE WHEN s.fingerprint IS NOT NULL THEN 'cache'"
    " WHEN kind IN ('sql', 'protobuf') OR (kind = 'migration' AND doc_id % 8 = 4) THEN 'specialized:' || kind ELSE 'model' END AS route"
    " FROM live LEFT JOIN state s ON s.repo_id = live.repo_id AND s.rel_path = live.rel_path AND s.fingerprint = live.fp)"
    " SELECT repo_id, kind, route, count(*) AS files FROM routed GROUP BY ALL",
    "f1_f2_f3_live_files": FILES + f"SELECT repo_id, rel_path, octet_length(encode(text))::BIGINT AS size FROM files WHERE {LIVE}",
    "f1_repository_rules": FILES
    + """, f AS (SELECT repo_id, rel_path, octet_length(encode(text))::BIGINT AS size, lang, doc_id AS d, doc_id % 8 AS e, doc_id % 10 AS r, regexp_extract(repo_id, '(\\d+)$', 1)::INTEGER AS n FROM files JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))
  SELECT repo_id, rel_path, size FROM f WHERE CASE WHEN n % 3 = 0 THEN r <> 3 ELSE r <> 4 AND lang <> 'de' AND (e <> 3 OR d % 10 = 3) AND NOT (e = 2 AND left(d::VARCHAR, 1) BETWEEN '0' AND '4')
    AND NOT (e = 5 AND d BETWEEN 10 AND 19) AND (e <> 0 OR starts_with(d::VARCHAR, n::VARCHAR)) END""",
    "f4_classify": FILES + f"SELECT repo_id, {KIND} AS kind, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM files GROUP BY 1, 2",
    "x1_fingerprints": FILES + f"SELECT repo_id, rel_path, {FP} AS fingerprint FROM files",
    "a1_summarize_tree": FILES
    + """, own AS (SELECT repo_id, regexp_replace(rel_path, '/[^/]*$', '') AS dir, regexp_extract(rel_path, '(\\.[a-z]+)$', 1) AS ext, regexp_extract(rel_path, '([^/]*)$', 1) AS name, octet_length(encode(text)) AS size FROM files WHERE doc_id % 10 <> 3),
  spine AS (SELECT DISTINCT repo_id, unnest(['', split_part(dir, '/', 1), dir]) AS dir FROM own),
  by_ext AS (SELECT repo_id, dir, ext, count(*) AS n, sum(size) AS bytes, min(name) AS first FROM own GROUP BY ALL),
  dirs AS (SELECT repo_id, dir, sum(n)::BIGINT AS file_count, sum(bytes)::BIGINT AS total_bytes, string_agg(ext || '=' || n, ',' ORDER BY n DESC, first) AS extensions FROM by_ext GROUP BY ALL)
  SELECT s.repo_id, s.dir, CASE WHEN s.dir = '' THEN 0 ELSE length(s.dir) - length(replace(s.dir, '/', '')) + 1 END::INTEGER AS depth, coalesce(file_count, 0) AS file_count, coalesce(total_bytes, 0) AS total_bytes, extensions
  FROM spine s LEFT JOIN dirs d ON s.repo_id = d.repo_id AND s.dir = d.dir""",
    "x7_j1_j2_import_edges": FILES + f", {EDGES} SELECT repo_id, src, dst FROM edges",
    "a6_w4_neighbors": FILES
    + f""", {EDGES}, ranked AS (SELECT repo_id, rel_path, other, min(rank) AS rank FROM (SELECT repo_id, src AS rel_path, dst AS other, 0 AS rank FROM edges
  UNION ALL SELECT repo_id, dst, src, 1 FROM edges) GROUP BY ALL)
  SELECT f.repo_id, f.rel_path, coalesce(string_agg(r.other, ',' ORDER BY rank, r.other), '') AS neighbors FROM files f LEFT JOIN ranked r ON r.repo_id = f.repo_id AND r.rel_path = f.rel_path GROUP BY ALL""",
    "j4_j5_upsert_state": FILES
    + f", {STATE} SELECT f.repo_id, f.rel_path, {FP} AS fingerprint, CASE WHEN s.fingerprint = {FP} THEN 'before' ELSE 'now' END AS written FROM files f LEFT JOIN state s ON s.repo_id = f.repo_id AND s.rel_path = f.rel_path",
    "j4_pruned": FILES + "SELECT repo_id, count(*) AS removed FROM files WHERE doc_id % 5 = 0 GROUP BY 1",
    "a9_module_index": FILES
    + """, parts AS (SELECT repo_id, rel_path, string_split(rel_path, '/') AS p, doc_id % 8 AS e, regexp_replace(rel_path, '\\.[a-z]+$', '') AS bare FROM files),
  tails AS (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM parts), keys AS (SELECT repo_id, rel_path, regexp_extract(bare, '([^/]+)$', 1) AS key FROM parts
  UNION SELECT repo_id, rel_path, replace(array_to_string(list_slice(string_split(bare, '/'), (len(p) - n + 1)::INT, len(p)), '/'), '/', '.') FROM tails WHERE e = 0
  UNION SELECT repo_id, rel_path, array_to_string(list_slice(p, (len(p) - n + 1)::INT, len(p)), '/') FROM tails WHERE e IN (1, 2, 3)
  UNION SELECT repo_id, rel_path, array_to_string(list_slice(string_split(bare, '/'), (len(p) - n + 1)::INT, len(p)), '/') FROM tails WHERE e IN (1, 2))
  SELECT repo_id, key, rel_path AS path FROM keys""",
    "a8_lookup_counts": FILES
    + f", {STATE} SELECT f.repo_id, count(s.fingerprint) AS hits, count(*) - count(s.fingerprint) AS misses FROM (SELECT *, {FP} AS fp FROM files) f LEFT JOIN state s ON s.repo_id = f.repo_id AND s.rel_path = f.rel_path AND s.fingerprint = f.fp GROUP BY 1",
    "w1_dedupe_findings": "SELECT (conv_id % 10)::VARCHAR AS repo_id, count(*) AS findings, sum(turn)::BIGINT AS chunk_sum FROM (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) GROUP BY 1",
    "w2_running_summary": "SELECT conv_id::VARCHAR AS rel_path, turn AS chunk_index, coalesce(last_value(CASE WHEN role = 'user' THEN nullif(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS summary_so_far FROM conversations",
    "a3_cacheable_files": "SELECT (conv_id % 10)::VARCHAR AS repo_id, conv_id::VARCHAR AS rel_path, count(*) AS chunks_processed FROM conversations GROUP BY conv_id HAVING bool_and(length(text) % 5 <> 0)",
    "w3_x2_number_notes": NOTES + f"SELECT repo_id, section_id, row_number() OVER (PARTITION BY repo_id, section_id ORDER BY file, seq)::INTEGER AS note_no, seq, {FID} AS finding_id FROM notes",
    "j6_section_change": NOTES
    + f""", ids AS (SELECT *, {FID} AS id FROM notes), live AS (SELECT repo_id, section_id, id, count(*) AS n FROM ids GROUP BY ALL),
  was AS (SELECT repo_id, section_id, CASE WHEN seq % 9 = 0 THEN reverse(id) ELSE id END AS id, count(*) AS n FROM ids GROUP BY ALL),
  both_ids AS (SELECT coalesce(l.repo_id, w.repo_id) AS repo_id, coalesce(l.section_id, w.section_id) AS section_id, coalesce(l.id, w.id) AS id, l.n AS ln, w.n AS wn
    FROM live l FULL JOIN was w ON l.repo_id = w.repo_id AND l.section_id = w.section_id AND l.id = w.id),
  agg AS (SELECT repo_id, section_id, bool_or(id = '') AS blank, coalesce(sum(wn), 0) = 0 AS fresh, coalesce(sum(CASE WHEN wn IS NULL THEN ln END), 0) AS added, coalesce(sum(CASE WHEN ln IS NULL THEN wn END), 0) AS removed,
    count(CASE WHEN ln IS NOT NULL AND wn IS NOT NULL THEN 1 END) AS same, coalesce(sum(ln), 0) AS total, coalesce(sum(wn), 0) AS cached FROM both_ids GROUP BY ALL)
  SELECT repo_id, section_id, CASE WHEN fresh OR blank THEN 'rewrite' WHEN added + removed = 0 THEN 'unchanged' WHEN total = 0 THEN 'rewrite' WHEN (added + removed) / total <= 0.3 THEN 'surgical' ELSE 'rewrite' END AS decision,
    (CASE WHEN fresh OR blank THEN total ELSE added END)::INTEGER AS added, (CASE WHEN fresh THEN 0 WHEN blank THEN cached ELSE removed END)::INTEGER AS removed,
    (CASE WHEN fresh OR blank THEN 0 ELSE same END)::INTEGER AS unchanged_count, total::INTEGER AS total_live,
    (CASE WHEN fresh OR blank THEN total + CASE WHEN fresh THEN 0 ELSE cached END ELSE added + removed END) / total AS churn FROM agg""",
    "j6_changed_places": NOTES
    + f""", ids AS (SELECT *, {FID} AS id, (row_number() OVER (PARTITION BY repo_id, section_id ORDER BY file, seq) - 1)::INTEGER AS place FROM notes),
  was AS (SELECT repo_id, section_id, place, CASE WHEN seq % 9 = 0 THEN reverse(id) ELSE id END AS id FROM ids), blank AS (SELECT DISTINCT repo_id, section_id FROM ids WHERE id = '')
  SELECT repo_id, section_id, 'added' AS change, place, id FROM ids n WHERE (repo_id, section_id) IN (SELECT repo_id, section_id FROM blank) OR NOT EXISTS (SELECT 1 FROM was w WHERE w.repo_id = n.repo_id AND w.section_id = n.section_id AND w.id = n.id)
  UNION ALL SELECT repo_id, section_id, 'removed', place, id FROM was w WHERE (repo_id, section_id) IN (SELECT repo_id, section_id FROM blank) OR NOT EXISTS (SELECT 1 FROM ids n WHERE w.repo_id = n.repo_id AND w.section_id = n.section_id AND w.id = n.id)""",
    "j11_diff_notes": NOTES
    + f""", ids AS (SELECT *, {FID} AS id FROM notes), was AS (SELECT repo_id, section_id, CASE WHEN seq % 9 = 0 THEN reverse(id) ELSE id END AS id FROM ids),
  now AS (SELECT repo_id, section_id, finding, CASE WHEN seq % 13 = 0 THEN reverse(id) ELSE id END AS id FROM ids)
  SELECT repo_id, section_id, id AS finding_id, 'added' AS change, sha256(finding) AS finding_sha256 FROM now n WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.repo_id = n.repo_id AND w.section_id = n.section_id AND w.id = n.id)
  UNION ALL SELECT repo_id, section_id, id, 'removed', NULL FROM was w WHERE NOT EXISTS (SELECT 1 FROM now n WHERE w.repo_id = n.repo_id AND w.section_id = n.section_id AND w.id = n.id)""",
    "x3_notes_hash": NOTES
    + """, one AS (SELECT repo_id, section_id, file, seq, substring(sha256(file), 1, 3) AS g, substring(sha256(concat_ws(chr(1), file, 'role', coalesce(finding, ''), '')), 1, 12) AS h FROM notes),
  parts AS (SELECT repo_id, section_id, g, substring(sha256(string_agg(h, chr(1) ORDER BY file, seq)), 1, 12) AS d FROM one GROUP BY ALL)
  SELECT repo_id, section_id, substring(sha256(string_agg(d, chr(1) ORDER BY g)), 1, 12) AS notes_hash FROM parts GROUP BY ALL""",
    "j9_claim_sources": NOTES
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id, section_id ORDER BY file, seq)::INTEGER AS note_no FROM notes)
  SELECT a.repo_id, a.section_id, a.note_no AS claim_idx, a.file || CASE WHEN b.file IS NULL OR b.file = a.file THEN '' ELSE ',' || b.file END AS refs
  FROM numbered a LEFT JOIN numbered b ON b.repo_id = a.repo_id AND b.section_id = a.section_id AND b.note_no = a.note_no + 1""",
    "a4_coverage": NOTES + "SELECT repo_id, section_id, count(*) AS findings, count(DISTINCT file) AS files FROM notes GROUP BY GROUPING SETS ((repo_id, section_id), (repo_id))",
    "w6_number_sources": NOTES
    + "SELECT repo_id, section_id, file AS ref, row_number() OVER (PARTITION BY repo_id, section_id ORDER BY first, file)::INTEGER AS number FROM (SELECT repo_id, section_id, file, min(seq) AS first FROM notes GROUP BY ALL)",
    "m7_review_outcome": "SELECT revise, revise AND quality = 1 AS accepted, count(*) AS n FROM (SELECT doc_id % 10 < 7 AND doc_id % 3 <> 0 AS revise, quality FROM labels) GROUP BY ALL",
    "a5_section_report": NOTES
    + """, sections AS (SELECT unnest(range(11))::INT AS ord, unnest(['domains', 'intent', 'capabilities', 'external_dependencies', 'integrations', 'cross_cutting',
      'entities', 'hard_specifications', 'personas', 'user_stories', 'diagrams']) AS section_id),
    counts AS (SELECT repo_id, section_id, count(DISTINCT file) AS files, count(*) AS findings,
      CASE WHEN max(seq) % 5 = 0 THEN 'Not yet populated. ' ELSE '' END || min(finding) AS body FROM notes GROUP BY ALL),
    critiques AS (SELECT repo_id, section_id, count(*) AS n, (sum(quality) % 11)::BIGINT AS score FROM notes JOIN labels ON doc_id = seq GROUP BY ALL),
    joined AS (SELECT r.repo_id, ord, s.section_id, coalesce(files, 0) AS files, coalesce(findings, 0) AS findings, coalesce(body, '') AS body, n, score,
      coalesce(body, '') LIKE '%Not yet populated%' OR coalesce(body, '') LIKE '%No findings were extracted%' OR lower(coalesce(body, '')) LIKE '%upstream sections required to derive%' AS is_empty
      FROM (SELECT DISTINCT repo_id FROM notes) r CROSS JOIN sections s LEFT JOIN counts c ON c.repo_id = r.repo_id AND c.section_id = s.section_id
      LEFT JOIN critiques q ON q.repo_id = r.repo_id AND q.section_id = s.section_id),
    scored AS (SELECT * REPLACE (CASE WHEN is_empty OR trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN NULL ELSE score END AS score),
      'the section says nothing of the files after the first ones, among them ' || n AS said FROM joined)
    SELECT repo_id, ord, section_id, files, findings, length(body) AS body_chars, is_empty, score,
      CASE WHEN score IS NOT NULL AND n % 3 = 0 THEN left(said, 60) WHEN score IS NOT NULL AND n % 3 = 1 THEN 'unsupported: ' || left(said, 50)
      WHEN is_empty THEN 'no findings' ELSE '' END AS gap, avg(score) OVER (PARTITION BY repo_id) AS overall FROM scored""",
    "u1_chunk_text": FILES + "SELECT repo_id, rel_path, sha256(text) AS text_sha256, true AS within FROM files",
}
