"""Registered queries of contracts, notes, section paths and rendering, and their SQL.

Documents stand for contract files, whose text is made of their columns with their own whole text
as a comment or description; conversations stand for files, their turns for chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import chunking, contracts as co, delta, evidence, files as fo, imports as io, notes as no, report as ro, state as so
from ..sources.files import saved
from .catalog import EDGES, FID, FILES, FP, KIND, NOTES, corpus, documents_as_notes, read

SECTION = ["repo_id", "section_id"]

# --- contracts -------------------------------------------------------------------------------
#
# A document's whole text stands in its file as it is: as comments of DDL, proto and GraphQL files, as
# a summary in JSON, as a block of text in YAML.

_BODY = "coalesce(text, '')"
DDL = f"""concat('CREATE TABLE t', doc_id, ' (id INTEGER PRIMARY KEY, ', lang, '_name TEXT NOT NULL, ref_id INTEGER REFERENCES t', doc_id + 1, '(id)', CASE WHEN doc_id % 3 = 0 THEN ', code TEXT UNIQUE' ELSE '' END, ');', chr(10),
  CASE WHEN doc_id % 8 = 0 THEN concat('ALTER TABLE t', doc_id + 7, ' ADD COLUMN n', n_chars, ' INTEGER;') ELSE concat('CREATE INDEX ix', doc_id, ' ON t', doc_id, ' (id);') END, chr(10), '-- ', replace({_BODY}, chr(10), concat(chr(10), '-- ')))"""
PROTO = f"""concat('syntax = "proto3";', chr(10), 'package p.', lang, ';', chr(10), array_join(transform(sequence(1, CAST(doc_id % 30 + 1 AS INT)), k -> concat('message M', doc_id, '_', k, ' {{ string id = 1; }}', chr(10))), ''),
  'service S', doc_id, ' {{', chr(10), '  rpc Get', n_chars, '(A) returns (stream B);', chr(10), '  rpc Put(A) returns (B);', chr(10), '}}', chr(10), 'service E {{', chr(10), '}}', chr(10), '// ', replace({_BODY}, chr(10), concat(chr(10), '// ')))"""
SDL = f"""concat('type T', doc_id, ' {{', chr(10), '  id: ID!', chr(10), '}}', chr(10), 'type Query {{', chr(10), '  get_', lang, '(id: ID!): T', doc_id, chr(10), '  all: [T', doc_id, ']', chr(10), '}}', chr(10),
  'extend type Subscription {{', chr(10), '  on', n_chars, ': T', doc_id, chr(10), '}}', chr(10), '# ', replace({_BODY}, chr(10), concat(chr(10), '# ')))"""
API = f"""concat('{{"openapi": "3.0.0", "info": {{"title": "API ', doc_id, '", "version": "1.', n_chars, '"}}, "paths": {{"/', lang, '/', doc_id, '": {{"get": ', to_json(named_struct('summary', {_BODY})), ', "delete": {{}}}}}}, "components": {{"schemas": {{"S', doc_id, '": {{}}}},
  "securitySchemes": {{"k": {{"type": "apiKey"}}, "b": {{"type": "http"}}}}}}}}')"""
YAML = f"""concat('openapi: 3.0.0', chr(10), 'info:', chr(10), '  title: API ', doc_id, chr(10), '  version: "1.', n_chars, '"', chr(10), 'paths:', chr(10), '  /', lang, '/', doc_id, ':', chr(10), '    get:', chr(10), '      description: |', chr(10),
  '        Text:', chr(10), '        ', replace({_BODY}, chr(10), concat(chr(10), '        ')), chr(10), '        end', chr(10), '    delete: {{}}', chr(10), 'components:', chr(10), '  schemas: {{S', doc_id, ': {{}}}}', chr(10), '  securitySchemes:', chr(10), '    k: {{type: apiKey}}', chr(10), '    b:', chr(10), '      type: http', chr(10))"""
TEXT = f"CASE doc_id % 4 WHEN 0 THEN {DDL} WHEN 1 THEN {PROTO} WHEN 2 THEN {SDL} ELSE CASE WHEN doc_id % 8 = 3 THEN {API} ELSE {YAML} END END"
PATH = "concat(lang, CASE WHEN doc_id % 8 = 0 THEN '/migrations' ELSE '' END, '/c', doc_id, CASE doc_id % 4 WHEN 0 THEN '.sql' WHEN 1 THEN '.proto' WHEN 2 THEN '.graphql' ELSE CASE WHEN doc_id % 8 = 3 THEN '.json' ELSE '.yaml' END END)"


def contract_files(spark, sf) -> DataFrame:
    return fo.classify(read(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.expr(PATH).alias("rel_path"), F.expr(TEXT).alias("text")))


def u2_u6_contract_findings(spark, sf):
    """All findings of all contract files, with the summary of their file: U2-U6, T2."""
    rows = co.contract_findings(co.parse_contracts(contract_files(spark, sf)))
    return rows.select("repo_id", "rel_path", "kind", "summary", "section_id", "finding", "line_start", "line_end")


def j7_scope_rpcs(spark, sf):
    """A file of up to 40 services for each document, with none to three calls each and the document's text as a comment among them."""
    service = "concat('service S', k, ' {', chr(10), array_join(transform(sequence(1, k % 4), r -> if(k % 4 = 0, '', concat('  rpc C', k, '_', r, '(A) returns (B);', chr(10)))), ''), '}', chr(10))"
    text = f"concat('syntax = \"proto3\";', chr(10), '/* ', replace(replace({_BODY}, '*/', ''), chr(10), ' '), ' */', chr(10), array_join(transform(sequence(1, CAST(n_chars % 40 + 1 AS INT)), k -> {service}), ''))"
    files = read(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.concat(F.lit("p"), "doc_id", F.lit(".proto")).alias("rel_path"), F.lit("protobuf").alias("kind"), F.expr(text).alias("text"))
    scoped = co.scope_items(co.contract_items(co.parse_contracts(files), "rpc", "service"))
    return scoped.select("repo_id", "rel_path", "service", "name", "line")


def o3_touched_tables(spark, sf):
    return co.touched_tables(co.parse_contracts(co.files_of(contract_files(spark, sf), "migration")))


CONTRACTS = f"WITH f AS (SELECT source AS repo_id, {PATH} AS rel_path, coalesce(text, '') AS body, doc_id % 30 + 1 AS m, * FROM documents)\n"


def _rows(test: str, kind: str, summary: str, findings: list[tuple[str, str, str, str]]) -> str:
    """SQL of the findings of one kind of file: (section, text, first line, last line)."""
    return " UNION ALL ".join(
        f"SELECT repo_id, rel_path, {kind} AS kind, {summary} AS summary, '{section}' AS section_id, {text} AS finding, {a}::INTEGER AS line_start, {b}::INTEGER AS line_end FROM f WHERE {test}"
        for section, text, a, b in findings
    )


_MIGRATION = "doc_id % 8 = 0"
CONTRACT_SQL = CONTRACTS + " UNION ALL ".join(
    (
        _rows(
            "doc_id % 4 = 0", f"CASE WHEN {_MIGRATION} THEN 'migration' ELSE 'sql' END", f"CASE WHEN {_MIGRATION} THEN 'Migration touches 2 table(s).' ELSE 'Schema for 1 table(s).' END",
            [
                ("entities", f"concat(CASE WHEN {_MIGRATION} THEN 'Migration adds' ELSE 'Persists' END, ' the **t', doc_id, '** entity. Columns: id, ', lang, '_name, ref_id', CASE WHEN doc_id % 3 = 0 THEN ', code' ELSE '' END, '.')", "1", "1"),
                ("integrations", "concat('`t', doc_id, '.ref_id` references `t', doc_id + 1, '.id` — a hard relational link between these entities.')", "1", "1"),
                ("cross_cutting", "concat('Storage invariants on **t', doc_id, '**: ', CASE WHEN doc_id % 3 = 0 THEN 'UNIQUE, ' ELSE '' END, 'NOT NULL.')", "1", "1"),
            ],
        ),
        _rows(_MIGRATION, "'migration'", "'Migration touches 2 table(s).'", [("entities", "concat('Migration alters entity **t', doc_id + 7, '**: ADD COLUMN n', n_chars, ' INTEGER.')", "2", "2")]),
        _rows("doc_id % 8 = 4", "'sql'", "'Schema for 1 table(s).'", [("cross_cutting", "concat('Index `ix', doc_id, '` on **t', doc_id, '** — encodes a query-time performance invariant the new system must preserve.')", "2", "2")]),
        _rows(
            "doc_id % 4 = 1", "'protobuf'", "concat('Proto file: ', m, ' message(s), 2 service(s), 2 rpc(s)')",
            [
                ("entities", "concat('Protocol entities in package `p.', lang, '`:', list_reduce(list_prepend('', list_transform(range(1, least(m, 25) + 1), lambda k: concat(chr(10), '  - **M', doc_id, '_', k, '**'))), lambda a, b: a || b), CASE WHEN m > 25 THEN concat(chr(10), '  - … ', m - 25, ' more message(s) elided.') ELSE '' END)", "3", "(2 + m)"),
                ("integrations", "concat('Service **S', doc_id, '** exposes the following RPCs:', chr(10), '  - `Get', n_chars, '(A) -> stream B`', chr(10), '  - `Put(A) -> B`')", "(3 + m)", "(6 + m)"),
                ("integrations", "concat('Service **E** exposes the following RPCs:', chr(10), '  - (no RPCs detected)')", "(7 + m)", "(8 + m)"),
                ("capabilities", "'Wire protocol exposes 2 remote procedure(s) across 2 service(s).'", "NULL", "NULL"),
            ],
        ),
        _rows(
            "doc_id % 4 = 2", "'graphql'", "'GraphQL SDL: 1 type(s), Query, Subscription roots'",
            [
                ("entities", "concat('GraphQL domain types:', chr(10), '  - **T', doc_id, '**')", "1", "1"),
                ("capabilities", "concat('GraphQL **Query** root exposes:', chr(10), '  - `get_', lang, '`', chr(10), '  - `all`')", "4", "4"),
                ("integrations", "concat('GraphQL **Subscription** root exposes:', chr(10), '  - `on', n_chars, '`')", "8", "8"),
            ],
        ),
        _rows(
            "doc_id % 4 = 3", "'openapi'", "'API contract: 2 endpoint(s), 1 schema(s)'",
            [
                ("intent", "concat('The system exposes a public API titled **API ', doc_id, '** (v1.', n_chars, ').')", "NULL", "NULL"),
                ("capabilities", "concat('Public API surface (subset shown):', chr(10), '  - `GET /', lang, '/', doc_id, '`', CASE WHEN doc_id % 8 = 7 THEN concat(' — Text:', chr(10), body, chr(10), 'end', chr(10)) WHEN body = '' THEN '' ELSE ' — ' || body END, chr(10), '  - `DELETE /', lang, '/', doc_id, '`')", "NULL", "NULL"),
                ("integrations", "'Inbound integration: HTTP API exposes 2 endpoint(s) for external consumers.'", "NULL", "NULL"),
                ("entities", "concat('API schemas (request/response models):', chr(10), '  - **S', doc_id, '**')", "NULL", "NULL"),
                ("cross_cutting", "'Authentication contract for the API: scheme(s) `apiKey`, `http`.'", "NULL", "NULL"),
            ],
        ),
    )
)

# --- notes -----------------------------------------------------------------------------------


def _chunks(spark, sf) -> DataFrame:
    """Turns as chunk results: a conversation is a file, some chunks failed."""
    turns = read(spark, sf, "conversations")
    size = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("chunks"))
    return turns.join(size, "conv_id").select(
        (F.col("conv_id") % 10).cast("string").alias("repo_id"), F.col("conv_id").cast("string").alias("rel_path"), F.col("turn").alias("chunk_index"), "chunks", (F.col("turn") * 10).cast("int").alias("line_offset"),
        F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("summary"), (F.length("text") % 5 != 0).alias("ok"), "text",
    )


def _model_notes(spark, sf) -> DataFrame:
    chunks = _chunks(spark, sf)
    sections = F.array(*map(F.lit, [*no.PRIMARY, "nowhere"]))
    found = chunks.select(
        "repo_id", "rel_path", "chunk_index", F.lit(0).alias("pos"), F.get(sections, (F.col("chunk_index") % 9).cast("int")).alias("section_id"), F.col("text").alias("finding"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end")
    )
    files = chunks.select("repo_id", "rel_path", F.lit("application_code").alias("kind"), X.fingerprint(F.col("rel_path")).alias("fingerprint")).distinct()
    return no.apply_extraction(files, chunks.drop("text"), found)


def m2_apply_extraction(spark, sf):
    s = F.col("sources")[0]
    return _model_notes(spark, sf).select("repo_id", "section_id", "file", "summary", "finding", "extractor", "chunk", "chunks", s["line_start"].alias("line_start"), s["line_end"].alias("line_end"), s["fingerprint"].alias("fingerprint"))


CHUNKS = """WITH t AS (SELECT (conv_id % 10)::VARCHAR AS repo_id, conv_id::VARCHAR AS file, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS chunks, length(text) % 5 <> 0 AS ok FROM conversations),
  done AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN nullif(text, '') END IGNORE NULLS) OVER (PARTITION BY file ORDER BY turn ROWS UNBOUNDED PRECEDING), '') AS summary FROM t WHERE ok),
  valid AS (SELECT *, ['domains', 'intent', 'capabilities', 'external_dependencies', 'integrations', 'cross_cutting', 'entities', 'hard_specifications', 'nowhere'][turn % 9 + 1] AS section_id FROM done),
  notes AS (SELECT * FROM valid WHERE section_id <> 'nowhere' QUALIFY row_number() OVER (PARTITION BY file, section_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ORDER BY turn) = 1)
"""


def m3_o2_union_notes(spark, sf):
    """Notes of three branches: files of changed fingerprints by the model, others from the state, and contracts."""
    model = _model_notes(spark, sf)
    changed = F.col("file").cast("long") % 3 == 0
    state = no.findings_of_state(model.where(~changed)).withColumn("summary", F.lit("stored"))
    special = co.specialized_notes(co.parse_contracts(contract_files(spark, sf)))
    notes = no.union_notes(model.where(changed), no.replay_cached(state), special)
    return notes.groupBy("repo_id", "section_id", "extractor").agg(
        F.count("*").alias("notes"), F.countDistinct("file").alias("files"), F.sum(F.length("finding")).alias("finding_chars"), F.sum(F.length("summary")).alias("summary_chars"), F.sum(F.size("sources")).alias("sources")
    )


def a2_extraction_stats(spark, sf):
    chunks = _chunks(spark, sf)
    number = F.col("rel_path").cast("long")
    route = F.when(number % 3 != 0, "cache").when(number % 2 == 0, "specialized:sql").otherwise("model")
    routed = chunks.select("repo_id", "rel_path").distinct().withColumn("route", route)
    mine = routed.where("route = 'model'").select("repo_id", "rel_path")
    notes = _model_notes(spark, sf).join(mine.withColumnRenamed("rel_path", "file"), ["repo_id", "file"], "left_semi")
    failed = routed.where(number % 4 == 0).select("repo_id", "rel_path")
    return no.extraction_stats(routed, notes, chunks.join(mine, ["repo_id", "rel_path"], "left_semi"), failed)


def m4_section_requests(spark, sf):
    """Every line of every section's request; note lines by their digest."""
    lines = no.section_request_lines(no.number_notes(documents_as_notes(spark, sf)), _taxonomy(spark))
    return lines.select(*SECTION, "line_no", F.sha2("line", 256).alias("line_sha256"))


def m1_extraction_requests(spark, sf):
    """The requests of every file in chunks of the default size, and its text put together again from them; texts of more than 20,000 characters stand twelve times in their files."""
    files = corpus(spark, sf)
    near = io.nearest_neighbors(files.select("repo_id", "rel_path"), io.import_edges(files))
    long = files.withColumn("text", F.when(F.length("text") > 20_000, F.repeat("text", F.lit(12))).otherwise(F.col("text")))
    requests = no.extraction_requests(chunking.chunk_files(long), near)
    before = F.lag(F.col("char_start") + F.length("body"), 1, 0).over(Window.partitionBy("repo_id", "rel_path").orderBy("chunk_index"))
    more = requests.withColumn("more", F.substring("body", before - F.col("char_start") + 1, F.length("body")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "more"))), lambda x: x["more"]), "")
    return more.groupBy("repo_id", "rel_path").agg(
        F.first(F.array_join("neighbors", ",")).alias("neighbors"), (F.count("*") == F.max("chunks")).alias("complete"), (F.max("chunks") > 1).alias("several"), F.sha2(whole, 256).alias("text_sha256")
    )


# --- sections --------------------------------------------------------------------------------


def _section_hashes(spark, sf):
    """Live notes hashes, and a stored state in which some sections have another hash."""
    notes = documents_as_notes(spark, sf)
    live = so.notes_hash(notes)
    n = notes.groupBy(*SECTION).agg(F.count("*").alias("n"))
    state = live.join(n, SECTION).select(*SECTION, F.when(F.col("n") % 3 == 0, F.col("notes_hash")).otherwise("old").alias("notes_hash"), "n")
    return notes, live, state


def m5_section_paths(spark, sf):
    notes, live, state = _section_hashes(spark, sf)
    ids = notes.select(*SECTION, "seq", X.finding_id(F.col("file"), F.col("section_id"), F.col("finding")).alias("id"))
    was = ids.select(*SECTION, F.when(F.col("seq") % 9 == 0, F.reverse("id")).otherwise(F.col("id")).alias("id"))
    answers = state.select(*SECTION, F.explode(F.array(F.struct(F.lit("edit").alias("request"), (F.col("n") % 2 == 0).alias("ok")), F.struct(F.lit("rewrite").alias("request"), (F.col("n") % 5 != 0).alias("ok")))).alias("a")).select(*SECTION, "a.*")
    sections = notes.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, no.PRIMARY))).alias("section_id"))
    paths = delta.section_path(sections, live, state, delta.section_change_counts(was, ids), answers)
    return paths.select(*SECTION, "path", "stored", (F.col("stored_hash") == "old").alias("keeps_old"))


def _taxonomy(spark) -> DataFrame:
    return no.sections(spark).withColumns({"title": F.initcap(F.replace("section_id", F.lit("_"), F.lit(" "))), "description": F.concat(F.lit("All of "), "section_id")})


def _run_of_sections(spark, sf):
    """Notes, paths, state and answers of a run in which sections take all ways."""
    notes, live, state = _section_hashes(spark, sf)
    ids = notes.select(*SECTION, X.finding_id(F.col("file"), F.col("section_id"), F.col("finding")).alias("id"), "seq")
    was = ids.select(*SECTION, F.when(F.col("seq") % 9 == 0, F.reverse("id")).otherwise(F.col("id")).alias("id"))
    ask = lambda kind, ok: F.struct(F.lit(kind).alias("request"), ok.alias("ok"), F.concat(F.lit(f"{kind} of "), "section_id").alias("body"))
    answers = state.select(*SECTION, F.explode(F.array(ask("edit", F.col("n") % 2 == 0), ask("rewrite", F.col("n") % 5 != 0))).alias("a")).select(*SECTION, "a.*")
    sections = notes.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, no.PRIMARY))).alias("section_id"))
    paths = delta.section_path(sections, live, state, delta.section_change_counts(was, ids), answers)
    return notes, paths, state.withColumn("body", F.concat(F.lit("stored "), "section_id")), answers


def m5_write_back(spark, sf):
    """What a run shows of every section and leaves in the state."""
    _, paths, state, answers = _run_of_sections(spark, sf)
    return delta.write_back(paths, state, answers, _taxonomy(spark)).select(*SECTION, "path", "body", "in_state", (F.col("notes_hash") == "old").alias("keeps_old"), "stored_body")


def m5_fallback_lines(spark, sf):
    """The raw findings, whole, of all sections whose rewrite failed; lines by their digest."""
    notes, paths, _, _ = _run_of_sections(spark, sf)
    failed = paths.where("path = 'fallback'").select(*SECTION, F.lit("no answer").alias("error"))
    lines = delta.fallback_lines(no.number_notes(notes), failed, _taxonomy(spark))
    return lines.select(*SECTION, "line_no", F.sha2("line", 256).alias("line_sha256"))


def m4_delta_request(spark, sf):
    """Every line of the requests that edit sections: notes that are new since a run in which every ninth note read otherwise, ids that are gone, stored claims."""
    # Six lists of lines are made of these: they are numbered and compared once.
    numbered = saved(no.number_notes(documents_as_notes(spark, sf)).withColumn("id", X.finding_id(F.col("file"), F.col("section_id"), F.col("finding"))), "notes")
    live = numbered.select(*SECTION, (F.col("note_no") - 1).alias("place"), "id", "seq")
    state = live.withColumn("id", F.when(F.col("seq") % 9 == 0, F.reverse("id")).otherwise(F.col("id")))
    changed = saved(delta.changed_places(state, live).withColumn("range", F.floor(F.col("place") / evidence.CLAIMS)), "changes")
    counted = lambda change, name: evidence.numbered(changed.where(F.col("change") == change), SECTION, ["place"], ["range"], name)
    notes = numbered.select(*SECTION, (F.col("note_no") - 1).alias("place"), "file", "summary", "finding")
    added = counted("added", "note_no").join(notes, [*SECTION, "place"])
    removed = counted("removed", "no").withColumnRenamed("id", "finding_id")
    claims = numbered.where("file < 'f2'").select(*SECTION, F.col("note_no").alias("claim_idx"), F.concat(F.lit("claim of "), "file").alias("text"))
    bodies = numbered.groupBy(*SECTION).agg(F.min("finding").alias("body"))
    lines = no.delta_request_lines(bodies, _taxonomy(spark), added, removed, claims)
    return lines.select(*SECTION, "part", "line_no", F.sha2("line", 256).alias("line_sha256"))


def m6_derivation_paths(spark, sf):
    bodies = section_bodies(documents_as_notes(spark, sf))
    upstream = ro.collect_upstream(bodies, no.lineage(spark))
    n = upstream.groupBy(*SECTION).agg(F.count("*").alias("n"))
    hashes = so.upstream_hash(upstream).join(n, SECTION)
    state = hashes.select(*SECTION, F.when(F.col("n") % 2 == 0, "old").otherwise(F.col("upstream_hash")).alias("upstream_hash"), F.col("repo_id").endswith("1").alias("revised"))
    derived = bodies.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, no.DERIVED))).alias("section_id"))
    return ro.derivation_path(derived, hashes, state, review=True).select(*SECTION, "path", "stored_on_success")


def m6_derivation_state(spark, sf):
    """The state rows that a run of derivations leaves: answers for all but the diagrams, which fail."""
    bodies = section_bodies(documents_as_notes(spark, sf))
    hashes = so.upstream_hash(ro.collect_upstream(bodies, no.lineage(spark)))
    derived = bodies.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, no.DERIVED))).alias("section_id"))
    state = hashes.select(*SECTION, F.when(F.col("repo_id").endswith("1"), F.col("upstream_hash")).otherwise("old").alias("upstream_hash"), F.lit(True).alias("revised"))
    paths = ro.derivation_path(derived, hashes, state, review=True)
    answers = paths.where("path = 'derive'").select(*SECTION, F.concat(F.lit("derived "), "section_id").alias("body"), (F.col("section_id") != "diagrams").alias("ok"))
    return ro.derivation_rows(paths, answers, review=True).select(*SECTION, (F.col("upstream_hash") != "").alias("has_upstream"), "body", "revised")


def section_bodies(notes: DataFrame) -> DataFrame:
    """A body for each section: its least finding, or a placeholder where the last note's number is a fifth one."""
    return notes.groupBy(*SECTION).agg(F.when(F.max("seq") % 5 == 0, "_No Findings were extracted_").otherwise(F.concat(F.lit("no findings: "), F.min("finding"))).alias("body"))


BODIES = "bodies AS (SELECT repo_id, section_id, CASE WHEN max(seq) % 5 = 0 THEN '_No Findings were extracted_' ELSE 'no findings: ' || min(finding) END AS body FROM notes GROUP BY ALL)"
LINEAGE = """lin(section_id, upstream_id, ord) AS (VALUES ('personas', 'capabilities', 0), ('personas', 'intent', 1), ('personas', 'entities', 2), ('personas', 'integrations', 3), ('user_stories', 'personas', 0),
   ('user_stories', 'capabilities', 1), ('user_stories', 'entities', 2), ('diagrams', 'domains', 0), ('diagrams', 'entities', 1), ('diagrams', 'integrations', 2))"""
UPSTREAM = f"{BODIES}, {LINEAGE}, up AS (SELECT repo_id, lin.section_id, ord::INTEGER AS ord, upstream_id, body FROM lin JOIN bodies b ON b.section_id = lin.upstream_id WHERE lower(body) NOT LIKE '%no findings were extracted%')"


def j8_collect_upstream(spark, sf):
    up = ro.collect_upstream(section_bodies(documents_as_notes(spark, sf)), no.lineage(spark))
    return up.select(*SECTION, "ord", "upstream_id", F.sha2("body", 256).alias("body_sha256"))


def m9_context_pack(spark, sf):
    """Populated sections of a repository as one text: here placeholders are told by the chat's marker alone."""
    pack = ro.context_pack(section_bodies(documents_as_notes(spark, sf)), no.sections(spark))
    return pack.select("repo_id", F.sha2("context", 256).alias("context_sha256"))


def a7_short_circuit(spark, sf):
    """Which repositories need no model at all: all counters, scopes and stored sections are looked at."""
    notes, live, state = _section_hashes(spark, sf)
    every = notes.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, no.PRIMARY))).alias("section_id"))
    kept = every.join(live, SECTION, "left").select(*SECTION, F.coalesce("notes_hash", F.lit("")).alias("notes_hash"))
    fresh = so.aggregation_fresh(live, kept.where(~F.col("repo_id").endswith("2") | (F.col("section_id") != "intent")), no.PRIMARY)
    upstream = so.upstream_hash(ro.collect_upstream(section_bodies(notes), no.lineage(spark)))
    repos = notes.select("repo_id").distinct()
    spine = repos.select("repo_id", F.explode(F.array(*map(F.lit, no.DERIVED))).alias("section_id"))
    stored = spine.join(upstream, SECTION, "left").select(*SECTION, F.coalesce("upstream_hash", F.lit("")).alias("upstream_hash"), (~F.col("repo_id").endswith("3")).alias("revised"))
    derived = so.derivation_fresh(upstream, stored, tuple(no.DERIVED), review=True)
    files = corpus(spark, sf)
    slim = files.select("repo_id", "rel_path", X.fingerprint(F.col("text")).alias("fingerprint"), fo.kind(F.col("rel_path"), F.col("text")).alias("kind"))
    routed = fo.route(so.lookup_extraction(slim, slim.select("repo_id", "rel_path", F.when(F.col("repo_id").endswith("4"), "").otherwise(F.col("fingerprint")).alias("fingerprint"))))
    empty = routed.select("repo_id", "rel_path").limit(0)
    none = notes.select("repo_id", "file").limit(0)
    no_chunks = empty.select("repo_id", "rel_path", F.lit(True).alias("ok"), F.lit(1).alias("chunks"))
    stats = no.extraction_stats(routed, none, no_chunks, empty)
    scope = repos.select("repo_id", so.scope_hash(F.array("repo_id"), F.array(F.lit("*.x"), F.lit("a"))).alias("scope_hash"))
    prior = repos.select("repo_id", so.scope_hash(F.array("repo_id"), F.when(F.col("repo_id").endswith("5"), F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("*.x")))).alias("scope_hash"))
    return so.can_short_circuit(stats, scope, prior, fresh, derived)


def j10_merge_edit(spark, sf):
    """Every fourth claim of a section goes, and a new one for every third note refers to that note and the next."""
    notes = no.number_notes(documents_as_notes(spark, sf))
    stored = notes.select(*SECTION, F.col("note_no").alias("claim_idx"), F.col("finding").alias("text"), evidence.note_refs(F.col("file"), F.col("sources")).alias("sources"))
    removed = stored.where("claim_idx % 4 = 0").select(*SECTION, "claim_idx")
    new = notes.where("note_no % 3 = 0").select(*SECTION, F.col("note_no").alias("claim_idx"), F.concat(F.lit("new "), "file").alias("text"), F.array(F.col("note_no"), F.col("note_no") + 1, F.lit(0)).alias("note_indices"))
    merged = delta.merge_surgical_edit(stored, removed, new, notes)
    return merged.select(*SECTION, "claim_idx", F.sha2("text", 256).alias("text_sha256"), F.array_join(F.transform("sources", lambda s: s["file"]), ",").alias("files"))


def j10_contradictions(spark, sf):
    """Every fifth note of a section contradicts the next one: positions with the sources that their notes give, in place of stored contradictions."""
    notes = no.number_notes(documents_as_notes(spark, sf))
    side = lambda text, *at: F.struct(text.alias("text"), F.array(*at).alias("note_indices"))
    n = F.col("note_no")
    against = notes.where("note_no % 5 = 0").select(*SECTION, n.alias("c_idx"), F.concat(F.lit("differs from "), "file").alias("summary"), F.array(side(F.coalesce("finding", F.lit("")), n), side(F.lit("the next one"), n + 1, F.lit(0), n + 1)).alias("positions"))
    found = delta.resolve_contradictions(against, notes)
    files = lambda p: F.array_join(F.transform(p["sources"], lambda s: s["file"]), ",")
    return found.select(*SECTION, "c_idx", "summary", F.sha2(F.col("positions")[0]["text"], 256).alias("text_sha256"), F.array_join(F.transform("positions", files), ";").alias("files"))


def x8_m8_render_sections(spark, sf):
    """A conversation is a section: its even turns are the body, every turn is a claim with a source of its own, and all turns contradict each other."""
    turns = read(spark, sf, "conversations").select(
        (F.col("conv_id") % 10).cast("string").alias("repo_id"), F.col("conv_id").cast("string").alias("section_id"), F.col("turn").cast("int").alias("turn"), F.concat(F.lit("T"), F.col("turn").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")), F.lit(".")).alias("text")
    )
    whole = F.sort_array(F.collect_list(F.when(F.col("turn") % 2 == 0, F.struct("turn", "text"))))
    bodies = turns.groupBy(*SECTION).agg(F.array_join(F.transform(whole, lambda x: x["text"]), "\n").alias("body"))
    source = F.array(F.struct(F.lit("f.py").alias("file"), (F.col("turn") + 1).alias("line_start"), (F.col("turn") + 1 + F.col("turn") % 2).alias("line_end"), F.lit("").alias("fingerprint")))
    claims = turns.select(*SECTION, F.col("turn").alias("claim_idx"), "text", source.alias("sources"))
    sides = F.sort_array(F.collect_list(F.struct("claim_idx", "text", "sources")))
    against = claims.groupBy(*SECTION).agg(F.lit(0).alias("c_idx"), F.lit("turns differ").alias("summary"), F.transform(sides, lambda p: F.struct(p["text"].alias("text"), p["sources"].alias("sources"))).alias("positions"))
    return evidence.render_sections(bodies, claims, against).select(*SECTION, F.sha2("document", 256).alias("document_sha256"), F.length("document").cast("long").alias("n_chars"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RENDER = f"""WITH t AS (SELECT (conv_id % 10)::VARCHAR AS repo_id, conv_id::VARCHAR AS section_id, turn, 'T' || turn || ': ' || coalesce(text, '') || '.' AS text,
   'f.py:' || (turn + 1) || CASE WHEN turn % 2 = 1 THEN '-' || (turn + 2) ELSE '' END AS ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations),
  d AS (SELECT repo_id, section_id, trim(coalesce(string_agg(text || '[' || no || ']', chr(10) ORDER BY turn) FILTER (turn % 2 = 0) || chr(10), '') ||
    coalesce(chr(10) || '## Supporting claims' || chr(10) || string_agg('- ' || text || ' [' || no || ']', chr(10) ORDER BY turn) FILTER (turn % 2 = 1) || chr(10), '') ||
    chr(10) || '## Conflicts in source' || chr(10) || '{evidence.CONFLICTS}' || chr(10) || chr(10) || '- **turns differ**' || chr(10) ||
    string_agg('  - ' || text || ' (`' || ref || '`)', chr(10) ORDER BY turn) || chr(10) || chr(10) || '## Sources' || chr(10) || string_agg(no || '. `' || ref || '`', chr(10) ORDER BY turn), {_WS}) AS document
    FROM t GROUP BY repo_id, section_id)
  SELECT repo_id, section_id, sha256(document) AS document_sha256, length(document)::BIGINT AS n_chars FROM d"""

# --- files -----------------------------------------------------------------------------------


def f8_select_manifests(spark, sf):
    """Every document in a directory of its own, by a notable name or not, at several depths."""
    name = F.get(F.array(*map(F.lit, ("README.md", "Makefile", "notes.txt"))), (F.col("doc_id") % 3).cast("int"))
    deep = F.when(F.col("doc_id") % 5 == 0, "a/b/c/").otherwise("a/")
    files = read(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.concat("lang", F.lit("/"), deep, F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), name).alias("rel_path"), F.coalesce("text", F.lit("")).alias("text"))
    return fo.select_manifests(files, 3).select("repo_id", "rel_path", F.sha2("text", 256).alias("text_sha256"), F.array_join("place", "/").alias("place"))


def s2_decode_text(spark, sf):
    """Bytes with every sort of line end and one that is no UTF-8, as text."""
    raw = F.concat(F.encode(F.concat(F.lit("a\rb\r\n"), F.coalesce("text", F.lit(""))), "UTF-8"), F.unhex(F.lit("FF0D0A")))
    return read(spark, sf, "documents").select("doc_id", F.sha2(X.decode_text(raw), 256).alias("text_sha256"))


def a4_coverage_report(spark, sf):
    """Coverage by section and in all: repositories of odd numbers have a state and no notes."""
    notes = documents_as_notes(spark, sf)
    odd = F.col("repo_id").rlike("[13579]$")
    state = notes.select("repo_id", F.concat("file", F.lit("."), "section_id").alias("rel_path"), (F.length("finding") % 3).alias("n")).groupBy("repo_id", "rel_path").agg(F.sum("n").alias("n_findings"))
    return ro.coverage_report(notes.where(~odd), state, no.PRIMARY)


def a2_files_by_kind(spark, sf):
    return no.files_by_kind(fo.classify(corpus(spark, sf)))


def a6_adjacency_pages(spark, sf):
    """Imports and importers of all files in pages of 50 names; every third file imports the hub of its repository as well."""
    files = corpus(spark, sf)
    hub = files.where(F.col("doc_id") % 3 == 0).select("repo_id", F.col("rel_path").alias("src"), F.lit("hub.py").alias("dst"))
    pages = io.adjacency_pages(io.import_edges(files).unionByName(hub), 50)
    return pages.select("repo_id", "rel_path", "side", "page", F.array_join("names", ",").alias("names"))


def a4_coverage_percent(spark, sf):
    """Files with findings of all files in the state: here notes are the documents with a label."""
    notes = documents_as_notes(spark, sf)
    labelled = notes.join(read(spark, sf, "labels").select(F.col("doc_id").alias("seq")).distinct(), "seq", "left_semi")
    contributing = labelled.groupBy("repo_id").agg(F.countDistinct("file").alias("with_findings"))
    state = notes.groupBy("repo_id").agg(F.countDistinct("file").alias("state_files"))
    return ro.coverage_percent(contributing, state)


QUERIES = {
    f.__name__: f
    for f in (
        f8_select_manifests, s2_decode_text, a4_coverage_percent, a4_coverage_report, a2_files_by_kind, a6_adjacency_pages, m4_delta_request, m5_write_back, m5_fallback_lines, u2_u6_contract_findings, j7_scope_rpcs, o3_touched_tables, m2_apply_extraction, m3_o2_union_notes, a2_extraction_stats, m4_section_requests, m1_extraction_requests,
        m5_section_paths, m6_derivation_paths, m6_derivation_state, j8_collect_upstream, m9_context_pack, a7_short_circuit, j10_merge_edit, j10_contradictions, x8_m8_render_sections,
    )
}

_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY repo_id, section_id ORDER BY file, seq)::INTEGER AS note_no FROM notes)"
_PATHS = f""", ids AS (SELECT *, {FID} AS id FROM notes), was AS (SELECT repo_id, section_id, CASE WHEN seq % 9 = 0 THEN reverse(id) ELSE id END AS id FROM ids),
  live AS (SELECT repo_id, section_id, id, count(*) AS n FROM ids GROUP BY ALL), old AS (SELECT repo_id, section_id, id, count(*) AS n FROM was GROUP BY ALL),
  joined AS (SELECT coalesce(l.repo_id, o.repo_id) AS repo_id, coalesce(l.section_id, o.section_id) AS section_id, coalesce(l.id, o.id) AS id, l.n AS ln, o.n AS wn FROM live l FULL JOIN old o ON l.repo_id = o.repo_id AND l.section_id = o.section_id AND l.id = o.id),
  agg AS (SELECT repo_id, section_id, bool_or(id = '') AS blank, coalesce(sum(CASE WHEN wn IS NULL THEN ln END), 0) + coalesce(sum(CASE WHEN ln IS NULL THEN wn END), 0) AS changed, coalesce(sum(ln), 0) AS total FROM joined GROUP BY ALL),
  n AS (SELECT repo_id, section_id, count(*) AS n FROM notes GROUP BY ALL), repos AS (SELECT DISTINCT repo_id FROM notes),
  spine AS (SELECT repo_id, unnest(['domains', 'intent', 'capabilities', 'external_dependencies', 'integrations', 'cross_cutting', 'entities', 'hard_specifications']) AS section_id FROM repos),
  paths AS (SELECT s.repo_id, s.section_id, n.n, CASE WHEN n.n IS NULL THEN 'empty' WHEN n.n % 3 = 0 THEN 'cached' WHEN NOT blank AND changed = 0 THEN 'unchanged' WHEN NOT blank AND changed / greatest(total, 1) <= 0.3 AND n.n % 2 = 0 THEN 'edited' WHEN n.n % 5 <> 0 THEN 'rewritten' ELSE 'fallback' END AS path
    FROM spine s LEFT JOIN n ON n.repo_id = s.repo_id AND n.section_id = s.section_id LEFT JOIN agg a ON a.repo_id = s.repo_id AND a.section_id = s.section_id)"""
_TITLE = "array_to_string(list_transform(string_split(section_id, '_'), lambda x: upper(x[1]) || x[2:]), ' ')"
_EXTRACTOR = "CASE WHEN file::BIGINT % 3 = 0 THEN 'llm:application_code' ELSE 'cache' END"
ORACLES = {
    "f8_select_manifests": """WITH f AS (SELECT source AS repo_id, lang || '/' || CASE WHEN doc_id % 5 = 0 THEN 'a/b/c/' ELSE 'a/' END || 'd' || doc_id || '/' AS dir, CASE doc_id % 3 WHEN 0 THEN 'README.md' WHEN 1 THEN 'Makefile' ELSE 'notes.txt' END AS name,
    doc_id % 5 = 0 AS deep, coalesce(text, '') AS text FROM documents)
  SELECT repo_id, dir || name AS rel_path, sha256(CASE WHEN length(text) > 20000 THEN left(text, 20000) || chr(10) || '... [truncated]' || chr(10) ELSE text END) AS text_sha256, dir || ' ' || name AS place FROM f WHERE name <> 'notes.txt' AND NOT deep""",
    "s2_decode_text": "SELECT doc_id, sha256('a' || chr(10) || 'b' || chr(10) || regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') || chr(65533) || chr(10)) AS text_sha256 FROM documents",
    "a4_coverage_report": NOTES
    + """, state AS (SELECT repo_id, file || '.' || section_id AS path, sum(length(finding) % 3) > 0 AS has FROM notes GROUP BY ALL), live AS (SELECT * FROM notes WHERE NOT regexp_matches(repo_id, '[13579]$')),
  repos AS (SELECT repo_id, count(*) AS stored, count(*) FILTER (has) AS has FROM state GROUP BY 1), ids AS (SELECT unnest(['domains', 'intent', 'capabilities', 'external_dependencies', 'integrations', 'cross_cutting', 'entities', 'hard_specifications']) AS section_id),
  per AS (SELECT repo_id, section_id, count(*) AS findings, count(DISTINCT file) AS files FROM live GROUP BY ALL), every AS (SELECT repo_id, count(*) AS findings, count(DISTINCT file) AS files FROM live GROUP BY ALL),
  total AS (SELECT r.repo_id, coalesce(findings, 0) AS findings, coalesce(files, has) AS files, greatest(coalesce(files, 0), stored) AS total FROM repos r LEFT JOIN every e ON e.repo_id = r.repo_id)
  SELECT r.repo_id, i.section_id, coalesce(findings, 0) AS findings, coalesce(files, 0) AS files, NULL::BIGINT AS total_files, NULL::DOUBLE AS percent FROM repos r CROSS JOIN ids i LEFT JOIN per p ON p.repo_id = r.repo_id AND p.section_id = i.section_id
  UNION ALL SELECT repo_id, NULL, findings, files, total, round_even(files * 100.0 / total, 1)::DOUBLE FROM total""",
    "a2_files_by_kind": FILES + f"SELECT repo_id, {KIND} AS kind, count(*) AS files FROM files GROUP BY 1, 2",
    "a6_adjacency_pages": FILES
    + f""", {EDGES}, every AS (SELECT * FROM edges UNION SELECT repo_id, rel_path, 'hub.py' FROM files WHERE doc_id % 3 = 0), sides AS (SELECT repo_id, src AS rel_path, 'imports' AS side, dst AS name FROM every UNION SELECT repo_id, dst, 'imported_by', src FROM every),
  placed AS (SELECT *, ((row_number() OVER (PARTITION BY repo_id, rel_path, side ORDER BY name) - 1) // 50)::INTEGER AS page FROM sides)
  SELECT repo_id, rel_path, side, page, string_agg(name, ',' ORDER BY name) AS names FROM placed GROUP BY ALL""",
    "a4_coverage_percent": NOTES
    + """, c AS (SELECT repo_id, count(DISTINCT file) AS total_files, count(DISTINCT file) FILTER (seq IN (SELECT doc_id FROM labels)) AS with_findings FROM notes GROUP BY 1)
  SELECT repo_id, total_files, with_findings, round_even(with_findings * 100.0 / total_files, 1)::DOUBLE AS percent FROM c""",
    "u2_u6_contract_findings": CONTRACT_SQL,
    "j7_scope_rpcs": """WITH s AS (SELECT source AS repo_id, 'p' || doc_id || '.proto' AS rel_path, unnest(range(1, n_chars % 40 + 2)) AS k FROM documents),
  placed AS (SELECT *, 3 + sum(2 + k % 4) OVER (PARTITION BY rel_path ORDER BY k) - (2 + k % 4) AS line FROM s)
  SELECT repo_id, rel_path, 'S' || k AS service, 'C' || k || '_' || r AS name, (line + r)::INTEGER AS line FROM (SELECT *, unnest(range(1, k % 4 + 1)) AS r FROM placed)""",
    "o3_touched_tables": CONTRACTS + "SELECT repo_id, rel_path, 2::BIGINT AS tables FROM f WHERE doc_id % 8 = 0",
    "m2_apply_extraction": CHUNKS
    + f"SELECT repo_id, section_id, file, summary, text AS finding, 'llm:application_code' AS extractor, CASE WHEN chunks > 1 THEN turn END::INTEGER AS chunk, CASE WHEN chunks > 1 THEN chunks END::INTEGER AS chunks, (1 + turn * 10)::INTEGER AS line_start, (3 + turn * 10)::INTEGER AS line_end, {FP.replace('text', 'file')} AS fingerprint FROM notes",
    "m3_o2_union_notes": CHUNKS.replace("WITH t AS", CONTRACTS.replace("WITH ", "WITH ", 1).rstrip() + ", t AS", 1)
    + f", c AS ({CONTRACT_SQL[len(CONTRACTS):]}), every AS (SELECT repo_id, section_id, {_EXTRACTOR} AS extractor, file, text AS finding, CASE WHEN file::BIGINT % 3 = 0 THEN summary ELSE 'stored' END AS summary FROM notes UNION ALL SELECT repo_id, section_id, 'specialized:' || kind, rel_path, finding, summary FROM c)"
    + " SELECT repo_id, section_id, extractor, count(*) AS notes, count(DISTINCT file) AS files, sum(length(finding))::BIGINT AS finding_chars, sum(length(summary))::BIGINT AS summary_chars, count(*)::BIGINT AS sources FROM every GROUP BY ALL",
    "a2_extraction_stats": CHUNKS
    + """, files AS (SELECT DISTINCT repo_id, file, chunks, CASE WHEN file::BIGINT % 3 <> 0 THEN 'cache' WHEN file::BIGINT % 2 = 0 THEN 'special' ELSE 'model' END AS route, file::BIGINT % 4 = 0 AS failed FROM t),
  per AS (SELECT f.*, (SELECT count(*) FROM notes n WHERE n.file = f.file) AS n, (SELECT count(*) FROM done d WHERE d.file = f.file) AS ok_chunks FROM files f)
  SELECT repo_id, count(*) AS files_seen, count(*) FILTER (route = 'model' AND n > 0) AS files_with_findings, coalesce(sum(n) FILTER (route = 'model'), 0)::BIGINT AS findings_total,
    count(*) FILTER ((route = 'special' AND failed) OR (route = 'model' AND chunks = 1 AND ok_chunks = 0)) AS files_skipped, coalesce(sum(ok_chunks) FILTER (route = 'model'), 0)::BIGINT AS chunks_processed,
    count(*) FILTER (route = 'cache') AS cache_hits, count(*) FILTER (route = 'special' AND NOT failed) AS specialized_files FROM per GROUP BY 1""",
    "m4_section_requests": NOTES
    + f""", {_NUMBERED}, title AS (SELECT repo_id, section_id, count(*) AS n, array_to_string(list_transform(string_split(section_id, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM notes GROUP BY 1, 2),
  heads AS (SELECT repo_id, section_id, unnest(['## Section: ' || title || ' (id: ' || section_id || ')', '', '### Brief', 'All of ' || section_id, '', '### Notes from ' || n || ' file(s) — referenced by 1-based index in `source_indices`']) AS line, unnest([-6, -5, -4, -3, -2, -1])::BIGINT AS line_no FROM title)
  SELECT repo_id, section_id, line_no, sha256(line) AS line_sha256 FROM heads UNION ALL SELECT repo_id, section_id, note_no::BIGINT, sha256('[' || note_no || '] ' || file || ' (file role: role): ' || coalesce(finding, '')) FROM numbered""",
    "m5_section_paths": NOTES + f"{_PATHS} SELECT repo_id, section_id, path, path IN ('empty', 'edited', 'rewritten') AS stored, path IN ('unchanged', 'fallback') AS keeps_old FROM paths",
    "m5_write_back": NOTES
    + f"""{_PATHS}, rows AS (SELECT *, CASE path WHEN 'empty' THEN '_No findings were extracted for **' || {_TITLE} || '** during the last walk._' || chr(10) || chr(10) || '> Brief: All of ' || section_id || chr(10)
    WHEN 'cached' THEN 'stored ' || section_id WHEN 'unchanged' THEN 'stored ' || section_id WHEN 'edited' THEN 'edit of ' || section_id WHEN 'rewritten' THEN 'rewrite of ' || section_id END AS body FROM paths)
  SELECT repo_id, section_id, path, body, true AS in_state, path IN ('unchanged', 'fallback') AS keeps_old, CASE WHEN path IN ('cached', 'unchanged', 'fallback') THEN 'stored ' || section_id ELSE body END AS stored_body FROM rows""",
    "m5_fallback_lines": NOTES
    + f"""{_PATHS}, {_NUMBERED}, failed AS (SELECT *, {_TITLE} AS title FROM paths WHERE path = 'fallback')
  SELECT repo_id, section_id, unnest([-7, -6, -5, -4, -3, -2, -1])::BIGINT AS line_no, sha256(unnest(['_Aggregation failed for **' || title || '** (no answer). Raw notes preserved below._', '', '> Brief: All of ' || section_id, '', '', '## Raw findings', ''])) AS line_sha256 FROM failed
  UNION ALL SELECT n.repo_id, n.section_id, note_no::BIGINT, sha256('- **' || file || '** — ' || coalesce(finding, '')) FROM numbered n JOIN failed f ON f.repo_id = n.repo_id AND f.section_id = n.section_id""",
    "m4_delta_request": NOTES
    + f""", {_NUMBERED}, ids AS (SELECT *, {FID} AS id FROM numbered), was AS (SELECT *, CASE WHEN seq % 9 = 0 THEN reverse(id) ELSE id END AS old FROM ids), blank AS (SELECT DISTINCT repo_id, section_id FROM ids WHERE id = ''),
  gone AS (SELECT repo_id, section_id, old, row_number() OVER (PARTITION BY repo_id, section_id ORDER BY note_no) AS no FROM was w WHERE (repo_id, section_id) IN (SELECT repo_id, section_id FROM blank) OR NOT EXISTS (SELECT 1 FROM ids n WHERE w.repo_id = n.repo_id AND w.section_id = n.section_id AND w.old = n.id)),
  come AS (SELECT *, row_number() OVER (PARTITION BY repo_id, section_id ORDER BY note_no) AS no FROM ids n WHERE (repo_id, section_id) IN (SELECT repo_id, section_id FROM blank) OR NOT EXISTS (SELECT 1 FROM was w WHERE w.repo_id = n.repo_id AND w.section_id = n.section_id AND w.old = n.id)),
  s AS (SELECT repo_id, section_id, min(finding) AS body, count(*) FILTER (file < 'f2') AS c, {_TITLE} AS title FROM notes GROUP BY ALL),
  n AS (SELECT s.*, (SELECT count(*) FROM come x WHERE x.repo_id = s.repo_id AND x.section_id = s.section_id) AS a, (SELECT count(*) FROM gone x WHERE x.repo_id = s.repo_id AND x.section_id = s.section_id) AS r FROM s),
  lists AS (SELECT repo_id, section_id, 0 AS part, unnest(['## Section: ' || title || ' (id: ' || section_id || ')', '', '### Brief', 'All of ' || section_id, '', '### Current section body (preserve unchanged paragraphs verbatim)', '```markdown', trim(coalesce(body, ''), {_WS}), '```', '']) AS line, unnest(range(10)) AS line_no FROM n
    UNION ALL SELECT repo_id, section_id, 1, unnest(['### Added findings (' || a || ') — index against new_claims.source_indices', '_(none)_']), unnest([0, 1]) FROM n
    UNION ALL SELECT repo_id, section_id, 3, unnest(['', '### Removed findings (' || r || ') — these no longer have source support; revise or drop the prose that depended on them', '_(none)_']), unnest([0, 1, 2]) FROM n
    UNION ALL SELECT repo_id, section_id, 5, unnest(['', '### Cached claims (' || c || ') — index into removed_claim_indices to drop any whose evidence is gone', '_(none)_']), unnest([0, 1, 2]) FROM n
    UNION ALL SELECT repo_id, section_id, 7, unnest(['', 'Edit the body to integrate the added findings and revise around the removed ones. Preserve unchanged paragraphs verbatim. Return SurgicalEdit per the schema.']), unnest([0, 1]) FROM n
    UNION ALL SELECT repo_id, section_id, 2, '[A' || no || '] ' || file || ' (file role: role): ' || coalesce(finding, ''), no FROM come
    UNION ALL SELECT repo_id, section_id, 4, '[R' || no || '] (cached finding id ' || old || ')', no FROM gone
    UNION ALL SELECT repo_id, section_id, 6, '[C' || note_no || '] claim of ' || file, note_no FROM numbered WHERE file < 'f2')
  SELECT l.repo_id, l.section_id, part::INTEGER AS part, line_no::BIGINT AS line_no, sha256(line) AS line_sha256 FROM lists l JOIN n ON n.repo_id = l.repo_id AND n.section_id = l.section_id
  WHERE line <> '_(none)_' OR (CASE part WHEN 1 THEN a WHEN 3 THEN r ELSE c END) = 0""",
    "m6_derivation_paths": NOTES
    + f""", {UPSTREAM}, n AS (SELECT repo_id, section_id, count(*) AS n FROM up GROUP BY ALL), spine AS (SELECT repo_id, unnest(['personas', 'user_stories', 'diagrams']) AS section_id FROM (SELECT DISTINCT repo_id FROM notes))
  SELECT s.repo_id, s.section_id, CASE WHEN n IS NULL THEN 'skipped' WHEN n % 2 = 1 AND s.repo_id LIKE '%1' THEN 'cached' ELSE 'derive' END AS path, NOT (n IS NOT NULL AND n % 2 = 1 AND s.repo_id LIKE '%1') AS stored_on_success
  FROM spine s LEFT JOIN n ON n.repo_id = s.repo_id AND n.section_id = s.section_id""",
    "m6_derivation_state": NOTES
    + f""", {UPSTREAM}, n AS (SELECT repo_id, section_id, count(*) AS n FROM up GROUP BY ALL), spine AS (SELECT repo_id, unnest(['personas', 'user_stories', 'diagrams']) AS section_id FROM (SELECT DISTINCT repo_id FROM notes))
  SELECT s.repo_id, s.section_id, n IS NOT NULL AS has_upstream, CASE WHEN n IS NULL THEN '' ELSE 'derived ' || s.section_id END AS body, true AS revised FROM spine s LEFT JOIN n ON n.repo_id = s.repo_id AND n.section_id = s.section_id
  WHERE n IS NULL OR (s.repo_id NOT LIKE '%1' AND s.section_id <> 'diagrams')""",
    "j10_contradictions": NOTES
    + f""", {_NUMBERED} SELECT a.repo_id, a.section_id, a.note_no AS c_idx, 'differs from ' || a.file AS summary, sha256(coalesce(a.finding, '')) AS text_sha256, a.file || ';' || coalesce(b.file, '') AS files
  FROM numbered a LEFT JOIN numbered b ON b.repo_id = a.repo_id AND b.section_id = a.section_id AND b.note_no = a.note_no + 1 WHERE a.note_no % 5 = 0""",
    "j8_collect_upstream": NOTES + f", {UPSTREAM} SELECT repo_id, section_id, ord, upstream_id, sha256(body) AS body_sha256 FROM up",
    "m9_context_pack": NOTES
    + f""", {BODIES}, s AS (SELECT unnest(range(8)) AS ord, unnest(['domains', 'intent', 'capabilities', 'external_dependencies', 'integrations', 'cross_cutting', 'entities', 'hard_specifications']) AS section_id)
  SELECT repo_id, sha256(string_agg('# ' || b.section_id || chr(10) || chr(10) || trim(body, {_WS}), chr(10) || chr(10) ORDER BY ord)) AS context_sha256 FROM bodies b JOIN s ON s.section_id = b.section_id GROUP BY repo_id""",
    "a7_short_circuit": FILES
    + f""", kinds AS (SELECT *, {KIND} AS kind FROM files), seen AS (SELECT repo_id, bool_and(CASE WHEN repo_id LIKE '%4' THEN kind IN ('sql', 'protobuf') OR (kind = 'migration' AND doc_id % 8 = 4) ELSE true END) AS quiet FROM kinds GROUP BY 1)
  SELECT repo_id, quiet AND repo_id NOT LIKE '%2' AND repo_id NOT LIKE '%3' AND repo_id NOT LIKE '%5' AS short_circuit FROM seen""",
    "j10_merge_edit": NOTES
    + f""", {_NUMBERED}, every AS (SELECT repo_id, section_id, 0 AS part, note_no AS idx, finding AS text, file AS files FROM numbered WHERE note_no % 4 <> 0
  UNION ALL SELECT n.repo_id, n.section_id, 1, n.note_no, 'new ' || n.file, n.file || CASE WHEN m.file IS NULL OR m.file = n.file THEN '' ELSE ',' || m.file END FROM numbered n LEFT JOIN numbered m ON m.repo_id = n.repo_id AND m.section_id = n.section_id AND m.note_no = n.note_no + 1 WHERE n.note_no % 3 = 0)
  SELECT repo_id, section_id, row_number() OVER (PARTITION BY repo_id, section_id ORDER BY part, idx)::INTEGER AS claim_idx, sha256(text) AS text_sha256, files FROM every""",
    "x8_m8_render_sections": RENDER,
    "m1_extraction_requests": FILES
    + f""", {EDGES}, ranked AS (SELECT repo_id, rel_path, other, min(side) AS side FROM (SELECT repo_id, src AS rel_path, dst AS other, 0 AS side FROM edges UNION ALL SELECT repo_id, dst, src, 1 FROM edges) GROUP BY ALL)
  SELECT f.repo_id, f.rel_path, coalesce(string_agg(r.other, ',' ORDER BY side, r.other), '') AS neighbors, true AS complete, CASE WHEN any_value(length(f.text)) > 20000 THEN 12 * any_value(length(f.text)) ELSE any_value(length(f.text)) END > 150000 AS several,
    sha256(any_value(CASE WHEN length(f.text) > 20000 THEN repeat(f.text, 12) ELSE f.text END)) AS text_sha256
  FROM files f LEFT JOIN ranked r ON r.repo_id = f.repo_id AND r.rel_path = f.rel_path GROUP BY f.repo_id, f.rel_path""",
}
