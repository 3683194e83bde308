import random
import time

from pyspark.sql import functions as F

from srcatlas.operators import delta, evidence as ev, notes as no, report as ro, state as so
from srcatlas.operators.markers import annotated

SRC = "array<struct<file:string,line_start:int,line_end:int,fingerprint:string>>"
FILES = "repo_id string, rel_path string, kind string, fingerprint string"
RESULTS = "repo_id string, rel_path string, chunk_index int, chunks int, line_offset int, summary string, ok boolean"
FINDINGS = "repo_id string, rel_path string, chunk_index int, pos int, section_id string, finding string, line_start int, line_end int"


def extraction(spark):
    files = spark.createDataFrame([("r", "a.py", "application_code", "fa"), ("r", "b.py", "application_code", "fb")], FILES)
    results = spark.createDataFrame(
        [("r", "a.py", 0, 3, 0, "first", True), ("r", "a.py", 1, 3, 10, "", True), ("r", "a.py", 2, 3, 20, "lost", False), ("r", "b.py", 0, 1, 0, "only", True)], RESULTS
    )
    found = spark.createDataFrame(
        [
            ("r", "a.py", 0, 0, "intent", "x ", 1, 2), ("r", "a.py", 1, 0, "intent", "x", 5, 6), ("r", "a.py", 1, 1, "entities", "y", 3, 4), ("r", "a.py", 2, 0, "entities", "z", 1, 1),
            ("r", "a.py", 0, 1, "personas", "derived", 1, 1), ("r", "b.py", 0, 0, "intent", "x", None, None),
        ],
        FINDINGS,
    )
    return files, results, found


def test_findings_become_notes(spark):
    rows = {(r.file, r.section_id): r for r in no.apply_extraction(*extraction(spark)).collect()}
    assert set(rows) == {("a.py", "intent"), ("a.py", "entities"), ("b.py", "intent")}
    first, second, other = rows["a.py", "intent"], rows["a.py", "entities"], rows["b.py", "intent"]
    assert (first.finding, first.summary, first.chunk, first.chunks, first.extractor) == ("x ", "first", 0, 3, "llm:application_code")
    assert (second.summary, second.chunk, tuple(second.sources[0])) == ("first", 1, ("a.py", 13, 14, "fa"))
    assert (other.chunk, other.chunks, tuple(other.sources[0])) == (None, None, ("b.py", None, None, "fb"))


def test_stored_findings_come_back_as_notes(spark):
    notes = no.apply_extraction(*extraction(spark))
    state = no.findings_of_state(notes).withColumn("summary", F.lit("kept"))
    again = no.replay_cached(state)
    content = lambda df: sorted((r.file, r.section_id, r.finding, str(r.sources)) for r in df.collect())
    assert content(again) == content(notes) and {(r.extractor, r.summary, r.chunk) for r in again.collect()} == {("cache", "kept", None)}
    assert no.union_notes(notes, again).count() == 6
    odd = spark.createDataFrame([("r", "c.py", "s", [("nowhere", "f", [])])], f"repo_id string, rel_path string, summary string, findings array<struct<section_id:string,finding:string,sources:{SRC}>>")
    assert no.replay_cached(odd).count() == 0


def test_all_counters(spark):
    _, results, _ = extraction(spark)
    routed = spark.createDataFrame([("r", p, r) for p, r in (("a.py", "model"), ("b.py", "model"), ("c.sql", "specialized:sql"), ("d.sql", "specialized:sql"), ("e.py", "cache"), ("f.py", "model"))], "repo_id string, rel_path string, route string")
    results = results.unionByName(spark.createDataFrame([("r", "f.py", 0, 1, 0, "", False)], RESULTS))
    failed = spark.createDataFrame([("r", "d.sql")], "repo_id string, rel_path string")
    row = no.extraction_stats(routed, no.apply_extraction(*extraction(spark)), results, failed).first().asDict()
    assert row == {"repo_id": "r", "files_seen": 6, "files_with_findings": 2, "findings_total": 3, "files_skipped": 2, "chunks_processed": 3, "cache_hits": 1, "specialized_files": 1}


def test_notes_are_numbered_over_files(spark):
    rows = [("r", "s", f, c, q) for f, c, q in (("b", 0, 1), ("a", 1, 1), ("a", 0, 2), ("a", 0, 1), ("c", None, 1))]
    df = spark.createDataFrame(rows, "repo_id string, section_id string, file string, chunk int, seq long")
    got = {(r.file, r.chunk, r.seq): r.note_no for r in no.number_notes(df).collect()}
    assert got == {("a", 0, 1): 1, ("a", 0, 2): 2, ("a", 1, 1): 3, ("b", 0, 1): 4, ("c", None, 1): 5}


def test_request_lines(spark):
    notes = spark.createDataFrame(
        [("r", "s", "a.py", "role", "one", [("a.py", 1, 2, ""), ("b.py", None, None, "")], None, 1), ("r", "s", "b.py", None, "two", None, None, 1)],
        f"repo_id string, section_id string, file string, summary string, finding string, sources {SRC}, chunk int, seq long",
    )
    about = spark.createDataFrame([("s", "Title", "About.")], "section_id string, title string, description string")
    lines = [r.line for r in no.section_request_lines(no.number_notes(notes), about).orderBy("line_no").collect()]
    assert lines == ["## Section: Title (id: s)", "", "### Brief", "About.", "", "### Notes from 2 file(s) — referenced by 1-based index in `source_indices`", "[1] a.py:1-2, b.py (file role: role): one", "[2] b.py: two"]


def test_edit_requests(spark):
    key = "repo_id string, section_id string"
    about = spark.createDataFrame([("s", "Title", "About."), ("t", "Other", "More.")], "section_id string, title string, description string")
    bodies = spark.createDataFrame([("r", "s", " Body.\nTwo. "), ("r", "t", None)], f"{key}, body string")
    added = spark.createDataFrame([("r", "s", 1, "a.py", "role", "one"), ("r", "s", 2, None, None, "two"), ("r", "u", 1, "x", "", "not asked")], f"{key}, note_no int, file string, summary string, finding string")
    removed = spark.createDataFrame([("r", "s", 1, "abc")], f"{key}, no int, finding_id string")
    claims = spark.createDataFrame([("r", "t", 1, "claim")], f"{key}, claim_idx int, text string")
    lines = {}
    for r in no.delta_request_lines(bodies, about, added, removed, claims).orderBy("part", "line_no").collect():
        lines.setdefault(r.section_id, []).append(r.line)
    end = ["", "Edit the body to integrate the added findings and revise around the removed ones. Preserve unchanged paragraphs verbatim. Return SurgicalEdit per the schema."]
    heads = no.PART_HEADS
    first = ["## Section: Title (id: s)", "", "### Brief", "About.", "", no.BODY_HEAD, "```markdown", "Body.\nTwo.", "```", ""]
    assert lines.pop("s") == [
        *first, heads["A"].format(n=2), "[A1] a.py (file role: role): one", "[A2] ?: two", "", heads["R"].format(n=1), "[R1] (cached finding id abc)", "", heads["C"].format(n=0), no.NO_ROWS, *end
    ]
    assert lines.pop("t")[10:] == [heads["A"].format(n=0), no.NO_ROWS, "", heads["R"].format(n=0), no.NO_ROWS, "", heads["C"].format(n=1), "[C1] claim", *end] and not lines


def test_what_is_written_back(spark):
    key = "repo_id string, section_id string"
    about = spark.createDataFrame([(s, s.title(), f"About {s}.") for s in ("empty", "kept", "edited", "failed", "new")], "section_id string, title string, description string")
    paths = spark.createDataFrame(
        [("r", "empty", "empty", True, ""), ("r", "kept", "unchanged", False, "old"), ("r", "edited", "edited", True, "now"), ("r", "failed", "fallback", False, "old"), ("r", "new", "fallback", False, None)],
        f"{key}, path string, stored boolean, stored_hash string",
    )
    state = spark.createDataFrame([("r", s, "old", f"old {s}") for s in ("empty", "kept", "edited", "failed")], f"{key}, notes_hash string, body string")
    answers = spark.createDataFrame([("r", "edited", "edit", True, "edited body"), ("r", "edited", "rewrite", False, "no"), ("r", "failed", "rewrite", False, None)], f"{key}, request string, ok boolean, body string")
    got = {r.section_id: tuple(r)[2:] for r in delta.write_back(paths, state, answers, about).collect()}
    empty = "_No findings were extracted for **Empty** during the last walk._\n\n> Brief: About empty.\n"
    assert got == {
        "empty": ("empty", empty, True, "", empty), "kept": ("unchanged", "old kept", True, "old", "old kept"), "edited": ("edited", "edited body", True, "now", "edited body"),
        "failed": ("fallback", None, True, "old", "old failed"), "new": ("fallback", None, False, None, None),
    }
    notes = spark.createDataFrame([("r", "failed", 1, "a.py", "one"), ("r", "failed", 2, None, None), ("r", "kept", 1, "x", "y")], f"{key}, note_no int, file string, finding string")
    failed = spark.createDataFrame([("r", "failed", "no answer")], f"{key}, error string")
    lines = [r.line for r in delta.fallback_lines(notes, failed, about).orderBy("line_no").collect()]
    assert "\n".join(lines) == "_Aggregation failed for **Failed** (no answer). Raw notes preserved below._\n\n> Brief: About failed.\n\n\n## Raw findings\n\n- **a.py** — one\n- **?** — "


def test_coverage_falls_back_to_the_state(spark):
    notes = spark.createDataFrame(
        [("a", "intent", "x.py"), ("a", "intent", "x.py"), ("a", "intent", None), ("a", "domains", "y.py"), ("a", "personas", "z.py"), ("c", "intent", "")], "repo_id string, section_id string, file string"
    )
    state = spark.createDataFrame([("a", "x.py", 1), *[("b", f"f{k}", k % 2) for k in range(16)], ("c", "q", 0)], "repo_id string, rel_path string, n_findings int")
    got = {(r.repo_id, r.section_id): tuple(r)[2:] for r in ro.coverage_report(notes, state, ("intent", "domains")).collect()}
    assert got == {
        ("a", "intent"): (3, 1, None, None), ("a", "domains"): (1, 1, None, None), ("a", None): (4, 2, 2, 100.0),
        ("b", "intent"): (0, 0, None, None), ("b", "domains"): (0, 0, None, None), ("b", None): (0, 8, 16, 50.0),
        ("c", "intent"): (1, 0, None, None), ("c", "domains"): (0, 0, None, None), ("c", None): (1, 0, 1, 0.0),
    }


KEY = "repo_id string, section_id string"
CLAIMS = f"{KEY}, claim_idx int, text string, sources {SRC}"
AGAINST = f"{KEY}, c_idx int, summary string, positions array<struct<text:string,sources:{SRC}>>"


def render(spark, body, claims, against=()):
    rows = [("r", "s", k, t, s) for k, (t, s) in enumerate(claims)]
    return ev.render_sections(spark.createDataFrame([("r", "s", body)], f"{KEY}, body string"), spark.createDataFrame(rows, CLAIMS), spark.createDataFrame([("r", "s", *x) for x in against], AGAINST)).first().document


def ref(file, a=None, b=None):
    return (file, a, b, "")


def test_markers_stand_behind_what_they_support(spark):
    body = "Orders are kept.\nCustomers  pay."
    got = render(spark, body, [("Orders are kept.", [ref("a.py", 1, 10)]), ("Customers  pay.", [ref("b.py"), ref("a.py", 1, 10)])])
    assert got == "Orders are kept.[1]\nCustomers  pay.[2][1]\n\n## Sources\n1. `a.py:1-10`\n2. `b.py`"


def test_claims_beside_the_body(spark):
    got = render(spark, "Other words.", [(" Orders are kept. ", [ref("a.py", 3, 3)]), ("No source.", [])])
    assert got == "Other words.\n\n## Supporting claims\n- Orders are kept. [1]\n\n## Sources\n1. `a.py:3`"


def test_equal_markers_stand_once(spark):
    """The second claim of the same source is in the body, so it is no supporting claim either."""
    got = render(spark, "One. Two.", [("One.", [ref("a")]), ("Two.", [ref("a")])])
    assert got == "One.[1] Two.\n\n## Sources\n1. `a`"


def test_conflicts_list_all_sides(spark):
    got = render(spark, "B.", [], [(0, "they differ", [("x", [ref("a"), ref("b", 2, 4)]), ("y ", [])])])
    assert got == f"B.\n\n## Conflicts in source\n{ev.CONFLICTS}\n\n- **they differ**\n  - x (`a`, `b:2-4`)\n  - y\n\n## Sources\n1. `a`\n2. `b:2-4`"


def marked_one_by_one(body, claims):
    """What the markers mean: each claim looks at the body as the claims before it left it."""
    for text, mark in claims:
        if text and mark and " ".join(text.split()) in " ".join(body.split()) and text in body and mark not in body:
            body = body.replace(text, text + mark, 1)
    return body


def test_one_pass_puts_markers_where_one_by_one_does():
    rng = random.Random(4)
    for k in range(400):
        words = ["ab", "a", "b c", "c", "a b", "x.", "é"] + (["[1]", "[2", "3]"] if k % 4 == 0 else [])
        body = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        claims = []
        for _ in range(rng.randint(0, 10)):
            a = rng.randint(0, max(0, len(body) - 1))
            text = rng.choice([body[a : a + rng.randint(1, 8)].strip(), rng.choice(words), ""])
            claims.append((text, "".join(f"[{rng.randint(1, 4)}]" for _ in range(rng.randint(0, 3)))))
        assert annotated(body, claims) == marked_one_by_one(body, claims), (body, claims)


def test_ten_thousand_claims_in_a_megabyte():
    sentences = [f"Sentence {k} says {k * 7919 % 10007} things about orders, customers, payments and all that follows from these facts." for k in range(10_000)]
    body = "\n".join(sentences)
    assert len(body) > 1_000_000
    start = time.time()
    got = annotated(body, [(s, f"[{k + 1}]") for k, s in enumerate(sentences)])
    assert time.time() - start < 10 and got == "\n".join(f"{s}[{k + 1}]" for k, s in enumerate(sentences))


def test_a_section_of_a_hundred_thousand_references(spark):
    n = 100_000
    claims = spark.range(n).select(
        F.lit("r").alias("repo_id"), F.lit("s").alias("section_id"), F.col("id").alias("claim_idx"), F.concat(F.lit("c"), "id").alias("text"),
        F.array(F.struct(F.concat(F.lit("f"), (F.col("id") % 50_000).cast("string")).alias("file"), *[F.lit(None).cast("int").alias(c) for c in ("line_start", "line_end")], F.lit("").alias("fingerprint"))).alias("sources"),
    )
    body = spark.createDataFrame([("r", "s", "B")], f"{KEY}, body string")
    document = ev.render_sections(body, claims, spark.createDataFrame([], AGAINST)).first().document
    lines = document.split("\n")
    assert lines[:5] == ["B", "", "## Supporting claims", "- c0 [1]", "- c1 [2]"] and lines[3 + 60_000] == "- c60000 [10001]" and lines[-1] == "50000. `f49999`"


def test_claims_are_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(delta, "CLAIMS", 4)
    old = spark.createDataFrame([("r", "s", k, f"old {k}", []) for k in range(30)], CLAIMS)
    removed = spark.createDataFrame([("r", "s", k) for k in range(0, 30, 3)], f"{KEY}, claim_idx int")
    new = spark.createDataFrame([("r", "s", k, f"new {k}", []) for k in range(9)], f"{KEY}, claim_idx int, text string, note_indices array<int>")
    rows = delta.merge_surgical_edit(old, removed, new, spark.createDataFrame([], NOTE)).orderBy("claim_idx").collect()
    assert [(r.claim_idx, r.text) for r in rows] == list(enumerate([f"old {k}" for k in range(30) if k % 3] + [f"new {k}" for k in range(9)], 1))


def test_empty_parts_are_left_out(spark):
    assert render(spark, " only a body \n", []) == "only a body" and render(spark, None, []) == ""


NOTE = f"{KEY}, note_no int, file string, sources {SRC}"


def test_edits_keep_old_claims_and_resolve_new_ones_by_added_notes(spark):
    old = spark.createDataFrame([("r", "s", k, f"old {k}", [ref("o")]) for k in (1, 2, 3)], CLAIMS)
    removed = spark.createDataFrame([("r", "s", 2), ("r", "s", 9)], f"{KEY}, claim_idx int")
    new = spark.createDataFrame([("r", "s", 1, "new", [2, 1, 2, 7, 0]), ("r", "s", 2, "bare", [])], f"{KEY}, claim_idx int, text string, note_indices array<int>")
    added = spark.createDataFrame([("r", "s", 1, "a.py", None), ("r", "s", 2, "b.py", [ref("b.py", 1, 2), ref("a.py")])], NOTE)
    rows = delta.merge_surgical_edit(old, removed, new, added).orderBy("claim_idx").collect()
    assert [(r.claim_idx, r.text, [s.file for s in r.sources]) for r in rows] == [(1, "old 1", ["o"]), (2, "old 3", ["o"]), (3, "new", ["b.py", "a.py"]), (4, "bare", [])]
    against = spark.createDataFrame([("r", "s", 0, "differ", [("x", [1]), ("y", [9])])], f"{KEY}, c_idx int, summary string, positions array<struct<text:string,note_indices:array<int>>>")
    row = delta.resolve_contradictions(against, added).first()
    assert (row.summary, [(p.text, [s.file for s in p.sources]) for p in row.positions]) == ("differ", [("x", ["a.py"]), ("y", [])])


def test_section_paths(spark):
    ids = "empty cached unchanged edited rewritten failed_edit failed fresh".split()
    sections = spark.createDataFrame([("r", s) for s in ids], KEY)
    live = spark.createDataFrame([("r", s, "new") for s in ids[1:]], f"{KEY}, notes_hash string")
    state = spark.createDataFrame([("r", s, "new" if s == "cached" else "old") for s in ids[:-1]], f"{KEY}, notes_hash string")
    decision = {"unchanged": "unchanged", "edited": "surgical", "failed_edit": "surgical"}
    changes = spark.createDataFrame([("r", s, decision.get(s, "rewrite")) for s in ids[1:]], f"{KEY}, decision string")
    answers = [("edited", "edit", True), ("failed_edit", "edit", False), ("failed_edit", "rewrite", True), ("rewritten", "rewrite", True), ("failed", "rewrite", False), ("fresh", "rewrite", True)]
    asked = spark.createDataFrame([("r", *a) for a in answers], f"{KEY}, request string, ok boolean")
    got = {r.section_id: (r.path, r.stored, r.stored_hash) for r in delta.section_path(sections, live, state, changes, asked).collect()}
    assert got == {
        "empty": ("empty", True, ""), "cached": ("cached", False, "new"), "unchanged": ("unchanged", False, "old"), "edited": ("edited", True, "new"), "rewritten": ("rewritten", True, "new"),
        "failed_edit": ("rewritten", True, "new"), "failed": ("fallback", False, "old"), "fresh": ("rewritten", True, "new"),
    }


def test_derivation_paths(spark):
    sections = spark.createDataFrame([("r", s) for s in "abcd"], KEY)
    upstream = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], f"{KEY}, upstream_hash string")
    state = spark.createDataFrame([("r", "a", "1", True), ("r", "b", "2", False), ("r", "c", "old", True)], f"{KEY}, upstream_hash string, revised boolean")
    path = lambda review: {r.section_id: r.path for r in ro.derivation_path(sections, upstream, state, review).collect()}
    assert path(True) == {"a": "cached", "b": "derive", "c": "derive", "d": "skipped"} and path(False)["b"] == "cached"
    answers = spark.createDataFrame([("r", "b", "new b", True), ("r", "c", "error", False)], f"{KEY}, body string, ok boolean")
    kept = {r.section_id: (r.body, r.upstream_hash, r.revised) for r in ro.derivation_rows(ro.derivation_path(sections, upstream, state, True), answers, True).collect()}
    assert kept == {"b": ("new b", "2", True), "d": ("", "", True)}


def test_freshness_needs_every_section(spark):
    live = spark.createDataFrame([("r", "a", "1")], f"{KEY}, notes_hash string")
    full = spark.createDataFrame([("r", "a", "1"), ("r", "b", "")], live.schema)
    fresh = lambda state: so.aggregation_fresh(live, state, ("a", "b")).first().fresh
    assert fresh(full) and not fresh(full.where("section_id = 'a'")) and not fresh(full.where("section_id = 'b'"))
    up = spark.createDataFrame([("r", "a", "1")], f"{KEY}, upstream_hash string")
    stored = spark.createDataFrame([("r", "a", "1", True), ("r", "b", "", False)], f"{KEY}, upstream_hash string, revised boolean")
    derived = lambda review: so.derivation_fresh(up, stored, ("a", "b"), review).first().fresh
    assert derived(False) and not derived(True)


def test_short_circuit_needs_all_conditions(spark):
    stats = spark.createDataFrame([(r, 0 if r == "none" else 2, 1, 0 if r == "model" else 1) for r in ("all", "none", "model", "scope", "first", "stale")], "repo_id string, files_seen long, cache_hits long, specialized_files long")
    scope = stats.select("repo_id", F.lit("h").alias("scope_hash"))
    prior = stats.where("repo_id <> 'first'").select("repo_id", F.when(F.col("repo_id") == "scope", "x").otherwise("h").alias("scope_hash"))
    fresh = stats.select("repo_id", (F.col("repo_id") != "stale").alias("fresh"))
    got = {r.repo_id: r.short_circuit for r in so.can_short_circuit(stats, scope, prior, fresh, fresh).collect()}
    assert got == {r: r == "all" for r in got} and len(got) == 6


def test_placeholders_by_use(spark):
    bodies = {"Not yet populated": "derive report upstream", "NOT YET POPULATED": "derive", "_No findings were extracted_": "derive report upstream", "Upstream sections required to derive": "derive report", "_Not yet populated. Run `x`": "derive report upstream chat", "no findings": "", "": ""}
    from srcatlas.functions.scalar import PLACEHOLDERS, is_placeholder

    df = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", *[is_placeholder(F.col("body"), m).alias(m) for m in PLACEHOLDERS])
    assert {r.body: " ".join(m for m in PLACEHOLDERS if r[m]) for r in df.collect()} == bodies


def test_hash_changes_with_sources_and_order(spark):
    schema = f"{KEY}, file string, summary string, finding string, sources {SRC}, chunk int, seq long"
    h = lambda *rows: so.notes_hash(spark.createDataFrame([("r", "s", *x) for x in rows], schema)).first().notes_hash
    a, b = ("f", "s", "x", [ref("f", 1, 2)], None, 1), ("g", "s", "y", None, None, 1)
    assert h(a, b) == h(b, a) and len({h(a, b), h(a), h(("f", "s", "x", [ref("f", 1, 3)], None, 1), b), h(("f", "s", "x", [ref("f", 1, 2)], None, 1), ("g", "s", "z", None, None, 1))}) == 4
