import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcatlas.functions import scalar as X
from srcatlas.functions.batches import slices
from srcatlas.functions.ignore import compile_rules
from srcatlas.operators import chunking, delta, evidence, files as fo, imports as io, notes as no, report as ro, state as so


def files(spark, rows):
    return spark.createDataFrame([("r", p, t, len(t)) for p, t in rows], "repo_id string, rel_path string, text string, size long")


def paths(df):
    return {r.rel_path for r in df.collect()}


def test_ignore_rules(spark):
    names = ["a.py", "node_modules/x/index.js", "__pycache__/s.pyc", "dist/b.tar", "b.log", "keep.log", "only", "sub/only", "a/x/b", "a/b", "logs"]
    df = files(spark, [(n, "x") for n in names])
    got = paths(fo.filter_ignored(df, extra=["*.log", "!keep.log", "/only", "a/**/b", "logs/"]))
    assert got == {"a.py", "keep.log", "sub/only", "logs"}


def test_repository_rules_override_defaults(spark):
    df = files(spark, [(".gitignore", "!dist/\nx/\n!x/y.txt\n"), ("dist/a", "1"), ("x/y.txt", "1"), ("z", "1")])
    assert paths(fo.filter_ignored(df)) == {".gitignore", "dist/a", "z"}


def test_rule_compiler():
    assert [n for _, _, n, _ in compile_rules(["# c", "", "!x", "y/"])] == [True, False]
    assert re.search(compile_rules(["[!a]b"])[0][1], "cb") and not re.search(compile_rules(["[!a]b"])[0][1], "ab")


def test_kinds(spark):
    rows = [
        ("schema.sql", "", "sql"), ("api.proto", "", "protobuf"), ("schema.graphql", "", "graphql"), ("src/app.go", "", "application_code"),
        ("backend/migrations/0001_init.sql", "", "migration"), ("alembic/versions/abc.py", "", "migration"), ("api.yaml", "openapi: 3.0.3", "openapi"),
        ("api.json", '{"openapi": "3.0.0"}', "openapi"), ("README.md", "", "other"), ("data.csv", "", "other"),
    ]
    got = {r.rel_path: r.kind for r in fo.classify(files(spark, [(p, t) for p, t, _ in rows])).collect()}
    assert got == {p: k for p, _, k in rows}


EDGES = [
    ([("pkg/a.py", "from pkg.b import thing\nimport os\n"), ("pkg/b.py", ""), ("pkg/__init__.py", "")], {("pkg/a.py", "pkg/b.py")}),
    ([("src/main.js", "import { run } from './worker';"), ("src/worker.js", "")], {("src/main.js", "src/worker.js")}),
    (
        [("pkg/a.py", "from .b import thing\nfrom . import helpers"), ("pkg/b.py", ""), ("pkg/helpers.py", ""), ("pkg/__init__.py", "")],
        {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/helpers.py"), ("pkg/a.py", "pkg/__init__.py")},
    ),
    ([("pkg/sub/leaf.py", "from ..sibling import thing"), ("pkg/sibling.py", "")], {("pkg/sub/leaf.py", "pkg/sibling.py")}),
    ([("pkg/a.py", "from . import helpers\nclass A:\n"), ("pkg/helpers.py", ""), ("pkg/__init__.py", "")], {("pkg/a.py", "pkg/__init__.py")}),
    ([("a.py", "from . import b"), ("b.py", "")], {("a.py", "b.py")}),
    ([("src/a.ts", "from x\nimport z from './b.service'"), ("src/b.service.ts", ""), ("src/b.ts", "")], {("src/a.ts", "src/b.ts")}),
]


@pytest.mark.parametrize("rows,expected", EDGES)
def test_import_edges(spark, rows, expected):
    assert {(r.src, r.dst) for r in io.import_edges(files(spark, rows)).collect()} == expected


def test_pages_of_a_hub(spark):
    edges = [("r", f"f{k:03d}.py", "hub.py") for k in range(230)] + [("r", "hub.py", "z.py"), ("q", "f.py", "hub.py"), ("r", "f000.py", "hub.py")]
    pages = io.adjacency_pages(spark.createDataFrame(edges, "repo_id string, src string, dst string"), 50)
    got = {(r.repo_id, r.rel_path, r.side, r.page): r.names for r in pages.collect()}
    hub = [got["r", "hub.py", "imported_by", k] for k in range(5)]
    assert [len(x) for x in hub] == [50, 50, 50, 50, 30] and sum(hub, []) == [f"f{k:03d}.py" for k in range(230)]
    assert got["r", "hub.py", "imports", 0] == ["z.py"] and got["q", "hub.py", "imported_by", 0] == ["f.py"] and got["r", "f000.py", "imports", 0] == ["hub.py"]


def test_repository_rules(spark):
    """Every prefix by its last matching rule, against the rules tried one by one on each path."""
    from srcatlas.functions.ignore import DEFAULT_EXCLUDES, compile_rules

    text = "*.log\n!keep.log\n/only_root\na/**/b\nout/\n!dist/\n!x/y.txt\nx/\n\\#odd\n*.tar.gz\n[ab].txt\n/src/*.c\n!/src/k?.c\nname"
    paths = ["keep.log", "z.log", "d/keep.log", "only_root", "d/only_root", "a/b", "a/q/r/b/f", "out", "out/f", "d/out/f", "dist/f", "x/y.txt", "#odd", "f.tar.gz", "a.txt", "c.txt", "src/m.c", "src/k1.c", "src/d/m.c", "name/f", "d/name", "build/f", "t.pyc"]
    rules = compile_rules([*DEFAULT_EXCLUDES, *text.split("\n"), "extra/"])

    def goes(path):
        steps = path.split("/")
        for n in range(1, len(steps) + 1):
            gone = False
            for _, regex, negate, dir_only in rules:
                if (n < len(steps) or not dir_only) and re.search(regex, "/".join(steps[:n])):
                    gone = not negate
            if gone:
                return True
        return False

    table = files(spark, [*((p, "x") for p in [*paths, "extra/f"]), (".gitignore", text)])
    kept = {r.rel_path for r in fo.filter_ignored(table, extra=["extra/"]).collect()}
    assert kept == {p for p in [*paths, "extra/f", ".gitignore"] if not goes(p)} and {"dist/f", "keep.log", "src/k1.c", "d/only_root", "c.txt"} <= kept
    # Another repository has no rules of its own.
    other = table.unionByName(table.where("rel_path <> '.gitignore'").withColumn("repo_id", F.lit("plain")))
    assert {r.rel_path for r in fo.filter_ignored(other).where("repo_id = 'plain'").collect()} == set(paths) - {"dist/f", "build/f", "t.pyc"} | {"extra/f"}


def test_neighbors_are_limited(spark):
    df = files(spark, [("hub.py", "".join(f"import leaf{k}\n" for k in range(20)))] + [(f"leaf{k}.py", "") for k in range(20)])
    edges = io.import_edges(df)
    assert edges.count() == 20
    hub = io.neighbors(io.graph_nodes(df, edges), 5).where("rel_path = 'hub.py'").first()
    assert len(hub.neighbors) == 5


def test_known_finding_id(spark):
    row = spark.range(1).select(X.finding_id(F.lit("a.py"), F.lit("entities"), F.lit("x")).alias("a"), X.finding_id(F.lit(""), F.lit("s"), F.lit("x")).alias("b")).first()
    assert (row.a, row.b) == ("0bedb7e841a9", "")


def test_refs(spark):
    rows = spark.createDataFrame([(None, None), (10, 10), (10, 25)], "s int, e int").select(X.render_ref(F.lit("a.py"), F.col("s"), F.col("e")).alias("r")).collect()
    assert [r.r for r in rows] == ["a.py", "a.py:10", "a.py:10-25"]


CHANGES = [
    (None, ["1", "2"], 0.3, "rewrite"), (["1", "2"], ["1", "2"], 0.3, "unchanged"), (["1", "2", "3", "4"], ["1", "2", "3", "4", "5"], 0.3, "surgical"),
    (["1"], ["1", "a", "b", "c"], 0.3, "rewrite"), (["1", "2"], ["1", "3"], -1.0, "rewrite"), (["1", "2", "3"], ["1", "2", "3", "4"], 0.25, "surgical"),
    ([""], ["1"], 0.3, "rewrite"), (["1"], [], 0.3, "rewrite"), (["1"], ["1", "2", "2"], 1.0, "surgical"),
]


def change_of(cached, live, threshold=0.3):
    """(decision, added places, removed ids, unchanged, live, churn) of one section by its lists."""
    cached = cached or []
    anew = not cached or "" in cached or "" in live
    added = [k for k, x in enumerate(live) if anew or x not in cached]
    removed = [x for x in cached if cached and (anew or x not in live)]
    changed = len(added) + len(removed)
    decision = "rewrite" if anew else "unchanged" if not changed else "rewrite" if not live else "surgical" if changed / len(live) <= threshold else "rewrite"
    churn = changed / len(live) if live else float(bool(removed))
    return decision, added, removed, 0 if anew else len(set(cached) & set(live)), len(live), churn


IDS = "repo_id string, section_id string, place int, id string"


def places(spark, ids):  # of no section at all where there are none
    return spark.createDataFrame([("r", "s", k, x) for k, x in enumerate(ids or [])], IDS)


@pytest.mark.parametrize("cached,live,threshold,decision", CHANGES)
def test_section_change(spark, cached, live, threshold, decision):
    want = change_of(cached, live, threshold)
    assert want[0] == decision
    row = delta.section_change_counts(places(spark, cached), places(spark, live), threshold).first()
    assert tuple(row)[2:] == (decision, len(want[1]), len(want[2]), *want[3:])
    changed = delta.changed_places(places(spark, cached), places(spark, live)).collect()
    assert sorted(r.place for r in changed if r.change == "added") == want[1] and sorted(r.id for r in changed if r.change == "removed") == sorted(want[2])
    assert all(r.id == (live if r.change == "added" else cached)[r.place] for r in changed)


TEXTS = [("hello world", 100, 10), ("", 100, 10), ("x" * 1000, 100, 0), ("line\n" * 200, 200, 40), ("abcdefghij" * 20, 50, 0), ("a b\n\n" * 50, 30, 0), ("aa\n\nbbb\ncccccccccccc\n\ndd", 10, 4), ("p q" * 9 + "\n\n\n" + "z" * 33, 12, 5)]


def packed(text, size, separators):
    """The pieces of a text by the rule itself: parts joined while they fit, a part too long split on its own."""
    if len(text) <= size:
        return [text] if text else []
    sep, *rest = separators
    parts = [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]] if sep else list(text)
    out, held = [], ""
    for p in parts:
        if held and (len(p) > size or len(held) + len(p) > size):
            out, held = [*out, held], ""
        if len(p) > size:
            out += packed(p, size, rest)
        else:
            held += p
    return [*out, held] if held else out


@pytest.mark.parametrize("text,size,overlap", TEXTS)
def test_chunks(text, size, overlap):
    out = chunking.split_text(text, size, overlap)
    base = packed(text, size - overlap, ["\n\n", "\n", " ", ""]) if len(text) > size else [text]
    assert out == [base[0], *[(a[-overlap:] if overlap else "") + b for a, b in zip(base, base[1:])]]
    assert all(len(c) <= size for c in out) and "".join(base) == text
    assert [text[a:b] for a, b in chunking.chunk_spans(text, size, overlap)] == out


def test_long_parts_are_split_on_their_own():
    assert chunking.split_text("aa\n\nbbb\ncccccccccccc\n\ndd", 10, 0) == ["aa\n\n", "bbb\n", "cccccccccc", "cc\n", "\n", "dd"]


def test_chunk_files_place_and_lines(spark):
    rows = [(f"f{k}", t) for k, (t, *_) in enumerate(TEXTS)]
    got = {}
    for r in chunking.chunk_files(files(spark, rows), 40, 8).collect():
        got.setdefault(r.rel_path, {})[r.chunk_index] = r
    for path, text in rows:
        spans, held = chunking.chunk_spans(text, 40, 8), got[path]
        assert [(held[k].char_start, held[k].body, held[k].chunks) for k in range(len(held))] == [(a, text[a:b], len(spans)) for a, b in spans]
        assert [held[k].line_offset for k in range(len(held))] == chunking.line_offsets(text, [text[a:b] for a, b in spans])
    assert chunking.line_offsets("a\nb\nc\nd", ["a\nb\n", "c\n", "d"]) == [0, 2, 3]


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    """However many texts arrive in one batch, a worker holds few of them and of their chunks as strings, and hands on what it has."""
    df, caught = files(spark, [("a", "b")]), []
    as_it_is = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: caught.append(run) or as_it_is(self, run, schema))
    chunking.chunk_files(df, 150_000, 8_000)
    texts = [f"{k} word\n" * 60_000 for k in range(60)]
    batch = pa.RecordBatch.from_pydict({"repo_id": ["r"] * 60, "rel_path": [f"f{k}" for k in range(60)], "text": texts})
    out = list(caught[0](iter([batch])))
    assert max(sum(map(len, b.column("body").to_pylist())) for b in out) <= chunking.FLUSH + 150_000
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["rel_path"], r["chunk_index"], r["body"]) for r in rows] == [(f"f{k}", i, body) for k, t in enumerate(texts) for i, body in enumerate(chunking.split_text(t))]


def test_the_chunks_of_one_long_text_leave_in_small_batches(spark, monkeypatch):
    df, caught = files(spark, [("a", "b")]), []
    as_it_is = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: caught.append(run) or as_it_is(self, run, schema))
    chunking.chunk_files(df, 2000, 100)
    text = "".join(f"word {k}\n" * 3 for k in range(300_000))
    out = list(caught[0](iter([pa.RecordBatch.from_pydict({"repo_id": ["r"], "rel_path": ["f"], "text": [text]})])))
    assert len(out) > 2 and max(sum(map(len, b.column("body").to_pylist())) for b in out) <= chunking.FLUSH + 2000
    assert [x for b in out for x in b.column("body").to_pylist()] == chunking.split_text(text, 2000, 100)


def test_a_chunking_worker_holds_no_more_of_a_full_batch(spark, monkeypatch):
    """What Python holds besides Arrow's own memory is the same for 5 MB and 40 MB of texts in a batch, and for several batches."""
    df, caught = files(spark, [("a", "b")]), []
    as_it_is = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: caught.append(run) or as_it_is(self, run, schema))
    chunking.chunk_files(df, 2000, 100)

    def peak(n, times):
        batch = pa.RecordBatch.from_pydict({"repo_id": ["r"] * n, "rel_path": [f"f{k}" for k in range(n)], "text": [f"{k} {'word ' * 300}\n" * 5 for k in range(n)]})
        tracemalloc.start()
        try:
            rows = sum(out.num_rows for out in caught[0](iter([batch] * times)))
            return rows, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (few, least), (many, full), (most, again) = peak(700, 1), peak(5_600, 1), peak(5_600, 2)
    assert many > 7 * few and most == 2 * many
    assert max(full, again) < 1.3 * least < 16 << 20


@pytest.mark.parametrize("sizes", [[], [0, 0], [5, 5, 5], [20, 1, 1], [1, 20, 1, None, 9, 2]])
def test_slices_of_batches(sizes):
    texts = [None if n is None else "ä" * n for n in sizes]
    parts = [p.column("t").to_pylist() for p in slices(pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())}), "t", 20)]
    assert sum(parts, []) == texts
    assert all(p and (len(p) == 1 or sum(2 * len(x or "") for x in p) <= 20) for p in parts)


@pytest.mark.parametrize("overlap", [10, -1])
def test_chunk_errors(spark, overlap):
    with pytest.raises(ValueError):
        chunking.split_text("x", 10, overlap)


IMPORTS = [
    (".py", "import os\nfrom a.b import c\n  from .d import e\nfrom .. import f, g\nx = 1\nimportant = 2\nfrom z", {"os", "a.b", ".d", "..", "..f"}),
    (".py", "from . import a, b", {".", ".a", ".b"}), (".py", "from . import a\nclass B:", {"."}), (".py", "from . import (a, b)", {"."}), (".py", "from . import a as c, d", {".", ".d"}),
    (".js", "import x, { y } from './w';\nconst z = require( \"q/r\" );\nawait import('./lazy')\nrequire(name + '/x')", {"./w", "q/r", "./lazy"}),
    (".go", 'import "fmt"\nimport (\n  "net/http"\n  alias "os"\n)', {"fmt", "net/http"}), (".java", "import a.b.C;\nimport static d.E.f;\nimport g.*;\nimport h", {"a.b.C", "d.E.f"}),
    (".rb", "require 'set'\nrequire_relative \"../x\"\nrequired 'no'", {"set", "../x"}), (".md", "import os", set()),
]


@pytest.mark.parametrize("ext,text,expected", IMPORTS)
def test_imports_of_languages(spark, ext, text, expected):
    assert {r.name for r in io.raw_imports(files(spark, [("a" + ext, text)])).collect()} == expected


def test_neighbors_of_a_hub(spark):
    df = files(spark, [("hub.py", "import leaf3\n")] + [(f"leaf{k}.py", "import hub\n") for k in range(30)])
    near = {r.rel_path: r.neighbors for r in io.nearest_neighbors(df, io.import_edges(df), 4).collect()}
    assert near["hub.py"] == ["leaf3.py", "leaf0.py", "leaf1.py", "leaf10.py"] and near["leaf5.py"] == ["hub.py"]
    graph = io.neighbors(io.graph_nodes(df, io.import_edges(df)), 4)
    assert {r.rel_path: r.neighbors for r in graph.collect()} == near


def test_state_roundtrip(spark):
    state = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "repo_id string, rel_path string, fingerprint string")
    new = spark.createDataFrame([("r", "b", "3"), ("r", "c", "4")], state.schema)
    assert {(r.rel_path, r.fingerprint) for r in so.upsert_state(state, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    looked = so.lookup_extraction(new, state)
    assert [r.hit for r in looked.collect()] == [False, False]
    assert paths(so.prune_state(state, new)) == {"b"}


def test_findings_are_deduplicated(spark):
    rows = [("r", "f", 0, 0, "intent", "x "), ("r", "f", 1, 0, "intent", "x"), ("r", "f", 0, 1, "nowhere", "x")]
    df = spark.createDataFrame(rows, "repo_id string, rel_path string, chunk_index int, pos int, section_id string, finding string")
    out = no.dedupe_findings(no.filter_valid_sections(df)).collect()
    assert [(r.chunk_index, r.finding) for r in out] == [(0, "x ")]


def test_sources_are_numbered_by_first_appearance(spark):
    rows = [("r", "s", 1, 0, "b"), ("r", "s", 1, 1, "a"), ("r", "s", 2, 0, "b"), ("r", "s", 2, 1, "c")]
    refs = evidence.coalesce_refs(spark.createDataFrame(rows, "repo_id string, section_id string, claim_idx int, seq int, ref string"))
    numbers = evidence.number_sources(refs)
    assert {r.ref: r.number for r in numbers.collect()} == {"b": 1, "a": 2, "c": 3}
    assert {r.claim_idx: r.marker for r in evidence.annotate_claims(refs, numbers).collect()} == {1: "[1][2]", 2: "[1][3]"}


def test_percent_is_half_even(spark):
    a = spark.createDataFrame([("r", 1)], "repo_id string, with_findings long")
    b = spark.createDataFrame([("r", 16)], "repo_id string, state_files long")
    assert ro.coverage_percent(a, b).first().percent == 6.2


def test_section_report_prefers_gaps_and_ignores_empty_bodies(spark):
    counts = spark.createDataFrame([("r", "a", 3, 2), ("r", None, 3, 2)], "repo_id string, section_id string, findings long, files long")
    bodies = spark.createDataFrame([("r", "a", "text"), ("r", "b", "No findings were extracted"), ("r", "c", "x" * 5)], "repo_id string, section_id string, body string")
    rows = [("r", "a", 8, ["g" * 70], ["u"]), ("r", "b", 2, ["g"], []), ("r", "c", 5, [], ["u" * 60]), ("r", "d", 1, ["g"], [])]
    critiques = spark.createDataFrame(rows, "repo_id string, section_id string, score long, gaps array<string>, unsupported_claims array<string>")
    got = {r.section_id: r for r in ro.section_report(bodies, list("abcd"), counts, bodies, critiques).collect()}
    assert {k: r.gap for k, r in got.items()} == {"a": "g" * 60, "b": "no findings", "c": "unsupported: " + "u" * 50, "d": ""}
    assert {k: (r.files, r.findings, r.body_chars, r.score) for k, r in got.items()} == {"a": (2, 3, 4, 8), "b": (0, 0, 26, None), "c": (0, 0, 5, 5), "d": (0, 0, 0, None)}
    assert {r.overall for r in got.values()} == {6.5}


def test_section_changes_count_like_the_lists(spark):
    was = {"a": "wxyyz", "b": "x", "c": [""], "d": "x", "f": "p"}
    now = {"a": "vvwxy", "b": "x", "c": "x", "e": "x", "f": "pppq"}
    table = lambda lists: spark.createDataFrame([("r", s, k, x) for s, ids in lists.items() for k, x in enumerate(ids or [])], IDS)
    got = {r.section_id: tuple(r)[2:] for r in delta.section_change_counts(table(was), table(now)).collect()}
    want = {s: change_of(list(was.get(s, "")), list(now.get(s, ""))) for s in {*was, *now}}
    assert got == {s: (d, len(a), len(r), *rest) for s, (d, a, r, *rest) in want.items()}
    plans = [delta.section_change_counts(table(was), table(now)), delta.changed_places(table(was), table(now))]
    assert not any("collect_list" in p._jdf.queryExecution().toString() for p in plans)
