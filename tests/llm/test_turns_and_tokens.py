"""Operators 11 to 13 against plain Python."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from srcatlas.llm import token_alignment as ta
from srcatlas.llm import token_counts as tc
from srcatlas.llm import turn_repair as tr
from srcatlas.llm.segments import Memo, cuts_at_blanks, segments

P = pytest.importorskip("public_tokenizers")
sys.setrecursionlimit(20_000)
SPACE = " \t\n\x0b\x0c\r"
CONVERSATIONS = "conv_id long, turn long, role string, text string"
A, B, WORDS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


# --- op11 ------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def plainly_repaired(rows):
    """The report of one conversation's rows by one dynamic programme over whole audits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = text.strip(SPACE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    def step(state, c):  # states: start, s, u, a
        return {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    @lru_cache(None)
    def best(k, state, inserted):
        found = [(0, "", ())] if k == n and state in ("start", "a") else []
        if inserted < 2:
            for c, role in (("u", "user"), ("a", "assistant")):
                if (to := step(state, c)) and (rest := best(k, to, inserted + 1)):
                    found.append((3 + rest[0], "I" + rest[1], ((role, ""), *rest[2])))
        if k < n:
            _, _, role, text = rows[k]
            if rest := best(k + 1, state, 0):
                found.append((4 + rest[0], "D" + rest[1], rest[2]))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 if faults[k] == "truncated" else 0
                moves = [(0, "K", role[:1], role), (3, "R", "u", "user"), (3, "R", "a", "assistant")]
                for cost, edit, c, said in moves:
                    if (to := step(state, c)) and (rest := best(k + 1, to, 0)):
                        found.append((cost + more + rest[0], edit + rest[1], ((said, text), *rest[2])))
        return min(found) if found else None

    cost, audit, kept = best(0, "start", 0)
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def reports(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def some_conversations(seed, convs=25, longest=24):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            rows.append((c, rng.choice([t, t, t, t + 1, None]), role, rng.choice(["Yes.", "No!", "why", " ", "", None, f"Line {t}.", f"Line {t}?", "ends \n"])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (99, None, "system", "x"), *[(98, 5, "user", "again.")] * 7]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_a_chunk", [1, 3, 1024])
def test_repair_equals_one_programme_over_each_conversation(spark, rows_a_chunk):
    rows = some_conversations(rows_a_chunk)
    table = spark.createDataFrame(rows, CONVERSATIONS)
    got = reports(tr.repair_report(table, tr.repair_chunks(tr.damage(table), rows_a_chunk)))
    want = defaultdict(list)
    for r in damaged(rows):
        want[r[0]].append(r)
    assert got == {c: plainly_repaired(want[c]) for c in {r[0] for r in rows}}


def test_repair_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from srcatlas.llm.oracles import ORACLES
    from srcatlas.llm.queries import QUERIES

    spark.createDataFrame(some_conversations(11), CONVERSATIONS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    said = con.sql(ORACLES["op11_turn_repair"])
    got = QUERIES["op11_turn_repair"](spark, f"file://{tmp_path}").select(*said.columns).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(said.fetchall(), key=key)


def test_a_long_conversation_over_many_chunks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "same.", " "])) for t in range(400)]
    table = spark.createDataFrame(rows, CONVERSATIONS)
    edited = tr.repair_chunks(table, 7)
    assert edited.select("part", "piece").distinct().count() > 50
    got = reports(tr.repair_report(table, edited))[1]
    assert got == plainly_repaired(rows)
    turns = [(r.role, r.text) for r in tr.repaired_turns(edited).orderBy("part", "piece", "place").collect()]
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == got["repaired_sha256"]


def test_fixups_stop_where_vectors_differ_by_a_constant():
    rng = random.Random(2)
    symbols = bytes(rng.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(200))
    for was in [(0, 0, 0, 0), tr.END]:
        for now in [(0, 6, 3, 0), (3, 0, 1, 2), (0, 0, 6, 6)]:
            assert tr.vector_mended(symbols, was, now, tr.vector_before(symbols, was)) == tr.vector_before(symbols, now)
    for was in range(4):
        for now in range(4):
            assert tr.state_mended(symbols, tr.END, was, now, tr.state_after(symbols, tr.END, was)) == tr.state_after(symbols, tr.END, now)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert tr.repair_report(none, tr.repair_chunks(tr.damage(none))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], CONVERSATIONS).withColumns({"none": F.lit(1), "part": F.lit("x"), "cost": F.lit(2)})
    (row,) = tr.repair_report(table, tr.repair_chunks(tr.damage(table))).collect()
    assert (row.gaps, row.cost, row.audit, row.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


# --- op12 and op13 ---------------------------------------------------------------------------------

ODD = [
    "", None, " a", "a ", "a  b", "a\n b\n\n  c \n", "x\xa0 y", "é ü 日本語 テスト", "🙂🙂 <|endoftext|> <s> </s> <0x41>", "a▁b", "tab\t x", "it's don't 'll we've", "aaaaaaaaaaaaaaaaaaaa bbbbbb",
    "  lead", "\n", "a\n", "a\n\n", "a \n", "nul\x00 x", "   ", "12345 67.8%  --- ===", "　wide 　", "é ﬁ", "long" * 60 + " tail", "the the the the", "the the the the",
]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "and", "tokenizer", "Über", "naïve", "x1", "foo.bar", "(a)", "don't", "日本", "supercalifragilistic", "end.\nNew"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)] + ODD


def documents(spark, texts, ids=None):
    rows = list(zip(range(len(texts)) if ids is None else ids, texts))
    return spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, pair string").repartition(5)


@lru_cache
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B), ta.byte_level_tokens(A), ta.piece_tokens(B)


def tokens_of(text):
    a, b, _, _ = libraries()
    return a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)


def groups_of(text):
    if not text:
        return [], 0, 0
    a, b = tokens_of(text)
    _, _, bytes_a, bytes_b = libraries()
    if not b"".join(bytes_a[i] for i in a) == (" " + text).encode() == b"".join(bytes_b[i] for i in b):
        return [], 0, 0
    ends = []
    for ids, table in ((a, bytes_a), (b, bytes_b)):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        ends.append(out)
    cuts, out = sorted(set(ends[0]) & set(ends[1])), []
    low = 0
    for cut in cuts:
        out.append(tuple([i for i, e in zip(ids, es) if low < e <= cut] for ids, es in zip((a, b), ends)))
        low = cut
    return out, len(a), len(b)


def plainly_aligned(texts):
    found = [groups_of(t) for t in texts]
    links = [Counter((i, j) for a, b in g for i in a for j in b) for g, _, _ in found]
    count = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [
        (
            n_a, n_b, len(g), sum(x.values()), sum(m for p, m in x.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in x.items()),
            hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else "",
        )
        for (g, n_a, n_b), x in zip(found, links)
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_all_links(spark):
    some = texts()
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in ta.align_documents(documents(spark, some), A, B).collect()}
    assert got == dict(enumerate(plainly_aligned(some)))


def test_alignment_with_small_blocks_wide_groups_and_dense_bitmaps(spark, monkeypatch):
    some = texts(4, 700)
    index = ta.index_pairs(documents(spark, some).coalesce(1), A, B)
    assert index.where(F.octet_length("docs") == ta.BITS).count() > 0
    counts = ta.pair_counts(index)
    links = [Counter((i, j) for a, b in groups_of(t)[0] for i in a for j in b) for t in some]
    want = {p: (sum(p in x for x in links), sum(x[p] for x in links)) for p in set().union(*links)}
    assert {(r.id_a, r.id_b): (r.n_docs, r.n_links) for r in counts.collect()} == want
    monkeypatch.setattr(ta, "WIDE", 1)
    two = ta.TwoTokenizers(A, B)
    for text, x in zip(some[:40] + ODD, links[:40] + [Counter((i, j) for a, b in groups_of(t)[0] for i in a for j in b) for t in ODD]):
        block = ta.Block(0)
        block.add([1], two.encode([text]), two)
        assert dict(zip((block.keys[0] >> ta.SLOT_BITS).tolist(), block.times[0].tolist())) == {i << ta.ID_BITS | j: m for (i, j), m in x.items()}


def test_bitmaps_come_back():
    import numpy as np

    rng = np.random.default_rng(3)
    runs = [np.sort(rng.choice(ta.SLOTS, n, replace=False)) for n in (1, 511, 512, 3, 8192, 700, 2)]
    column = ta.bitmaps(np.concatenate(runs), np.array([len(x) for x in runs]))
    slots, sizes = ta.slots_of(column.slice(1))
    assert sizes.tolist() == [len(x) for x in runs[1:]] and slots.tolist() == np.concatenate(runs[1:]).tolist()


def test_alignment_of_empty_and_repeated_rows(spark):
    assert ta.align_documents(documents(spark, []), A, B).collect() == []
    got = sorted(tuple(r[c] for c in NAMES) for r in ta.align_documents(documents(spark, ["the end.", "the end.", None, ""], [1, 1, None, None]), A, B).collect())
    assert got == sorted(plainly_aligned(["the end.", "the end.", None, ""]))


def test_cut_texts_have_the_library_s_ids():
    two = ta.TwoTokenizers(A, B)
    assert cuts_at_blanks(B)
    for text, ids in zip(texts(9), two.encode(texts(9))):
        if ids is not None:
            assert tuple(memoryview(x).cast("I").tolist() for x in ids) == tuple(map(list, tokens_of(text)))


def test_memo_forgets_what_is_not_used():
    memo = Memo(lambda parts: map(len, parts), lambda v: 0, 2000)
    for k in range(50):
        assert memo.of({f"p{k}", "x" * 100})[f"p{k}"] == len(f"p{k}")
    assert len(memo.now) + len(memo.before) < 25 and "x" * 100 not in memo.now
    assert segments("a b") == ["a", "b"] and segments("a\n b c") == ["a\n b", "c"] and segments("a ") is None


@pytest.mark.parametrize("path", [B, WORDS])
def test_counts_equal_the_library_and_come_from_the_cache(spark, tmp_path, path, monkeypatch):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    library = SentencePieceProcessor(model_file=path) if path == B else Tokenizer.from_file(path)
    encode = library.encode if path == B else lambda t: library.encode(t, add_special_tokens=False).ids
    some, cache = texts(7) * 2, f"file://{tmp_path}/cache"
    docs = documents(spark, some, [None, *range(1, len(some))])
    want = sorted((k or 0, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 40) for k, t in enumerate(some))
    rows = lambda: sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.count_tokens(docs, path, cache, 40).collect())
    assert rows() == want
    stored = tc.stored_counts(spark, cache, path)
    assert stored.count() == len({t or "" for t in some})
    written = spark.read.parquet(f"{cache}/{tc.tokenizer_version(path)}").count()
    assert written == len({t or "" for t in some})
    # Everything is known now: a second run encodes nothing, and another text alone is added.
    assert rows() == want and spark.read.parquet(f"{cache}/{tc.tokenizer_version(path)}").count() == written
    more = documents(spark, [*some, "quite new"])
    assert tc.count_tokens(more, path, cache).count() == len(some) + 1
    assert spark.read.parquet(f"{cache}/{tc.tokenizer_version(path)}").count() == written + 1
    other = B if path == WORDS else WORDS
    assert tc.tokenizer_version(other) != tc.tokenizer_version(path) and tc.stored_counts(spark, cache, other).count() == 0


def test_counts_of_an_empty_table_and_of_a_stored_lie(spark, tmp_path):
    cache = f"file://{tmp_path}/c"
    assert tc.count_tokens(documents(spark, []), B, cache).collect() == []
    # A stored count is believed: it is looked up, not encoded again.
    spark.createDataFrame([(bytearray(hashlib.sha256(b"abc").digest()), 77)], tc.COUNTS).write.mode("append").parquet(f"{cache}/{tc.tokenizer_version(B)}")
    assert [r.n_tokens for r in tc.count_tokens(documents(spark, ["abc"]), B, cache).collect()] == [77]
