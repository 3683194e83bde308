"""The stages of the pipeline against plain Python, one by one and together."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from srcatlas.llm import mixing, quality
from srcatlas.llm.oracles import ORACLES

from test_llm import SCHEMA, WORD, P, docs, near_duplicate_classes

CLASHES = ["k", "t", "p", "row", "n", "copy", "kept", "component_id", "size", "q_id", "q_row", "q_in", "rate", "a", "b"]
BLANK = " \t\n\x0b\x0c\r"


def plain_line_fails(line, rules=quality.RULES):
    n = len(re.findall(r"[^ \t\n\x0b\f\r]+", line))
    symbols, separators = sum(c in quality.SYMBOLS for c in line), sum(c in "|»›•" for c in line)
    if symbols * 100 > n * rules["max_line_symbol_percent"] or separators * 100 > n * rules["max_line_separator_percent"]:
        return True
    if line.count("!!") * 100 > n * rules["max_line_shout_percent"]:
        return True
    tokens = line.split(" ")
    if any(re.fullmatch(r"[^ \t\n\x0b\f\r]+", tokens[k]) and len(set(tokens[k : k + 5])) == 1 for k in range(len(tokens) - 4)):
        return True
    ends = line.rstrip(BLANK).rstrip("\"')]»”")[-1:] in tuple(".!?:;,…。")
    return len(line) < rules["max_boilerplate_chars"] and (any(x in line.lower() for x in quality.BOILERPLATE) or (n < rules["min_unpunctuated_words"] and not ends))


def plain_quality(text, rules=quality.RULES):
    """(kept, text without failing lines) of a text."""
    words, at = WORD.findall(text), {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = text.split("\n")
    good = [x for x in lines if not WORD.search(x) or not plain_line_fails(x)]
    left = sum(len(WORD.findall(x)) for x in good)
    base = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return not base and left * 100 >= len(words) * rules["min_kept_percent"], "\n".join(good)


def texts():
    rng = random.Random(17)
    words = [f"word{k}" for k in range(300)]
    sentence = lambda low=4, high=14: " ".join(rng.choice(words) for _ in range(rng.randint(low, high))) + rng.choice(".?!")
    odd = ["Home | About | Contact", "BUY NOW!! CHEAP!! HERE!!", "# # $ % & &", "click here", "no mark at the end", "la la la la la la.", "Chapter", "(Quoted.)", "All rights reserved by someone or other who wrote this.", "\ttabbed words, and. \t", "die Straße – läuft…", "»ja«"]
    out = []
    for k in range(70):
        lines = [" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 7))] + rng.sample(odd, rng.randint(0, 5)) * rng.choice((1, 1, 2))
        rng.shuffle(lines)
        out.append("\n".join(lines))
    for k in range(0, 30, 3):  # near copies, some of them of one line less
        w = out[k].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    for k in range(0, 20, 2):
        out[k] += f'\n{sentence()} token = "{token()}" and more words follow here.'
    return [*out, out[3], "", None, "short text.", "x " * 40_000 + "end."]


def with_clashes(df):
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])


def test_quality_stage_equals_plain_rules(spark):
    rows = texts()
    got = {r.doc_id: r for r in pipeline.quality(spark, docs(spark, rows), "").collect()}
    want = {k: plain_quality(t or "") for k, t in enumerate(rows)}
    assert set(got) == {k for k, (kept, _) in want.items() if kept} and 20 < len(got) < len(rows)
    assert all(r.text == want[k][1] and r.n_chars == len(r.text) for k, r in got.items())
    verdict = {r.doc_id: (r.kept, r.kept_words) for r in quality.quality_report(docs(spark, rows)).collect()}
    assert all(verdict[k] == (kept, len(WORD.findall(clean))) for k, (kept, clean) in want.items())


def test_near_duplicate_stage_equals_all_pairs(spark):
    rows = texts()
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs(spark, rows), "").collect()}
    assert kept == {k for k, (_, _, keep) in near_duplicate_classes(rows, 80).items() if keep} and len(kept) < len(rows) - 5


def test_secret_stage_takes_the_tokens_out(spark):
    rows = texts()
    got = {r.doc_id: r.text for r in pipeline.secrets(spark, docs(spark, rows), "").collect()}
    for k, t in enumerate(rows):
        assert got[k] == (t and re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", t))


def labels_of(spark, n, path):
    spark.createDataFrame([(k, int(k % 5 != 0), int(k % 9 == 0)) for k in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_together(spark, tmp_path):
    rows = [t for t in texts() if t is None or len(t) < 5000]
    sf = f"file://{tmp_path}"
    docs(spark, rows).write.parquet(f"{sf}/documents.parquet")
    labels_of(spark, 60, sf)
    stage = docs(spark, rows)
    for _, step in pipeline.STAGES[:3]:
        stage = spark.createDataFrame(step(spark, stage, sf).collect(), SCHEMA)
    rates = mixing.mix(stage, spark.read.parquet(f"{sf}/labels.parquet"))
    copies = {r.doc_id: r.n for r in rates.select("doc_id", mixing.copies_of(F.col("rate"), F.col("doc_id")).alias("n")).collect()}
    held = {r.doc_id: r.text for r in stage.collect()}
    from tokenizers import Tokenizer

    tok, found, sequences = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}, {}
    for r in pipeline.run(spark, sf).collect():
        found.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(found) == {k for k, n in copies.items() if n > 0} and sum(copies.values()) > 10
    for k, pieces in found.items():
        ids = np.array([*tok.encode(held[k], add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        assert sum(r.length for r in pieces) == copies[k] * len(ids) // 4
        assert all(r.ids == ids[4 * r.start : 4 * (r.start + r.length)] for r in pieces)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert pieces[0].padded_length in {2**k for k in range(12)}


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path, name, stage):
    sf = f"file://{tmp_path}"
    labels_of(spark, 60, sf)
    none = stage(spark, docs(spark, []), sf)
    assert none.count() == 0
    if name == "packing":
        return
    assert none.columns == docs(spark, []).columns
    rows = [*texts()[:40], None, ""]
    source = with_clashes(docs(spark, rows).unionByName(docs(spark, [rows[5], rows[5]], [5, None])))
    out = stage(spark, source, sf)
    assert out.columns == source.columns
    seen = 0
    for r in out.collect():
        who = "none" if r.doc_id is None else r.doc_id
        assert all(r[c] == f"{c}:{who}" for c in CLASHES) and r.lang == "en"
        seen += 1
    assert seen > 10


@pytest.mark.parametrize("name", ["op5_minhash_near_dedup", "op7_substring_dedup", "op8_quality_rules", "op2_pivot_near_dedup"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from srcatlas.llm.queries import QUERIES

    rows = [t for t in texts() if t is None or len(t) < 5000]
    rows[4] = rows[4] + " " + " ".join(f"p{k}" for k in range(70))
    rows[9] = " ".join(f"p{k}" for k in range(65)) + " tail"
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    x = np.random.default_rng(3).normal(size=(60, 8)).astype(np.float32)
    x[20:30] = x[3] * 2 + 0.05
    vectors = [(k, v.tolist()) for k, v in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [float("inf")] + [1.0] * 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    said = con.sql(ORACLES[name])
    got = QUERIES[name](spark, f"file://{tmp_path}").select(*said.columns).collect()
    assert sorted(map(tuple, got)) == sorted(said.fetchall())
