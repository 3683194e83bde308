"""What the plans of the registered queries look like: no products of tables, only columns that are needed, texts out of shuffles."""

import re

import pytest

from srcatlas.operators import files as fo
from srcatlas.plans import catalog, sections, storage

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string", "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}
QUERIES = catalog.QUERIES | sections.QUERIES | storage.QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = {
        "documents": [(k, f"Text {k} of some length that goes on for a while, so that no filter drops it.\n" * (k % 3 + 1), "en", f"src{k % 4}", 80) for k in range(40)],
        "labels": [(k, k % 2, 0) for k in range(40)], "conversations": [(k // 4, k % 4, "user", f"turn {k}.") for k in range(24)], "events": [],
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_tables(spark, tables, name):
    text = plan(QUERIES[name](spark, tables))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def schemas_read(text: str) -> set[str]:
    return {c.split(":")[0] for x in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in x.split(",") if c}


@pytest.mark.parametrize("name, columns", [("w1_dedupe_findings", {"conv_id", "turn", "text"}), ("x1_fingerprints", {"doc_id", "text", "lang", "source"}), ("a9_module_index", {"doc_id", "lang", "source"}), ("m7_review_outcome", {"doc_id", "quality"})])
def test_only_needed_columns_are_read(spark, tables, name, columns):
    assert schemas_read(plan(QUERIES[name](spark, tables))) <= columns


def shuffled(text: str) -> list[str]:
    """What the exchanges of a plan take in."""
    return [m[1] for m in re.finditer(r"\(\d+\) Exchange\n(Input[^\n]*)", text)]


@pytest.mark.parametrize("name", ["walk_changed_by_kind", "f1_repository_rules", "j6_section_change", "j6_changed_places", "w3_x2_number_notes", "x7_j1_j2_import_edges"])
def test_texts_are_not_shuffled(spark, tables, name):
    moved = shuffled(plan(QUERIES[name](spark, tables)))
    assert moved and not any(re.search(r"\b(?:text|finding)#", x) for x in moved)


def test_filters_reach_the_scan(spark, tables):
    text = plan(fo.filter_size(spark.read.parquet(f"{tables}/documents.parquet").withColumnRenamed("n_chars", "size"), 100))
    assert "LessThanOrEqual(n_chars,100)" in text
