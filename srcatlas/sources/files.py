"""Reading file corpora, and writing and reading notes, state and sections."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import decode_text, strip

STATE_VERSION = 3
#: Fixed names of the state tables; each is written and reset on its own.
SCOPES = ("extraction", "aggregation", "derivation", "scope")


def _path(spark: SparkSession, where: str):
    """(Hadoop file system, path) of a location of any scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """files(repo_id, rel_path, content, size) below a folder of any scheme; unreadable files are skipped, and Spark lists none of 0 bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    store, path = _path(spark, root)
    base = store.makeQualified(path).toUri().getPath().rstrip("/") + "/"
    # Paths come with scheme and host, and escaped like URLs; the root's own path tells where the rest begins.
    place = F.regexp_replace(F.col("path"), r"^[a-zA-Z][\w+.-]*:(?://[^/]*)?(?=/)", "")
    rel = F.substring(F.url_decode(F.regexp_replace(place, r"\+", "%2B")), len(base) + 1, 1 << 20)
    return raw.select(F.lit(repo_id).alias("repo_id"), rel.alias("rel_path"), "content", F.col("length").alias("size"))


def with_text(files: DataFrame) -> DataFrame:
    return files.withColumn("text", decode_text(F.col("content"))).drop("content")


def write_notes(notes: DataFrame, path: str) -> None:
    """Append notes as JSON lines by repository and section, with the time of writing."""
    notes.withColumn("ts", F.current_timestamp()).write.mode("append").partitionBy("repo_id", "section_id").json(path)


def read_notes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    store, place = _path(spark, path)
    return spark.read.schema(schema).json(path) if store.exists(place) else spark.createDataFrame([], schema)


def reset(spark: SparkSession, path: str) -> None:
    """Remove all notes, or a whole state; what is read afterwards is empty."""
    store, place = _path(spark, path)
    store.delete(place, True)


# --- state ---------------------------------------------------------------------------------------
#
# A scope is a folder of numbered snapshots (Parquet) and of numbered commits (one small file each that
# names a snapshot).  A snapshot counts once its commit can be read: what a writer that stopped left
# behind (rows without commit, a commit cut short) is passed over, and the state before it holds.  The
# commit file is created without overwriting, so of two writers of one number a single one succeeds.


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, a fresh one if all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="srcatlas-state-")
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, where two reads of it must agree to the row."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _names(spark: SparkSession, folder: str) -> list[str]:
    store, path = _path(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []


def _number(name: str) -> int:
    digits = name.split(".")[0].split("-")[0]
    return int(digits) if digits.isdigit() else 0


def _write_snapshot(state: DataFrame, folder: str) -> None:
    state.withColumn("version", F.lit(STATE_VERSION)).withColumn("saved_at", F.current_timestamp()).write.parquet(folder)


def _write_commit(spark: SparkSession, file: str, content: str) -> None:
    store, path = _path(spark, file)
    out = store.create(path, False)
    try:
        out.writeBytes(content)
    finally:
        out.close()


def _read_commit(spark: SparkSession, file: str) -> dict | None:
    """What a commit says; None for one that was cut short."""
    store, path = _path(spark, file)
    stream = store.open(path)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()
    return found if isinstance(found, dict) and "snapshot" in found else None


def last_commit(spark: SparkSession, root: str, scope: str) -> dict | None:
    """The newest commit of a scope whose snapshot is there."""
    for name in reversed(_names(spark, f"{root}/{scope}/commits")):
        found = _read_commit(spark, f"{root}/{scope}/commits/{name}")
        store, path = _path(spark, f"{root}/{scope}/snapshots/{found['snapshot']}/_SUCCESS") if found else (None, None)
        if found and store.exists(path):
            return found | {"number": _number(name)}
    return None


def save_state(state: DataFrame, root: str, scope: str, keep: int = 2) -> None:
    """Replace the table of one scope by a new snapshot.

    The rows may come from the state itself: older snapshots stay while they are read, and the last
    `keep` of them remain after the commit.  Another writer that commits the same number makes this fail.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope}")
    spark, place = state.sparkSession, f"{root}/{scope}"
    number = 1 + max([0, *map(_number, _names(spark, f"{place}/commits"))])
    snapshot = f"{number:012d}-{uuid.uuid4().hex}"
    _write_snapshot(state, f"{place}/snapshots/{snapshot}")
    _write_commit(spark, f"{place}/commits/{number:012d}.json", json.dumps({"snapshot": snapshot, "version": STATE_VERSION}))
    drop_snapshots(spark, root, scope, keep)


def drop_snapshots(spark: SparkSession, root: str, scope: str, keep: int = 2) -> None:
    """Remove snapshots and commits that are older than the last `keep` good commits, and what torn writers before these left."""
    place, good = f"{root}/{scope}", []
    for name in reversed(_names(spark, f"{place}/commits")):
        if len(good) < keep and (found := _read_commit(spark, f"{place}/commits/{name}")):
            good.append((_number(name), found["snapshot"]))
    if not good:
        return
    newest, oldest, named = good[0][0], good[-1][0], {s for _, s in good}
    for name in _names(spark, f"{place}/snapshots"):
        if name not in named and _number(name) <= newest:
            reset(spark, f"{place}/snapshots/{name}")
    for name in _names(spark, f"{place}/commits"):
        if _number(name) < oldest:
            reset(spark, f"{place}/commits/{name}")


def load_state(spark: SparkSession, root: str, scope: str, schema: str, required=("repo_id",)) -> DataFrame:
    """Rows of the current version of one scope's last committed snapshot with their required columns; all else loads as absent.

    A folder of Parquet files without commits, as earlier releases wrote it, is read as it is.
    """
    fields = StructType.fromDDL(schema)
    found = last_commit(spark, root, scope)
    place = f"{root}/{scope}/snapshots/{found['snapshot']}" if found else f"{root}/{scope}"
    if not found and not any(n.endswith(".parquet") for n in _names(spark, place)):
        return spark.createDataFrame([], fields)
    df = spark.read.schema(StructType([*fields.fields, *StructType.fromDDL("version int").fields])).parquet(place).where(F.col("version") == STATE_VERSION)
    for c in required:
        df = df.where(F.col(c).isNotNull())
    return df.drop("version")


# --- sections ------------------------------------------------------------------------------------

#: Fixed text of a section that no run has filled yet; the name of the tool that fills it is a parameter.
NOT_YET = "_Not yet populated. Run `{tool} walk` to fill this section._"


def section_documents(bodies: DataFrame, sections: DataFrame, ids: Sequence[str], tool: str = "srcatlas") -> DataFrame:
    """(repo_id, section_id, document) of every section of each repository: title and stripped body.

    `ids` are the sections of the taxonomy, `sections` (section_id, title, description) its small table.  A
    section without a body gets a placeholder with its description, an empty body an empty document.
    """
    every = bodies.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, ids))).alias("section_id"))
    spine = every.join(F.broadcast(sections.select("section_id", "title", "description")), "section_id")
    title, none = F.concat(F.lit("# "), "title", F.lit("\n\n")), NOT_YET.format(tool=tool)
    blank = F.concat(title, F.lit(f"{none}\n\n> "), "description", F.lit("\n"))
    rows = spine.join(bodies.select("repo_id", "section_id", "body"), ["repo_id", "section_id"], "left")
    return rows.select("repo_id", "section_id", F.when(F.col("body").isNull(), blank).otherwise(F.concat(title, strip(F.col("body")), F.lit("\n"))).alias("document"))


def write_sections(documents: DataFrame, path: str) -> None:
    """Write the documents of `section_documents`, replacing old ones."""
    documents.select("repo_id", "section_id", "document").write.mode("overwrite").partitionBy("repo_id").parquet(path)
