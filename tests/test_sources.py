import pytest

from srcatlas.sources import files as sf

STATE = "repo_id string, rel_path string, fingerprint string"


def rows(df):
    return sorted(tuple(r)[:3] for r in df.collect())


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+1.py").write_bytes(b"one\r\ntwo\xff")
    (tmp_path / "y.txt").write_text("y")
    for root in (str(tmp_path), "file://" + str(tmp_path), "file:" + str(tmp_path) + "/"):
        got = {r.rel_path: (r.text, r.size) for r in sf.with_text(sf.read_files(spark, root, "r")).collect()}
        assert got == {"a b/x+1.py": ("one\ntwo\ufffd", 9), "y.txt": ("y", 1)}


def test_state_scopes_are_apart(spark, tmp_path):
    root = "file://" + str(tmp_path / "state")
    assert rows(sf.load_state(spark, root, "extraction", STATE)) == []
    sf.save_state(spark.createDataFrame([("r", "a", "1"), (None, "b", "2")], STATE), root, "extraction")
    sf.save_state(spark.createDataFrame([("r", "z", "9")], STATE), root, "derivation")
    old = sf.load_state(spark, root, "extraction", STATE)
    assert rows(old) == [("r", "a", "1")]
    # A state may be saved over the one that it was read from.
    sf.save_state(old.selectExpr("repo_id", "rel_path", "concat(fingerprint, '!') AS fingerprint"), root, "extraction")
    assert rows(sf.load_state(spark, root, "extraction", STATE)) == [("r", "a", "1!")]
    sf.reset(spark, f"{root}/extraction")
    assert rows(sf.load_state(spark, root, "extraction", STATE)) == [] and rows(sf.load_state(spark, root, "derivation", STATE)) == [("r", "z", "9")]


def test_other_versions_load_as_absent(spark, tmp_path):
    root = "file://" + str(tmp_path)
    spark.createDataFrame([("r", "a", "1", 2), ("r", "b", "2", 3)], STATE + ", version int").write.parquet(f"{root}/extraction")
    assert rows(sf.load_state(spark, root, "extraction", STATE)) == [("r", "b", "2")]


class Stop(Exception):
    pass


def save(spark, root, mark):
    sf.save_state(spark.createDataFrame([("r", "a", mark)], STATE), root, "aggregation")


def loaded(spark, root):
    return [r.fingerprint for r in sf.load_state(spark, root, "aggregation", STATE).collect()]


def stopped_while_writing_rows(monkeypatch):
    def torn(state, folder, whole=sf._write_snapshot):
        whole(state, folder)
        sf.reset(state.sparkSession, f"{folder}/_SUCCESS")
        raise Stop

    monkeypatch.setattr(sf, "_write_snapshot", torn)


def stopped_before_the_commit(monkeypatch):
    def stop(*_):
        raise Stop

    monkeypatch.setattr(sf, "_write_commit", stop)


def stopped_in_the_commit(monkeypatch):
    def torn(spark, file, content, whole=sf._write_commit):
        whole(spark, file, content[: len(content) // 2])
        raise Stop

    monkeypatch.setattr(sf, "_write_commit", torn)


def stopped_before_old_snapshots_go(monkeypatch):
    def stop(*_):
        raise Stop

    monkeypatch.setattr(sf, "drop_snapshots", stop)


def stopped_while_old_snapshots_go(monkeypatch):
    def stop(spark, path, whole=sf.reset):
        whole(spark, path)
        raise Stop

    monkeypatch.setattr(sf, "reset", stop)


@pytest.mark.parametrize("stop, kept", [
    (stopped_while_writing_rows, "3"), (stopped_before_the_commit, "3"), (stopped_in_the_commit, "3"), (stopped_before_old_snapshots_go, "4"), (stopped_while_old_snapshots_go, "4"),
])
def test_a_writer_may_stop_between_any_two_steps(spark, tmp_path, monkeypatch, stop, kept):
    root = "file://" + str(tmp_path / "s")
    for mark in "123":
        save(spark, root, mark)
    with monkeypatch.context() as m, pytest.raises(Stop):
        stop(m)
        save(spark, root, "4")
    assert loaded(spark, root) == [kept]
    # The next writer goes on from there and clears up.
    save(spark, root, "5")
    assert loaded(spark, root) == ["5"]
    save(spark, root, "6")
    assert len(sf._names(spark, f"{root}/aggregation/snapshots")) == 2 and loaded(spark, root) == ["6"]


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    root = "file://" + str(tmp_path / "s")
    save(spark, root, "1")

    def meanwhile(state, folder, whole=sf._write_snapshot):
        monkeypatch.setattr(sf, "_write_snapshot", whole)
        save(spark, root, "other")
        whole(state, folder)

    monkeypatch.setattr(sf, "_write_snapshot", meanwhile)
    with pytest.raises(Exception, match="exists"):
        save(spark, root, "mine")
    assert loaded(spark, root) == ["other"]


def test_an_older_snapshot_stays_readable_while_a_newer_is_written(spark, tmp_path):
    root = "file://" + str(tmp_path / "s")
    save(spark, root, "1")
    old = sf.load_state(spark, root, "aggregation", STATE)
    save(spark, root, "2")
    assert [r.fingerprint for r in old.collect()] == ["1"] and loaded(spark, root) == ["2"]


def test_sections_without_a_body_get_a_placeholder(spark, tmp_path):
    taxonomy = spark.createDataFrame([("intent", "Intent", "What it is for."), ("domains", "Domains", "Its parts.")], "section_id string, title string, description string")
    bodies = spark.createDataFrame([("r", "intent", " It counts.\n"), ("q", "domains", "")], "repo_id string, section_id string, body string")
    documents = sf.section_documents(bodies, taxonomy, ["intent", "domains"])
    got = {(r.repo_id, r.section_id): r.document for r in documents.collect()}
    assert got["r", "intent"] == "# Intent\n\nIt counts.\n" and got["q", "domains"] == "# Domains\n\n\n" and len(got) == 4
    assert got["r", "domains"] == "# Domains\n\n_Not yet populated. Run `srcatlas walk` to fill this section._\n\n> Its parts.\n"
    path = "file://" + str(tmp_path / "d")
    for _ in range(2):
        sf.write_sections(documents, path)
    assert spark.read.parquet(path).count() == 4


def test_notes_are_appended_and_reset(spark, tmp_path):
    path, schema = "file://" + str(tmp_path / "notes"), "repo_id string, section_id string, finding string"
    assert sf.read_notes(spark, path, schema).count() == 0
    for text in ("x", "y"):
        sf.write_notes(spark.createDataFrame([("r", "s", text)], schema), path)
    assert {r.finding for r in sf.read_notes(spark, path, schema).collect()} == {"x", "y"}
    sf.reset(spark, path)
    assert sf.read_notes(spark, path, schema).count() == 0
