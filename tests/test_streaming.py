import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpusmill.plans.config import load_config
from corpusmill.plans.workspace import Workspace
from corpusmill.streaming.incremental import VERSIONS_SCHEMA, harvest_versions, read_versions

DATE = "2025-01-01T00:00:00+00:00"


def test_versions(spark, tmp_path):
    folder, ws = str(tmp_path / "v"), Workspace(spark, str(tmp_path / "ws"))

    def add(*versions):
        spark.createDataFrame([(p, v, bytearray(c)) for p, v, c in versions],
                              VERSIONS_SCHEMA).write.mode("append").parquet(folder)

    def run(checkpoint="ck"):
        query = harvest_versions(read_versions(spark, folder), ws, load_config(), DATE,
                                 str(tmp_path / checkpoint))
        query.awaitTermination()
        return {r["path"]: r["text"].split("\n\n", 1)[1] for r in ws.raw.read().collect()}

    add(("a.md", 1, b"one"), ("a.md", 3, b"three"), ("a.md", 2, b"two"), ("b.md", 1, b"b"),
        ("archive/x.md", 1, b"x"), ("bad.md", 1, b"\xff"))
    assert run() == {"a.md": "three", "b.md": "b"}
    parts = len(ws.raw._list()[1])
    add(("b.md", 2, b"b"))  # same content again
    assert run() == {"a.md": "three", "b.md": "b"} and len(ws.raw._list()[1]) == parts
    add(("a.md", 4, b"four"), ("c.md", 1, b"c"))
    want = {"a.md": "four", "b.md": "b", "c.md": "c"}
    assert run() == want
    assert run() == want
    hashes = ws.state.read().orderBy("file_id").collect()
    assert run("fresh") == want  # everything is replayed in one batch
    assert ws.state.read().orderBy("file_id").collect() == hashes
    assert ws.raw.read().where(F.col("source_hash").isNull()).count() == 0


def test_an_older_version_never_replaces_a_newer_one(spark, tmp_path):
    folder, ws = str(tmp_path / "v"), Workspace(spark, str(tmp_path / "ws"))

    def add(*versions):
        spark.createDataFrame([(p, v, bytearray(c)) for p, v, c in versions],
                              VERSIONS_SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint):
        harvest_versions(read_versions(spark, folder, 1), ws, load_config(), DATE,
                         str(tmp_path / checkpoint)).awaitTermination()
        return {r["path"]: r["text"].split("\n\n", 1)[1] for r in ws.raw.read().collect()}

    add(("a.md", 3, b"three"), ("bad.md", 7, b"\xff"))
    assert run("ck") == {"a.md": "three"}
    add(("a.md", 2, b"two"), ("b.md", 5, b"b"))
    assert run("ck") == {"a.md": "three", "b.md": "b"}
    assert run("fresh") == {"a.md": "three", "b.md": "b"}  # replayed file by file
    bad = spark.read.parquet(f"{ws.root}/quarantine").collect()
    assert {(r["file_id"], r["error"]) for r in bad} == {("bad.md", "not UTF-8, version 7")}
    assert len(bad) == 2  # once for each of the two streams


def test_a_batch_that_died_is_replayed_without_a_trace(spark, tmp_path, monkeypatch):
    """The last save of a batch fails; the next run takes the batch up again."""
    folder, ws = str(tmp_path / "v"), Workspace(spark, str(tmp_path / "ws"))
    spark.createDataFrame([("a.md", 1, bytearray(b"one")), ("bad.md", 1, bytearray(b"\xff"))],
                          VERSIONS_SCHEMA).write.parquet(folder)

    def run():
        harvest_versions(read_versions(spark, folder), ws, load_config(), DATE,
                         str(tmp_path / "ck")).awaitTermination()

    def killed(*args, **kwargs):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(ws.versions, "apply", killed)
        with pytest.raises(StreamingQueryException):
            run()
    assert {r["path"] for r in ws.raw.read().collect()} == {"a.md"}
    for _ in range(2):
        run()
        assert [r["file_id"] for r in spark.read.parquet(f"{ws.root}/quarantine").collect()] == [
            "bad.md"]
        assert [r["path"] for r in ws.raw.read().collect()] == ["a.md"]
        assert ws.state.read().count() == 1
