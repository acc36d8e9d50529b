import pytest
from pyspark.sql import functions as F

from corpusmill import storage
from corpusmill.operators import lookup
from corpusmill.sources.tables import KeyedTable


def rows(spark, values):
    return spark.createDataFrame(list(values.items()), "path string, text string")


def contents(table):
    got = [tuple(r) for r in table.read().collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["path"], "path string, text string")


@pytest.mark.parametrize("runs", [16, 2])
def test_upserts_and_deletes(spark, table, monkeypatch, runs):
    monkeypatch.setattr("corpusmill.sources.tables.SNAPSHOT_RUNS", runs)
    want = {}
    assert contents(table) == want and table.is_new()
    steps = [({f"k{i}": "0" for i in range(40)}, []), ({"k1": "1", "n": "1"}, ["k2"]),
             ({"k1": "2", "k2": "back"}, ["n", "absent"]), ({}, ["k1"]),
             ({f"k{i}": "3" for i in range(5, 25)}, []), ({"k1": "4"}, ["k30"])]
    for upserts, deletes in steps:
        gone = spark.createDataFrame([(d,) for d in deletes], "path string")
        before = table.read()
        table.apply(rows(spark, upserts) if upserts else None, gone)
        assert dict(map(tuple, before.collect())) == want  # an older frame stays readable
        want = {k: v for k, v in {**want, **upserts}.items() if k not in deletes}
        assert contents(table) == want
    assert len(table._list()[1]) <= runs
    assert dict(map(tuple, table.apply(rows(spark, {"k7": "x"})).collect())) == {"k7": "x"}


def test_a_replayed_batch_takes_its_own_place(spark, table):
    table.apply(rows(spark, {"a": "0", "c": "0"}))
    gone = spark.createDataFrame([("c",)], "path string")
    for _ in range(2):
        table.apply(rows(spark, {"a": "1", "b": "1"}), run="q", batch=0)
        table.apply(rows(spark, {"a": "2"}), gone, run="q", batch=1)
        assert contents(table) == {"a": "2", "b": "1"}
    table.apply(rows(spark, {"a": "1", "b": "1"}), run="q", batch=0)  # the older one alone
    assert contents(table) == {"a": "2", "b": "1"}
    table.apply(rows(spark, {"b": "3"}))
    assert contents(table) == {"a": "2", "b": "3"}


def test_an_unlisted_folder_is_invisible(spark, table):
    table.apply(rows(spark, {"a": "1"}))
    rows(spark, {"a": "half"}).write.parquet(f"{table.root}/runs/00000002-crashed/00000000")
    assert contents(table) == {"a": "1"}


def test_keys_are_read_and_moved_without_bodies(spark, table):
    table.apply(rows(spark, {f"k{i}": "0" for i in range(40)}))
    table.apply(rows(spark, {"k1": "1"}))
    table.apply(rows(spark, {"k1": "2", "k2": "2"}))
    plan = table.read().select("path")._jdf.queryExecution().executedPlan().toString()
    assert len(table._list()[1]) == 3 and "FileScan" in plan and "text" not in plan
    assert contents(table)["k1"] == "2"


def test_a_second_writer_fails(spark, table):
    table.apply(rows(spark, {"a": "1"}))
    version, listed = table._list()
    with pytest.raises(OSError):
        table._put(version, listed)
    assert contents(table) == {"a": "1"}


def test_empty_changes_leave_no_entry(spark, table):
    table.apply(rows(spark, {"a": "1"}))
    table.apply(rows(spark, {"a": "1"}).where("false"))
    assert len(table._list()[1]) == 1


def test_counts_are_taken_while_writing(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', id) v", "array('a') w")
    written = storage.materialise(df, "t", {"odd": F.count(F.when(F.col("id") % 2 == 1, 1))},
                                  measured=True)
    counted = storage.observed(written)
    assert counted["odd"] == 5 and counted["rows"] == 10
    assert counted["bytes"] == written.agg(F.sum(storage._width(written))).first()[0]
    assert storage.observed(written.select("id")) == {}


def test_broadcast_needs_a_small_side(spark, monkeypatch):
    big = spark.range(20_000).selectExpr("id k", "repeat('x', 100) v")
    small = spark.range(10).selectExpr("id k")
    hinted = lambda df, bound: "ResolvedHint" in storage.broadcast_if_small(
        df, bound)._jdf.queryExecution().analyzed().toString()
    assert hinted(small, 1000) and not hinted(big, 1000) and hinted(big, 10_000_000)


@pytest.mark.parametrize("few,some", [(10**9, 0), (0, 10**9), (0, 0)])
def test_lookups_agree_whatever_the_size(spark, monkeypatch, few, some):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", few)
    monkeypatch.setattr(lookup, "HASHED_KEYS", some)
    table = spark.range(1000).selectExpr("cast(id as string) k", "id % 3 j", "id v").repartition(3)
    keys = spark.range(0, 2000, 7).selectExpr("cast(id as string) k", "id % 3 j", "-id w")
    got = lookup.fetch(table, keys, ["k", "j"]).collect()
    assert sorted((r["v"], r["w"]) for r in got) == [(i, -i) for i in range(0, 1000, 7)]
    rest = lookup.without(table, keys.select("k", "j"), ["k", "j"]).collect()
    assert sorted(r["v"] for r in rest) == [i for i in range(1000) if i % 7]
    one = lookup.fetch(table, keys.select("k", "w"), "k")
    assert one.columns == ["k", "j", "v", "w"] and one.count() == len(got)


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, **settings):
            self.settings = settings

        def get(self, key, default=None):
            return self.settings.get(key, default)

    class Session:
        def __init__(self, **settings):
            self.conf = Conf(**settings)
            self.sparkContext = spark.sparkContext

    with pytest.raises(ValueError):
        storage.scratch_root(Session(**{"spark.master": "yarn"}))
    named = Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://shared/ck/"})
    assert storage.scratch_root(named) == "hdfs://shared/ck"
