import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.fingerprints import leaf_of, merkle_fingerprint
from corpusmill.sources import trees
from corpusmill.sources.trees import FingerprintTree

SCHEMA = "grp string, rel string, hash string"


@pytest.fixture
def tree(spark, tmp_path):
    return FingerprintTree(spark, str(tmp_path / "tree"))


def frame(spark, files):
    return spark.createDataFrame([(g, r, h) for (g, r), h in files.items()], SCHEMA)


def prints(df):
    return {r["grp"]: r["fingerprint"] for r in df.collect()}


def full(spark, files):
    return prints(merkle_fingerprint(frame(spark, files), "grp", "rel", "hash"))


def corpus():  # the hot group holds most files
    return {(g, f"d{i % 7}/f{i}"): f"h{i}" for g, n in (("hot", 600), ("a", 60), ("b", 1))
            for i in range(n)}


@pytest.mark.parametrize("pushed", [256, 1])
def test_adds_changes_and_deletes_equal_the_full_computation(spark, tree, monkeypatch, pushed):
    monkeypatch.setattr(trees, "PUSHED_NAMES", pushed)
    rng, files = random.Random(pushed), corpus()
    counts = tree.update(frame(spark, files))
    assert counts["files"] == counts["lines"] == len(files)
    assert prints(tree.roots()) == full(spark, files)
    for step in range(2):
        changed = {k: f"s{step}" for k in rng.sample(sorted(files), 5)}
        changed[("new" if step else "a", f"new{step}")] = "n"
        removed = [k for k in rng.sample(sorted(files), 4) if k not in changed]
        removed += [("b", "d0/f0")] if step == 1 and ("b", "d0/f0") not in changed else []
        files = {k: v for k, v in (files | changed).items() if k not in removed}
        tree.update(frame(spark, changed), spark.createDataFrame(
            list(set(removed)), "grp string, rel string"))
        assert prints(tree.roots()) == full(spark, files)


def test_sync_finds_what_changed(spark, tree):
    files = corpus()
    tree.sync(frame(spark, files))
    assert tree.sync(frame(spark, files)) == {"files": 0, "leaves": 0, "lines": 0}
    after = {k: v for k, v in files.items() if k[0] != "b" and k[1] != "d1/f1"}
    after[("hot", "d2/f2")] = "changed"
    assert tree.sync(frame(spark, after))["files"] == 4  # b's file, f1 of two groups, one change
    assert prints(tree.roots()) == full(spark, after)
    tree.sync(frame(spark, {}))
    assert prints(tree.roots()) == {} == full(spark, {})
    tree.sync(frame(spark, files))
    assert prints(tree.roots()) == full(spark, files)


def test_an_empty_tree(spark, tree):
    assert tree.sync(frame(spark, {}))["files"] == 0
    assert prints(tree.roots()) == {}


def test_one_changed_file_reads_one_leaf(spark, tree):
    files = corpus()
    tree.update(frame(spark, files))
    leaf = frame(spark, files).where("grp = 'hot'").withColumn("leaf", leaf_of(F.col("rel")))
    name = leaf.where("rel = 'd3/f3'").first()["leaf"]
    beside = leaf.where(F.col("leaf") == name).count()
    changed = {("hot", "d3/f3"): "changed"}
    assert tree.update(frame(spark, changed)) == {"files": 1, "leaves": 1, "lines": beside}
    assert prints(tree.roots()) == full(spark, files | changed)
    touched = spark.createDataFrame([("hot", name)], "grp string, node string")
    plan = tree._children(4, touched)._jdf.queryExecution().toString()
    pushed = [line for line in plan.split("PushedFilters: ")[1:]]
    assert pushed and all(f"EqualTo(node,{name})" in p.split("]")[0] for p in pushed)


def test_a_run_that_dies_between_nodes_and_files(spark, tree, monkeypatch):
    files = corpus()
    tree.sync(frame(spark, files))
    after = files | {("a", "d0/f0"): "x", ("c", "new"): "y"}

    def dies(*args, **kwargs):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(tree.files, "apply", dies)
        with pytest.raises(RuntimeError):
            tree.sync(frame(spark, after))
    assert tree.sync(frame(spark, after))["files"] == 2
    assert prints(tree.roots()) == full(spark, after)
