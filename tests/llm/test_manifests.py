"""Repeated byte strings, the Merkle manifest and hard negatives, against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import hardneg, merkle, queries, suffixes

SF = "/root/testdata/sf0.001"
BIG = (1 << 63) - 1


def against_sql(spark, key):
    df = queries.QUERIES[key](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(tuple, df.select(names).collect()), key=str)
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    want = db.sql(queries.ORACLE[key])
    assert sorted(want.columns) == names
    order = [want.columns.index(n) for n in names]
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


# ---- repeated byte strings -------------------------------------------------------------------

def brute_repeats(rows, length=suffixes.LENGTH):
    texts = [(BIG if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        for i in range(len(b) - length + 1):
            g = b[i:i + length]
            least[g] = min(least.get(g, BIG), d)
    out = []
    for (own, _), (d, b) in zip(rows, texts):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < d:
                gone[i:i + length] = [True] * length
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def odd_documents():
    rng = random.Random(3)
    words = ["alpha", "béta", "gamma", "delta", "ε", "zeta\n", "eta"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    line, base, rows = prose(30), prose(300), []
    for i in range(120):
        text = prose(rng.randrange(60))
        if i % 3 == 0:  # a common line, with other words around it
            text += line + text[::-1]
        if i % 4 == 0:
            text = base[:rng.randrange(2000)] + text
        rows.append((i * 7 % 130, base if i % 10 == 0 else text))
    return rows + [
        (None, base), (None, "x" * 300), (3, "x" * 200), (3, "x" * 200), (3, None), (5, ""),
        (900, "y" * 49), (901, "y" * 49), (902, "z" * 51), (902, "z" * 51), (903, "z" * 52),
        (904, base * 20), (-5, "ab" * 40), (905, "ba" * 40)]


@pytest.mark.parametrize("settings", [
    {}, {"chunk_bytes": 3000, "bucket_anchors": 300},
    {"chunk_bytes": 3000, "bucket_anchors": 300, "hot_segments": 5}])
def test_repeats_of_odd_documents(spark, settings):
    rows = odd_documents()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows],
                               "doc_id long, text string, chunk string, sha int").repartition(3)
    got = sorted(map(tuple, suffixes.drop_repeats(df, **settings).collect()), key=str)
    assert got == brute_repeats(rows)


def test_repeats_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.drop_repeats(df).collect() == []


def test_suffixes_come_in_order():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    data[2000:2200] = 0  # a long run of one byte, the least one
    at = rng.permutation(len(data) - suffixes.LENGTH)
    order, group = suffixes.sort_suffixes(data, at)
    strings = [data[p:p + suffixes.LENGTH].tobytes() for p in at[order]]
    assert strings == sorted(strings)
    assert [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))] == \
        [i == g for i, g in enumerate(group)]


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    found = {}
    for shift in (0, 13):
        part = data[shift:]
        start, n, key = suffixes.segments(part, np.array([len(part)]))
        for s, k, h in zip(start, n, key):
            for p in range(s, s + k):
                assert found.setdefault(part[p:p + suffixes.LENGTH].tobytes(), h) == h
    assert len(found) >= 4900


# ---- Merkle manifest ------------------------------------------------------------------------

def brute_manifest(rows):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row, text):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])

    def tree(nodes):
        """Root, and for each node the list of (siblings before, siblings after)."""
        ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, way in enumerate(ways):
                run = level[at[i] // 8 * 8:at[i] // 8 * 8 + 8]
                way.append((run[:at[i] % 8], run[at[i] % 8 + 1:]))
                at[i] //= 8
            level = [h(*level[i:i + 8]) for i in range(0, len(level), 8)]
        return level[0], ways

    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[4])), r) for r in langs[lang])
        mine = [r for _, r in mine]
        trees[lang] = (mine, [leaf(r, r[4]) for r in mine], *tree([leaf(r, r[4]) for r in mine]))
    root, tops = tree([trees[x][2] for x in order])
    out = []
    for lang, top in zip(order, tops):
        mine, leaves, subroot, ways = trees[lang]
        for row, own, way in zip(mine, leaves, ways):
            node, text = own, row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf(row, text and "".join(
                    c.lower() if "A" <= c <= "Z" else c for c in text))
            for before, after in way + top:
                node = h(*before, node, *after)
            proof = h(*[x for before, after in way + top for x in before + after])
            out.append((row[0], own, subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def odd_rows(n):
    rows = [(i, f"s{i % 3}", ["de", "en", None, "ÄÖ", ""][min(i % 7, 4)], i * 2, f"Text {i} ÀB")
            for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "s", "en", 0, ""), (3, "s", "en", 1, "A"),
                   (3, "s", "en", 1, "A"), (3, "s", "en", 1, "b"), (-7, "s", "de", 1, "L" * 100_000),
                   (BIG - 1, "s", "en", None, "q"), (8, "s", "only", 1, "Single")]


@pytest.mark.parametrize("levels", [1, 4])  # a superblock of 8 leaves, and one that holds all
def test_manifest_of_odd_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = odd_rows(40)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, "
                                     "text string").withColumn("leaf", F.lit(1)).withColumn(
        "tree", F.lit("x")).repartition(3)
    got = sorted(map(tuple, merkle.manifest(df).collect()), key=str)
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "s", "en", 1, "lone")]
    row, = merkle.manifest(spark.createDataFrame(rows, schema)).collect()
    assert row["leaf"] == row["subroot"] == row["root"]
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [tuple(row)] == brute_manifest(rows)


def test_manifest_against_sql(spark):
    against_sql(spark, "op12_merkle_manifest")


# ---- hard negatives -------------------------------------------------------------------------

def brute_negatives(rows):
    kept = []
    for vec_id, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, [math.floor(256 * x) for x in v], label))
    out = []
    for i, (anchor, q, own) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(
            ((-sum(a * b for a, b in zip(q, v)), BIG if d is None else d, label != own, d)
             for j, (d, v, label) in enumerate(kept) if j != i and len(v) == len(q)),
            key=lambda x: x[:3])
        for p, _, _, d in [x for x in scored if not x[2]][:5]:
            hard = [x for x in scored if x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(anchor, d, k, x[3], -p, -x[0]) for k, x in enumerate(hard, 1)]
    return sorted(out, key=str)


def test_negatives_of_odd_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((4, 12)) / 3
    rows = [(i * 25, (centres[i % 4] + rng.standard_normal(12) / 8).astype(np.float32).tolist(),
             int(rng.integers(0, 4))) for i in range(160)]
    rows += [rows[4], rows[4], rows[9], rows[9], (None, rows[3][1], 2), (None, rows[5][1], 1),
             (100_000, [0.0] * 12, 1), (100_100, None, 1), (100_200, [], 1), (100_300, rows[0][1], None),
             (100_400, [float("nan")] * 12, 2), (100_500, [None] + [0.5] * 11, 2),
             (100_600, [float("inf")] * 12, 2), (100_700, [0.5, 0.25], 1), (100_800, [0.5, 0.5], 1),
             (100_801, [0.4, 0.5], 2), (-100, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn(
        "row", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    got = sorted(map(tuple, hardneg.mine(df).collect()), key=str)
    want = brute_negatives(rows)
    assert len(want) > 100 and got == want
    assert hardneg.mine(df.limit(0)).collect() == []


def test_negatives_in_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_VALUES", 400)
    monkeypatch.setattr(hardneg, "GROUP_VALUES", 60)
    monkeypatch.setattr(hardneg, "TILE", 64)
    rng = np.random.default_rng(10)
    rows = [(i * 50, rng.standard_normal(20).tolist(), int(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hardneg.mine(df).collect()), key=str) == brute_negatives(rows)


@pytest.mark.parametrize("size", [3, 64, 100])
def test_intervals_hold_the_product(size):
    rng = np.random.default_rng(size)
    v = rng.integers(-300, 300, (80, size))
    v[3] = 0
    v[4] = v[5]
    codes, along, rest = hardneg.encode(v)
    length = np.sqrt((v.astype(float) ** 2).sum(1))
    middle, half = hardneg.Anchors(v).bounds(slice(0, 80), codes, along, rest, length)
    assert (np.abs(middle - v @ v.T) <= half).all()
    assert (half <= 0.5 * np.outer(length, length) + 1e-6).mean() > 0.95  # the filter does filter


def test_negatives_against_sql(spark):
    against_sql(spark, "op13_hard_negatives")
