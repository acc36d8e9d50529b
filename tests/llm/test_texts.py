"""Tokens, packing, Huffman files, languages, toxicity and importance on small inputs."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import huffman, importance, langid, packing, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["", "a", " a", "a  b", "a   b", "foo \nbar", "x\n\n y", "tab\t x", "trail ", "  ", "a\nb",
       "a\n\nb  c", "x'S Y'll", "12 345 ½² ß Ü", "İstanbul Éa", "a<|endoftext|> b", "é 日本語",
       "don't STOP", "a  b", "q\r\n z", "a b\n", "\n", "\na", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "no id here"), (5, "same text"),
            (5, "same text"), (7, "word " * 9000), (8, "!!! 123")]
    # Names that clash with the results' are ignored.
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"score": F.lit("x"), "piece": F.lit(9), "lang": F.lit("en"), "source": F.lit("s"),
         "start": F.lit(1), "n": F.lit(2), "length": F.lit(0)}).repartition(3)


@pytest.fixture
def nothing(docs):
    return docs.filter("false")


@pytest.mark.parametrize("name,end,spaced", [("byte_bpe_50k.json", 0, True),
                                             ("word_bpe_49k.json", 2, False)])
def test_ids_are_the_tokenizers_own(spark, name, end, spaced):
    path = tokens.default_path(name)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = tokens.Encoder(path, end, spaced).encode(pa.array(texts)).to_pylist()
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for text, ids, w in zip(texts, got, want):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids + [end], text[:50]


@pytest.mark.parametrize("name,end,spaced", [
    ("word_bpe_49k.json", 2, False), ("byte_bpe_50k.json", 0, True)])
def test_ids_with_a_small_cache_and_random_ascii(monkeypatch, name, end, spaced):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(tokens, "JOINED_WORDS", 3)
    path, rng = tokens.default_path(name), np.random.default_rng(5)
    letters = list("aAzZ09.,'-!_|<>\n  é") + ["ß", "the", "I'll", "don't", "x1y2", "\t", "日"]
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(1500)]
    encode = tokens.Encoder(path, end, spaced).encode
    got = [x for k in range(0, len(texts), 100) for x in encode(pa.array(texts[k:k + 100])).to_pylist()]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for text, ids, w in zip(texts, got, want):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids + [end], repr(text)


def fewest_bins(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                bins[j] += items[i]
                go(i + 1, bins)
                bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("name, end, spaced", [("byte_bpe_50k.json", 0, True), ("word_bpe_49k.json", 2, False)])
def test_a_full_cache_keeps_what_was_met_again(monkeypatch, name, end, spaced):
    """Frequent words outlive a cache that rare ones fill, and are encoded once."""
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 120)
    path = tokens.default_path(name)
    encoder, own = tokens.Encoder(path, end, spaced), Tokenizer.from_file(path)
    encoded, joined, direct = Counter(), encoder._joined, encoder._direct
    encoder._joined = lambda words: encoded.update(words) or joined(words)
    encoder._direct = lambda words: encoded.update(words) or direct(words)
    rng = random.Random(3)

    def word():
        return "".join(rng.choice("abcdeghi") for _ in range(9))

    often = [word() for _ in range(24)]
    for i in range(60):
        # A third of the frequent words at a time, marked off in all ways that are looked up.
        some = often[i % 3::3]
        texts = ["x " + " ".join(some[:4] + [w + "," for w in some[4:]] + [word() for _ in range(20)]),
                 "é\n", "", "(7) 'tis it's\nso 42"]
        want = [np.array([*own.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes() for t in texts]
        assert encoder.encode(pa.array(texts)).to_pylist() == want
        assert len(encoder.places) == len(encoder.stored) == len(encoder.met) <= 120
    assert max(encoded[(" " if spaced else "") + w] for w in often) <= 3


def test_plans_are_whole_and_optimal_on_small_instances():
    rnd = random.Random(5)
    for _ in range(120):
        items = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 10))), reverse=True)
        plan = packing.plan_bins(Counter(items), 20)
        held = Counter()
        for used, times in plan:
            assert sum(k * n for k, n in used.items()) <= 20
            for k, n in used.items():
                held[k] += n * times
        assert held == Counter(items)
        assert sum(n for _, n in plan) == fewest_bins(items, 20)
    many = Counter({k: rnd.randint(1, 3000) for k in range(1, 2049, 7)})
    bins = sum(n for _, n in packing.plan_bins(many))
    assert packing.lower_bound(many, 2048) <= bins <= sum(
        n for _, n in packing.best_fit(many, 2048))
    assert packing.plan_bins({}) == []


def test_packing_holds_every_token_once(docs, nothing):
    packed = packing.pack_documents(docs, capacity=64, with_ids=True)
    rows = packed.collect()
    tok = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    by_doc = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = [(d, tok.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in
            [(r["doc_id"], r["text"]) for r in docs.collect()] if d != 5]
    for d, ids in want:
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [i for r in parts for i in np.frombuffer(r["ids"], "<u4")] == ids
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert all(r["length"] == 64 for r in parts[1:])
    assert len(by_doc[5]) == 2  # repeated rows are two documents
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 64
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(packed).collect()}
    assert whole == ends
    assert packing.pack_documents(nothing).collect() == []


def test_code_is_complete_limited_and_decodes():
    rnd = np.random.default_rng(3)
    for counts, limit in (({7: 5}, 20), ({1: 1, 2: 1}, 20),
                          ({i: int(1.6 ** i) + 1 for i in range(40)}, 8),
                          ({int(i): 1 for i in range(300)}, 9)):
        lengths = huffman.code_lengths(counts, limit)
        assert max(lengths.values()) <= limit
        if len(counts) > 1:
            assert sum(2.0 ** -k for k in lengths.values()) == 1
        code = huffman.Code(lengths)
        for n in (0, 1, 255, 256, 257, 5000):
            ids = rnd.choice(list(counts), n)
            sizes = np.array([n // 2, n - n // 2, 0])
            got, got_sizes = code.read(code.block(ids, sizes))
            assert got.tolist() == ids.tolist() and got_sizes.tolist() == sizes.tolist()
    assert huffman.code_lengths({}) == {}
    with pytest.raises(ValueError):
        huffman.code_lengths({i: 1 for i in range(5)}, 2)


def test_files_round_trip_in_document_order(docs, nothing):
    blocks, lengths = huffman.encode_corpus(docs, block_ids=50)
    rows = huffman.decode_corpus(blocks, lengths, with_ids=True).collect()
    tok = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json"))
    want = sorted((((r["doc_id"] is not None, r["doc_id"] or 0), r["doc_id"],
                    tok.encode(r["text"] or "", add_special_tokens=False).ids + [2])
                   for r in docs.collect()), key=lambda x: x[0])
    assert len(rows) == len(want)
    start = 0
    for got, (_, doc_id, ids) in zip(sorted(rows, key=lambda r: r["start"]), want):
        assert (got["doc_id"], got["start"], got["n_tokens"]) == (doc_id, start, len(ids))
        assert np.frombuffer(got["ids"], "<u4").tolist() == ids
        assert got["ids_crc32"] == zlib.crc32(got["ids"])
        start += len(ids)
    blocks, lengths = huffman.encode_corpus(nothing)
    assert huffman.decode_corpus(blocks, lengths).collect() == []


def plain_bits(text, samples, order=3, min_count=langid.MIN_COUNT):
    """The same code length, byte by byte from dictionaries."""
    marked = langid.BOUNDARY.encode()
    known = [Counter() for _ in range(order + 1)]
    for s in samples:
        data = marked + s.lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                known[k][data[i - k:i + 1]] += 1
    for k in (2, 3):
        known[k] = Counter({x: n for x, n in known[k].items() if n >= min_count})
    contexts = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        for x, n in known[k].items():
            contexts[k].setdefault(x[:-1], {})[x[-1:]] = n
    total, data = 0.0, marked + text.lower().encode()
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = contexts[k].get(data[i - k:i])
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if data[i:i + 1] in seen:
                total -= np.log2(seen[data[i:i + 1]] / (n + kinds))
                break
            total -= np.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    samples = {"a": ["the cat sat on the mat. " * 9, "that hat"], "b": ["le chat était là. " * 9]}
    model = langid.learn(samples) | {"key": "t1"}
    texts = ["the hat", "le chat", "", "x", "zzz 日本", "THE CAT! " * 40]
    got = langid.code_lengths(pa.array(texts), model)
    want = [[plain_bits(t, samples[k]) for k in ("a", "b")] for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
    names, score = langid.identify(pa.array(texts), model)
    assert names[:4] == ["a", "b", "und", "a"] or names[:3] == ["a", "b", "und"]
    assert ((0 <= score) & (score <= 1)).all() and score[2] == 0


def test_languages_of_held_out_documents(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_languages(table).join(table.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert held.first()[0] > 0.95 and got.count() == table.count()
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.identify_languages(docs).collect()}
    assert rows == {(1, "en"), (2, "und"), (3, "und"), (None, "en"), (5, "en"), (7, "en"),
                    (8, "und")}
    assert langid.identify_languages(nothing).collect() == []
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 5


def toxic_rows(n=400):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "seven"]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            text[rnd.randrange(len(text))] = "insult" + rnd.choice(["", "ing", "ed", "ion"])
        rows.append((i, " ".join(text), "en" if i % 3 else "fr"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, nothing):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks)
    wrong = got.join(marks, "doc_id").filter("held_out and predicted != toxic").count()
    assert wrong <= 2 and got.filter("score < 0 or score > 1").count() == 0
    assert got.filter("(score >= 0.5) != (predicted = 1)").count() == 0
    assert toxicity.score_toxicity(nothing, marks).collect() == []
    empty = toxicity.score_toxicity(docs.limit(3), marks.filter("false")).collect()
    assert [r["predicted"] for r in empty] == [0, 0, 0]
    kept = toxicity.keep_civil(docs, marks)
    assert kept.columns == docs.columns and 290 <= kept.count() <= 310


def test_toxicity_thresholds_are_those_of_the_whole_table(spark):
    # One text in nine is toxic, and no score tells them apart for sure; the sample of the fit
    # is half toxic. The cut must be the best one over all rows that were not fitted on.
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(4000):
        k = rnd.choice([0] * 8 + [1, 2, 3, 4])
        text = [rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)]
        text[:k] = [f"insult{j}" for j in range(k)]
        rows.append((i, " ".join(text), "en"))
        marks.append((i, int(rnd.random() < (0, 0.1, 0.2, 0.45, 0.9)[k])))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(table, labels, per_label=150)
    got = toxicity.score_toxicity(table, labels, model=model).join(labels, "doc_id").filter(
        "not held_out").select("score", "toxic").toPandas().sort_values("score")
    toxic, score = got["toxic"].to_numpy(), got["score"].to_numpy()

    def f1(cut):
        return 2 * toxic[score >= cut].sum() / ((score >= cut).sum() + toxic.sum())

    assert 0.08 < toxic.mean() < 0.2
    assert f1(0.5) >= max(f1(x) for x in score) - 0.01


def test_toxicity_of_odd_texts(spark, docs):
    rows, labels = toxic_rows()
    model = toxicity.train([t for _, t, _ in rows], np.array([y for _, y in labels]),
                           [x for _, _, x in rows])
    got = toxicity.score_toxicity(docs, None, model=model).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    # Whole texts: the word that matters stands at the end of a long one.
    long = "river stone " * 30_000
    clean, foul = toxicity.score(pa.array([long, long + "insulting"]), model)
    assert clean < 0.5 <= foul


def test_scoring_takes_memory_by_the_slice():
    # What a position costs, by filter or language, is held for part of a batch at a time.
    rows, labels = toxic_rows()
    texts = [t for _, t, _ in rows]
    weights = toxicity.train(texts, np.array([y for _, y in labels]), [x for _, _, x in rows])
    many = pa.array((texts + ["", None, "?!"]) * 100, pa.string()).fill_null("")
    model = langid.learn({"a": texts[:200], "b": texts[200:], "c": texts[:100], "d": texts}) | {
        "key": "memory"}
    langid.code_lengths(many[:9], model)  # the unfolded tables stay
    for run in (lambda t: toxicity.score(t, weights), lambda t: langid.code_lengths(t, model)):
        tracemalloc.start()
        got = run(many)
        peak = tracemalloc.get_traced_memory()[1] - got.nbytes
        tracemalloc.stop()
        assert many.nbytes > 6 << 20 and peak < 24 << 20
        alone = np.concatenate([run(many[i:i + 1]) for i in range(403)])
        assert np.allclose(got, np.concatenate([alone] * 100), atol=1e-5)


def test_importance_against_counts(spark):
    rows = [(i, "good fine nice words here" if i % 2 else "junk spam junk noise") for i in range(60)]
    docs = spark.createDataFrame([*rows, (98, None), (99, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)], "doc_id long, quality int")
    got = importance.resample(docs, labels, k=20).collect()
    assert sum(r["selected"] for r in got) == 20 and len(got) == 62
    weight = {r["doc_id"]: r["log_weight"] for r in got}
    assert weight[98] == weight[99] == 0 and weight[1] > weight[0]
    cut = sorted((r["key"] for r in got), reverse=True)[19]
    assert all(r["selected"] == (r["key"] >= cut) for r in got)

    def grams(text):
        words = text.split()
        return [(w,) for w in words] + list(zip(words, words[1:]))

    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i % 2 and i < 40 for g in grams(t))
    m = importance.BUCKETS
    want = sum(np.log((target[g] + 1) / (sum(target.values()) + m))
               - np.log((raw[g] + 1) / (sum(raw.values()) + m)) for g in grams(rows[1][1]))
    assert abs(weight[1] - want) < 1e-9
    none = importance.resample(docs, labels.filter("false")).collect()
    assert not any(r["selected"] for r in none)
    assert importance.resample(docs.filter("false"), labels).collect() == []


def test_kth_largest_with_ties(spark):
    values = [1.0, 5.0, 5.0, 5.0, 2.0, -3.0, 1e9, 5.0000001]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in range(1, 9):
        assert importance.kth_largest(keys, k, bins=4) == sorted(values, reverse=True)[k - 1]
