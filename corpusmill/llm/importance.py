"""Quality by importance resampling (operator 1).

Two generative models over hashed word unigrams and bigrams: one of the target (documents
labelled good), one of the raw corpus. A document's weight is the log-ratio of its likelihoods;
a sample of k documents without replacement, in proportion to the weights, is the k largest sums
of weight and Gumbel noise (Gumbel top-k).

Raw counts cover every document. The target's come from a bounded sample of labelled ones. The
k-th largest key is found by histograms that narrow down on it, so no task sorts the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import (bounded_sample, mixed, per_text, slices, strings, uniform,
                                  word_codes, word_hashes)
from corpusmill.storage import materialise

BUCKETS = 10_000
TARGET_DOCS = 20_000
SMOOTHING = 1.0
BINS = 1024


def ngram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text and the bucket of every word and of every pair of neighbours."""
    offsets, codes, vocab = word_codes(texts)
    hashes = word_hashes(vocab)
    word = hashes[codes]
    single = (mixed(word) % np.uint64(buckets)).astype(np.int64)
    n = np.diff(offsets)
    if not len(word):
        return offsets, single
    pair = (mixed(word[:-1] * np.uint64(31) + word[1:] + np.uint64(1))
            % np.uint64(buckets)).astype(np.int64)
    # The n-grams of a text: its words, then its pairs (one less).
    count = np.where(n > 0, 2 * n - 1, 0)
    out_offsets = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(out_offsets[-1], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - offsets[text]
    out[out_offsets[text] + place] = single
    inner = np.flatnonzero(text[:-1] == text[1:])
    out[out_offsets[text[inner]] + n[text[inner]] + place[inner]] = pair[inner]
    return out_offsets, out


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """n-grams by bucket over all texts; a task sends one row per bucket at most."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = strings(batch.column(0))
            for a, b in slices(column):
                total += np.bincount(ngram_buckets(column.slice(a, b - a), buckets)[1],
                                     minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])],
                                         names=["bucket", "n"])

    out = np.zeros(buckets)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
            F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target share over raw share, by bucket."""
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", target_docs: int = TARGET_DOCS,
        buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """(log-ratio by bucket, share of target rows among labelled ones). Without labelled target
    documents the ratios are 0 and the share is 0."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).filter(
        "i is not null and y in (0, 1)")
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    raw = _counts(docs.select(text), buckets)
    if not n.get(1):
        return np.zeros(buckets), 0.0
    chosen = bounded_sample(known.filter("y = 1"), "y", "i", target_docs).select("i").distinct()
    target = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(
        F.broadcast(chosen), "i").select("t")
    return log_ratios(_counts(target, buckets), raw), n[1] / sum(n.values())


def kth_largest(keys: DataFrame, k: int, bins: int = BINS) -> float:
    """The k-th largest of a written column ``key`` (k at most the number of rows): histograms
    between ever closer bounds until the bin that holds it is one value."""
    r = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    low, high, above = r["lo"], r["hi"], 0  # ``above``: keys over ``high``
    while low < high:
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        found = sorted(inside.groupBy(bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"),
            F.max("key").alias("hi")).collect(), key=lambda x: -x["bin"])
        for x in found:
            if above + x["n"] >= k:
                low, high = x["lo"], x["hi"]
                break
            above += x["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             label: str = "quality", k: int | None = None, seed: int = 0,
             model: tuple | None = None) -> DataFrame:
    """One row per document: id, log_weight, key (weight plus Gumbel noise), selected.

    ``k`` defaults to the labelled target share of all documents. Exactly k are selected unless
    keys tie at the k-th place (rows that share id and text do): ties are all selected. Null
    and empty texts hold no n-gram: weight 0. The noise is fixed by id, text and seed. Without
    target labels k is 0 by default and nothing is selected; an empty table gives an empty
    result; other columns are ignored.
    """
    ratios, share = model or fit(docs, labels, doc_id, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def weigh(column: pa.Array) -> pa.Array:
        texts, out = strings(column), np.zeros(len(column))
        for a, b in slices(texts):
            offsets, buckets = ngram_buckets(texts.slice(a, b - a), len(shared.value))
            out[a:b] = per_text(shared.value[buckets], offsets, np.add, 0.0)
        return pa.array(out)

    # The open unit interval, so that the double logarithm is finite.
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 52))
            + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select(F.col(doc_id), weigh.asNondeterministic()(F.col(text)).alias("log_weight"),
                       (-F.log(-F.log(draw))).alias("_noise")).select(
        doc_id, "log_weight", (F.col("log_weight") + F.col("_noise")).alias("key"))
    rows = materialise(rows, "importance")
    total = rows.count()
    k = min(total, round(share * total) if k is None else k)
    if not k:
        return rows.withColumn("selected", F.lit(False))
    return rows.withColumn("selected", F.col("key") >= F.lit(kth_largest(rows.select("key"), k)))


def keep_selected(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The selected documents, all columns as they were."""
    chosen = sample.filter("selected").select(F.col(doc_id).alias("__id")).distinct()
    return docs.join(chosen, F.col(doc_id) == F.col("__id"), "left_semi")
