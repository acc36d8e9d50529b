"""Convolutional toxicity classifier trained in numpy (operator 2).

A word's embedding is the sum of hashed vectors: one for the word, one for each of its prefixes
of three to five letters, so an unseen word shares what its beginning taught. Filters of width
one to three slide over the embeddings of a whole text, each is max-pooled, and a logistic
layer reads the pooled values. A filter is linear before pooling, so a task computes each
filter tap once per distinct word of a batch and adds table rows per position.

Thresholds are calibrated per language on all training rows left out of the fit, scored on the
cluster and counted by score, weighted so that both labels have their share of the whole table:
the sample that the weights are fitted on has a mix of its own. The language is
guessed from the text's own words (naive Bayes over the same hashes), never read from the
table. The score is shifted so that 0.5 is the threshold of the guessed language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.words import (bounded_sample, held_out, mixed, per_text, runs, slices, strings,
                                  uniform, word_codes, word_hashes)

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
SAMPLE_PER_LABEL = 4000
EPOCHS = 3
BATCH = 64
POSITIONS = 1 << 15  # words of a slice that are convolved together
CALIBRATION_SHARE = 0.2
BINS = 64  # of a logit's unit, when thresholds are chosen
FAR = 64.0  # logits beyond are counted as this
COUNTED = ["low", "high", "toxic", "clean"]
PREFIXES = (3, 4, 5)


def feature_ids(vocab: list[str]) -> np.ndarray:
    """Hash buckets of each word: the word and its prefixes."""
    columns = [word_hashes(vocab)]
    for n in PREFIXES:
        columns.append(mixed(word_hashes([w[:n] for w in vocab]) + np.uint64(n)))
    return (np.stack(columns, 1) % np.uint64(BUCKETS)).astype(np.int64)


def taps(weights: dict, features: np.ndarray) -> np.ndarray:
    """Every filter tap of every word: (words, taps, filters)."""
    vectors = weights["embedding"][features].sum(axis=1)
    return np.stack([vectors @ w for w in weights["taps"]], 1)


def convolve(table: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Filter values at each position, by width; beyond a text's end nothing is added."""
    out, at = [], 0
    for width in WIDTHS:
        value = table[codes, at].copy()
        for step in range(1, width):
            inside = np.ones(len(codes), bool)
            for back in range(1, step + 1):
                last = offsets[1:] - back
                inside[last[last >= offsets[:-1]]] = False
            there = np.flatnonzero(inside)
            value[there] += table[codes[there + step], at + step]
        out.append(value)
        at += width
    return out


def pooled(table: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rectified maxima of all filters over each whole text; zeros for a text without words."""
    values = convolve(table, codes, offsets)
    return np.concatenate(
        [np.maximum(per_text(v, offsets, np.maximum, 0), 0) for v in values], 1)


def _guess(languages: np.ndarray, features, codes, offsets) -> np.ndarray:
    """Index of the likeliest language, the number of languages for a text without words."""
    if not languages.shape[1]:
        return np.zeros(len(offsets) - 1, np.int64)
    total = per_text(languages[features[:, 0]][codes], offsets, np.add, 0)
    return np.where(np.diff(offsets) > 0, total.argmax(1), languages.shape[1])


def _logits(weights, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, codes, vocab = word_codes(texts)
    features = feature_ids(vocab)
    table = taps(weights, features)
    values = np.zeros((len(texts), FILTERS * len(WIDTHS)), table.dtype)
    language = np.zeros(len(texts), np.int64)
    # What a position takes is many times its text: only the table is made for all at once.
    for a, b in runs(offsets[1:], POSITIONS):
        own, at = codes[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        values[a:b] = pooled(table, own, at)
        language[a:b] = _guess(weights["languages"], features, own, at)
    return values @ weights["out"] + weights["bias"], language


def score(texts: pa.Array, weights: dict) -> np.ndarray:
    """Score of each whole text, 0 to 1; 0.5 and more is predicted toxic."""
    out = np.zeros(len(texts))
    for a, b in slices(texts, 1 << 20):
        logit, language = _logits(weights, texts.slice(a, b - a))
        shifted = np.clip(logit - weights["thresholds"][language], -30, 30)
        out[a:b] = 1 / (1 + np.exp(-shifted))
    return out


def train(texts: list[str], labels: np.ndarray, languages: list[str | None],
          epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Fit on labelled texts. Without both labels every score is near 0 (or near 1)."""
    weights, fit = _train(texts, labels, languages, epochs, seed)
    if len(fit):
        labels = np.asarray(labels, np.float64)
        held = np.setdiff1d(np.arange(len(texts)), fit)
        held = held if len(held) else fit
        logit, language = _logits(weights, pa.array([texts[i] for i in held], pa.string()))
        _calibrate(weights, pd.DataFrame({
            "language": language, "bin": np.arange(len(held)), "low": logit, "high": logit,
            "toxic": labels[held], "clean": 1 - labels[held]}))
    return weights


def _coded(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text as numbers, and the features of each number; read in slices, so
    that no more than the numbers is held of all texts."""
    known: dict[str, int] = {}
    docs = []
    for a, b in slices(texts):
        offsets, codes, vocab = word_codes(texts.slice(a, b - a))
        place = np.array([known.setdefault(w, len(known)) for w in vocab], np.int32)
        codes = place[codes]
        docs += [codes[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
    return docs, feature_ids(list(known))


def _train(texts, labels, languages, epochs=EPOCHS, seed=7) -> tuple[dict, np.ndarray]:
    """Weights without thresholds, and the texts they were fitted on (none without both labels)."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    n_taps = sum(WIDTHS)
    names = sorted({x for x in languages if x})
    weights = {
        "embedding": rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        "taps": [rng.normal(0, 0.1, (DIM, FILTERS)).astype(np.float32) for _ in range(n_taps)],
        "out": np.full(FILTERS * len(WIDTHS), 0.5), "bias": -2.0,
        "languages": np.zeros((BUCKETS, len(names)), np.float32),
        "thresholds": np.zeros(len(names) + 1)}
    if not len(texts) or labels.min() == labels.max():
        weights["out"][:] = 0
        weights["bias"] = -20.0 if not len(texts) or labels.max() == 0 else 20.0
        return weights, np.zeros(0, np.int64)
    docs, features = _coded(strings(texts if isinstance(texts, (pa.Array, pa.ChunkedArray))
                                    else pa.array(texts, pa.string())))

    # Languages: smoothed word frequencies, one bucket per word.
    if names:
        seen = np.full((BUCKETS, len(names)), 0.1)
        for i, name in enumerate(languages):
            if name:
                np.add.at(seen[:, names.index(name)], features[docs[i], 0], 1)
        weights["languages"] = np.log(seen / seen.sum(0)).astype(np.float32)

    fold = rng.random(len(texts)) < CALIBRATION_SHARE
    if len(set(labels[~fold])) < 2 or len(set(labels[fold])) < 2:
        fold[:] = False
    fit = np.flatnonzero(~fold)

    # A first guess of each bucket: log-odds of the texts it occurs in.
    present = np.full((2, BUCKETS), 0.5)
    for i in fit:
        present[int(labels[i]), np.unique(features[docs[i]])] += 1
    share = [max(1, (labels[fit] == k).sum()) for k in (0, 1)]
    odds = np.log(present[1] / share[1]) - np.log(present[0] / share[0])
    weights["embedding"][:, 0] = np.clip(odds / 4, -1, 1)
    at = 0
    for width in WIDTHS:
        for k in range(width):
            weights["taps"][at + k][0, : FILTERS // 2] += 1.0 / width
        at += width

    _descend(weights, docs, features, labels, fit, epochs, rng)

    return weights, fit


def _calibrate(weights: dict, cells: pd.DataFrame, shares=(1.0, 1.0)) -> None:
    """Set the thresholds by counts of toxic and clean texts per language and bin of scores.

    ``shares`` are what a counted text of either label (toxic, clean) stands for.
    """
    weights["thresholds"][:] = _threshold(cells, shares)
    for k in range(weights["languages"].shape[1]):
        own = cells[cells["language"] == k]
        if own["toxic"].sum() >= 10 and own["clean"].sum() >= 10:
            weights["thresholds"][k] = _threshold(own, shares)


def _threshold(cells: pd.DataFrame, shares) -> float:
    """The cut of best F1; in the middle of the gap it falls into."""
    bins = cells.groupby("bin").agg({"low": "min", "high": "max", "toxic": "sum", "clean": "sum"})
    low, high, toxic, clean = (bins[c].to_numpy(np.float64) for c in bins)
    order = np.argsort(-high, kind="stable")
    hits = np.cumsum(toxic[order]) * shares[0]
    f1 = 2 * hits / (hits + np.cumsum(clean[order]) * shares[1] + hits[-1])
    best = int(f1.argmax())
    below = high[order[best + 1]] if best + 1 < len(order) else low[order[best]] - 1
    return float((low[order[best]] + below) / 2)


def _descend(weights, docs, features, labels, fit, epochs, rng, rate=0.02):
    """Adam on the logistic loss; only the positions that won the pooling get gradients."""
    moments: dict = {}
    balance = np.array([0.5 / max(1e-9, (labels[fit] == k).mean()) for k in (0, 1)])
    step = 0

    def update(name, value, gradient):
        m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient ** 2 - v)
        value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    for _ in range(epochs):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            step += 1
            chosen = order[a:a + BATCH]
            offsets = np.concatenate(([0], np.cumsum([len(docs[i]) for i in chosen])))
            words, codes = np.unique(np.concatenate([docs[i] for i in chosen]),
                                     return_inverse=True)
            if not len(words):
                continue
            own = features[words]
            vectors = weights["embedding"][own].sum(axis=1)
            table = np.stack([vectors @ w for w in weights["taps"]], 1)
            values = convolve(table, codes, offsets)
            winners, maxima = [], []
            for v in values:
                top = per_text(v, offsets, np.maximum, -np.inf)
                where = np.full(top.shape, -1)
                for d in range(len(chosen)):
                    if offsets[d + 1] > offsets[d]:
                        where[d] = v[offsets[d]:offsets[d + 1]].argmax(0) + offsets[d]
                winners.append(np.where(top > 0, where, -1))
                maxima.append(np.maximum(top, 0))
            pool = np.concatenate(maxima, 1)
            y = labels[chosen]
            p = 1 / (1 + np.exp(-np.clip(pool @ weights["out"] + weights["bias"], -30, 30)))
            error = (p - y) * balance[y.astype(int)] / len(chosen)
            back = error[:, None] * weights["out"]
            out_gradient = pool.T @ error
            weights["bias"] -= rate * error.sum()
            word_gradient = np.zeros_like(vectors)
            at = 0
            for w, width in enumerate(WIDTHS):
                d, f = np.nonzero(winners[w] >= 0)
                position = winners[w][d, f]
                signal = back[d, w * FILTERS + f].astype(np.float32)
                for k in range(width):
                    inside = position + k < offsets[d + 1]
                    word, g, ff = codes[position[inside] + k], signal[inside], f[inside]
                    tap = weights["taps"][at + k]
                    gradient = np.zeros_like(tap)
                    np.add.at(gradient.T, ff, vectors[word] * g[:, None])
                    np.add.at(word_gradient, word, tap.T[ff] * g[:, None])
                    update(("tap", at + k), tap, gradient)
                at += width
            update("out", weights["out"], out_gradient)
            moved = np.flatnonzero(word_gradient.any(1))
            np.add.at(weights["embedding"], own[moved].reshape(-1), np.repeat(
                -0.5 * word_gradient[moved], own.shape[1], axis=0))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        lang: str = "lang", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> dict:
    """Train on about ``per_label`` labelled documents of each label outside the held-out fold.

    The sample is the documented bound of what the driver holds, and only the weights are fitted
    on it; thresholds are chosen on all other labelled documents outside the held-out fold. Rows
    without text, id or a label of 0 or 1 are not learned from. A document labelled twice counts
    with each label.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).filter(
        "i is not null and y in (0, 1)").filter(~held_out("i"))
    chosen = F.broadcast(bounded_sample(known, "y", "i", per_label))
    sample = (docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
              .join(chosen, "i").filter("t is not null"))
    rows = sample.orderBy(F.xxhash64("i", "t"), "t", "y").select("i", "t", "l", "y").toArrow()
    weights, fitted = _train(rows["t"], rows["y"].to_numpy(), rows["l"].to_pylist())
    if not len(fitted):
        return weights
    used = sorted(set(rows["i"].take(pa.array(fitted)).to_pylist()))
    del rows
    pa.default_memory_pool().release_unused()
    inside = docs.sparkSession.createDataFrame(
        [(i,) for i in used], T.StructType([T.StructField("i", sample.schema["i"].dataType)]))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    scored = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter(
        "i is not null and t is not null").filter(~held_out("i")).select(
        "i", _rater(shared)("t").alias("s")).select("i", "s.*")
    marked = scored.join(known, "i").join(
        F.broadcast(inside.withColumn("fitted", F.lit(True))), "i", "left")
    out, toxic = F.col("fitted").isNull(), F.col("y") == 1
    # At most 2 * FAR * BINS rows of each language.
    cells = marked.groupBy(
        "language", F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), "logit")) * BINS)
        .alias("bin")).agg(*[
            c.alias(f"{name}_{which}") for which, own in (("out", out), ("all", F.lit(True)))
            for name, c in zip(COUNTED, (
                F.min(F.when(own, F.col("logit"))), F.max(F.when(own, F.col("logit"))),
                F.count_if(own & toxic), F.count_if(own & ~toxic)))]).toPandas()
    shared.destroy()
    totals = cells[["toxic_all", "clean_all"]].sum().to_numpy(np.float64)
    counted = cells[["toxic_out", "clean_out"]].sum().to_numpy(np.float64)
    which = "out" if counted.all() else "all"
    cells = cells[["language", "bin"]].join(cells[[f"{c}_{which}" for c in COUNTED]].set_axis(
        COUNTED, axis=1))
    _calibrate(weights, cells[cells["toxic"] + cells["clean"] > 0],
               totals / counted if counted.all() else (1.0, 1.0))
    return weights


def _rater(shared):
    """A column function: text -> logit and index of the guessed language, by shared weights."""
    @F.arrow_udf("logit double, language int")
    def rate(text: pa.Array) -> pa.Array:
        texts = strings(text)
        logit, language = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        for a, b in slices(texts, 1 << 20):
            logit[a:b], language[a:b] = _logits(shared.value, texts.slice(a, b - a))
        return pa.StructArray.from_arrays([pa.array(logit), pa.array(language)],
                                          names=["logit", "language"])

    return rate.asNondeterministic()


def toxicity(model: dict, spark):
    """A column function: text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        return pa.array(score(strings(text), shared.value))

    return rate.asNondeterministic()


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                   text: str = "text", lang: str = "lang", label: str = "toxic",
                   model: dict | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Null and empty texts, and texts without words, get the score of a text in which no filter
    fires. Repeated rows give repeated rows; a null id is not held out; an empty table gives an
    empty result; without labelled rows of both kinds nothing is predicted toxic (or all is, if
    all labels are). Other columns, whatever their names, are ignored.
    """
    model = model or fit(docs, labels, doc_id, text, lang, label)
    rate = toxicity(model, docs.sparkSession)
    return docs.select(
        F.col(doc_id), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"),
        rate(F.col(text)).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_civil(docs: DataFrame, labels: DataFrame, text: str = "text",
               model: dict | None = None) -> DataFrame:
    """The documents, all columns as they were, that are not predicted toxic."""
    model = model or fit(docs, labels, text=text)
    rate = toxicity(model, docs.sparkSession)
    return docs.withColumn("__toxicity", rate(F.col(text))).filter(
        "__toxicity < 0.5").drop("__toxicity")
