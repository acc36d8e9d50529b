"""Language identification by prediction by partial matching (operator 7).

One byte context tree of order 3 per language, learned once and then frozen. A byte costs what
its longest known context says: minus log2 of its share there, or the escape of that context
plus its cost in the next shorter one (escape method C: distinct symbols against all). Below
order 0 every byte costs 8 bits. The language with the shortest code for the whole text wins.

With frozen statistics the cost is a function of the last three bytes and the next, so each
worker unfolds the trees into one table of states (all contexts kept in any language) by
symbols by languages, and scores a batch of whole texts with table lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import bounded_sample, held_out, kept, slices, strings

SAMPLE_DOCS = 400
SAMPLE_BYTES = 2 << 20
MIN_COUNT = 3
UNKNOWN = "und"
BOUNDARY = "\0\0\0"
COST_BYTES = 4 << 20  # of a slice: what each of its bytes costs in each language



def _lowered(texts: pa.Array) -> np.ndarray:
    """Bytes of the lower-cased texts, each behind three boundary bytes, and their offsets."""
    marked = pc.binary_join_element_wise(BOUNDARY, pc.utf8_lower(texts), "")
    offsets = np.frombuffer(marked.buffers()[1], np.int32)[
        marked.offset:marked.offset + len(marked) + 1]
    data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets.astype(np.int64) - offsets[0]


def learn(samples: dict[str, list[str]], min_count: int = MIN_COUNT) -> dict:
    """Counts of contexts by language: {languages, symbols, counts}; counts[k][language] are
    the keys (context and next byte) of order k and how often each was seen."""
    languages = sorted(k for k, v in samples.items() if v)
    coded = {}
    for name in languages:
        data, offsets = _lowered(pa.array(samples[name], pa.string()))
        coded[name] = data, offsets
    seen = np.zeros(256, bool)
    for data, _ in coded.values():
        seen[np.unique(data)] = True
    seen[0] = True
    symbols = np.full(256, seen.sum(), np.int64)
    symbols[seen] = np.arange(seen.sum())
    size = int(seen.sum()) + 1  # the last class: bytes never seen
    counts = []
    for order in range(4):
        by_language = []
        for name in languages:
            data, offsets = coded[name]
            r = symbols[data]
            at = np.ones(len(r), bool)
            for shift in range(3):
                inner = offsets[:-1] + shift
                at[inner[inner < len(r)]] = False
            at = np.flatnonzero(at)
            key = np.zeros(len(at), np.int64)
            for back in range(order, -1, -1):
                key = key * size + r[at - back]
            keys, n = np.unique(key, return_counts=True)
            if order >= 2:
                kept = n >= min_count
                keys, n = keys[kept], n[kept]
            by_language.append((keys, n))
        counts.append(by_language)
    return {"languages": languages, "symbols": symbols, "size": size, "counts": counts}


def unfold(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(state by the last three symbols, bits by state, next symbol and language)."""
    size, counts = model["size"], model["counts"]
    n_lang = len(model["languages"])

    def level(order, parents, parent_of):
        """Costs of the contexts of one order, given those of the next shorter one."""
        contexts = np.unique(np.concatenate([keys // size for keys, _ in counts[order]]))
        bits = parents[parent_of(contexts)].copy()
        for l, (keys, n) in enumerate(counts[order]):
            at = np.searchsorted(contexts, keys // size)
            total = np.bincount(at, n, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            known = total > 0
            escape = np.zeros(len(contexts))
            escape[known] = -np.log2(kinds[known] / (total + kinds)[known])
            bits[:, :, l] += escape[:, None].astype(np.float32)
            bits[at, keys % size, l] = -np.log2(n / (total + kinds)[at])
        return contexts, bits

    flat = np.full((1, size, n_lang), 8, np.float32)
    _, zero = level(0, flat, lambda c: np.zeros(len(c), np.int64))
    tables, state = [zero], np.zeros((size, size, size), np.int32)
    parent = np.zeros(1, np.int64)  # by context of the next shorter order: row in its table
    start = 1
    for order in (1, 2, 3):
        shorter = tables[-1]
        contexts, bits = level(order, shorter, lambda c: parent[c % size ** (order - 1)])
        ids = np.arange(len(contexts), dtype=np.int32) + start
        if order == 1:
            state[:, :, contexts] = ids
        elif order == 2:
            state[:, contexts // size, contexts % size] = ids
        else:
            state.reshape(-1)[contexts] = ids
        if order < 3:
            # A context kept at this order has all its suffixes: counts only grow downwards.
            parent = np.zeros(size ** order, np.int64)
            parent[contexts] = np.arange(len(contexts))
        tables.append(bits)
        start += len(contexts)
    return state.reshape(-1), np.concatenate(tables).reshape(-1, n_lang)


def code_lengths(texts: pa.Array, model: dict) -> np.ndarray:
    """Bits of each whole text under each language."""
    state, bits = kept(("langid", model["key"]), lambda: unfold(model))
    size, n_lang = model["size"], len(model["languages"])
    out = np.zeros((len(texts), n_lang))
    symbols = model["symbols"].astype(np.int32)
    for a, b in slices(texts, COST_BYTES // (4 * max(4, n_lang))):
        data, offsets = _lowered(texts.slice(a, b - a))
        r = symbols[data]
        context = (r[:-3] * size + r[1:-2]) * size + r[2:-1]
        cost = bits[state[context].astype(np.int64) * size + r[3:]]
        # Costs before a text's first byte are those of its boundary; reduceat skips them.
        starts, stops = offsets[:-1], offsets[1:] - 3
        full = stops > starts
        if full.any():
            at = np.empty(2 * full.sum(), np.int64)
            at[::2], at[1::2] = starts[full], stops[full]
            cost = np.concatenate((cost, np.zeros((1, n_lang), np.float32)))
            out[a:b][full] = np.add.reduceat(cost, at, axis=0, dtype=np.float64)[::2]
    return out


def identify(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    """The language of each text and the probability its code lengths give it."""
    languages = model["languages"]
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    if not languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    lengths = code_lengths(texts, model)
    best = lengths.argmin(axis=1)  # ties: the first language by name
    gap = (lengths - lengths.min(axis=1, keepdims=True)) * np.log(2)
    score = np.where(letters, 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1), 0.0)
    return [languages[i] if ok else UNKNOWN for i, ok in zip(best, letters)], score


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Learn from about ``sample_docs`` whole texts of each language, up to the one that passes
    ``sample_bytes``; rows of the held-out fold and rows without text or language are left out."""
    known = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t"))
    known = known.filter(F.col("l").isNotNull() & F.col("i").isNotNull() & ~held_out("i"))
    chosen = bounded_sample(known, "l", "i", sample_docs).filter("t is not null and t != ''")
    samples, used = {}, {}
    for r in chosen.orderBy(F.xxhash64("i"), "t").toLocalIterator():
        if used.get(r["l"], 0) < sample_bytes:
            samples.setdefault(r["l"], []).append(r["t"])
            used[r["l"]] = used.get(r["l"], 0) + len(r["t"])
    model = learn(samples)
    model["key"] = f"{docs.sparkSession.sparkContext.applicationId}-{id(model)}-{sum(used.values())}"
    return model


def language(model: dict, spark) -> "callable":
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        names, score = identify(strings(text), shared.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)],
                                          fields=list(kind))

    return predict.asNondeterministic()


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       lang: str = "lang", model: dict | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts when there
    is nothing to learn from. Bytes never seen in learning cost 8 bits and an escape in every
    language. Repeated rows give repeated rows; a null id is not held out; an empty table gives
    an empty result; other columns are ignored.
    """
    model = model or fit(docs, doc_id, text, lang)
    predict = language(model, docs.sparkSession)
    return docs.select(
        F.col(doc_id), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"),
        predict(F.col(text)).alias("_p")).select(
        doc_id, "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, text: str = "text", least: float = 0.5,
                    model: dict | None = None) -> DataFrame:
    """The documents, all columns as they were, whose language is known with ``least`` score."""
    model = model or fit(docs, text=text)
    predict = language(model, docs.sparkSession)
    marked = docs.withColumn("__language", predict(F.col(text)))
    sure = (F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= least)
    return marked.filter(sure).drop("__language")
