"""URL filtering: allow and block rules first, gradient-boosted trees for the rest (operator 5).

The trees read lexical features of a URL: lengths, depth, share of digits, character entropy,
parameters, and statistics of its suffixes (top label, last two labels, path extension, first
path segment): how common each is among all URLs, and how often URLs labelled with it are
blocked. Labels are given, or are the verdicts of the rules themselves. Suffixes are hashed to
a fixed number of buckets, so their statistics cover all URLs and stay bounded.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import bounded_sample, strings
from corpusmill.storage import materialise

SAMPLE_PER_LABEL = 20_000
SUFFIX_BUCKETS = 4096
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 64
LEXICAL = 14
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The rules, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host(url: Column) -> Column:
    """Lower-cased (A-Z) text after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER,
                                      UPPER.lower())).otherwise("")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. A rule fits its
    host and all subdomains, where the path starts with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
                       ).otherwise(found)
    return found


# ---- features -------------------------------------------------------------------------

def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffixes(host_: str, path_: str) -> list[int]:
    """Buckets of the top label, the last two labels, the extension and the first segment."""
    labels = host_.split(".")
    last = path_.rsplit("/", 1)[-1]
    parts = ["t:" + labels[-1], "d:" + ".".join(labels[-2:]),
             "e:" + (last.rsplit(".", 1)[1] if "." in last else ""),
             "s:" + (path_.split("/")[1] if path_.count("/") > 0 else "")]
    return [zlib.crc32(p.encode("utf-8", "replace")) % SUFFIX_BUCKETS for p in parts]


def lexical(url: str, host_: str, path_: str) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    return [len(url), len(host_), len(path_), host_.count("."), host_.count("-"),
            path_.count("/"), sum(c.isdigit() for c in url) / max(1, len(url)),
            sum(c.isdigit() for c in host_), _entropy(url), _entropy(host_),
            query.count("&") + 1 if query else 0, float("#" in url),
            float(url[:8].lower() == "https://"), max(map(len, host_.split(".")))]


def features(urls, hosts, paths, stats: np.ndarray) -> np.ndarray:
    """One row per URL: lexical values, then commonness and block rate of each suffix."""
    rows = [lexical(u or "", h, p) for u, h, p in zip(urls, hosts, paths)]
    at = np.array([suffixes(h, p) for h, p in zip(hosts, paths)], np.int64).reshape(-1, 4)
    plain = np.array(rows, np.float64).reshape(len(rows), LEXICAL)
    return np.concatenate((plain, stats[at, 0], stats[at, 1]), axis=1)


# ---- boosted trees --------------------------------------------------------------------

def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH,
          rate: float = RATE, weight: np.ndarray | None = None) -> dict:
    """Logistic boosting of complete trees over quantile bins. With one label only, a constant.
    A row counts ``weight`` times, and once without."""
    counts = np.ones(len(y)) if weight is None else weight
    share = ((counts * y).sum() + 0.5) / (counts.sum() + 1)
    model = {"base": math.log(share / (1 - share)), "trees": [], "depth": depth}
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    score = np.full(len(y), model["base"])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = counts * (p - y), counts * p * (1 - p)
        leaf = np.zeros(len(y), np.int64)
        splits = []
        for level in range(depth):
            n = 1 << level
            best = np.full(n, 1e-6)
            feature, cut = np.zeros(n, np.int64), np.full(n, np.inf)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key, size = leaf * (len(e) + 1) + binned[:, f], n * (len(e) + 1)
                g = np.bincount(key, gradient, size).reshape(n, -1).cumsum(1)
                h = np.bincount(key, hessian, size).reshape(n, -1).cumsum(1)
                gain = (g[:, :-1] ** 2 / (h[:, :-1] + 1)
                        + (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + 1)
                        - g[:, -1:] ** 2 / (h[:, -1:] + 1))
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better], feature[better], cut[better] = top[better], f, e[k[better]]
            splits.append((feature, cut))
            leaf = 2 * leaf + (x[np.arange(len(y)), feature[leaf]] > cut[leaf])
        size = 1 << depth
        value = -rate * np.bincount(leaf, gradient, size) / (np.bincount(leaf, hessian, size) + 1)
        score += value[leaf]
        model["trees"].append((splits, value))
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1."""
    score = np.full(len(x), model["base"])
    for splits, value in model["trees"]:
        leaf = np.zeros(len(x), np.int64)
        for feature, cut in splits:
            leaf = 2 * leaf + (x[np.arange(len(x)), feature[leaf]] > cut[leaf])
        score += value[leaf]
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


# ---- the jobs -------------------------------------------------------------------------

def _read(batch) -> tuple[list, list, list]:
    return tuple(strings(batch.column(i)).to_pylist() for i in range(3))


def suffix_statistics(rows: DataFrame) -> np.ndarray:
    """(log commonness, smoothed block rate) by bucket, over all rows (url, host, path,
    blocked: 1, 0 or null); a task sends one row per bucket at most."""
    def run(batches):
        total = np.zeros((3, SUFFIX_BUCKETS), np.int64)
        for batch in batches:
            _, hosts, paths = _read(batch)
            label = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.array([suffixes(h, p) for h, p in zip(hosts, paths)], np.int64).reshape(-1, 4)
            for k, chosen in enumerate((np.ones(len(at), bool), label == label, label == 1)):
                total[k] += np.bincount(at[chosen].reshape(-1), minlength=SUFFIX_BUCKETS)
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(t[seen]) for t in total]],
                                         names=["bucket", "n", "labelled", "blocked"])

    found = rows.mapInArrow(run, "bucket long, n long, labelled long, blocked long").groupBy(
        "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]).collect()
    total = np.zeros((SUFFIX_BUCKETS, 3))
    for r in found:
        total[r["bucket"]] = r["n"], r["labelled"], r["blocked"]
    share = (total[:, 2].sum() + 1) / (total[:, 1].sum() + 2)
    return np.stack((np.log1p(total[:, 0]), (total[:, 2] + 5 * share) / (total[:, 1] + 5)), 1)


def fit(rows: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> dict:
    """Train on about ``per_label`` different URLs of each label, from (url, host, path, blocked).

    Equal URLs are counted first, so a URL that holds a third of all rows comes to the driver once.
    A sampled URL counts as often as it occurs, times what its label has lost in the sample: the
    trees see the mix of labels of all rows, whatever ``per_label`` is.
    """
    stats = suffix_statistics(rows)
    distinct = materialise(rows.filter("blocked is not null").groupBy(
        "url", "host", "path", "blocked").agg(F.count(F.lit(1)).alias("n")), "labelled-urls")
    totals = {r["blocked"]: r["n"] for r in
              distinct.groupBy("blocked").agg(F.sum("n").alias("n")).collect()}
    chosen = bounded_sample(distinct, "blocked", "url", per_label)
    sample = chosen.orderBy(F.xxhash64("url"), "url", "blocked").collect()
    x = features([r["url"] for r in sample], [r["host"] for r in sample],
                 [r["path"] for r in sample], stats)
    y = np.array([r["blocked"] for r in sample], np.float64)
    weight = np.array([r["n"] for r in sample], np.float64)
    for label, total in totals.items():
        if (y == label).any():
            weight[y == label] *= total / weight[y == label].sum()
    weight *= len(y) / max(1.0, weight.sum())
    return {"stats": stats, "trees": boost(x, y, weight=weight)}


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES,
               labels: DataFrame | None = None, label: str = "blocked",
               per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, block_score (of the trees; null where a
    rule decides).

    ``labels`` (url, ``label`` 0 or 1) trains the trees; without it, the URLs that a rule
    decides do, with its verdict. Null URLs and those without ``://`` have empty host and path,
    fit no rule and are judged by the trees like any other; an empty URL counts as null.
    Repeated rows give repeated rows; an empty table an empty result; other columns are ignored.
    ``per_label`` bounds the URLs that the trees are fitted on. Where nothing is labelled, or all alike, the trees are a constant: an even chance allows.
    """
    named = pages.select(F.col(page_id).alias("i"), F.col(url).alias("url"))
    parts = named.select("i", "url", host(F.col("url")).alias("host"),
                         path(F.col("url")).alias("path"))
    parts = parts.withColumns({"host": F.coalesce("host", F.lit("")),
                               "path": F.coalesce("path", F.lit(""))})
    ruled = parts.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    blocked = F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0)
    known = ruled.select("url", "host", "path", blocked.alias("blocked"))
    if labels is not None:
        given = labels.filter(F.col(label).isin(0, 1) & F.col(url).isNotNull()).select(
            F.col(url).alias("url"), F.col(label).cast("int").alias("blocked"))
        known = known.withColumn("blocked", F.lit(None).cast("int")).unionByName(given.select(
            "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "blocked"))
    model = pages.sparkSession.sparkContext.broadcast(fit(known, per_label))

    @F.arrow_udf("double")
    def rate(url: pa.Array, host: pa.Array, path: pa.Array, open_: pa.Array) -> pa.Array:
        at = np.flatnonzero(open_.to_numpy(zero_copy_only=False))
        out = np.full(len(url), np.nan)
        if len(at):
            x = features(*(strings(c.take(pa.array(at))).to_pylist() for c in (url, host, path)),
                         model.value["stats"])
            out[at] = predict(model.value["trees"], x)
        return pa.array(out, from_pandas=True)

    scored = ruled.withColumn("p", rate.asNondeterministic()(
        "url", "host", "path", F.col("r").isNull()))
    return scored.select(
        F.col("i").alias(page_id), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"),
                   F.when(F.col("p") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.round("p", 6).alias("block_score"))
