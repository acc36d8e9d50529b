"""Temperature mixing of sources (operator 10), in DataFrame functions only.

Weights are source token shares raised to an exponent between 1 (as found) and 0 (uniform) and
normalised. The exponent is bisected: the largest flattening that neither passes the target
entropy nor repeats a source more often than allowed. A budget of tokens then gives every
source a number of epochs. Whole epochs emit every document; the last, partial one emits the
source's blocks in a permuted order until its tokens are spent, the last block in part.

A block holds about ``block_tokens`` tokens of one source, dealt by hash, so a source with a
third of all rows is cut into many blocks: totals are kept per block, and only the one block
that a source's budget ends in is ordered by document. What is selected comes down to a few
numbers per source, and documents meet them without moving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.storage import broadcast_if_small, materialise

ENTROPY_SHARE = 0.9
MAX_REPEATS = 1.5
BLOCK_TOKENS = 1 << 20
PROBES = 32
ROUNDS = 4
PREFIX = "__mix_"


def tokens_of(text: Column) -> Column:
    """Runs of characters other than blanks and line ends; none in null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _hash48(*parts: Column) -> Column:
    """48 bits of an md5, as a number that any engine can compute."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def find_exponent(totals: DataFrame, entropy_share: float, max_repeats: float) -> float:
    """The smallest exponent, to 2^-20, whose entropy is at most the target share of the
    highest possible and whose repeats stay allowed; 1 if the sources as found are more even
    than that. Each round probes 31 exponents at once: five halvings."""
    low, high = 0.0, 1.0
    used = totals.filter("tokens > 0")
    for _ in range(ROUNDS):
        step = (high - low) / PROBES
        probes = used.select(
            F.explode(F.sequence(F.lit(1), F.lit(PROBES - 1))).alias("k"),
            F.ln("tokens").alias("l")).withColumn("a", F.lit(low) + F.col("k") * F.lit(step))
        z = F.sum(F.exp(F.col("a") * F.col("l")))
        stats = probes.groupBy("k", "a").agg(
            z.alias("z"),
            F.sum(F.exp(F.col("a") * F.col("l")) * F.col("a") * F.col("l")).alias("zl"),
            F.count(F.lit(1)).alias("n"), (F.max("l") - F.min("l")).alias("spread"))
        enough = ((F.ln("z") - F.col("zl") / F.col("z")
                   <= F.lit(entropy_share) * F.ln(F.col("n").cast("double")))
                  & ((1 - F.col("a")) * F.col("spread") <= F.ln(F.lit(float(max_repeats)))))
        first = stats.filter(enough).agg(F.min("k").alias("k")).first()["k"]
        k = PROBES if first is None else first
        low, high = low + (k - 1) * step, low + k * step
    return high


def plan_mix(rows: DataFrame, entropy_share: float = ENTROPY_SHARE,
             max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None,
             block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> DataFrame:
    """One row per source from (source, tokens, h: a document hash, d: another): weight,
    epochs (whole), and where the partial epoch ends: all blocks with a key under ``cut_key``,
    of the block with that key the documents with ``d <= cut_doc``."""
    totals = materialise(rows.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-totals")
    exponent = find_exponent(totals, entropy_share, max_repeats)
    sums = totals.filter("tokens > 0").agg(
        F.sum(F.exp(F.lit(exponent) * F.ln("tokens"))).alias("z"),
        F.max("tokens").alias("most")).first()
    z, most = sums["z"], sums["most"] or 1
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.ln("tokens")) / F.lit(z or 1.0))
    if budget_tokens is None:  # the least repeated source passes exactly once
        repeats = F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - exponent))
    else:
        repeats = F.col("weight") * F.lit(float(budget_tokens)) / F.col("tokens")
    sources = totals.withColumn("weight", weight).withColumn(
        "repeats", F.when(F.col("tokens") > 0, repeats).otherwise(1.0)).select(
        "source", "weight", "repeats", "tokens",
        F.floor("repeats").alias("epochs"),
        ((F.col("repeats") - F.floor("repeats")) * F.col("tokens")).alias("quota"),
        F.ceil((F.col("tokens") + 1) / F.lit(block_tokens)).alias("n_blocks"))
    sources = materialise(sources, "mix-sources")

    placed = rows.join(broadcast_if_small(sources.select(
        "source", "n_blocks", "epochs", "quota")), "source").withColumn(
        "block", F.pmod("h", "n_blocks")).withColumn(
        "key", _hash48(F.lit(seed), F.col("source"), F.col("block"), F.col("epochs")))
    blocks = placed.groupBy("source", "key", "quota").agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("key").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    # The block in which the running total first passes the quota.
    cuts = blocks.withColumn("running", F.sum("tokens").over(before)).filter(
        "running > quota").groupBy("source").agg(
        F.min_by(F.struct("key", (F.col("quota") - F.col("running") + F.col("tokens"))
                          .alias("room")), "key").alias("cut")).select(
        "source", F.col("cut.key").alias("cut_key"), F.col("cut.room").alias("room"))
    cuts = materialise(cuts, "mix-cuts")
    small = broadcast_if_small(cuts)
    inside = placed.join(small, "source").filter("key = cut_key")
    upto = Window.partitionBy("source").orderBy("d").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("running", F.sum("tokens").over(upto)).filter(
        "running <= room").groupBy("source").agg(F.max("d").alias("cut_doc"))
    return materialise(sources.join(cuts.drop("room"), "source", "left").join(
        last, "source", "left"), "mix-plan")


def _keyed(docs: DataFrame, doc_id: str, source: str, seed: int) -> DataFrame:
    """The documents with the columns the plan speaks of, under names of their own."""
    return docs.withColumns({
        PREFIX + "source": _source_key(F.col(source)),
        PREFIX + "h": _hash48(F.lit(seed), F.lit("block"), F.col(doc_id)),
        PREFIX + "d": _hash48(F.lit(seed), F.lit("doc"), F.col(doc_id))})


def _emitted(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The documents once per epoch that holds them, with epoch and block."""
    named = plan.select([F.col(c).alias(PREFIX + c) for c in (
        "source", "n_blocks", "epochs", "cut_key", "cut_doc")])
    c = lambda name: F.col(PREFIX + name)
    joined = docs.join(broadcast_if_small(named), PREFIX + "source").withColumn(
        PREFIX + "block", F.pmod(c("h"), c("n_blocks"))).withColumn(
        PREFIX + "key", _hash48(F.lit(seed), c("source"), c("block"), c("epochs")))
    extra = (c("cut_key").isNotNull() & (
        (c("key") < c("cut_key")) | ((c("key") == c("cut_key")) & (c("d") <= c("cut_doc")))))
    copies = c("epochs").cast("int") + F.when(extra, 1).otherwise(0)
    return joined.withColumn(PREFIX + "epoch", F.explode(
        F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(
            F.array().cast("array<int>"))))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                source: str = "source", entropy_share: float = ENTROPY_SHARE,
                max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None,
                block_tokens: int = BLOCK_TOKENS, seed: int = 0,
                whole_rows: bool = False) -> DataFrame:
    """One row per emission: id, source, epoch, block and ``position`` in [0, 1), which orders
    the blocks of an epoch across sources; with ``whole_rows`` the documents as they were.

    Without ``budget_tokens`` the least repeated source passes exactly once, so every document
    is emitted at least once. Null sources are a source of their own; a source without tokens
    (null or empty texts) is emitted once and has no weight. Documents that share an id, and so
    their hashes, are in or out together. An empty table gives an empty result. Columns whose
    names clash with the result's are ignored, or kept as they were with ``whole_rows``.
    """
    rows = _keyed(docs.select(doc_id, source, text), doc_id, source, seed).select(
        F.col(PREFIX + "source").alias("source"), F.col(PREFIX + "h").alias("h"),
        F.col(PREFIX + "d").alias("d"), tokens_of(F.col(text)).alias("tokens"))
    plan = plan_mix(materialise(rows, "mix-rows"), entropy_share, max_repeats, budget_tokens,
                    block_tokens, seed)
    if whole_rows:
        return _emitted(_keyed(docs, doc_id, source, seed), plan, seed).select(docs.columns)
    out = _emitted(_keyed(docs.select(doc_id, source), doc_id, source, seed), plan, seed)
    c = lambda name: F.col(PREFIX + name)
    return out.select(
        F.col(doc_id), F.col(source), c("epoch").alias("epoch"), c("block").alias("block"),
        (_hash48(F.lit(seed), c("source"), c("block"), c("epoch"))
         / F.lit(float(1 << 48))).alias("position"))
