"""The registered queries of this package, each over its whole table, and SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (ann, covertree, hardneg, huffman, importance, langid, merkle, mixing,
                            neardup, packing, suffixes, toxicity, urls)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def importance_query(spark, folder):
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


def toxicity_query(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"),
                                   table(spark, folder, "labels"))


def packing_query(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


def jaccard_query(spark, folder):
    return neardup.jaccard_join(table(spark, folder, "documents"))


def urls_query(spark, folder):
    return urls.judge_urls(table(spark, folder, "pages"))


def cover_tree_query(spark, folder):
    return covertree.near_duplicates(table(spark, folder, "embeddings"))


def language_query(spark, folder):
    return langid.identify_languages(table(spark, folder, "documents"))


def huffman_query(spark, folder):
    blocks, lengths = huffman.encode_corpus(table(spark, folder, "documents"))
    return huffman.decode_corpus(blocks, lengths)


def neighbours_query(spark, folder):
    return ann.nearest_neighbours(table(spark, folder, "embeddings"))


def mixing_query(spark, folder):
    out = mixing.mix_sources(table(spark, folder, "documents"))
    return out.select("doc_id", "source", "epoch", "block",
                      F.round("position", 9).alias("position"))


def repeats_query(spark, folder):
    return suffixes.drop_repeats(table(spark, folder, "documents"))


def manifest_query(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))


def negatives_query(spark, folder):
    return hardneg.mine(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_importance_resampling": importance_query,
    "op2_toxicity": toxicity_query,
    "op3_best_fit_packing": packing_query,
    "op4_jaccard_join": jaccard_query,
    "op5_url_filter": urls_query,
    "op6_cover_tree_neardup": cover_tree_query,
    "op7_language_id": language_query,
    "op8_huffman_ids": huffman_query,
    "op9_nearest_neighbours": neighbours_query,
    "op10_mix_sources": mixing_query,
    "op11_suffix_array_dedup": repeats_query,
    "op12_merkle_manifest": manifest_query,
    "op13_hard_negatives": negatives_query,
}


def _mixing_sql() -> str:
    """The same plan in SQL: four rounds of 31 probes, block totals, and the two cuts."""
    def h48(*parts):
        text = " || ':' || ".join(parts)
        return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"

    rounds, low = [], "0.0"
    for r in range(mixing.ROUNDS):
        step = f"{1.0 / mixing.PROBES ** (r + 1)!r}"
        rounds.append(f"""
        r{r} AS (SELECT {low} + (coalesce(min(k), {mixing.PROBES}) - 1) * {step} AS low FROM (
            SELECT k, a, sum(exp(a * l)) AS z, sum(exp(a * l) * a * l) AS zl, count(*) AS n,
                   max(l) - min(l) AS spread
            FROM (SELECT p.k, {low} + p.k * {step} AS a, ln(t.tokens) AS l FROM totals t,
                         range(1, {mixing.PROBES}) p(k) WHERE t.tokens > 0) GROUP BY k, a)
          WHERE ln(z) - zl / z <= {mixing.ENTROPY_SHARE} * ln(CAST(n AS DOUBLE))
            AND (1 - a) * spread <= ln({mixing.MAX_REPEATS}))""")
        low = f"(SELECT low FROM r{r})"
    return f"""
    WITH docs AS (
        SELECT doc_id, source, coalesce('s' || source, 'n') AS s,
               {h48("'0'", "'block'", "coalesce(CAST(doc_id AS VARCHAR), '')")} AS h,
               {h48("'0'", "'doc'", "coalesce(CAST(doc_id AS VARCHAR), '')")} AS d,
               coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS tokens
        FROM documents),
      totals AS (SELECT s, sum(tokens) AS tokens FROM docs GROUP BY s),
      {",".join(rounds)},
      found AS (SELECT low + {1.0 / mixing.PROBES ** mixing.ROUNDS!r} AS a
                FROM r{mixing.ROUNDS - 1}),
      reps AS (SELECT s, tokens, CASE WHEN tokens > 0 THEN
                 pow((SELECT max(tokens) FROM totals) / tokens, 1 - (SELECT a FROM found))
                 ELSE 1 END AS repeats FROM totals),
      sources AS (SELECT s, CAST(floor(repeats) AS BIGINT) AS epochs,
                    (repeats - floor(repeats)) * tokens AS quota,
                    CAST(ceil((tokens + 1) / {float(mixing.BLOCK_TOKENS)}) AS BIGINT) AS n_blocks
                  FROM reps),
      placed AS (SELECT *, {h48("'0'", "s", "CAST(block AS VARCHAR)",
                                "CAST(epochs AS VARCHAR)")} AS key
                 FROM (SELECT docs.*, epochs, quota, h % n_blocks AS block
                       FROM docs JOIN sources USING (s))),
      blocks AS (SELECT s, key, quota, sum(tokens) AS tokens FROM placed GROUP BY ALL),
      cuts AS (SELECT s, arg_min(key, key) AS cut_key,
                      arg_min(quota - running + tokens, key) AS room
               FROM (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY key) AS running
                     FROM blocks) WHERE running > quota GROUP BY s),
      ends AS (SELECT s, max(d) AS cut_doc FROM (
                 SELECT s, d, room, sum(tokens) OVER (PARTITION BY s ORDER BY d) AS running
                 FROM placed JOIN cuts USING (s) WHERE key = cut_key)
               WHERE running <= room GROUP BY s),
      copies AS (SELECT p.*, epochs + CASE WHEN key < cut_key
                   OR (key = cut_key AND d <= cut_doc) THEN 1 ELSE 0 END AS n
                 FROM placed p LEFT JOIN cuts USING (s) LEFT JOIN ends USING (s))
    SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, block,
           round({h48("'0'", "s", "CAST(block AS VARCHAR)", "CAST(epoch AS VARCHAR)")}
                 / {float(1 << 48)}, 9) AS position
    FROM (SELECT *, unnest(range(n)) AS epoch FROM copies)"""


def _manifest_sql(levels: int = 7, tops: int = 4) -> str:
    """The trees level by level, up to 8 ** 7 leaves a language and 8 ** 4 languages; then every
    leaf is folded up. CRC-32 is taken bit by bit."""
    fan, upper = merkle.FAN, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    number = "CAST(doc_id AS VARCHAR)"

    def framed(value):
        value = f"CAST({value} AS VARCHAR)"
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(
            framed(text if c == "text" else c) for c in merkle.FIELDS) + ")"

    crc = f"""xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(
        range(1, length({number}) + 1),
        lambda i: CAST(ascii(substr({number}, i, 1)) AS BIGINT))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) for k in range(8)]),
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
        4294967295)"""

    def climb(name, nodes, steps):
        out = [f"{name}0 AS MATERIALIZED ({nodes})"]
        for k in range(steps):
            out.append(f"""{name}_runs{k} AS MATERIALIZED (
                SELECT tree, place // {fan} AS run, list(digest ORDER BY place) AS nodes,
                       max(c) AS c
                FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k})
                GROUP BY ALL)""")
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT tree, run AS place, CASE
                WHEN c = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS digest
                FROM {name}_runs{k})""")
        return out

    def fold(name, first, runs, tree, steps):
        left = f"array_to_string(nodes[:place % {fan}], '')"
        right = f"array_to_string(nodes[place % {fan} + 2:], '')"
        return [f"{name}0 AS MATERIALIZED ({first})"] + [
            f"""{name}{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (place // {fan} AS place,
                CASE WHEN c = 1 THEN node ELSE sha256({left} || node || {right}) END AS node,
                CASE WHEN c = 1 THEN proof ELSE proof || {left} || {right} END AS proof)
                FROM {name}{k} f JOIN {runs}_runs{k} r
                ON r.tree = {tree} AND r.run = f.place // {fan})""" for k in range(steps)]

    parts = [
        f"""leaves AS MATERIALIZED (SELECT *, row_number() OVER (
                PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
            FROM (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf("text")} AS leaf,
                CASE WHEN {crc} % 3 = 0
                THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")}
                ELSE {leaf("text")} END AS changed FROM documents))""",
        *climb("node", "SELECT tree, place, leaf AS digest FROM leaves", levels),
        f"""subroots AS MATERIALIZED (SELECT tree AS lang, digest AS subroot,
            row_number() OVER (ORDER BY tree) - 1 AS place FROM node{levels})""",
        *climb("top", "SELECT 'all' AS tree, place, subroot AS digest FROM subroots", tops),
        *fold("within", "SELECT doc_id, tree, leaf, place, changed AS node, '' AS proof FROM leaves",
              "node", "f.tree", levels),
        *fold("beyond", f"""SELECT f.* REPLACE (s.place AS place), s.subroot
              FROM within{levels} f JOIN subroots s ON s.lang = f.tree""", "top", "'all'", tops),
    ]
    return "WITH " + ", ".join(parts) + f""" SELECT doc_id, leaf, subroot, digest AS root,
        sha256(proof) AS proof_sha256, node AS folded_root, node = digest AS verified
        FROM beyond{tops}, top{tops}"""


HARD_NEGATIVES_SQL = """
    WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
            CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      anchors AS (SELECT * FROM rows WHERE vec_id % 100 = 0),
      scored AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, b.r, b.vec_id,
            a.label = b.label AS same,
            CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM anchors a JOIN rows b ON a.r != b.r),
      positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (
            PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (
            PARTITION BY p.a, p.r ORDER BY n.score DESC, n.vec_id, n.r) AS INTEGER) AS rank,
        n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same
        AND 80 * p.score <= 100 * n.score AND n.score <= p.score
    QUALIFY rank <= 5"""

ORACLE = {"op10_mix_sources": _mixing_sql(), "op12_merkle_manifest": _manifest_sql(),
          "op13_hard_negatives": HARD_NEGATIVES_SQL}
