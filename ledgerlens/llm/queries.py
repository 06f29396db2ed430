"""Registered queries: each operator, with production parameters, on its
whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (decontamination, langid, linededup, lm, minhash, mixing, phrases,
                            sharding, topk, toxicity, urlfilter, veccodes, vecdedup)
from ledgerlens.llm.common import fold, ship_package, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_index")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(fold(F.col("doc_id"), 5) != 0))
    return langid.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "rejected", "cross_entropy")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    model, counts = lm.train(docs.filter(fold(F.col("doc_id"), 5) != 1))
    scored = lm.score(docs, model, counts, keep=["doc_id"])
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "copy", F.round("rate", 6).alias("rate"), "mix_key")


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return vecdedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)
                       .alias("kept_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), f"vec_id % {topk.EVERY} = 0")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return phrases.mine_collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return veccodes.compression_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
    "op11_topk_search": op11_topk_search,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = ("regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_OP5 = f"""
WITH item AS (
  SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL
), spot AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM item WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
         array_to_string(list_slice(w, i, i + 12), ' ') AS body
  FROM spot
), doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce({_WORDS.format('text')}, []) AS w FROM documents
), place AS (
  SELECT r, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i
  FROM doc, (SELECT DISTINCT size FROM win) s WHERE len(w) >= s.size
), hit AS (
  SELECT p.r, p.i, p.size, win.item_id
  FROM (SELECT r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS body
        FROM place) p JOIN win USING (size, body)
), inside AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hit) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hit WHERE item_id IS NOT NULL)
  GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN inside USING (r) LEFT JOIN named USING (r)
"""

_OP6 = f"""
WITH RECURSIVE size AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rated AS (
  SELECT source, {mixing.EPOCHS}::DOUBLE * sum(n) OVER () * pow(n::DOUBLE, {mixing.EXPONENT}::DOUBLE)
         / sum(pow(n::DOUBLE, {mixing.EXPONENT}::DOUBLE)) OVER () / n AS rate
  FROM size
), term AS (
  SELECT source, rate, 0 AS j, exp(-rate) AS p, exp(-rate) AS below FROM rated
  UNION ALL
  SELECT source, rate, j + 1, p * rate / (j + 1), below + p * rate / (j + 1)
  FROM term WHERE j < ceil(rate + 20 * sqrt(rate) + 40)
), keyed AS (
  SELECT doc_id, source, concat_ws('|', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''),
                                   md5(coalesce(text, '')), coalesce(source, '')) AS k
  FROM documents
), drawn AS (
  SELECT doc_id, source, CASE WHEN nth = 1 THEN k ELSE concat_ws('~', k, nth) END AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY k) AS nth FROM keyed)
)
SELECT doc_id, d.source, j + 1 AS copy, round(rate, 6) AS rate, md5(concat_ws('/', k, j + 1)) AS mix_key
FROM drawn d JOIN term t ON d.source IS NOT DISTINCT FROM t.source
 AND CAST('0x' || substr(md5(k), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 >= below
"""

_OP8 = f"""
WITH line AS (
  SELECT doc_id, r, unnest(string_split(body, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) AS nth
  FROM (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS body FROM documents)
), keyed AS (
  SELECT *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key
  FROM line
), common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(holder) FILTER (doc_id <> holder) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth)
                       FILTER (holder IS NULL OR doc_id = holder), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY r, doc_id
"""

_DIGITS = ("list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS {}))")
_FINITE = ("embedding IS NOT NULL AND "
           "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")

_OP11 = f"""
WITH vec AS (
  SELECT row_number() OVER () AS r, vec_id, {_DIGITS.format('DOUBLE')} AS v
  FROM embeddings WHERE {_FINITE}
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vec q JOIN vec c ON q.r <> c.r WHERE q.vec_id % {topk.EVERY} = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
WHERE rank <= {topk.K}
"""

_OP12 = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(b, '[^\\x20\\x09]+') AS w FROM (
    SELECT lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")},
                                              '[.,;:!?\\x0A-\\x0D]')) AS b FROM documents)
), gram AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM piece, (SELECT unnest(range(1, {phrases.LONGEST} + 1)) AS m) WHERE len(w) >= m)
  GROUP BY ALL
), total AS (
  SELECT lang, sum(f) AS n FROM gram WHERE m = 1 GROUP BY lang
), cand AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram
  WHERE m > 1 AND f >= {phrases.MIN_COUNT}
), cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
         ({phrases.SCORE_SCALE}::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN gram l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN gram r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), worst AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_part AS (
  SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM (
    SELECT *, unnest(range(2, m)) AS s FROM cand)
), covered AS (
  SELECT DISTINCT c.lang, c.phrase FROM inner_part p
  JOIN cand c ON c.lang = p.lang AND c.phrase = array_to_string(p.w[i:i + s - 1], ' ')
  WHERE 100::HUGEINT * p.a >= {phrases.COVER_PERCENT} * c.a
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst ANTI JOIN covered USING (lang, phrase))
JOIN total USING (lang) WHERE rank <= {phrases.TOP}
"""


def _op13(parts: int = veccodes.PARTS, entries: int = veccodes.ENTRIES, rounds: int = veccodes.ROUNDS) -> str:
    """Full comparisons in every round; vectors of one length."""
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {_DIGITS.format('BIGINT')} AS v
  FROM embeddings WHERE {_FINITE}
), part AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
  FROM kept, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, x FROM part WHERE r <= {entries}
)"""]
    for n in range(rounds + 1):
        steps.append(f""", near{n} AS MATERIALIZED (
  SELECT r, p, x, min(d * {entries} + e) AS best FROM (
    SELECT r, p, part.x, e, list_sum(list_transform(range(1, len(part.x) + 1),
           lambda i: (part.x[i] - b.x[i]) * (part.x[i] - b.x[i]))) AS d
    FROM part JOIN book{n} b USING (p))
  GROUP BY r, p, x
)""")
        if n < rounds:
            steps.append(f""", mean{n} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT p, best % {entries} AS e, i, sum(x[i]) AS s, count(*) AS n
    FROM near{n}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM part))) AS i) GROUP BY ALL)
  GROUP BY p, e
), book{n + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN mean{n} m USING (p, e)
)""")
    return "".join(steps) + f""", coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY p) AS code,
         CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds})
         AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


# Sharding needs crc32 and a 64-bit hash, language models and shingle
# graphs need more than SQL: their tests compare with plain Python.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": _OP5,
    "op6_mixing": _OP6,
    "op8_line_dedup": _OP8,
    "op11_topk_search": _OP11,
    "op12_collocations": _OP12,
    "op13_vector_codes": _op13(),
}
