"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    bpe, byte_bpe, lexical, lm, mixing, neardup, ngram_join, paragraphs, periodic, pii, quality, toxicity, urls)
from tillroll.llm.common import table

#: The encoders' files among the installed public tokenizers.
TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
#: Documents that lexical search gives for an item.
BEST = 50


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


def op2_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "embeddings"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm.held_out(F.col("doc_id"))
    return lm.score(table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.find(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("pattern")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                            ~toxicity.held_out(F.col("doc_id")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                        toxicity.is_toxic().cast("int").alias("predicted"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.find(periodic.with_planted_periods(table(spark, sf_dir, "documents"))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BEST)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return byte_bpe.encode(table(spark, sf_dir, "documents"), str(public_tokenizers.path(BYTE_RANKS)),
                           public_tokenizers.PATTERN, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_near_embeddings, op3_lm_scoring, op4_pii, op5_repeated_passages, op6_bpe,
    op7_url_filters, op8_toxicity, op9_ngram_join, op10_mixing, op11_periodic_runs, op12_lexical_search, op13_byte_bpe)}

OP7_SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parsed AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM cut
), rules(h, p, v) AS (VALUES {", ".join(str(r) for r in urls.HOST_RULES)}
), fitting AS (
  SELECT host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, parsed.host, parsed.path, rule,
  coalesce(v, CASE WHEN {urls.any_pattern_sql(urls.PATTERNS, "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
    THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN fitting ON parsed.host = fitting.host AND parsed.path = fitting.path AND k = 1
"""

OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS s,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM sized GROUP BY source
), levels AS (
  -- the level l solves sum(least(2 s, l w)) = 1.5 * total; it is one of these candidates
  SELECT a.source, (SELECT (sum(s) * 150)::BIGINT FROM sources)
      - (SELECT coalesce(sum(2 * s), 0)::BIGINT * 100 FROM sources b WHERE 2 * b.s * a.w < 2 * a.s * b.w) AS num,
    (SELECT sum(w)::BIGINT * 100 FROM sources b WHERE 2 * b.s * a.w >= 2 * a.s * b.w) AS den, 2 * a.s AS s2, a.w
  FROM sources a
), level AS (
  SELECT num, den FROM levels WHERE s2 * den > num * w ORDER BY s2::DOUBLE / w LIMIT 1
), targets AS (
  SELECT source, s, CASE WHEN (2 * s) * coalesce((SELECT den FROM level), 0) <= coalesce((SELECT num FROM level), 0) * w
    OR NOT EXISTS (SELECT 1 FROM level) THEN (2 * s)::DOUBLE
    ELSE ((SELECT num FROM level) * w)::DOUBLE / (SELECT den FROM level)::DOUBLE END AS target
  FROM sources
), rated AS (
  SELECT source, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM targets
), placed AS (
  -- 256 times a point on the circle, and 256 times the arc's length
  SELECT doc_id, size, rated.source, s, target, rate, (rate - floor(rate)) * 256 AS arc,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * 256 AS spot
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
), tried AS (
  SELECT source, start, sum(size * (floor(rate)::BIGINT + CASE
      WHEN (floor(spot)::BIGINT - start + 256) % 256 < floor(arc) THEN 1
      WHEN (floor(spot)::BIGINT - start + 256) % 256 = floor(arc) AND spot - floor(spot) < arc - floor(arc) THEN 1 ELSE 0 END)) AS words,
    any_value(target) AS goal
  FROM placed, range(256) AS seeds(start) GROUP BY source, start
), seed AS (
  SELECT source, start FROM tried
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(words::DOUBLE - goal), start) = 1
)
SELECT doc_id, size, s AS source_size, target,
  (size * (floor(rate)::BIGINT + CASE
    WHEN (floor(spot)::BIGINT - start + 256) % 256 < floor(arc) THEN 1
    WHEN (floor(spot)::BIGINT - start + 256) % 256 = floor(arc) AND spot - floor(spot) < arc - floor(arc) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed JOIN seed ON placed.source IS NOT DISTINCT FROM seed.source
"""

OP2_SQL = """
WITH RECURSIVE vector AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vector a JOIN vector b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) >= 0.9 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN link l ON l.a = r.b OR l.b = r.b
), part AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id OR b = vec_id)::BIGINT AS n_links, component_id,
  vec_id = component_id AS kept
FROM embeddings JOIN part USING (vec_id)
"""

OP9_SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM cut
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM overlap JOIN sized x ON a = x.doc_id JOIN sized y ON b = y.doc_id
  WHERE 100 * n_shared >= 75 * (x.n + y.n - n_shared)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN link l ON l.a = r.b OR l.b = r.b
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM documents d LEFT JOIN sized USING (doc_id)
"""

OP12_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), sized AS (
  SELECT d, doc_id, count(*)::BIGINT AS n FROM cut GROUP BY d, doc_id
), total AS (
  SELECT count(*)::BIGINT AS number, sum(n)::BIGINT AS words FROM sized
), posting AS (
  SELECT d, term, count(*)::BIGINT AS tf FROM cut GROUP BY d, term
), item AS (
  SELECT row_number() OVER () AS i, item_id, text FROM benchmark
), wanted AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM item
), weighted AS (
  SELECT term, floor(1000.0 * ln((2 * any_value(number) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, total GROUP BY term
), scored AS (
  SELECT i, item_id, doc_id, d,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * number) // words)))))::BIGINT AS score
  FROM wanted JOIN weighted USING (term) JOIN posting USING (term) JOIN sized USING (d), total
  GROUP BY i, item_id, doc_id, d
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""

ORACLE_SQL: dict[str, str] = {"op2_near_embeddings": OP2_SQL, "op7_url_filters": OP7_SQL, "op9_ngram_join": OP9_SQL,
                              "op10_mixing": OP10_SQL, "op12_lexical_search": OP12_SQL}
