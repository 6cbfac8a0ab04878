"""The operators as queries on the benchmark tables, with SQL where it says the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.llm import (
    ann, jaccard, mixing, packing, phrases, pii, pu_quality, quality_rules, secrets, toxicity, warc, whitening, winnowing,
)
from trendlake.llm.tables import fold

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0).select("vec_id"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("shuffle_key")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 4) == 2
    scored = pu_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quality_rules, op3_pii, op4_secrets, op5_jaccard_join, op6_warc, op7_toxicity,
        op8_nearest_neighbours, op9_mixing, op10_pu_quality, op11_winnowing,
        op12_whitening, op13_collocations,
    )
}

_OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), spots AS (
  SELECT row, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), win AS (
  SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM spots
), rep AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY row
), m AS (
  SELECT w.row, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.row = cov.row
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CAST(CAST(n_symbols > 0.1::DOUBLE * n_words AS INT)
            + CAST(n_lines >= 4 AND n_dup_lines > 0.3::DOUBLE * n_lines AS INT)
            + CAST(word_chars < 2.0::DOUBLE * n_words OR word_chars > 20.0::DOUBLE * n_words AS INT) AS INT) AS soft_failures
  FROM m
), h AS (
  SELECT host, count(*) AS host_docs, CAST(count(*) FILTER (WHERE base_failed OR soft_failures > 0) AS BIGINT) AS host_failed
  FROM f GROUP BY host
), p AS (
  SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE AS f, sum(host_docs::DOUBLE * host_docs) AS n2,
         sum(host_failed::DOUBLE * host_failed / host_docs) AS f2, count(*)::DOUBLE AS k FROM h
), r AS (
  SELECT n, f / n AS m, CASE WHEN f > 0 AND f < n AND n - n2 / n - (k - 1) <> 0 THEN
    ((f2 - n * (f / n) * (f / n)) - (f / n) * (1 - f / n) * (k - 1)) / ((f / n) * (1 - f / n) * (n - n2 / n - (k - 1))) END AS rho FROM p
), s AS (
  SELECT m, coalesce(CASE WHEN rho > 0 THEN greatest(1 / rho - 1, 2.0::DOUBLE) ELSE n END, n) AS s FROM r
), hr AS (
  SELECT host, host_docs, host_failed, (host_failed + s.m * s.s) / (host_docs + s.s) AS rate FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failures, host, host_docs,
       host_failed, round(rate, 6) AS host_rate, NOT base_failed AND soft_failures = 0 AND rate <= 0.6 AS kept
FROM f JOIN hr USING (host)
"""

_OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.a, reach.c FROM links JOIN reach ON links.b = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

_OP6 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((('0x' || substr(sha1(t), CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS INT)) % 32 + 1 AS BIGINT), 1)),
      'string_agg', '') AS payload_digest FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN largest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest > page_id THEN largest END AS refers_to FROM g
"""

_OP9 = r"""
WITH RECURSIVE z AS (
  SELECT coalesce(source, '') AS s, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY 1
), t AS (SELECT sum(size) AS size, sum(sqrt(size)) AS w FROM z),
r AS (
  SELECT s, CASE WHEN z.size > 0 THEN sqrt(z.size) / t.w * t.size / z.size ELSE 1.0 END AS rate FROM z, t
), c AS (
  SELECT d.*, rate, unnest(range(1, CAST(greatest(ceil(rate / 64.0), 1) AS BIGINT) + 1)) AS j,
         greatest(ceil(rate / 64.0), 1) AS parts FROM documents d JOIN r ON r.s = coalesce(source, '')
), u AS (
  SELECT doc_id, rate / parts AS m, ('0x' || substr(md5(doc_id || '|17|' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM c
), pois AS (
  SELECT doc_id, m, u, exp(-m) AS p, exp(-m) AS c, 0 AS k FROM u
  UNION ALL SELECT doc_id, m, u, p * m / (k + 1), c + p * m / (k + 1), k + 1 FROM pois WHERE u >= c
), n AS (
  SELECT doc_id, sum(k) AS n FROM (SELECT doc_id, m, u, max(k) AS k FROM pois GROUP BY ALL) GROUP BY doc_id
), e AS (
  SELECT documents.*, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy FROM documents JOIN n USING (doc_id)
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy FROM e
"""

_OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (SELECT lang, unnest(pieces) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS ph
  FROM w, range(1, 5) r(m) WHERE len(w) >= m
), c AS MATERIALIZED (SELECT lang, ph, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM c WHERE len(ph) > 1),
s AS (
  SELECT cut.lang, cut.ph, cut.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a) // (x.a::HUGEINT + y.a) AS score
  FROM cut JOIN c x ON x.lang = cut.lang AND x.ph = cut.ph[1 : k] JOIN c y ON y.lang = cut.lang AND y.ph = cut.ph[k + 1 : len(cut.ph)]
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS o FROM s),
f AS (
  SELECT lang, unnest(list_transform(range(1, len(ph) - m + 2), lambda i: ph[i : i + m - 1])) AS ph, a
  FROM c, range(2, 4) r(m) WHERE len(ph) > m
), longer AS (SELECT lang, ph, max(a) AS longer FROM f GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.ph, ' ') AS phrase FROM b LEFT JOIN longer z ON z.lang = b.lang AND z.ph = b.ph
  WHERE o = 1 AND NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * b.a, false)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op2_quality_rules": _OP2, "op5_jaccard_join": _OP5, "op6_warc": _OP6, "op9_mixing": _OP9, "op13_collocations": _OP13,
}
