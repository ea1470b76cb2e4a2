"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    ann, bpe, language, licenses, mixing, negatives, pii, pq, quality, simhash, urls, warc, whitening,
)
from parlance.llm.common import table

TOKENIZER = "word_bpe_49k.json"
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def tokenizer_path() -> str:
    return str(public_tokenizers.path(TOKENIZER))


def op1_ann(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where(F.col("vec_id") % ann.EVERY == 0))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = (table(spark, sf, t) for t in ("documents", "labels"))
    return quality.classify(docs.select("doc_id", "text"), labels).select("_row.doc_id", "held_out", "score", "predicted")


def op3_pq(spark: SparkSession, sf: str) -> DataFrame:
    return pq.linked(table(spark, sf, "embeddings"))


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op6_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), RULES)


def op7_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf, "documents"))


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents"))


def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.archived(table(spark, sf, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    out = whitening.whitening(table(spark, sf, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


QUERIES = {
    q.__name__: q for q in (
        op1_ann, op2_quality, op3_pq, op4_pii, op5_language, op6_urls, op7_licenses, op8_simhash, op9_bpe, op10_mixing,
        op11_warc, op12_whitening, op13_negatives,
    )
}

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLES = {
    "op3_pq": f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {pq.COSINE}),
reached AS (
  SELECT vec_id AS id, vec_id AS node FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.node),
classes AS (SELECT id, min(node) AS component_id FROM reached GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN classes c ON c.id = e.vec_id LEFT JOIN counts k ON k.id = e.vec_id""",
    "op6_urls": f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS place
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND place = 1""",
    "op10_mixing": f"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS rank, md5(coalesce(text, '')) AS tie,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, [{", ".join(map(str, map(float, mixing.WEIGHTS)))}][turn % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS weight,
    [{", ".join(map(str, mixing.TILTS))}][turn % {len(mixing.TILTS)} + 1]::DOUBLE AS tilt,
    {mixing.CAP}.0::DOUBLE * source_size AS most FROM sources),
ordered AS (
  SELECT *, sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most AS fixed,
    sum(weight) OVER (ORDER BY most / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open FROM weighed),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) - fixed) / open AS level FROM ordered),
level AS (SELECT max(level) AS level FROM levels WHERE level <= most / weight),
plan AS (SELECT source, source_size, tilt, least(most, weight * coalesce((SELECT level FROM level), 0)) AS target FROM levels),
run AS (
  SELECT d.*, p.source_size, p.target, p.tilt,
    sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, tie ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS middle
  FROM docs d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(ceil((target - middle) / nullif(source_size, 0)), 0) ELSE 0 END::BIGINT AS copies,
    middle / nullif(target, 0) AS u FROM run)
SELECT doc_id, size, source_size, target, size * copies AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN tilt = 0 THEN u
    ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)) / (2 * tilt) END, 6) END AS position FROM taken""",
    "op11_warc": """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes,
    sha1(coalesce(html, '')) AS h FROM pages),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS place,
    first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS least FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN least END AS refers_to
FROM placed""",
    "op13_negatives": f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives.NEGATIVES}""",
}
