"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsieve.llm import brown
from colsieve.llm.exact_dedup import exact_dedup
from colsieve.llm.lattice import near_vectors
from colsieve.llm.lengths import length_histogram
from colsieve.llm.mixing import schedule
from colsieve.llm.near_dedup import near_duplicates
from colsieve.llm.packing import pack
from colsieve.llm.quality import N_GRADES, grades_of, scored, train
from colsieve.llm.sharding import interleaved_shards
from colsieve.llm.warc import derivatives, responses
from colsieve.sources.scratch import read_table

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("digest", "text_sha256")


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts of shards at most one apart. The groups of equal texts play no part in it."""
    shards = interleaved_shards(read_table(spark, sf_dir, "documents"), n_shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 (polynomial 0xEDB88320, reflected) of the blob ``b`` in DuckDB, which has no function for it.
CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n))"


def crc32_sql(blob: str) -> str:
    """``crc32`` of a blob expression; the query has a one-row CTE ``crc(t)`` with CRC_TABLE."""
    digits = f"hex({blob})"
    each = f"list_transform(range(octet_length({blob})), lambda i: ('0x' || {digits}[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"xor(4294967295, list_reduce({each}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT))"


ORACLES["op2_sharding"] = f"""
WITH crc AS (SELECT {CRC_TABLE} AS t),
rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32_sql("encode(coalesce(text, ''))")} AS text_crc32,
         coalesce('s' || source, 'null') AS name, md5('1-' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle
  FROM documents, crc),
inner_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY shuffle, doc_id, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY name) AS n
  FROM rows),
fractions AS (
  SELECT *, (r::DOUBLE + ('0x' || md5('1:' || name)[1:8])::BIGINT::DOUBLE / 4294967296::DOUBLE) / n::DOUBLE AS fraction FROM inner_ranks),
places AS (
  SELECT *, row_number() OVER (ORDER BY fraction, name, shuffle, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS total FROM fractions)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p * 8 // total)::INTEGER AS shard,
       (p - (p * 8 // total * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM places
"""


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


#: Pairs are counted by their shared shingles: exact, and quadratic in common ones, which the small table bears.
ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (
  SELECT doc_id, doc_id AS r FROM words
  UNION
  SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.doc_id),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT least.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, least.doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept where a good grade is at least as likely as not; the model is fitted on 16,384 rated documents at most."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, grades_of(read_table(spark, sf_dir, "labels")), N_GRADES)
    rows = scored(docs, model, carry=["doc_id"])
    return rows.select("doc_id", "score", "expected_grade", F.col("tail")[0].alias("p_not_toxic"), F.col("tail")[1].alias("p_good"), (F.col("tail")[1] >= 0.5).alias("kept"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once at least, no source more than twice."""
    return schedule(read_table(spark, sf_dir, "documents"), max_epochs=2.0).withColumn("weight", F.round("weight", 9))


#: The exponent in closed form: shares p**a repeat the smallest source (largest / smallest)**(1 - a) times as often as the largest.
ORACLES["op5_mixing"] = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS name, coalesce(doc_id::VARCHAR, 'null') AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens
  FROM documents),
sums AS (SELECT name, sum(tokens)::BIGINT AS total FROM rows GROUP BY name),
ends AS (SELECT max(total)::DOUBLE AS most, min(total)::DOUBLE AS least, sum(total)::DOUBLE AS whole FROM sums),
exponent AS (SELECT *, CASE WHEN most / least <= 2 THEN 0 ELSE 1 - ln(2.0::DOUBLE) / ln(most / least) END AS a FROM ends),
weights AS (
  SELECT name, total, pow(total / whole, a) / sum(pow(total / whole, a)) OVER () AS weight, pow(most / total, 1 - a) AS epochs
  FROM sums, exponent),
plan AS (SELECT *, floor(epochs + 1e-8)::BIGINT AS full_blocks, greatest(epochs - floor(epochs + 1e-8), 0) AS rest FROM weights),
part AS (
  SELECT doc_id, source, tokens, weight, full_blocks AS block, rows.name, key, md5('1-' || full_blocks || '-' || key) AS hex, total, rest
  FROM rows JOIN plan ON plan.name = rows.name WHERE rest > 1e-8),
runs AS (
  SELECT *, sum(tokens) OVER (PARTITION BY name ORDER BY hex, key ROWS UNBOUNDED PRECEDING) - tokens AS before FROM part),
taken AS (
  SELECT doc_id, source, tokens, weight, block, name, key FROM runs WHERE before < rest * total
  UNION ALL
  SELECT doc_id, source, tokens, weight, unnest(range(full_blocks)), rows.name, key FROM rows JOIN plan ON plan.name = rows.name)
SELECT doc_id, source, tokens::BIGINT AS tokens, round(weight, 9) AS weight, block::INTEGER AS block,
       (row_number() OVER (PARTITION BY block, name ORDER BY md5('1-' || block || '-' || key), key) - 1)::BIGINT AS place
FROM taken
"""


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


#: All pairs of a label: the small tables bear it. Links near the threshold may be missed by the hashing, and aren't there.
ORACLES["op6_embedding_near_dedup"] = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings WHERE label IS NOT NULL),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) >= 0.93 * a.norm * b.norm),
reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.vec_id),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN degrees USING (vec_id)
"""


@query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records for each page; their blocks as digest and length, the source's headers as text."""
    records = derivatives(responses(read_table(spark, sf_dir, "pages")))
    heads = F.array_join(F.array_sort(F.transform(F.map_entries("source_headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "; ")
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date", "content_type",
        "block_digest", "payload_digest", F.length("block").cast("long").alias("block_length"), heads.alias("source_headers"),
    )


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(read_table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
