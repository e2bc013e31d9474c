"""The registered queries of this subpackage; each goes over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.runtime import bound_batches, bound_reader, new_path, table

from . import decontamination, fingerprints, jaccard_join, license_scan, packing, sharding, token_counts, token_files, toxicity, url_filters

TOKEN_LIMIT = 4096
END_BYTE_BPE, END_WORD_BPE = 2, 1


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_BYTE_BPE)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt, path = sharding.shard(table(spark, sf_dir, "documents"), 40), new_path(spark, "shards")
    sharding.write_shards(dealt, path)
    return sharding.read_shards(spark, path, dealt).select(
        "doc_id",
        sharding.record_size("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    bound_reader(spark)
    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_WORD_BPE)
    return token_files.read(spark, path, with_ids=False)


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: For pages without canonical links and refresh redirects, as those of the given tables are.
OP5_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), rules(action, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(action, length(h) + length(p)) AS action
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("matches")


def held_out(key: str = "doc_id"):
    """The fold that labels are never learnt from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & ~held_out()).select("doc_id", "toxic")
    return toxicity.fit(docs, labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


#: Pairs of sets by their common shingles, then what is reachable; for small tables.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), places AS (
  SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words
), shingles AS (
  SELECT r, i, lead(t, 4) OVER x IS NOT NULL AS whole, concat_ws(' ', t, lead(t, 1) OVER x, lead(t, 2) OVER x, lead(t, 3) OVER x, lead(t, 4) OVER x) AS g
  FROM places WINDOW x AS (PARTITION BY r ORDER BY i)
), sets AS (
  SELECT doc_id, coalesce(s, []) AS s
  FROM words LEFT JOIN (SELECT r, list_sort(list(DISTINCT g)) AS s FROM shingles WHERE whole OR i = 1 GROUP BY r) USING (r)
), classes AS (
  SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), grams AS (
  SELECT c, n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.c <> b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT c AS a, c AS b FROM classes
  UNION
  SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a
), components AS (
  SELECT a, min(b) AS component FROM reached GROUP BY a
)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN components ON a = c
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fingerprints.with_next(table(spark, sf_dir, "documents"))
    half = "cast(char_length(text) div 2 as int)"
    edited = near.withColumn("edited", F.expr(f"concat(left(text, char_length(text) - {half}), left(next_text, {half}))"))
    sets = edited.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        *(fingerprints.paragraphs(F.col(c)).alias(k) for k, c in (("a", "text"), ("e", "edited"), ("x", "next_text"))),
    )
    df = sets.withColumns({f"cells_{k}": fingerprints.sketch(F.col(k)) for k in ("a", "e", "x")})
    df = fingerprints.with_differences(df, {f"d_{k}": ("a", k, "cells_a", f"cells_{k}") for k in ("e", "x")})
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.encoded(F.col("cells_a")).alias("fingerprint"),
        fingerprints.encoded(F.col("cells_e")).alias("edited_fingerprint"),
        fingerprints.likeness("a", "e", "d_e").alias("near_edited"),
        fingerprints.likeness("a", "x", "d_x").alias("near_next"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_best_fit_packing, op3_sharding, op4_token_files, op5_url_filters, op6_license_scan, op7_toxicity, op8_jaccard_join, op9_fingerprints, op10_decontamination)}
ORACLE_SQL: dict[str, str] = {"op5_url_filters": OP5_SQL, "op8_jaccard_join": OP8_SQL}
