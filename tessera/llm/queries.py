"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import fuzzy_hash, kneser_ney, near_dedup, packing, pitman_yor, sentencepiece_bpe, token_files, toxicity, url_filter, warc
from tessera.llm.common import small_batches


def table(spark, sf_dir, name):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the url query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=80)


def op2_fuzzy_hash(spark, sf_dir):
    done = fuzzy_hash.next_text_likeness(table(spark, sf_dir, "documents"))
    sha = F.sha2("edited", 256).alias("edited_sha256")
    return done.select("doc_id", "n_chars", sha, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_sentencepiece(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    done = sentencepiece_bpe.encode_and_decode(table(spark, sf_dir, "documents"), model)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _bucket(column, n):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_bucket("doc_id", 3) != 1)
    model = toxicity.train(docs.where(_bucket("doc_id", 3) != 1), labels)
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op7_quality(spark, sf_dir):
    judged = kneser_ney.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *kneser_ney.BASE, "base_failed", "kept", "perplexity")


def op8_pitman_yor(spark, sf_dir):
    held_out = F.coalesce(_bucket("doc_id", 5) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("trained", ~held_out)
    done = pitman_yor.score(docs).withColumn("held_out", ~F.col("trained"))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op10_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    read = token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    size = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return read.select("doc_id", "start", size, F.crc32("ids").alias("ids_crc32"))


def queries():
    made = [op1_near_dedup, op2_fuzzy_hash, op3_sentencepiece, op4_url_filter, op5_toxicity, op6_packing, op7_quality, op8_pitman_yor, op9_warc, op10_token_files]
    return {f.__name__: f for f in made} | {"pipeline": corpus_pipeline.run}


SQL_OP1 = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.node WHERE r.c < e.v),
m AS (SELECT node, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL_OP4 = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, row_number() OVER () AS r,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, r, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw,
    coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path FROM cut),
hosts AS (SELECT page_id, r, path,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
fits AS (SELECT r, max(struct_pack(n := length(h) + length(p), k := length(h), rule := h || p, v := v)) AS best
  FROM hosts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM hosts LEFT JOIN fits USING (r)
"""


SQL_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p),
digits AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5))::BIGINT) AS fives FROM d)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(fives, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digits
"""


def oracle_sql():
    return {"op1_near_dedup": SQL_OP1, "op4_url_filter": SQL_OP4, "op9_warc": SQL_OP9}
