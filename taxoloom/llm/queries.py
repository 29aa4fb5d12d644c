"""Thin queries over the operators of this subpackage, registered by the entry module."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, conversation_queries, editprint, licenses, lines, packing, simhash, substring, topk, toxicity, urls
from ._run import table

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op2_edit_fingerprint(spark, sf_dir):
    return editprint.with_classes(editprint.fingerprints_with_edits(table(spark, sf_dir, "documents")))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_hits")


def op5_line_dedup(spark, sf_dir):
    return lines.dedup(table(spark, sf_dir, "documents"), digest=True)


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, words=1, radius=2)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op7_substring_dedup(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents"), window=35, digest=True)


def op8_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op9_url_filter(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~_held_out()))
    return toxicity.score(docs, model).withColumn("held_out", _held_out())


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_edit_fingerprint": op2_edit_fingerprint,
    "op3_packing": op3_packing,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    **conversation_queries.QUERIES,
}

TOP_K_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.n AS query_n, q.vec_id AS query_id, c.n, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.n <> q.n),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_n ORDER BY score DESC, vec_id, n)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
_RULES = ", ".join(str((verdict, host, path)) for verdict, host, path in URL_RULES)
_BLOCKED = ", ".join(f"('{h}')" for h in urls.DEFAULT_BLOCKED)
URL_SQL = f"""
WITH rules(verdict, rh, rp) AS (VALUES {_RULES}), blocked(bh) AS (VALUES {_BLOCKED}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(verdict, len(rh || rp)) AS verdict FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
b AS (SELECT DISTINCT page_id FROM p JOIN blocked ON host = bh OR ends_with(host, '.' || bh))
SELECT p.page_id, host, path, rule, coalesce(f.verdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN f ON f.page_id = p.page_id LEFT JOIN b ON b.page_id = p.page_id
"""
ORACLES: dict[str, str] = {"op1_top_k": TOP_K_SQL, "op5_line_dedup": lines.ORACLE, "op9_url_filter": URL_SQL, **conversation_queries.ORACLES}
