"""From raw documents to packed training sequences, in five written stages.

Each stage takes the documents that its predecessor kept; its decisions take effect. All stages but the last
return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoloom.llm import lines, packing, simhash, substring, toxicity
from taxoloom.llm._run import written

#: No stage after the first can be checked by SQL: its input depends on a learned model.
ORACLE_SQL = None
#: Near duplicates: five-word shingles whose sets have a Jaccard similarity of 0.8 or more. Candidates are found by
#: 256 bits, of which such a pair differs in 38 on average (deviation 5.7). Of 4000 random pairs of 54 to 216 shingles
#: at exactly 0.8, 42 met in no band and 1 differed in over 60 bits, so 1.1 % were lost; above 0.8 it falls quickly.
NEAR_WORDS, NEAR_RADIUS, NEAR_BANDS, NEAR_BITS, NEAR_LEAST = 4, 60, 224, 20, 0.8


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels outside the held-out third, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = toxicity.learn(docs, labels)
    return toxicity.keep_clean(docs, model)


def _same_columns(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted anew where the text changed."""
    out = changed
    if "n_chars" in docs.columns and "n_removed" in changed.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines, however short, and so of runs of lines are cut out of the texts."""
    return _same_columns(docs, lines.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id stays."""
    segments = simhash.sampled_segments(NEAR_WORDS, NEAR_BANDS, NEAR_BITS)
    return simhash.keep_one(docs, 5, NEAR_WORDS, NEAR_RADIUS, segments, NEAR_LEAST)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words are cut out of the texts."""
    return _same_columns(docs, substring.dedup(docs, window=35))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        table = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
