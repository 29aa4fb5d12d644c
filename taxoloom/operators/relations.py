"""Hypernym relations from analysed sentences, as a bag and as a multimap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import head_lemma


def sentences(tagged: DataFrame) -> DataFrame:
    """doc_id, sent_id and the words as an array of structs in their order."""
    fields = ("pos", "token", "tag", "lemma", "is_stop")
    return tagged.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("words"))


def chunk_relations(sents: DataFrame, level: str = "t", all_hyponyms: bool = False) -> DataFrame:
    """doc_id, sent_id, hyper, hypo over glued noun phrases; level t takes tokens, l head-lemma forms.

    The list's members count only with ``all_hyponyms``.
    """
    found = P.matches(sents)
    pairs = found.withColumn("_h", F.explode(F.concat(F.array("hypo"), "hypos") if all_hyponyms else F.array("hypo")))

    def form(place: str):
        w = F.element_at("words", F.col(f"{place}.start") + 1)
        token = F.lower(w["token"])
        if level == "t":
            return token
        return head_lemma(token, F.lower(w["lemma"]), F.regexp_extract(w["tag"], r"^(\d+)", 1).cast("int"))

    return pairs.select("doc_id", "sent_id", form("hyper").alias("hyper"), form("_h").alias("hypo"))


def word_relations(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, hyper, hypo over noun phrases of single tagged words; all listed hyponyms count."""
    rows = P.matches(sents, P.word_symbols).withColumn("_h", F.explode(F.concat(F.array("hypo"), "hypos")))
    lemmas = lambda g: F.array_join(F.transform(F.slice("words", g["start"] + 1, g["end"] - g["start"]), lambda w: w["lemma"]), " ")
    return rows.select("doc_id", "sent_id", lemmas(F.col("hyper")).alias("hyper"), lemmas(F.col("_h")).alias("hypo"))


def glued(relations: DataFrame) -> DataFrame:
    """The words of both sides joined by ``_``."""
    return relations.withColumns({c: F.translate(c, " ", "_") for c in ("hyper", "hypo")})


def multimap(relations: DataFrame) -> DataFrame:
    """hyper with its hyponyms as a sorted bag."""
    return relations.groupBy("hyper").agg(F.sort_array(F.collect_list("hypo")).alias("hypos"))


def counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("hyper", "hypo").agg(F.count("*").alias("n"))


def encode(relations: DataFrame, vocab: DataFrame) -> DataFrame:
    """Relations between vocabulary ids; pairs with an unknown side are left out."""
    a = vocab.select(F.col("term").alias("hyper"), F.col("term_id").alias("hyper_id"))
    b = vocab.select(F.col("term").alias("hypo"), F.col("term_id").alias("hypo_id"))
    return relations.join(a, "hyper").join(b, "hypo").select("hyper_id", "hypo_id")
