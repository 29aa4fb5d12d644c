"""Corpus views: sentences and words of documents, vocabulary, and index encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def words(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, sent_id, pos, word: lines are sentences, single blanks part words, empty words are left out."""
    sents = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("sent_id", "sent"))
    return sents.select("doc_id", "sent_id", F.posexplode(F.split("sent", " ")).alias("pos", "word")).where("word <> ''")


def nested(corpus: DataFrame) -> DataFrame:
    """doc_id and its sentences as an array of arrays of words."""
    sents = corpus.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    docs = sents.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "w"))).alias("s"))
    return docs.select("doc_id", F.transform("s", lambda s: F.transform(s["w"], lambda w: w["word"])).alias("sents"))


def vocabulary(corpus: DataFrame) -> DataFrame:
    """term_id (dense from 0 by first appearance) and term.

    Ids come from a sort by the first place, ranked by ranges, so no task holds all words.
    """
    first = corpus.groupBy("word").agg(F.min(F.struct("doc_id", "sent_id", "pos")).alias("at"))
    return ranked(first, [], ["at"]).select((F.col("place") - 1).alias("term_id"), F.col("word").alias("term"))


def encode(corpus: DataFrame, vocab: DataFrame, strict: bool = False) -> DataFrame:
    """Words replaced by their ids; with ``strict`` an unknown word is an error."""
    out = corpus.join(vocab.withColumnRenamed("term", "word"), "word", "left" if strict else "inner")
    if strict:
        out = out.withColumn("term_id", F.when(F.col("term_id").isNull(), F.raise_error(F.concat(F.lit("unknown word: "), "word")).cast("long")).otherwise(F.col("term_id")))
    return out.select("doc_id", "sent_id", "pos", "term_id")


def encode_compound(terms: DataFrame, vocab: DataFrame, unknown: str = "unk") -> DataFrame:
    """Glued terms to glued ids; words outside of the vocabulary become ``unknown``."""
    parts = terms.select("term", F.posexplode(F.split("term", "_")).alias("i", "w"))
    joined = parts.join(vocab.select(F.col("term").alias("w"), "term_id"), "w", "left")
    ids = F.coalesce(F.col("term_id").cast("string"), F.lit(unknown))
    return joined.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", ids.alias("id")))), lambda x: x["id"]), "_").alias("ids"))


def occurrences(corpus_idx: DataFrame) -> DataFrame:
    """Places of each term: ascending word positions for each document and sentence."""
    return corpus_idx.groupBy("term_id", "doc_id", "sent_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def glue_spans(tagged: DataFrame, spans: DataFrame) -> DataFrame:
    """Words of each span (doc_id, sent_id, start, end, root) become one, tagged ``<root>np``.

    Positions are counted anew within the sentence; words outside of spans stay as they are.
    """
    inside = spans.select("doc_id", "sent_id", "start", "root", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    rows = tagged.join(inside, ["doc_id", "sent_id", "pos"], "left").withColumn("at", F.coalesce("start", "pos"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "_")
    glued = rows.groupBy("doc_id", "sent_id", "at").agg(
        joined("token").alias("token"), F.first("tag").alias("tag"), joined("lemma").alias("lemma"), F.first("is_stop").alias("is_stop"), F.max("root").alias("root")
    )
    order = Window.partitionBy("doc_id", "sent_id").orderBy("at")
    return glued.select(
        "doc_id", "sent_id", (F.row_number().over(order) - 1).alias("pos"), "token",
        F.when(F.col("root").isNotNull(), F.concat(F.col("root").cast("string"), F.lit("np"))).otherwise(F.col("tag")).alias("tag"),
        "lemma", F.when(F.col("root").isNotNull(), F.lit(False)).otherwise(F.col("is_stop")).alias("is_stop"),
    )


def pieces(words: Column, spans: Column) -> Column:
    """A sentence's words in their order as structs of ``words`` and ``root``: those of each span together, others alone.

    ``spans`` are structs of start, end, root, in order and apart; a lone word has no root.
    """
    lone = lambda a, n: F.transform(F.slice(words, a + 1, n), lambda w: F.struct(F.array(w).alias("words"), F.lit(None).cast("int").alias("root")))
    before = lambda i: F.when(i > 0, F.element_at(spans, i)["end"]).otherwise(F.lit(0))

    def held(s, i):
        span = F.struct(F.slice(words, s["start"] + 1, s["end"] - s["start"]).alias("words"), s["root"].cast("int").alias("root"))
        return F.concat(lone(before(i), s["start"] - before(i)), F.array(span))

    last = before(F.size(spans))
    return F.flatten(F.concat(F.transform(spans, held), F.array(lone(last, F.size(words) - last))))


def glue_sentences(sents: DataFrame, spans: Column) -> DataFrame:
    """Sentences (doc_id, sent_id, words) with each span glued as ``glue_spans`` does it; no row leaves its task."""
    parted = sents.withColumn("_spans", spans).select("doc_id", "sent_id", pieces(F.col("words"), F.col("_spans")).alias("_p"))
    joined = lambda p, c: F.array_join(F.transform(p["words"], lambda w: w[c]), "_")
    glued = lambda p, i: F.struct(
        i.cast("int").alias("pos"), joined(p, "token").alias("token"),
        F.when(p["root"].isNotNull(), F.concat(p["root"].cast("string"), F.lit("np"))).otherwise(p["words"][0]["tag"]).alias("tag"),
        joined(p, "lemma").alias("lemma"), (p["root"].isNull() & p["words"][0]["is_stop"]).alias("is_stop"),
    )
    return parted.select("doc_id", "sent_id", F.transform("_p", glued).alias("words"))


def glue_ids(corpus_idx: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos, id, is_term: ids of each span (doc_id, sent_id, start, end) joined by ``_``, the others as they are.

    A span of one word is a term, too. Positions are counted anew within the sentence.
    """
    inside = spans.select("doc_id", "sent_id", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    rows = corpus_idx.join(inside, ["doc_id", "sent_id", "pos"], "left").withColumn("at", F.coalesce("start", "pos"))
    held = F.array_sort(F.collect_list(F.struct("pos", F.col("term_id").cast("string").alias("id"))))
    glued = rows.groupBy("doc_id", "sent_id", "at").agg(F.array_join(F.transform(held, lambda x: x["id"]), "_").alias("id"), F.max(F.col("start").isNotNull()).alias("is_term"))
    order = Window.partitionBy("doc_id", "sent_id").orderBy("at")
    return glued.select("doc_id", "sent_id", (F.row_number().over(order) - 1).alias("pos"), "id", "is_term")


def glued_ids(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """``glue_ids`` of words that know their new place: doc_id, sent_id, pos (new), i (old), is_term, lemma.

    One join for the ids and one grouping; spans and places need no shuffle of their own.
    """
    rows = found.join(vocab.withColumnRenamed("term", "lemma"), "lemma")
    held = F.array_sort(F.collect_list(F.struct("i", F.col("term_id").cast("string").alias("id"))))
    return rows.groupBy("doc_id", "sent_id", "pos").agg(F.array_join(F.transform(held, lambda x: x["id"]), "_").alias("id"), F.max("is_term").alias("is_term"))


def split_parts(docs: DataFrame, parts: int) -> DataFrame:
    """Number of the chunk of consecutive documents that each one falls in; chunks differ by one document at most."""
    total = docs.agg(F.count("*").alias("n"))
    placed = ranked(docs.select("doc_id"), [], ["doc_id"])
    return placed.join(F.broadcast(total)).select("doc_id", F.floor((F.col("place") - 1) * parts / F.col("n")).cast("long").alias("part"))
