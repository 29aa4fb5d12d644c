"""From raw text to analysed sentences, noun-phrase spans, term candidates and relations.

A tagger is any function from a list of words to a list of (tag, lemma, is_stop); it runs in Arrow batches, and where
it has ``many``, once for all sentences of a batch. ``tagging.learn`` makes one from an analysed corpus. Without one,
tags follow rules of closed word classes and word endings, as column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate, chain
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ARTICLES, drop_article, strip_tags, tag_string
from . import corpus, relations

Tagger = Callable[[list[str]], list[tuple[str, str, bool]]]

#: Tags of closed word classes and of word endings, the first that fits (fixed values of this package).
CLOSED = {
    "DT": "a an the this that these those each every some any no",
    "IN": "of in on at by for from with without under over between into through during to as than",
    "CC": "and or but nor",
    "PRP": "i you he she it we they me him her us them",
    "MD": "can could may might must shall should will would",
    "VBP": "is are was were be been am has have had do does did such",
}
CUES = {"such": "JJ", "other": "JJ", "including": "VBG", "especially": "RB"}
#: An ending is a pattern, or letters that stand at the word's end, any of several.
ENDINGS = (
    (r"^[0-9][0-9.,]*$", "CD"), (("ly",), "RB"), (("ing",), "VBG"), (("ed",), "VBN"), (("ous", "ful", "ive", "able", "ible", "less", "ical"), "JJ"), (r"[^suix]s$", "NNS"),
)
TOKEN = r"[\p{L}\p{N}_'-]+|[^\p{L}\p{N}_'\s-]"
#: Java repeats a group by recursion, so a long run overflows the stack, unless the group gives nothing back (``*+``).
#: Nothing needs to be given back in a run cut after each noun. Last, what stands before no noun is passed over at once.
_NOUN = r"NN[PS]{0,2}\d+"
_SPAN_WORDS = r"(?:(?:JJ[RS]{0,2}|IN|VB[NG])\d+ )"
SPAN = rf"{_SPAN_WORDS}*+{_NOUN}(?: {_SPAN_WORDS}*+{_NOUN})*+|{_SPAN_WORDS}++"
#: Adjectives and nouns before a noun, with an article (chunks) or of two words at least (candidates).
_CHUNK_WORDS = r"(?:(?:JJ[RS]?|CD)\d+ )"
CHUNK = rf"(?:DT\d+ )?{_CHUNK_WORDS}*+{_NOUN}(?: {_CHUNK_WORDS}*+{_NOUN})*+|{_CHUNK_WORDS}++"
_ADJECTIVE = r"(?:JJ[RS]?\d+ )"
CANDIDATE = rf"(?:{_ADJECTIVE}++{_NOUN}|{_NOUN}(?= {_ADJECTIVE}*+{_NOUN}))(?: {_ADJECTIVE}*+{_NOUN})*+|{_ADJECTIVE}++"


def _words(text: str) -> Column:
    """The sentences of a text as lists of words; none is empty."""
    plain = F.regexp_replace(strip_tags(F.coalesce(F.col(text), F.lit(""))), r"([.!?])[ \t]+", "$1\n")
    found = F.transform(F.split(plain, "\n"), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)))
    return F.filter(found, lambda w: F.size(w) > 0)


def sentences(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, sents: a document's sentences in one row."""
    return docs.select(F.col(id_col).alias("doc_id"), _words(text).alias("sents"))


def tokens(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, sent_id, words: lines and sentence ends part sentences; markup is left out, and empty sentences."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_words(text)).alias("sent_id", "words"))
    return rows.select("doc_id", "sent_id", "words")


def rule_tag(word: Column, low: Column | None = None) -> Column:
    """Tag of a word by the rules of this module; ``low`` is the word in small letters, where that is at hand."""
    low = F.lower(word) if low is None else low
    known = F
    for cue, tag in CUES.items():
        known = known.when(low == cue, F.lit(tag))
    for tag, words in CLOSED.items():
        known = known.when(low.isin(*words.split()), F.lit(tag))
    out = F.when(word == ",", F.lit(",")).when(word.isin(".", "!", "?"), F.lit(".")).when(low.isin(*CUES, *_closed_words()), known)
    out = out.when(~word.rlike(r"[\p{L}\p{N}]"), F.lit(":"))
    for ending, tag in ENDINGS:
        out = out.when(low.rlike(ending) if isinstance(ending, str) else reduce(or_, (low.endswith(e) for e in ending)), F.lit(tag))
    return out.otherwise(F.lit("NN"))


def _closed_words() -> list[str]:
    return [w for words in CLOSED.values() for w in words.split()]


def rule_lemma(word: Column, tag: Column, low: Column | None = None) -> Column:
    """Lower case; plural nouns lose their ending."""
    low = F.lower(word) if low is None else low
    single = F.when(low.rlike(r"[^aeiou]ies$"), F.regexp_replace(low, r"ies$", "y")).when(low.rlike(r"(sh|ch|x|z)es$"), F.regexp_replace(low, r"es$", "")).otherwise(F.regexp_replace(low, r"s$", ""))
    return F.when(tag == "NNS", single).otherwise(low)


def rule_stop(word: Column, low: Column | None = None) -> Column:
    return (F.lower(word) if low is None else low).isin(*_closed_words())


def ruled(words: Column) -> Column:
    """Words as structs of pos, token, tag, lemma, is_stop by the rules; small letters and tags are made once a word."""
    small = lambda w: F.when(w.rlike(r"^[!-@\[-~]+$"), w).otherwise(F.lower(w))  # noqa: E731  lower is the dearest step here, and most words need none
    lowered = F.transform(words, lambda w: F.struct(w.alias("token"), small(w).alias("low")))
    tags = F.transform(lowered, lambda x: F.struct(x["token"].alias("token"), x["low"].alias("low"), rule_tag(x["token"], x["low"]).alias("tag")))
    whole = lambda x, i: F.struct(
        i.cast("int").alias("pos"), x["token"].alias("token"), x["tag"].alias("tag"), rule_lemma(x["token"], x["tag"], x["low"]).alias("lemma"), rule_stop(x["token"], x["low"]).alias("is_stop")
    )
    return F.transform(tags, whole)


def tag(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The analysed sentences: doc_id, sent_id and ``words``, structs of pos, token, tag, lemma, is_stop."""
    sents = tokens(docs, text, id_col)
    if tagger is None:
        return sents.select("doc_id", "sent_id", ruled(F.col("words")).alias("words"))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string()), ("tag", pa.string()), ("lemma", pa.string()), ("is_stop", pa.bool_())]))
    shared = docs.sparkSession.sparkContext.broadcast(tagger) if hasattr(tagger, "many") else None  # a model is shipped once
    single = None if shared else tagger

    def run(batches):
        many = shared.value.many if shared else lambda sents: [single(words) for words in sents]
        for b in batches:
            sents = b.column(2).to_pylist()
            got = [list(x) for x in many(sents)]
            if [len(x) for x in got] != [len(x) for x in sents]:
                raise ValueError("a tagger gives as many tags as there are words")
            parts = list(zip(*chain.from_iterable(got))) or [(), (), ()]
            fields = kind.value_type
            columns = [pa.array([i for x in sents for i in range(len(x))], pa.int32()), pa.array(list(chain.from_iterable(sents)), pa.string()), *(pa.array(p, f.type) for p, f in zip(parts, list(fields)[2:]))]
            offsets = pa.array([0, *accumulate(map(len, sents))], pa.int32())
            words = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(fields)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words], ["doc_id", "sent_id", "words"])

    id_kind = sents.schema["doc_id"].dataType.simpleString()
    return sents.mapInArrow(run, f"doc_id {id_kind}, sent_id int, words array<struct<pos:int,token:string,tag:string,lemma:string,is_stop:boolean>>")


def each(sents: DataFrame, items: Column, name: str) -> DataFrame:
    """doc_id, sent_id and a row for each of the items.

    As ``explode``, but for that Spark infers a filter on the size, pushes it below and so makes the items twice (and
    what they are made of again and again).
    """
    return sents.select("doc_id", "sent_id", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def tagged_rows(sents: DataFrame) -> DataFrame:
    """The long table of analysed words."""
    return each(sents, F.col("words"), "w").select("doc_id", "sent_id", "w.pos", "w.token", "w.tag", "w.lemma", "w.is_stop")


def plain_tags(words: Column) -> Column:
    """Tags with their positions, cue words not told apart."""
    return F.array_join(F.transform(words, lambda w, i: F.concat(w["tag"], i.cast("string"))), " ")


def positions(match: Column) -> Column:
    """Word positions of a match in a tag string."""
    return F.transform(F.regexp_extract_all(match, F.lit(r"[A-Z]+(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def _found(tags: Column, pattern: str) -> Column:
    """Word positions of each match in a tag string; what was only passed over ends with a blank."""
    hits = F.filter(F.regexp_extract_all(tags, F.lit(pattern), F.lit(0)), lambda m: ~m.endswith(" "))
    return F.transform(hits, positions)


def term_spans(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, at: positions of each run of adjectives, nouns, prepositions and participles before a noun."""
    return each(sents, _found(plain_tags(F.col("words")), SPAN), "at")


def term_candidates(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, term: glued lemmas of adjectives and nouns before a noun, two words at least."""
    term = lambda at: F.array_join(F.transform(at, lambda i: F.element_at("words", i + 1)["lemma"]), "_")
    return each(sents, F.transform(_found(plain_tags(F.col("words")), CANDIDATE), term), "term")


def chunks(words: Column) -> Column:
    """start, end, root (offset of the head) of a sentence's noun chunks, in order, without a leading article.

    Cue words of the relation patterns end a chunk.
    """
    span = lambda at: drop_article(words, F.element_at(at, 1), F.element_at(at, -1) + 1, F.element_at(at, -1) - F.element_at(at, 1))
    return F.filter(F.transform(_found(tag_string(words), CHUNK), span), lambda s: s.isNotNull())


def chunk_spans(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id and start, end, root of each of the ``chunks``."""
    return each(sents, chunks(F.col("words")), "s").select("doc_id", "sent_id", "s.start", "s.end", "s.root")


def glue_chunks(sents: DataFrame) -> DataFrame:
    """Sentences with their noun chunks glued into one word each."""
    return corpus.glue_sentences(sents, chunks(F.col("words")))


def extract(docs: DataFrame, tagger: Tagger | None = None, level: str = "t", all_hyponyms: bool = False, start: int = 0, max_docs: int | None = None, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Relations (doc_id, sent_id, hyper, hypo) and terms (doc_id, term) from raw documents.

    Documents with an id below ``start`` are passed over; ``max_docs`` keeps as many of the rest, by id.
    """
    chosen = docs.where(F.col(id_col) >= start) if start else docs
    if max_docs is not None:
        chosen = chosen.orderBy(id_col).limit(max_docs)
    sents = tag(chosen, tagger, text, id_col)
    found = relations.chunk_relations(glue_chunks(sents), level, all_hyponyms)
    return found, term_candidates(sents).select("doc_id", "term")


__all__ = ["ARTICLES", "Tagger", "chunk_spans", "extract", "rule_tag", "tag", "tagged_rows", "term_candidates", "term_spans", "tokens"]
