"""Column expressions over words, glued terms and analysed sentences (arrays of word structs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words kept as they are in tag strings; leading articles of noun phrases (fixed values).
CUE_WORDS = ("such", "as", "and", "or", "other", "including", "especially")
ARTICLES = ("a", "A", "an", "An", "the", "The")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<.*?>", "")


def title_of(html: Column) -> Column:
    """Content of the first title element, trimmed; null where there is none or only blanks."""
    found = F.trim(F.regexp_extract(html, r"<title>(.*?)</title>", 1))
    return F.when((found != "") & (found != "Home Page"), found)


def glue(words: Column) -> Column:
    return F.array_join(words, "_")


def sub_lists(words: Column) -> Column:
    """All proper runs of consecutive elements, shortest first; none for fewer than two elements."""
    n = F.size(words)
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(words, i, k)),
        )
    )
    return F.when(n > 1, runs).otherwise(F.array().cast("array<array<string>>"))


def tag_string(words: Column, field: str = "token") -> Column:
    """Tags with their positions joined by blanks; cue words stand for themselves."""
    cues = [F.lit(c) for c in CUE_WORDS]
    each = lambda w, i: F.when(w[field].isin(*cues), w[field]).otherwise(F.concat(w["tag"], i.cast("string")))
    return F.array_join(F.transform(words, each), " ")


def np_positions(words: Column) -> Column:
    """Position and head offset of the words that are glued noun phrases."""
    at = F.transform(
        words,
        lambda w, i: F.when(
            w["tag"].rlike(r"^\d+np$") & ~w["lemma"].isin(*CUE_WORDS), F.struct(i.alias("pos"), F.regexp_extract(w["tag"], r"^(\d+)", 1).cast("int").alias("head"))
        ),
    )
    return F.filter(at, lambda x: x.isNotNull())


def head_lemma(token: Column, lemma: Column, head: Column) -> Column:
    """The token's words with only the head replaced by its lemma; unchanged if the lengths differ."""
    t, m = F.split(token, "_"), F.split(lemma, "_")
    swapped = F.array_join(F.transform(t, lambda w, i: F.when(i == head, F.element_at(m, i + 1)).otherwise(w)), "_")
    return F.when((F.size(t) == F.size(m)) & (head < F.size(t)), swapped).otherwise(token)


def drop_article(words: Column, start: Column, end: Column, root: Column) -> Column:
    """Span (start, end, root) without a leading article; null if nothing is left."""
    has = F.element_at(words, start + 1)["token"].isin(*ARTICLES)
    begin = F.when(has, start + 1).otherwise(start)
    head = F.when(has, F.greatest(root - 1, F.lit(0))).otherwise(root)
    return F.when(begin != end, F.struct(begin.alias("start"), end.alias("end"), head.alias("root")))


def pad(words: Column, width: Column) -> Column:
    """The words followed by empty ones up to the width."""
    missing = F.greatest(width - F.size(words), F.lit(0))
    return F.concat(words, F.array_repeat(F.lit(""), missing))
