"""Queries from raw text to tags, spans, candidates and relations, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, frequencies, linguistics, relations, ruled, tagging
from ..sources import scratch
from .registry import query, table

_CLOSED = " ".join(f"WHEN low IN ({', '.join(repr(w) for w in words.split())}) THEN '{t}'" for t, words in linguistics.CLOSED.items())
TAGGED = rf"""
s0 AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '<.*?>', '', 'g'), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS lines FROM documents),
s1 AS (SELECT doc_id, list_filter(list_transform(lines, lambda s: regexp_extract_all(s, '[\p{{L}}\p{{N}}_''-]+|[^\p{{L}}\p{{N}}_''\s-]')), lambda w: len(w) > 0) AS sents FROM s0),
s2 AS (SELECT doc_id, i - 1 AS sent_id, sents[i] AS w FROM s1, LATERAL (SELECT unnest(range(1, len(sents) + 1)) AS i)),
s3 AS (SELECT doc_id, sent_id, j - 1 AS pos, w[j] AS token, lower(w[j]) AS low FROM s2, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j)),
s4 AS (SELECT *, CASE WHEN token = ',' THEN ',' WHEN token IN ('.', '!', '?') THEN '.' WHEN NOT regexp_matches(token, '[\p{{L}}\p{{N}}]') THEN ':'
  WHEN low IN ('such', 'other') THEN 'JJ' WHEN low = 'including' THEN 'VBG' WHEN low = 'especially' THEN 'RB' {_CLOSED}
  WHEN regexp_matches(low, '^[0-9][0-9.,]*$') THEN 'CD' WHEN low LIKE '%ly' THEN 'RB' WHEN low LIKE '%ing' THEN 'VBG' WHEN low LIKE '%ed' THEN 'VBN'
  WHEN regexp_matches(low, '(ous|ful|ive|able|ible|less|ical)$') THEN 'JJ' WHEN regexp_matches(low, '[^suix]s$') THEN 'NNS' ELSE 'NN' END AS tag FROM s3),
tagged AS (SELECT doc_id, sent_id, pos, token, tag, CASE WHEN tag <> 'NNS' THEN low WHEN regexp_matches(low, '[^aeiou]ies$') THEN regexp_replace(low, 'ies$', 'y')
  WHEN regexp_matches(low, '(sh|ch|x|z)es$') THEN regexp_replace(low, 'es$', '') ELSE regexp_replace(low, 's$', '') END AS lemma FROM s4),
strings AS (SELECT doc_id, sent_id, string_agg(tag || pos, ' ' ORDER BY pos) AS tags, string_agg(CASE WHEN token IN ('such', 'as', 'and', 'or', 'other', 'including', 'especially') THEN token ELSE tag || pos END, ' ' ORDER BY pos) AS cued,
  list(lemma ORDER BY pos) AS lem, list(token ORDER BY pos) AS tok FROM tagged GROUP BY ALL)
"""


def tagged(spark, sf):
    return linguistics.tag(table(spark, sf, "documents"))


@query("rule_tags", f"WITH {TAGGED} SELECT tag, lemma, count(*) AS n FROM tagged GROUP BY ALL")
def rule_tags(spark, sf):
    return linguistics.tagged_rows(tagged(spark, sf)).groupBy("tag", "lemma").agg(F.count("*").alias("n"))


@query(
    "pos_term_spans",
    rf"WITH {TAGGED}, m AS (SELECT doc_id, sent_id, unnest(regexp_extract_all(tags, '((JJ[RS]?[RS]?|NN[PS]?[PS]?|IN|VBN|VBG)[0-9]+ )*NN[PS]?[PS]?[0-9]+')) AS m FROM strings) SELECT doc_id, sent_id::INT AS sent_id, array_to_string(regexp_extract_all(m, '[0-9]+'), ' ') AS at FROM m",
)
def pos_term_spans(spark, sf):
    return ruled.term_spans(table(spark, sf, "documents")).withColumn("at", F.array_join(F.transform("at", lambda x: x.cast("string")), " "))


@query(
    "pos_term_candidates",
    rf"WITH {TAGGED}, m AS (SELECT doc_id, lem, unnest(regexp_extract_all(tags, '((NN[PS]?[PS]?|JJ[RS]?)[0-9]+ )+NN[PS]?[PS]?[0-9]+')) AS m FROM strings) SELECT array_to_string(list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: lem[x::INT + 1]), '_') AS term, count(*) AS n, count(DISTINCT doc_id) AS df FROM m GROUP BY ALL",
)
def pos_term_candidates(spark, sf):
    found = ruled.term_candidates(table(spark, sf, "documents")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.count("doc_id").alias("df"))


@query(
    "noun_chunks",
    rf"""WITH {TAGGED}, m AS (SELECT doc_id, sent_id, tok, unnest(regexp_extract_all(cued, '(DT[0-9]+ )?((JJ[RS]?|NN[PS]?[PS]?|CD)[0-9]+ )*NN[PS]?[PS]?[0-9]+')) AS m FROM strings),
    p AS (SELECT doc_id, sent_id, tok, list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: x::INT) AS a FROM m),
    q AS (SELECT doc_id, sent_id, a[1] AS s, a[-1] + 1 AS e, tok[a[1] + 1] IN ('a', 'A', 'an', 'An', 'the', 'The') AS art FROM p)
    SELECT doc_id, sent_id::INT AS sent_id, (s + art::INT)::INT AS start, e::INT AS "end", (e - 1 - s - art::INT)::INT AS root FROM q WHERE s + art::INT < e""",
)
def noun_chunks(spark, sf):
    return linguistics.chunk_spans(tagged(spark, sf))


@query(
    "glued_chunks",
    rf"""WITH {TAGGED}, m AS (SELECT doc_id, sent_id, tok, unnest(regexp_extract_all(cued, '(DT[0-9]+ )?((JJ[RS]?|NN[PS]?[PS]?|CD)[0-9]+ )*NN[PS]?[PS]?[0-9]+')) AS m FROM strings),
    p AS (SELECT doc_id, sent_id, tok, list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: x::INT) AS a FROM m),
    q AS (SELECT doc_id, sent_id, a[1] + (tok[a[1] + 1] IN ('a', 'A', 'an', 'An', 'the', 'The'))::INT AS s, a[-1] + 1 AS e FROM p),
    i AS (SELECT doc_id, sent_id, s, e - 1 - s AS root, unnest(range(s, e)) AS pos FROM q WHERE s < e),
    g AS (SELECT string_agg(token, '_' ORDER BY t.pos) AS token, coalesce(max(root) || 'np', min(tag)) AS tag FROM tagged t LEFT JOIN i USING (doc_id, sent_id, pos) GROUP BY doc_id, sent_id, coalesce(s, t.pos))
    SELECT tag, count(*) AS n, count(DISTINCT token) AS words FROM g GROUP BY tag""",
)
def glued_chunks(spark, sf):
    """Words of whole documents with noun chunks glued into one."""
    return glued(spark, sf).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("token").alias("words"))


#: Documents with noun chunks glued: their words in new places.
GLUED = rf"""{TAGGED}, m AS (SELECT doc_id, sent_id, tok, unnest(regexp_extract_all(cued, '(DT[0-9]+ )?((JJ[RS]?|NN[PS]?[PS]?|CD)[0-9]+ )*NN[PS]?[PS]?[0-9]+')) AS m FROM strings),
    p AS (SELECT doc_id, sent_id, tok, list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: x::INT) AS a FROM m),
    q AS (SELECT doc_id, sent_id, a[1] + (tok[a[1] + 1] IN ('a', 'A', 'an', 'An', 'the', 'The'))::INT AS s, a[-1] + 1 AS e FROM p),
    i AS (SELECT doc_id, sent_id, s, e - 1 - s AS root, unnest(range(s, e)) AS pos FROM q WHERE s < e),
    glued AS (SELECT doc_id, sent_id, (row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY place) - 1)::INT AS pos, token, tag, lemma, root FROM
      (SELECT doc_id, sent_id, coalesce(s, t.pos) AS place, string_agg(token, '_' ORDER BY t.pos) AS token, coalesce(max(root) || 'np', min(tag)) AS tag, string_agg(lemma, '_' ORDER BY t.pos) AS lemma, max(root) AS root FROM tagged t LEFT JOIN i USING (doc_id, sent_id, pos) GROUP BY ALL))"""


def glued(spark, sf):
    return linguistics.tagged_rows(linguistics.glue_chunks(tagged(spark, sf)))


@query("np_concat", f"WITH {GLUED} SELECT doc_id, sent_id::INT AS sent_id, pos, token, tag, lemma FROM glued")
def np_concat(spark, sf):
    return glued(spark, sf).select("doc_id", "sent_id", "pos", "token", "tag", "lemma")


@query("np_positions", f"WITH {GLUED} SELECT doc_id, sent_id::INT AS sent_id, pos, root::INT AS head FROM glued WHERE root IS NOT NULL AND lemma NOT IN ('such', 'as', 'and', 'or', 'other', 'including', 'especially')")
def np_positions(spark, sf):
    """Places and head offsets of the glued noun phrases."""
    s = linguistics.each(linguistics.glue_chunks(tagged(spark, sf)), X.np_positions(F.col("words")), "x")
    return s.select("doc_id", "sent_id", "x.pos", "x.head")


@query("tag_strings", f"WITH {TAGGED} SELECT doc_id, sent_id::INT AS sent_id, cued AS tags FROM strings")
def tag_strings(spark, sf):
    return tagged(spark, sf).select("doc_id", "sent_id", X.tag_string(F.col("words")).alias("tags"))


@query(
    "lemma_tag_strings",
    f"WITH {TAGGED} SELECT doc_id, sent_id::INT AS sent_id, string_agg(CASE WHEN lemma IN ('such', 'as', 'and', 'or', 'other', 'including', 'especially') THEN lemma ELSE tag || pos END, ' ' ORDER BY pos) AS tags FROM tagged GROUP BY doc_id, sent_id",
)
def lemma_tag_strings(spark, sf):
    return tagged(spark, sf).select("doc_id", "sent_id", X.tag_string(F.col("words"), "lemma").alias("tags"))


@query(
    "strip_article",
    f"WITH {TAGGED} SELECT doc_id, sent_id::INT AS sent_id, art::INT AS start, 1 - art::INT AS root FROM (SELECT doc_id, sent_id, tok[1] IN ('a', 'A', 'an', 'An', 'the', 'The') AS art FROM strings WHERE len(tok) > 1)",
)
def strip_article(spark, sf):
    """The first two words of every sentence as a span, less a leading article."""
    first = F.transform(F.slice("words", 1, 2), lambda w: F.struct(w.alias("token")))  # no tags are asked for
    s = linguistics.tokens(table(spark, sf, "documents")).where(F.size("words") > 1).select("doc_id", "sent_id", first.alias("words")).withColumn("span", X.drop_article(F.col("words"), F.lit(0), F.lit(2), F.lit(1)))
    return s.select("doc_id", "sent_id", "span.start", "span.root")


@query(
    "glued_ids",
    rf"""WITH {TAGGED}, vocab AS (SELECT lemma, row_number() OVER (ORDER BY min((doc_id, sent_id, pos))) - 1 AS id FROM tagged GROUP BY lemma),
    x AS (SELECT doc_id, sent_id, unnest(regexp_extract_all(tags, '((JJ[RS]?[RS]?|NN[PS]?[PS]?|IN|VBN|VBG)[0-9]+ )*NN[PS]?[PS]?[0-9]+')) AS m FROM strings),
    y AS (SELECT doc_id, sent_id, list_transform(regexp_extract_all(m, '[0-9]+'), lambda x: x::INT) AS a FROM x), z AS (SELECT doc_id, sent_id, a[1] AS s, unnest(range(a[1], a[-1] + 1)) AS pos FROM y)
    SELECT doc_id, sent_id::INT AS sent_id, (row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY place) - 1)::INT AS pos, id, is_term FROM
    (SELECT doc_id, sent_id, coalesce(s, t.pos) AS place, string_agg(id::VARCHAR, '_' ORDER BY t.pos) AS id, max(s) IS NOT NULL AS is_term FROM tagged t JOIN vocab USING (lemma) LEFT JOIN z USING (doc_id, sent_id, pos) GROUP BY ALL)""",
)
def glued_ids(spark, sf):
    """Lemma ids of whole documents, term spans glued and marked."""
    found = ruled.glued_lemmas(table(spark, sf, "documents"))
    vocab = corpus.vocabulary(found.select("doc_id", "sent_id", F.col("i").alias("pos"), F.col("lemma").alias("word")))
    return corpus.glued_ids(found, vocab)


@query(
    "noun_filter_tfidf",
    f"""WITH {TAGGED}, t AS (SELECT doc_id, lemma AS term, count(*) AS tf FROM tagged WHERE tag LIKE 'N%' GROUP BY ALL), nd AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
    SELECT doc_id, term AS term_id, tf, round(tf * ln(n / count(*) OVER (PARTITION BY term)), 6) AS tfidf FROM t, nd""",
)
def noun_filter_tfidf(spark, sf):
    """Weights of the lemmas whose tag starts with N."""
    docs = table(spark, sf, "documents")
    out = frequencies.tf_idf(scratch.written(ruled.nouns(docs), "nouns"), docs)  # read twice, so made once
    return out.withColumn("tfidf", F.round("tfidf", 6))


@query("tagger_words", f"WITH {TAGGED} SELECT token, tag, lemma, count(*) AS n FROM tagged GROUP BY ALL")
def tagger_words(spark, sf):
    """What a tagger learns from each word."""
    return tagging.ruled_word_counts(linguistics.tokens(table(spark, sf, "documents")))


@query(
    "tagger_transitions",
    f"""WITH {TAGGED}, e AS (SELECT doc_id, sent_id, pos, tag FROM tagged UNION ALL SELECT doc_id, sent_id, max(pos) + 1, '^' FROM tagged GROUP BY ALL)
    SELECT before, tag, count(*) AS n FROM (SELECT coalesce(lag(tag) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), '^') AS before, tag FROM e) GROUP BY ALL""",
)
def tagger_transitions(spark, sf):
    """What it learns from neighbours."""
    return tagging.transitions(tagged(spark, sf))


@query("tagger_viterbi")
def tagger_viterbi(spark, sf):
    """All documents tagged by a model that learned from the sentences of all; tests compare it with every path of tags."""
    docs = table(spark, sf, "documents")
    return tagging.tag_counts(docs, tagging.learn(ruled.tag(docs)))


#: Sentences of the four kinds over the parts' own words, each with one relation.
_KIND = "p_partkey % 4"
_PARTS = """part_words AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w, string_split(lower(p_type), ' ') AS t FROM part)"""


def parts_text(spark, sf):
    """A document for every part, naming its kind and three of the name's words in one of four wordings."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("w"), F.concat(F.element_at(F.split(F.lower("p_type"), " "), -1), F.lit("kind")).alias("t"))
    a, b = F.concat(F.element_at("w", 1), F.lit("x")), F.concat(F.element_at("w", -1), F.lit("x"))
    texts = (
        F.concat(F.lit("We sell the "), "t", F.lit(" such as "), a, F.lit(" , "), a, F.lit(" and "), b, F.lit(".")),
        F.concat(F.lit("It is such "), "t", F.lit(" as "), a, F.lit(" or "), b, F.lit(".")),
        F.concat(F.lit("With "), a, F.lit(" , "), b, F.lit(" and other "), "t", F.lit(".")),
        F.concat(F.lit("No words.\nHere is "), "t", F.lit(" , including "), a, F.lit(" and "), b, F.lit(".")),
    )
    kind = F.col("doc_id") % 4
    return p.select("doc_id", F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).when(kind == 2, texts[2]).otherwise(texts[3]).alias("text"))


@query(
    "relations_from_text",
    f"WITH {_PARTS} SELECT doc_id, t[-1] || 'kind' AS hyper, CASE WHEN doc_id % 4 = 2 THEN w[1] ELSE w[-1] END || 'x' AS hypo FROM part_words",
)
def relations_from_text(spark, sf):
    """End to end from raw text: the last noun phrase of a list is the hyponym (the first one before "other")."""
    found, _ = linguistics.extract(parts_text(spark, sf))
    return found.select("doc_id", "hyper", "hypo")


@query("relations_from_some_text", f"WITH {_PARTS} SELECT doc_id, t[-1] || 'kind' AS hyper, CASE WHEN doc_id % 4 = 2 THEN w[1] ELSE w[-1] END || 'x' AS hypo FROM part_words WHERE doc_id >= 20 ORDER BY doc_id LIMIT 100")
def relations_from_some_text(spark, sf):
    """The same with the driver's limits, which are the feature: a first id and a number of documents."""
    found, _ = linguistics.extract(parts_text(spark, sf), start=20, max_docs=100)
    return found.select("doc_id", "hyper", "hypo")


def listed_text(spark, sf):
    """Every line of a document with four words or more, worded as one of four kinds of lists of its first words."""
    found = lambda line: F.transform(F.slice(F.regexp_extract_all(line, F.lit("[a-z]{3,}"), F.lit(0)), 1, 4), lambda w: F.concat(w, F.lit("x")))

    def said(w, k):
        a, b, c, d = w[0], w[1], w[2], w[3]
        out = F.when(k == 0, F.concat(F.lit("The "), a, F.lit(" such as "), b, F.lit(" , "), c, F.lit(" and "), d, F.lit(" .")))
        out = out.when(k == 1, F.concat(F.lit("such "), a, F.lit(" as "), b, F.lit(" or "), c, F.lit(" .")))
        out = out.when(k == 2, F.concat(a, F.lit(" , "), b, F.lit(" , "), c, F.lit(" and other "), d, F.lit(" .")))
        return F.when(F.size(w) == 4, out.otherwise(F.concat(a, F.lit(" , especially "), b, F.lit(" , "), c, F.lit(" ."))))

    docs = table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n"), lambda line, i: said(found(line), (F.col("doc_id") + i) % 4))
    return docs.select("doc_id", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"))


_LISTED = """l AS (SELECT doc_id, i, regexp_extract_all(lines[i + 1], '[a-z]{3,}')[1:4] AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(0, len(lines))) AS i)),
f AS (SELECT doc_id, (doc_id + i) % 4 AS k, w[1] || 'x' AS a, w[2] || 'x' AS b, w[3] || 'x' AS c, w[4] || 'x' AS d FROM l WHERE len(w) = 4)"""


@query(
    "hearst_chunk",
    f"WITH {_LISTED} SELECT doc_id, CASE k WHEN 2 THEN d ELSE a END AS hyper, unnest(CASE k WHEN 0 THEN [b, c, d] ELSE [b, c] END) AS hypo FROM f",
)
def hearst_chunk(spark, sf):
    """All listed hyponyms; two at most before "other"."""
    return linguistics.extract(listed_text(spark, sf), all_hyponyms=True)[0].select("doc_id", "hyper", "hypo")


@query("hearst_last", f"WITH {_LISTED} SELECT doc_id, CASE k WHEN 2 THEN d ELSE a END AS hyper, CASE k WHEN 0 THEN d WHEN 2 THEN b ELSE c END AS hypo FROM f")
def hearst_last(spark, sf):
    """Only the phrase at a list's end, as head-lemma forms."""
    return linguistics.extract(listed_text(spark, sf), level="l")[0].select("doc_id", "hyper", "hypo")


@query(
    "hearst_pos",
    """WITH w AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w, replace(lower(p_type), ' ', '') || 'kind' AS t FROM part),
    p AS (SELECT doc_id, t, w[1] || 'x' AS a, w[-1] || 'x' AS b FROM w)
    SELECT doc_id, t AS hyper, unnest(CASE doc_id % 4 WHEN 0 THEN [a || ' ' || b, a || ' ' || b, b || ' ' || a] WHEN 1 THEN [a, b] ELSE [a || ' ' || b, b || ' ' || a] END) AS hypo FROM p""",
)
def hearst_pos(spark, sf):
    """Phrases of tagged words over every part's name, from raw text; a last phrase without a conjunction gives its last noun."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("w"), F.concat(F.translate(F.lower("p_type"), " ", ""), F.lit("kind")).alias("t"))
    a, b = F.concat(F.element_at("w", 1), F.lit("x")), F.concat(F.element_at("w", -1), F.lit("x"))
    x, y, kind = F.concat_ws(" ", a, b), F.concat_ws(" ", b, a), F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("The "), "t", F.lit(" such as "), x, F.lit(" , "), y, F.lit(" and "), x, F.lit(" .")))
    text = text.when(kind == 1, F.concat(F.lit("such "), "t", F.lit(" as "), x, F.lit(" .")))
    text = text.when(kind == 2, F.concat(x, F.lit(" , "), y, F.lit(" , and other "), "t", F.lit(" .")))
    docs = p.select("doc_id", text.otherwise(F.concat("t", F.lit(" , including "), x, F.lit(" and "), y, F.lit(" ."))).alias("text"))
    return relations.word_relations(linguistics.tag(docs)).select("doc_id", "hyper", "hypo")


@query(
    "glued_relations",
    "SELECT p_partkey AS doc_id, replace(p_type, ' ', '_') AS hyper, replace(p_name, ' ', '_') AS hypo FROM part",
)
def glued_relations(spark, sf):
    return relations.glued(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("hyper"), F.col("p_name").alias("hypo")))
