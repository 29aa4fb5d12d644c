"""Queries over words, vocabularies, frequencies and term candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, corpus, frequencies, postings, relations, terms
from ..sources import scratch
from .registry import query, table

CORPUS = """
sents AS (SELECT doc_id, i - 1 AS sent_id, string_split(x[i], ' ') AS w
          FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)),
corpus AS (SELECT doc_id, sent_id, j - 1 AS pos, w[j] AS word FROM sents, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j) WHERE w[j] <> '')
"""
TF = CORPUS + """, tf AS (SELECT doc_id, word AS term, count(*) AS tf FROM corpus GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), nd AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
tfidf AS (SELECT doc_id, term, tf, tf * ln(n / df) AS tfidf FROM tf JOIN dfs USING (term), nd)
"""


def words(spark, sf):
    return corpus.words(table(spark, sf, "documents"))


def counts(spark, sf):
    """Words counted a document. Texts are dealt by their ids first: they are smaller than their words, and the counts need no shuffle."""
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    return frequencies.term_frequency(corpus.words(docs).withColumnRenamed("word", "term_id"))


@query("tokenize_lines", f"WITH {CORPUS} SELECT doc_id, sent_id::INT AS sent_id, pos::INT AS pos, word FROM corpus")
def tokenize_lines(spark, sf):
    return words(spark, sf)


@query(
    "doc_shapes",
    """SELECT doc_id, len(x) AS n_sentences, list_sum(list_transform(x, lambda s: len(string_split(s, ' '))))::BIGINT AS n_words, array_to_string(x, ' ') AS string
       FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)""",
)
def doc_shapes(spark, sf):
    from ..sources.readers import shapes

    s = shapes(table(spark, sf, "documents").withColumnRenamed("text", "content"))
    return s.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.size("words").cast("long").alias("n_words"), "string")


VOCAB = CORPUS + ", vocab AS (SELECT word AS term, row_number() OVER (ORDER BY place) - 1 AS term_id FROM (SELECT word, min((doc_id, sent_id, pos)) AS place FROM corpus GROUP BY word))"


@query("vocab_index", f"WITH {VOCAB} SELECT term_id, term FROM vocab")
def vocab_index(spark, sf):
    return corpus.vocabulary(words(spark, sf))


@query("index_encode", f"WITH {VOCAB} SELECT doc_id, sent_id::INT AS sent_id, pos::INT AS pos, term_id FROM corpus JOIN vocab ON term = word")
def index_encode(spark, sf):
    w = words(spark, sf)
    return corpus.encode(w, corpus.vocabulary(w))


@query("occurrence_index", f"WITH {CORPUS} SELECT word AS term_id, doc_id, sent_id::INT AS sent_id, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM corpus GROUP BY word, doc_id, sent_id")
def occurrence_index(spark, sf):
    o = corpus.occurrences(words(spark, sf).withColumnRenamed("word", "term_id"))
    return o.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query("term_freq", f"WITH {TF} SELECT doc_id, term AS term_id, tf FROM tf")
def term_freq(spark, sf):
    return counts(spark, sf)


@query(
    "doc_freq_postings",
    f"""WITH {TF} SELECT term AS term_id, floor(doc_id / {postings.BLOCK})::BIGINT AS block, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS docs, sum(count(*)) OVER (PARTITION BY term)::BIGINT AS df
    FROM tf GROUP BY term, floor(doc_id / {postings.BLOCK})""",
)
def doc_freq_postings(spark, sf):
    """Document frequencies, and the postings' blocks, unpacked."""
    blocks = scratch.written(postings.build(counts(spark, sf)))
    docs = postings.documents(blocks.withColumns({"at": F.col("block"), "many": F.col("n")})).groupBy("term_id", F.col("at").alias("block"), F.col("many").alias("n")).agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    docs = docs.withColumn("docs", F.array_join(F.transform("docs", lambda x: x.cast("string")), ","))
    return docs.join(postings.document_frequency(blocks), "term_id")


@query("doc_length", f"WITH {CORPUS} SELECT doc_id, count(*) AS dl FROM corpus GROUP BY doc_id")
def doc_length(spark, sf):
    return frequencies.lengths(words(spark, sf))


@query("avg_doc_length", f"WITH {CORPUS} SELECT round(avg(dl), 6) AS avg_dl FROM (SELECT count(*) AS dl FROM corpus GROUP BY doc_id)")
def avg_doc_length(spark, sf):
    return frequencies.lengths(words(spark, sf)).agg(F.round(F.avg("dl"), 6).alias("avg_dl"))


@query("tfidf", f"WITH {TF} SELECT doc_id, term AS term_id, tf, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf(spark, sf):
    return frequencies.tf_idf(counts(spark, sf), table(spark, sf, "documents")).withColumn("tfidf", F.round("tfidf", 6))


@query(
    "tfidf_smoothed_l2",
    f"""WITH {TF}, r AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (term), nd)
    SELECT doc_id, term AS term_id, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM r""",
)
def tfidf_smoothed_l2(spark, sf):
    return frequencies.tf_idf_smooth(counts(spark, sf), table(spark, sf, "documents")).withColumn("tfidf", F.round("tfidf", 6))


@query(
    "top_terms_per_doc",
    f"""WITH {TF} SELECT * FROM (SELECT doc_id, term AS term_id, round(tfidf, 6) AS tfidf, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term)::INT AS rank FROM tfidf) WHERE rank <= 10""",
)
def top_terms_per_doc(spark, sf):
    best = frequencies.top_terms(frequencies.tf_idf(counts(spark, sf), table(spark, sf, "documents")))
    return best.select("doc_id", "term_id", F.round("tfidf", 6).alias("tfidf"), "rank")


@query("prune_min_count", f"WITH {TF} SELECT doc_id, term AS term_id, tf FROM (SELECT *, sum(tf) OVER (PARTITION BY term) AS s FROM tf) WHERE s >= 82")
def prune_min_count(spark, sf):
    return frequencies.prune(counts(spark, sf), 82)


@query(
    "term_distribution",
    f"""WITH {TF}, l AS (SELECT doc_id, count(*) AS dl FROM corpus GROUP BY doc_id) SELECT doc_id, term AS term_id, tf, round(tfidf, 6) AS tfidf, dl FROM tfidf JOIN l USING (doc_id)""",
)
def term_distribution(spark, sf):
    docs = table(spark, sf, "documents")
    w = words(spark, sf)
    d = frequencies.distribution(frequencies.tf_idf(counts(spark, sf), docs), frequencies.lengths(w))
    return d.withColumn("tfidf", F.round("tfidf", 6))


@query("lemma_counts", f"WITH {CORPUS} SELECT lower(word) AS lemma, count(*) AS n FROM corpus GROUP BY 1")
def lemma_counts(spark, sf):
    return words(spark, sf).groupBy(F.lower("word").alias("lemma")).agg(F.count("*").alias("n"))


@query("corpus_split", "SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) * 4 / count(*) OVER ())::BIGINT AS part FROM documents")
def corpus_split(spark, sf):
    return corpus.split_parts(table(spark, sf, "documents"), 4)


@query("top_words", f"WITH {CORPUS} SELECT word, count(*) AS n FROM corpus GROUP BY word ORDER BY n DESC, word LIMIT 50")
def top_words(spark, sf):
    return words(spark, sf).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


TITLES = "SELECT page_id, nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '') AS title FROM pages"


@query("title_extract", f"SELECT * FROM ({TITLES}) WHERE title IS NOT NULL AND title <> 'Home Page'")
def title_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.title_of(F.col("html")).alias("title")).where("title is not null")


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS text FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("conversation_sentences", "SELECT conv_id AS doc_id, array_to_string(list(text ORDER BY turn), chr(10)) AS content, count(*) AS n_sents FROM conversations GROUP BY conv_id")
def conversation_sentences(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.agg(F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("content"), F.count("*").alias("n_sents"))


PART = """
c AS (SELECT replace(lower(p_type), ' ', '_') AS term, count(*) AS freq FROM part GROUP BY 1 UNION ALL SELECT replace(lower(p_name), ' ', '_'), count(*) FROM part GROUP BY 1),
cand AS (SELECT term, sum(freq)::BIGINT AS freq, len(string_split(term, '_')) AS length FROM c GROUP BY term),
sub AS (SELECT term, freq, length, array_to_string(w[i:i + k - 1], '_') AS sub FROM (SELECT *, string_split(term, '_') AS w FROM cand),
        LATERAL (SELECT unnest(range(1, length)) AS k), LATERAL (SELECT unnest(range(1, length - k + 2)) AS i))
"""


def part_terms(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_type").alias("t")).union(p.select("p_name"))
    return terms.candidates(rows, "t")


@query("term_candidates", f"WITH {PART} SELECT term, freq, length::INT AS length FROM cand")
def term_candidates(spark, sf):
    return part_terms(spark, sf)


@query("subsequences", f"WITH {PART} SELECT term, sub FROM sub")
def subsequences(spark, sf):
    return terms.sub_sequences(part_terms(spark, sf))


@query(
    "containment_map",
    f"""WITH {PART} SELECT DISTINCT term, sub FROM sub WHERE sub IN (SELECT term FROM cand UNION SELECT DISTINCT sub FROM sub WHERE length = 2)""",
)
def containment_map(spark, sf):
    known = part_terms(spark, sf)
    short = terms.sub_sequences(known.where("length = 2")).select(F.col("sub").alias("term"))
    return terms.containment(known.select("term").union(short).distinct())


@query(
    "cvalue",
    f"""WITH {PART}, mx AS (SELECT max(length) AS n FROM cand), lv AS (SELECT * FROM cand, mx),
    a3 AS (SELECT term, freq, length, log2(length) * freq AS cval FROM lv WHERE length = n AND log2(length) * freq > 2),
    t3 AS (SELECT sub, arg_max(a3.freq, a3.term) AS t, 1 AS c FROM a3 JOIN sub USING (term) GROUP BY sub),
    a2 AS (SELECT * FROM (SELECT lv.term, freq, length, CASE WHEN c IS NULL THEN log2(length) * freq ELSE log2(length) * freq - t / c END AS cval FROM lv LEFT JOIN t3 ON sub = term WHERE length = n - 1) WHERE cval > 2),
    t2 AS (SELECT sub, sum(t) AS t, sum(c) AS c FROM (SELECT * FROM t3 UNION ALL SELECT sub, a2.freq, 1 FROM a2 JOIN sub USING (term)) GROUP BY sub),
    a1 AS (SELECT * FROM (SELECT lv.term, freq, length, CASE WHEN c IS NULL THEN log2(length) * freq ELSE log2(length) * freq - t / c END AS cval FROM lv LEFT JOIN t2 ON sub = term WHERE length = n - 2) WHERE cval > 2)
    SELECT term, round(cval, 6) AS cval FROM (SELECT term, cval FROM a3 UNION ALL SELECT term, cval FROM a2 UNION ALL SELECT term, cval FROM a1)""",
)
def cvalue(spark, sf):
    return terms.c_values(part_terms(spark, sf)).withColumn("cval", F.round("cval", 6))


@query(
    "term_filter",
    f"""WITH {TF}, b AS (SELECT lower(term) AS term, max(tfidf) AS tfidf FROM tfidf GROUP BY 1), c AS (SELECT lower(word) AS term, log2(1 + count(DISTINCT doc_id)) AS cval FROM corpus GROUP BY 1)
    SELECT DISTINCT term FROM b FULL JOIN c USING (term) WHERE round(coalesce(cval, 0), 6) > 8 OR round(coalesce(tfidf, 0), 6) > 17 OR (round(coalesce(tfidf, 0), 6) > 11 AND round(coalesce(cval, 0), 6) > 6)""",
)
def term_filter(spark, sf):
    best = frequencies.tf_idf(counts(spark, sf), table(spark, sf, "documents")).groupBy(F.lower("term_id").alias("term")).agg(F.round(F.max("tfidf"), 6).alias("tfidf"))
    cval = words(spark, sf).groupBy(F.lower("word").alias("term")).agg(F.round(F.log2(1.0 + F.countDistinct("doc_id")), 6).alias("cval"))
    return terms.select_terms(cval, best)


REL = "rel AS (SELECT c_mktsegment AS hyper, n_name AS hypo FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def bag(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_mktsegment").alias("hyper"), F.col("n_name").alias("hypo"))


@query("relation_multimap", f"WITH {REL} SELECT hyper, array_to_string(list(hypo ORDER BY hypo), ',') AS hypos FROM rel GROUP BY hyper")
def relation_multimap(spark, sf):
    return relations.multimap(bag(spark, sf)).withColumn("hypos", F.array_join("hypos", ","))


@query("relation_counts", f"WITH {REL} SELECT hyper, hypo, count(*) AS n FROM rel GROUP BY ALL")
def relation_counts(spark, sf):
    return relations.counts(bag(spark, sf))


@query(
    "relation_encode",
    f"""WITH {REL}, v AS (SELECT n_name AS term, n_nationkey::BIGINT AS term_id FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 100 + ascii(c_mktsegment) FROM customer)
    SELECT a.term_id AS hyper_id, b.term_id AS hypo_id FROM rel JOIN v a ON a.term = hyper JOIN v b ON b.term = hypo""",
)
def relation_encode(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    vocab = n.select(F.col("n_nationkey").cast("long").alias("term_id"), F.col("n_name").alias("term")).union(c.select((100 + F.ascii("c_mktsegment")).cast("long"), "c_mktsegment").distinct())
    return relations.encode(bag(spark, sf), vocab)


@query(
    "lemma_head_form",
    """SELECT term, CASE WHEN len(t) = len(l) AND head < len(t) THEN array_to_string(list_transform(t, lambda x, i: CASE WHEN i = head + 1 THEN l[i] ELSE x END), '_') ELSE term END AS lemma_form
       FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS term, string_split(p_name, ' ') AS t, string_split(lower(p_type), ' ') AS l, p_size % 3 AS head FROM part)""",
)
def lemma_head_form(spark, sf):
    p = table(spark, sf, "part").select(F.regexp_replace("p_name", " ", "_").alias("term"), F.regexp_replace(F.lower("p_type"), " ", "_").alias("l"), (F.col("p_size") % 3).alias("head")).distinct()
    return p.select("term", X.head_lemma(F.col("term"), F.col("l"), F.col("head")).alias("lemma_form"))


@query(
    "compound_lookup",
    f"""WITH {VOCAB}, t AS (SELECT DISTINCT lower(p_name) AS n FROM part UNION SELECT 'the of zzzz'), p AS (SELECT replace(n, ' ', '_') AS term, i, w[i] AS x FROM (SELECT n, string_split(n, ' ') AS w FROM t), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i))
    SELECT p.term, string_agg(coalesce(term_id::VARCHAR, 'unk'), '_' ORDER BY i) AS ids FROM p LEFT JOIN vocab v ON v.term = x GROUP BY p.term""",
)
def compound_lookup(spark, sf):
    names = table(spark, sf, "part").select(F.regexp_replace(F.lower("p_name"), " ", "_").alias("term")).union(spark.range(1).select(F.lit("the_of_zzzz"))).distinct()
    return corpus.encode_compound(names, corpus.vocabulary(words(spark, sf)))


@query("padded_sentences", f"WITH {CORPUS} SELECT doc_id, sent_id::INT AS sent_id, len(w) AS n_words, max(len(w)) OVER (PARTITION BY doc_id) AS width, array_to_string(list_resize(w, max(len(w)) OVER (PARTITION BY doc_id), ''), '|') AS padded FROM sents")
def padded_sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "s")).withColumn("w", F.split("s", " "))
    width = s.groupBy("doc_id").agg(F.max(F.size("w")).alias("width"))
    out = s.join(width, "doc_id")
    return out.select("doc_id", "sent_id", F.size("w").cast("long").alias("n_words"), F.col("width").cast("long").alias("width"), F.array_join(X.pad(F.col("w"), F.col("width")), "|").alias("padded"))


@query("check_dense_ids", f"WITH {VOCAB} SELECT 'dense_ids' AS \"check\", (CASE WHEN count(*) = max(term_id) + 1 AND min(term_id) = 0 THEN 0 ELSE 1 END)::BIGINT AS violations FROM vocab")
def check_dense_ids(spark, sf):
    return checks.dense_ids(corpus.vocabulary(words(spark, sf)))


@query("check_terms_known", f"WITH {REL} SELECT 'terms_known' AS \"check\", count(*) AS violations FROM (SELECT hyper FROM rel UNION SELECT hypo FROM rel) WHERE hyper NOT IN (SELECT n_name FROM nation)")
def check_terms_known(spark, sf):
    return checks.known(bag(spark, sf), table(spark, sf, "nation").select(F.col("n_name").alias("term")))


@query("check_frequency_keys", f"WITH {TF} SELECT 'frequency_keys' AS \"check\", (SELECT count(*) FROM ((SELECT doc_id, term FROM tf EXCEPT SELECT doc_id, term FROM tfidf) UNION ALL (SELECT doc_id, term FROM tfidf EXCEPT SELECT doc_id, term FROM tf))) AS violations")
def check_frequency_keys(spark, sf):
    """Both tables lie by term, as weights do anyway, so their keys are compared where they are."""
    tf = counts(spark, sf)
    return checks.same_keys(tf.repartition("term_id"), frequencies.tf_idf(tf, table(spark, sf, "documents")), ["doc_id", "term_id"], "frequency_keys")


@query("check_non_empty", f"WITH {CORPUS} SELECT 'non_empty' AS \"check\", count(*) AS violations FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM corpus)")
def check_non_empty(spark, sf):
    return checks.non_empty(table(spark, sf, "documents"), words(spark, sf))
