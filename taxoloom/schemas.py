"""Row types of the long tables that the operators exchange."""

from pyspark.sql import types as T


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


I, L, D, S, B = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
RAW = _of(doc_id=L, content=S)
TAGGED = _of(doc_id=L, sent_id=I, pos=I, token=S, tag=S, lemma=S, is_stop=B)
CORPUS = _of(doc_id=L, sent_id=I, pos=I, word=S)
VOCAB = _of(term_id=L, term=S)
TF = _of(doc_id=L, term_id=L, tf=L)
EDGE = _of(parent=L, child=L, child_ord=I)
NODE_TERM = _of(node_id=L, rank=I, term_id=L, term=S, score=D)
EVAL = _of(hyper_id=L, hyper=S, hyper_score=D, hypo_id=L, hypo=S, hypo_score=D, label=I)
EMBEDDING = _of(term_id=L, emb=T.ArrayType(D))
