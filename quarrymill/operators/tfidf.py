"""TF-IDF keywords per document over a corpus of tagged tokens ``(doc_id, sent_id, pos, term,
pos_tag)``. ``sentences`` ``(doc_id, n)`` gives the number of sentences where empty ones count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators import tokens as tok

K = 0.5


def term_statistics(corpus: DataFrame) -> DataFrame:
    """``(doc_id, term, cnt, pos_tag, n_sentences)``: count, tag where first met, sentences with it."""
    return corpus.groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct("sent_id", "pos", "pos_tag"))["pos_tag"].alias("pos_tag"), F.count_distinct("sent_id").alias("n_sentences"))


def term_frequency(corpus: DataFrame, agg: str = "last") -> DataFrame:
    """``(doc_id, term, tf, df, pos_tag)``: share of the term in a sentence; of several sentences
    the last decides, or their maximum or mean. One shuffle by document and sentence, one by term."""
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "sent_id"))
    per_sentence = corpus.withColumn("size", size).groupBy("doc_id", "sent_id", "term").agg(
        (F.count(F.lit(1)) / F.first("size")).alias("tf"), F.min(F.struct("pos", "pos_tag")).alias("first"))
    pick = {"last": F.max(F.struct("sent_id", "tf"))["tf"], "max": F.max("tf"), "mean": F.avg("tf")}[agg]
    return per_sentence.groupBy("doc_id", "term").agg(pick.alias("tf"), F.count(F.lit(1)).alias("df"), F.min(F.struct("sent_id", "first"))["first"]["pos_tag"].alias("pos_tag"))


def sentence_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("doc_id").agg(F.count_distinct("sent_id").alias("n"))


def tfidf(corpus: DataFrame, normalization: str = "none", tags: tuple[str, ...] | None = tok.NOUN_TAGS, stopwords: bool = False, stemming: bool = False, agg: str = "last", sentences: DataFrame | None = None, k: float = K) -> DataFrame:
    """``(doc_id, term, score)``. ``normalization``: none, ``log`` (log10(1 + tf)) or ``double``
    (k + (1 - k) tf / max tf of the document). An empty corpus gives no rows."""
    if stopwords:
        corpus = tok.drop_stopwords(corpus)
    if stemming:
        corpus = corpus.withColumn("term", tok.stem("term"))
    scored = term_frequency(corpus, agg).join(sentences if sentences is not None else sentence_counts(corpus), "doc_id")
    if normalization == "log":
        scored = scored.withColumn("tf", F.log10(1 + F.col("tf")))
    elif normalization == "double":
        most = F.max("tf").over(Window.partitionBy("doc_id"))
        scored = scored.withColumn("tf", k + (1 - k) * F.col("tf") / most)
    scored = scored.withColumn("score", F.col("tf") * F.log10(F.col("n") / F.col("df")))
    if tags is not None:
        scored = scored.filter(F.col("pos_tag").isin(*tags))
    return scored.select("doc_id", "term", "score")


def top_terms(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best terms of every document; ties go to the smaller term."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 6)), "term"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)
