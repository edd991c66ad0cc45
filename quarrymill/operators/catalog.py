"""Keywords against controlled vocabularies: by name, and by similarity of word vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import vectors as V
from quarrymill.tables import staged

#: Similarity in percent that a vector match must exceed.
SIMILARITY = 66.0


def load_catalog(entries: DataFrame, name_col: str, position_col: str | None = None) -> DataFrame:
    """One entry per name; of equal names the last by position (or the greatest row) wins."""
    rest = [c for c in entries.columns if c != name_col]
    order = F.struct(F.col(position_col), *[F.col(c) for c in rest if c != position_col and not entries.schema[c].dataType.simpleString().startswith("map")]) if position_col else F.struct(*[F.col(c) for c in rest])
    return entries.filter(F.col(name_col).isNotNull()).groupBy(name_col).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("e")).select(name_col, "e.*")


def known_terms(keywords: DataFrame, catalog: DataFrame, term_col: str = "term", name_col: str = "name") -> DataFrame:
    """Keywords that are exactly a catalog name."""
    return keywords.join(catalog.select(F.col(name_col).alias(term_col)).distinct(), term_col, "left_semi")


def with_entries(keywords: DataFrame, catalog: DataFrame, term_col: str = "term", name_col: str = "name") -> DataFrame:
    """Every keyword with its catalog entry, null where there is none."""
    return keywords.join(catalog.withColumnRenamed(name_col, term_col), term_col, "left")


def filter_by_catalog(keywords: DataFrame, catalog: DataFrame, word_vectors: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, term, score)``: exact names stay; a keyword whose vector is similar enough to a
    catalog name's gives that name with the keyword's score. Of several scores the lowest stays.

    ``word_vectors``: ``(word, vector)``. Catalog names are the queries of a block-wise search over
    the keywords' words; each name takes all words that are similar enough.
    """
    exact = known_terms(keywords, catalog).select("doc_id", "term", "score")
    if word_vectors is None:
        return exact.groupBy("doc_id", "term").agg(F.min("score").alias("score"))
    coded = word_vectors.select("word", "vector", F.xxhash64("word").alias("vec_id"))
    words = coded.join(keywords.select(F.col("term").alias("word")).distinct(), "word", "left_semi")
    names = coded.join(catalog.select(F.col("name").alias("word")).distinct(), "word", "left_semi")
    found = V.similar(words, names, similarity, "vec_id", "vector")
    pairs = found.join(names.select(F.col("vec_id").alias("query_id"), F.col("word").alias("name")), "query_id").join(words.select(F.col("vec_id").alias("neighbour_id"), F.col("word").alias("term")), "neighbour_id")
    alike = keywords.join(pairs.select("term", "name"), "term").select("doc_id", F.col("name").alias("term"), "score")
    return exact.unionByName(alike).groupBy("doc_id", "term").agg(F.min("score").alias("score"))


def merge_keywords(results: list[DataFrame]) -> DataFrame:
    """``(doc_id, term, score)`` of several extractors; a later one overrides an earlier score."""
    ranked = [r.select("doc_id", "term", "score", F.lit(i).alias("priority")) for i, r in enumerate(results)]
    return reduce(DataFrame.unionByName, ranked).groupBy("doc_id", "term").agg(F.max_by("score", "priority").alias("score"))


#: Sentences of a document that are searched together.
PASSAGE_BLOCK = 1_000


def text_passages(words: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(doc_id, word, passages)``: the different sentences of the document that contain the word
    exactly, sorted. Words meet the sentences of their document in blocks, so that a document of very
    many sentences is not one task."""
    wanted = staged(words.select("doc_id", "word").filter(F.length("word") > 0).distinct(), "words")
    known = sentences.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    part = F.floor(F.col("sent_id") / PASSAGE_BLOCK) if "sent_id" in sentences.columns else F.lit(0)
    cut = staged(known.select("doc_id", part.alias("part"), "sentence"), "sentences")
    parts = cut.select("doc_id", "part").distinct()
    met = wanted.join(parts, "doc_id").join(cut, ["doc_id", "part"]).filter(F.contains("sentence", "word"))
    return met.groupBy("doc_id", "word").agg(F.sort_array(F.collect_set("sentence")).alias("passages"))
