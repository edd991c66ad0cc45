"""Sentences, tokens and tags as rows, with pluggable splitter, tokenizer, tagger and stemmer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrymill.functions import stemmer
from quarrymill.functions import text as T

# Default stop-words.
STOPWORDS = tuple(
    "aber alle als also am an auch auf aus bei bin bis bist da damit das dass daß dein dem den der des die dies dieser doch dort du durch ein eine einem einen einer eines er es für hatte hier ich ihr im in ist ja kann kein "
    "man mein mit nach nicht noch nur ob oder ohne sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird wo zu zum zur".split()
)
NOUN_TAGS = ("NN",)


def sentences(documents: DataFrame, splitter: Callable[[Column], Column] = T.split_sentences, unwrap: bool = True) -> DataFrame:
    """``(doc_id, sent_id, sentence)``; null texts have none."""
    source = T.unwrap_lines(F.col("text")) if unwrap else F.col("text")
    return documents.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(splitter(source)).alias("sent_id", "sentence"))


def tokens(sents: DataFrame, tokenizer: Callable[[Column], Column] = T.tokenize) -> DataFrame:
    """``(doc_id, sent_id, pos, term)``."""
    return sents.select("doc_id", "sent_id", F.posexplode(tokenizer(F.col("sentence"))).alias("pos", "term"))


def clean_sentences(sents: DataFrame, min_terms: int = 5, min_length: int = 2, max_percent: int = 80, pattern: str = T.CLEANING) -> DataFrame:
    """``(doc_id, sent_id, terms)``; a sentence of too few terms or of contents keeps its row with
    no terms."""
    cleaned = sents.withColumn("terms", T.clean_tokens(T.tokenize(F.col("sentence")), pattern, min_length))
    reject = (F.size("terms") <= min_terms) | (T.contents_percent(F.col("sentence"), min_length) >= max_percent)
    return cleaned.select("doc_id", "sent_id", F.when(reject, F.array().cast("array<string>")).otherwise(F.col("terms")).alias("terms"))


def default_tag(term: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Numbers, marks, function words, capitalised words, others."""
    return (
        F.when(term.rlike(r"^\p{Nd}+$"), F.lit("CARD")).when(~term.rlike(r"[\p{L}\p{N}]"), F.lit("$."))
        .when(F.lower(term).isin(*stopwords), F.lit("FUNC")).when(term.rlike(r"^\p{Lu}"), F.lit("NN")).otherwise(F.lit("OTHER"))
    )


def tag(toks: DataFrame, tagger: Callable[[Column], Column] = default_tag) -> DataFrame:
    return toks.withColumn("pos_tag", tagger(F.col("term")))


def keep_tags(toks: DataFrame, tags: tuple[str, ...] = NOUN_TAGS) -> DataFrame:
    return toks.filter(F.col("pos_tag").isin(*tags))


def drop_stopwords(toks: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """Lower-cased terms are compared with the list as it is."""
    return toks.filter(~F.lower("term").isin(*stopwords))


@F.pandas_udf(StringType())
def stem(terms: pd.Series) -> pd.Series:
    """German stems; null stays null."""
    return terms.map(stemmer.german_stem, na_action="ignore")


def corpus(tagged: DataFrame, by_document: bool = False) -> DataFrame:
    """A tagged-token table as corpus: null and blank terms out, blanks around terms off, one row
    per place. ``by_document`` shuffles it by document, so that no later step by document, sentence
    or term of a document has to."""
    term = F.trim("term")
    clean = tagged.select("doc_id", "sent_id", "pos", term.alias("term"), "pos_tag").filter(F.length("term") > 0)
    if by_document:
        clean = clean.repartition("doc_id")
    return clean.groupBy("doc_id", "sent_id", "pos").agg(F.min(F.struct("term", F.coalesce("pos_tag", F.lit("")).alias("pos_tag"))).alias("t")).select("doc_id", "sent_id", "pos", "t.term", "t.pos_tag")
