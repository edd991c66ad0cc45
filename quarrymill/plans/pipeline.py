"""Composite operators: keyword and entity analysis of documents, extractor registry, batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.config import Settings
from quarrymill.functions import text as T
from quarrymill.operators import catalog as C
from quarrymill.operators import entities as E
from quarrymill.operators import lines, textrank, tfidf
from quarrymill.operators import tokens as tok
from quarrymill.sinks import graph
from quarrymill.tables import staged

#: Keyword extractors by name: ``(tagged tokens, settings) -> (doc_id, term, score)``.
EXTRACTORS: dict[str, Callable[[DataFrame, Settings], DataFrame]] = {
    "tfidf": lambda corpus, s: tfidf.tfidf(corpus, s.normalization, tok.NOUN_TAGS, s.with_stopword_filter, s.with_stemming),
    "textrank": lambda corpus, s: textrank.textrank(tok.drop_stopwords(tok.keep_tags(corpus)), s.word_window_size, s.iteration, s.with_vector_normalization),
}


def corpus_of(documents: DataFrame, settings: Settings) -> DataFrame:
    """Tagged tokens of documents, cleaned sentence by sentence or as whole texts."""
    if settings.every_single_sentence:
        clean = tok.clean_sentences(tok.sentences(documents), settings.min_term_count, settings.min_term_length, settings.min_table_of_content, settings.cleaning_regex)
        rows = clean.select("doc_id", "sent_id", F.posexplode("terms").alias("pos", "term"))
    else:
        texts = lines.clean_documents(documents, None, settings.min_term_count, settings.min_term_length, settings.min_table_of_content)
        rows = tok.tokens(texts.select("doc_id", F.posexplode("sentences").alias("sent_id", "sentence")))
    return tok.tag(rows)


def extract_keywords(documents: DataFrame, settings: Settings = Settings(), corpus: DataFrame | None = None) -> DataFrame:
    """``(doc_id, term, score)`` of all configured extractors, later ones overriding. ``corpus``: that
    of the documents, where it is there already."""
    corpus = corpus_of(documents, settings) if corpus is None else corpus
    return C.merge_keywords([EXTRACTORS[name](corpus, settings) for name in settings.keyword_extractor_algorithms])


def analyse_keywords(documents: DataFrame, catalog: DataFrame, settings: Settings = Settings(), word_vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Keywords that the catalog knows, and their text passages."""
    found = C.filter_by_catalog(extract_keywords(documents, settings), catalog, word_vectors, settings.similarity)
    passages = C.text_passages(found.select("doc_id", F.col("term").alias("word")), tok.sentences(documents))
    return found, passages


def analyse_entities(documents: DataFrame, register: DataFrame, places: DataFrame, settings: Settings = Settings(), recognised: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, validated addresses and validated locations. ``recognised``: ``(doc_id, entity)``
    of a model, with ``probability`` where it gives one; by default runs of capitalised words."""
    if recognised is None:
        recognised = E.capitalised_entities(tok.tokens(tok.sentences(documents)))
    else:
        recognised = recognised.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
        if "probability" in recognised.columns:
            recognised = E.probable(recognised, settings.min_probability)
    found = staged(E.entities(documents, recognised, settings.address_regex), "entities")
    return found, E.validate_addresses(found, register, settings.max_street_count, settings.max_section_count), E.validate_locations(found, places, settings.contains_in_synonyms, settings.min_named_entity_length)


def entity_passages(documents: DataFrame, register: DataFrame, places: DataFrame, settings: Settings = Settings(), recognised: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated addresses, validated locations, and ``(doc_id, word, passages)``: the sentences that
    hold a display form of an address or the name of a location as it stands in the text."""
    _, addresses, locations = analyse_entities(documents, register, places, settings, recognised)
    addresses, locations = staged(addresses, "addresses"), staged(locations, "locations")
    forms = E.display_keys(addresses).select("doc_id", F.explode("keys").alias("word")).unionByName(locations.select("doc_id", F.col("prefix").alias("word")))
    return addresses, locations, C.text_passages(forms, tok.sentences(documents))


def places_as_graph(addresses: DataFrame, locations: DataFrame, register: DataFrame, places: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of validated addresses and locations with their passages."""
    told = E.address_passages(addresses.select("doc_id", "name", "number", "suffix", "feature_id").distinct(), passages).select("doc_id", "feature_id", "passages")
    a = told.join(register.select("feature_id", "strnam", "hausnr", "hausnrz", "bez_name").dropDuplicates(["feature_id"]), "feature_id")
    b = locations.join(passages.withColumnRenamed("word", "prefix"), ["doc_id", "prefix"], "left").join(places.select("id", "name", "latitude", "longitude", "feature_code").dropDuplicates(["id"]), "id")
    return graph.place_graph(a, b)


class Keywords:
    """Keyword analysis behind one object, with fixed settings and catalog."""

    def __init__(self, catalog: DataFrame, settings: Settings = Settings(), word_vectors: DataFrame | None = None):
        self.catalog, self.settings, self.word_vectors = catalog, settings, word_vectors

    def keywords(self, documents: DataFrame) -> DataFrame:
        return extract_keywords(documents, self.settings)

    def filtered(self, keywords: DataFrame) -> DataFrame:
        return C.filter_by_catalog(keywords, self.catalog, self.word_vectors, self.settings.similarity)


class NamedEntities:
    """Entity analysis behind one object, with fixed settings, register and gazetteer."""

    def __init__(self, register: DataFrame, places: DataFrame, settings: Settings = Settings()):
        self.register, self.places, self.settings = register, places, settings

    def entities(self, documents: DataFrame) -> DataFrame:
        return analyse_entities(documents, self.register, self.places, self.settings)[0]

    def validated(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        return analyse_entities(documents, self.register, self.places, self.settings)[1:]


def joined_sentences(corpus: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, sentence)`` of tokens put together again."""
    gathered = corpus.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return gathered.select("doc_id", "sent_id", T.join_tokens(F.transform("t", lambda x: x["term"])).alias("sentence"))
