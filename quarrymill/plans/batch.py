"""The batch run, model training and imports: composite operators with side effects."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date
from typing import Protocol

import pandas as pd
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.config import Settings
from quarrymill.functions import vectors as V
from quarrymill.operators import tokens as tok
from quarrymill.operators.proximity import great_circle_m
from quarrymill.plans import pipeline
from quarrymill.sinks import graph, relational
from quarrymill.sources import readers
from quarrymill.tables import staged


class KeywordExtractor(Protocol):
    """Scores terms of a tagged corpus: ``(doc_id, term, score)``."""

    def extract(self, corpus: DataFrame) -> DataFrame: ...


class EntityExtractor(Protocol):
    """Finds entities of documents: ``(doc_id, entity)``."""

    def extract(self, documents: DataFrame) -> DataFrame: ...


def register(name: str, extractor: KeywordExtractor) -> None:
    """Make an extractor available under a name of the settings."""
    pipeline.EXTRACTORS[name] = lambda corpus, _: extractor.extract(corpus)


def run_batch(
    documents: DataFrame, done: DataFrame, catalog: DataFrame, path: str, settings: Settings = Settings(), batch: int = readers.BATCH, word_vectors: DataFrame | None = None,
    register: DataFrame | None = None, places: DataFrame | None = None, recognised: DataFrame | None = None,
) -> DataFrame:
    """Analyse the next documents of the queue: keywords against the catalog, then, where ``register``
    and ``places`` are given, addresses and locations; append the results to the relational tables and
    the graph below ``path``, and give ``(doc_id, keywords_done, entities_done, is_analysed)``.

    What earlier batches stored stays, and a batch that is repeated adds nothing. Documents without a
    text stay unanalysed; a pass marks its documents only when all its results are written, so a
    failure leaves them in the queue. ``recognised``: entities of a model, ``(doc_id, entity)``."""
    spark = documents.sparkSession
    todo = readers.work_queue(documents, done, batch)
    chosen = staged(documents.join(todo, "doc_id", "left_semi"), "chosen")
    readable = chosen.filter(F.col("text").isNotNull())
    keywords_done = entities_done = False
    if settings.keyword_analyse:
        names = catalog.withColumnRenamed("term", "name")
        found, passages = (staged(x, n) for x, n in zip(pipeline.analyse_keywords(readable, names, settings, word_vectors), ("keywords", "passages"), strict=True))
        if settings.result_to_tables:
            relational.append_tables(spark, relational.persist_keywords(found, catalog, passages), path)
        if settings.result_to_graph:
            graph.append_graph(spark, *graph.keyword_graph(readable, found, catalog, passages), path)
        keywords_done = True
    if settings.named_entity_analyse and register is not None and places is not None:
        addresses, locations, passages = (staged(x, n) for x, n in zip(pipeline.entity_passages(readable, register, places, settings, recognised), ("addresses", "locations", "passages"), strict=True))
        if settings.result_to_tables:
            relational.append_tables(spark, relational.persist_addresses(addresses, register, passages) | relational.persist_locations(locations, places, passages), path)
        if settings.result_to_graph:
            graph.append_graph(spark, *pipeline.places_as_graph(addresses, locations, register, places, passages), path)
        entities_done = True
    has_text = F.col("text").isNotNull()
    both = (keywords_done or not settings.keyword_analyse) and (entities_done or not settings.named_entity_analyse or register is None or places is None)
    return chosen.select("doc_id", (has_text & F.lit(keywords_done)).alias("keywords_done"), (has_text & F.lit(entities_done)).alias("entities_done"), (has_text & F.lit(both)).alias("is_analysed"))


def train_and_save(spark: SparkSession, articles_path: str, model_path: str, size: int = 100, min_count: int = 5) -> Word2VecModel:
    """Word vectors of an article dump, saved for later runs."""
    articles = readers.articles(spark, articles_path).select(F.col("id").cast("long").alias("doc_id"), "text")
    sentences = tok.sentences(articles).select(pipeline.T.tokenize(F.col("sentence")).alias("tokens"))
    model = V.train_word_vectors(sentences, size=size, min_count=min_count)
    model.write().overwrite().save(model_path)
    return model


def load_model(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)


def analogy_accuracy(vectors: DataFrame, questions: DataFrame, k: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of questions ``(a, b, c, d)`` - a is to b as c to d - whose answer is among the ``k``
    nearest to b - a + c; questions with unknown words are left out, none at all give 0."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = questions.withColumn("query_id", -1 - F.monotonically_increasing_id())
    for name in "abc":
        asked = asked.join(v.select(F.col("id").alias(name), F.col("v").alias(f"v_{name}")), name)
    target = F.zip_with(F.zip_with("v_b", "v_a", lambda x, y: x - y), "v_c", lambda x, y: x + y)
    asked = staged(asked.select("query_id", "a", "b", "c", "d", target.alias("t")), "questions")
    near = V.nearest(v, asked.select(F.col("query_id").alias("id"), F.col("t").alias("v")), k + 3, "id", "v")
    met = near.join(asked.drop("t"), "query_id").filter((F.col("neighbour_id") != F.col("a")) & (F.col("neighbour_id") != F.col("b")) & (F.col("neighbour_id") != F.col("c")))
    best = met.groupBy("query_id", "d").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "neighbour_id"))), 1, k).alias("n"))
    right, total = best.filter(F.exists("n", lambda x: x["neighbour_id"] == F.col("d"))).count(), asked.count()
    return right / total if total else 0.0


def import_gazetteer(spark: SparkSession, dump: str, path: str) -> DataFrame:
    """Replace the location table by a dump."""
    readers.gazetteer_dump(spark, dump).write.mode("overwrite").parquet(f"{path}/nlp_locations")
    return spark.read.parquet(f"{path}/nlp_locations")


def search_gazetteer(names: DataFrame, client: Callable[[str], list[tuple[int, str, float, float]]], origin: tuple[float, float], max_distance_m: float) -> DataFrame:
    """``(name, id, found, latitude, longitude)`` of a web gazetteer's answers near the origin; a
    failing request gives nothing for its name."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name in b["name"]:
                try:
                    rows += [(name, *r) for r in client(name)]
                except Exception:  # the service may be away for some names
                    continue
            yield pd.DataFrame(rows, columns=["name", "id", "found", "latitude", "longitude"])

    got = names.select("name").filter(F.col("name").isNotNull()).distinct().mapInPandas(ask, "name string, id long, found string, latitude double, longitude double")
    return got.filter(great_circle_m(F.col("latitude"), F.col("longitude"), F.lit(origin[0]), F.lit(origin[1])) <= max_distance_m)


def missing_terms(catalog: DataFrame, stored: DataFrame) -> int:
    """Number of catalog terms the stored table does not hold, case ignored."""
    return catalog.select(F.lower("term").alias("k")).distinct().join(stored.select(F.lower("name").alias("k")), "k", "left_anti").count()


def purge(spark: SparkSession, names: list[str], confirmed: bool = False) -> None:
    """Drop result tables; only with ``confirmed``."""
    for name in names if confirmed else ():
        spark.sql(f"DROP TABLE IF EXISTS nlp_{name}")


def graph_text(edges: DataFrame, doc_id: int, limit: int = 100) -> str:
    """The first edges of a document's graph, one line each, for debugging."""
    rows = edges.filter(F.col("doc_id") == doc_id).orderBy("src", "dst").limit(limit).collect()
    return "\n".join(f"{r['src']} -> {r['dst']} ({r['weight']:g})" for r in rows)


def matrix_text(edges: DataFrame, doc_id: int, most: int = 15) -> str:
    """The adjacency matrix of a small graph as text; '' if it has more than ``most`` terms."""
    rows = edges.filter(F.col("doc_id") == doc_id).limit(most * most + 1).collect()
    terms = sorted({r["src"] for r in rows} | {r["dst"] for r in rows})
    if len(terms) > most:
        return ""
    weight = {(r["src"], r["dst"]): r["weight"] for r in rows}
    return "\n".join(" ".join([t, *(f"{weight.get((t, u), 0):g}" for u in terms)]) for t in terms)


def model_name(prefix: str = "word2vec", day: date | None = None) -> str:
    """Name of a model file with the day of its training, today if none is given."""
    return f"{prefix}-{(day or date.today()).isoformat()}"
