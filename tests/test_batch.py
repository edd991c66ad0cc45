import json
from datetime import date

import pytest

from quarrymill.config import Settings
from quarrymill.plans import batch, pipeline


TEXT = "Das Planungsamt prüft den Bebauungsplan und die Verwaltung beschließt den Umbau der Schule am Markt. " * 3
CATALOG = "term string, morphem string, iscore boolean, ontologies array<string>"


def test_batch_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "n", None, "u") for i, t in enumerate([TEXT, None, TEXT, TEXT])], "doc_id long, text string, name string, author string, uri string")
    done = spark.createDataFrame([(0,)], "doc_id long")
    cat = spark.createDataFrame([("Schule", "m", True, ["o"])], CATALOG)
    state = batch.run_batch(docs, done, cat, str(tmp_path), Settings(every_single_sentence=True, min_term_count=2), batch=2)
    assert {r["doc_id"]: r["is_analysed"] for r in state.collect()} == {1: False, 2: True}
    assert spark.read.parquet(str(tmp_path / "nlp_documents_keywords")).count() == 1
    assert spark.read.parquet(str(tmp_path / "graph_edges")).count() == 7


def test_two_batches_with_both_passes(spark, tmp_path):
    """A later batch keeps what an earlier one stored; a repeated batch adds nothing."""
    place = "Das Haus steht Lindauer Allee 17-18 in Nord und gehört Berlin seit langem allein. "
    docs = spark.createDataFrame([(i, TEXT + place, f"n{i}", None, f"u{i}") for i in range(3)], "doc_id long, text string, name string, author string, uri string")
    cat = spark.createDataFrame([("Schule", "m", True, ["o"])], CATALOG)
    register = spark.createDataFrame([("Lindauer Allee", "17", "", "Nord", "f1", "10001"), ("Lindauer Allee", "18", None, "Nord", "f2", "10001"), ("Anderer Weg", "1", None, "Nord", "f3", None)], "strnam string, hausnr string, hausnrz string, bez_name string, feature_id string, plz string")
    places = spark.createDataFrame([(7, "Das Haus Berlin", ["Spree"], 52.5, 13.4, "PPL"), (8, "Lindauer", ["x"], 1.0, 2.0, "PPL")], "id long, name string, synonyms array<string>, latitude double, longitude double, feature_code string")
    settings = Settings(every_single_sentence=True, min_term_count=2)
    recognised = spark.createDataFrame([(i, e, p) for i in range(3) for e, p in (("Lindauer Allee", 0.99), ("Nord", 0.96), ("Spreewald", 0.1))], "doc_id long, entity string, probability double")
    count = lambda name: spark.read.parquet(str(tmp_path / name)).count()
    done = spark.createDataFrame([], "doc_id long")
    for n, size in ((1, 2), (2, 2), (2, 2)):
        state = batch.run_batch(docs, done, cat, str(tmp_path), settings, size, register=register, places=places, recognised=recognised)
        assert all(r["keywords_done"] and r["entities_done"] and r["is_analysed"] for r in state.collect())
        seen = 2 if n == 1 else 3
        assert (count("nlp_documents_keywords"), count("nlp_keywords"), count("nlp_documents_addresses"), count("nlp_addresses"), count("nlp_documents_locations"), count("nlp_locations")) == (seen, 1, 2 * seen, 2, seen, 1)
        assert count("graph_nodes") == seen + 3 + 3
        if n == 1:
            done = state.select("doc_id")
    told = spark.read.parquet(str(tmp_path / "nlp_documents_addresses")).collect()
    assert {len(r["text_passages"] or []) for r in told} == {1}
    labels = {r["label"] for r in spark.read.parquet(str(tmp_path / "graph_nodes")).collect()}
    assert labels == {"Document", "Keyword", "Term", "Ontology", "Address", "Location"}


def test_failed_pass_marks_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT, "n", None, "u")], "doc_id long, text string, name string, author string, uri string")
    broken = spark.createDataFrame([("Schule",)], "term string")
    with pytest.raises(Exception):  # noqa: B017
        batch.run_batch(docs, spark.createDataFrame([], "doc_id long"), broken, str(tmp_path), Settings(every_single_sentence=True, min_term_count=2))


def test_model_name():
    assert batch.model_name("m", date(2020, 1, 5)) == "m-2020-01-05"


def test_extractor_registry(spark):
    class Fixed:
        def extract(self, corpus):
            return corpus.selectExpr("doc_id", "'x' AS term", "1.0D AS score").distinct()

    batch.register("fixed", Fixed())
    docs = spark.createDataFrame([(1, "Ein Haus steht hier.")], "doc_id long, text string")
    got = pipeline.extract_keywords(docs, Settings(keyword_extractor_algorithms=("fixed",), every_single_sentence=True, min_term_count=0)).collect()
    assert [(r["term"], r["score"]) for r in got] == [("x", 1.0)]


def test_vectors(spark, tmp_path):
    e = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 1.0]), (3, [0.0, 1.0, 1.0]), (4, [-1.0, -1.0, -1.0]), (5, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, 1, 2, 3)], "a long, b long, c long, d long")
    assert batch.analogy_accuracy(e, q) == 1.0
    assert batch.analogy_accuracy(e, q.limit(0)) == 0.0
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "revid": 1, "url": "u", "title": "t", "text": "eins zwei drei. " * 20}]))
    batch.train_and_save(spark, str(tmp_path / "a.json"), str(tmp_path / "m"), size=4, min_count=1)
    assert batch.load_model(str(tmp_path / "m")).getVectors().count() >= 3


def test_helpers(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a", "b", 1.0)], "doc_id long, src string, dst string, weight double")
    assert batch.graph_text(edges, 1) == "a -> b (1)"
    assert batch.matrix_text(edges, 1) == "a 0 1\nb 0 0"
    names = spark.createDataFrame([("x",), ("bad",), (None,)], "name string")

    def client(name):
        if name == "bad":
            raise OSError
        return [(1, "X", 52.53, 13.38), (2, "Far", 0.0, 0.0)]

    got = batch.search_gazetteer(names, client, (52.530644, 13.383068), 12_500).collect()
    assert [(r["name"], r["id"]) for r in got] == [("x", 1)]
    cat = spark.createDataFrame([("a",), ("B",)], "term string")
    assert batch.missing_terms(cat, spark.createDataFrame([("b",)], "name string")) == 1
    with pytest.raises(Exception):  # noqa: B017
        batch.import_gazetteer(spark, str(tmp_path / "none"), str(tmp_path))
