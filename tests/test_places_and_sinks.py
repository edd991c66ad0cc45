import json
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quarrymill.config import Settings
from quarrymill.operators import entities as E
from quarrymill.plans import batch, pipeline
from quarrymill.sinks import graph, relational
from quarrymill.sources import readers
from quarrymill.streaming.queue import run_queue


def test_address_validation(spark):
    docs = spark.createDataFrame([(1, "Das Haus steht Lindauer Allee 17 in Nord."), (2, "Nirgends 1234567")], "doc_id long, text string")
    register = spark.createDataFrame([("Lindauer Allee", "17", None, "Nord", "f1"), ("Lindauer Allee", "18", None, "Nord", "f2"), (None, "1", None, None, None)], "strnam string, hausnr string, hausnrz string, bez_name string, feature_id string")
    found = spark.createDataFrame([(1, "Lindauer Allee 17-18"), (1, "Nord")], "doc_id long, entity string")
    assert sorted(r["feature_id"] for r in E.validate_addresses(found, register).collect()) == ["f1", "f2"]
    assert "Lindauer Allee 17" in [r["entity"].split("steht ")[-1] for r in E.pattern_entities(docs).collect()]


def test_register_predicate(spark):
    """A missing suffix takes any, number 0 the whole street, a section only its own rows."""
    register = spark.createDataFrame([("Am Hof", "5", "a", "Nord", "f1"), ("AM HOF", "5", None, "Süd", "f2"), ("Am Hof", "6", None, "Nord", "f3"), ("Am Hofe", "5", None, "Nord", "f4"), ("Am Hof", None, None, None, "f5")], "strnam string, hausnr string, hausnrz string, bez_name string, feature_id string")

    def met(name, number, suffix, section=None):
        c = spark.createDataFrame([(1, "e", name, number, suffix, section)], "doc_id long, entity string, name string, number int, suffix string, bez_name string")
        return sorted(r["feature_id"] for r in E.match_register(c, register).collect())

    assert met("am hof", 5, "") == ["f1", "f2"]
    assert met("Am Hof", 5, "A") == ["f1"]
    assert met("Am Hof", 0, "") == ["f1", "f2", "f3", "f5"]
    assert met("Am Hof", 5, "", "süd") == ["f2"]
    assert met("Am Ho%", 5, None) == ["f1", "f2", "f4"]
    assert met("Am H_f", 6, "") == ["f3"]


def test_passages_of_addresses(spark):
    found = spark.createDataFrame([(1, "Am Hof", 5, "A"), (1, "Weg", 7, ""), (1, "Allee", 0, None)], "doc_id long, name string, number int, suffix string")
    passages = spark.createDataFrame([(1, "Am Hof 5", ["p1"]), (1, "Am Hof", ["p2"]), (1, "Allee", ["p3"]), (2, "Weg 7", ["p4"])], "doc_id long, word string, passages array<string>")
    assert {r["name"]: r["passages"] for r in E.address_passages(found, passages).collect()} == {"Am Hof": ["p1"], "Weg": None, "Allee": ["p3"]}


def test_house_number_ranges(spark):
    from quarrymill.functions import text as T

    cases = {"17-20": [17, 18, 19, 20], "18/20": [18, 20], "12a/b/c": [12, 12, 12], "1-20000": [1, 20000], "": [], "20-18": [18, 19, 20]}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.house_numbers(F.col("s")).alias("h"))
    got = {r["s"]: [(h["number"], h["suffix"]) for h in r["h"]] for r in df.collect()}
    assert {k: [n for n, _ in v] for k, v in got.items()} == cases
    assert got["12a/b/c"] == [(12, "A"), (12, "B"), (12, "C")]


def test_archives_and_metadata(spark, tmp_path):
    fields = [""] * 19
    fields[0], fields[1], fields[4], fields[5] = "5", "Ä", "1.5", "2.5"
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("DE.txt", "\t".join(fields) + "\n")
    assert rows(readers.gazetteer_archive(spark, str(tmp_path / "g.zip"), "DE.txt", str(tmp_path / "dump")).select("id", "name")) == [(5, "Ä")]
    with pytest.raises(ValueError, match="no entry"):
        readers.gazetteer_archive(spark, str(tmp_path / "g.zip"), "FR.txt", str(tmp_path / "dump2"))
    page = '<html><meta name="Author" content="A"><meta content="B" property="author"><meta name="title" content="no"><title>T</title></html>'
    meta = spark.createDataFrame([(page,), ("<p>x",)], "h string").select(readers.html_metadata(F.col("h")).alias("m")).collect()
    assert [r["m"] for r in meta] == [{"author": "A", "title": "no"}, {}]


def test_stored_entities(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, author string")
    assert rows(relational.update_authors(docs, spark.createDataFrame([(2, "z"), (2, "y"), (1, None)], "id long, author string"))) == [(1, "a"), (2, "z")]
    assert rows(relational.delete_where(docs, "author = 'a'")) == [(2, "b")]
    assert relational.delete_where(docs).count() == 0
    assert rows(relational.lookup(docs, docs.filter("id = 2"))) == [(2, "b")]
    with pytest.raises(ValueError, match="not inserted"):
        relational.insert_entities("addresses", docs)
    relational.create_tables(spark, ["keywords"])
    spark.sql("INSERT INTO nlp_keywords VALUES (1, 'k')")
    assert spark.table("nlp_keywords").count() == 1
    batch.purge(spark, ["keywords"])
    assert spark.catalog.tableExists("nlp_keywords")
    batch.purge(spark, ["keywords"], confirmed=True)
    assert not spark.catalog.tableExists("nlp_keywords")


def test_names_inside_entities(spark):
    found = spark.createDataFrame([(1, "die Lindauer Allee 17"), (1, "nichts")], "doc_id long, entity string")
    assert rows(E.containing_names(found, spark.createDataFrame([("Lindauer Allee",)], "n string"))) == [(1, "Lindauer Allee 17")]


def test_locations(spark):
    found = spark.createDataFrame([(1, "Berlin Mitte 12"), (2, "Köln")], "doc_id long, entity string")
    places = E.gazetteer(spark.createDataFrame([(1, "berlin", "Spree-Athen", 52.53, 13.38), (2, "Berlin Mitte", "", 52.53, 13.38), (3, "Berlin", None, 10.0, 10.0)], "id long, name string, synonyms string, latitude double, longitude double"))
    assert rows(E.validate_locations(found, places)) == sorted([(1, "Berlin", 1), (1, "Berlin", 3), (1, "Berlin Mitte", 2)], key=repr)
    assert rows(E.validate_locations(spark.createDataFrame([(1, "spree-athen")], "doc_id long, entity string"), places, in_synonyms=True)) == [(1, "spree-athen", 1)]
    assert rows(E.locations_near(found, places)) == [(1, "Berlin", 1)]


def test_locations_in_synonyms(spark, monkeypatch):
    """All prefixes of all entities against all synonyms, also where one stands several times, begins
    inside a word, is followed by more, or differs in case or in letters beyond the basic plane."""
    entities = ["Linden", "Linden Hof", "Lindenau am See", "linden  hof", "Am 12 Lindenau", "ÄÖÜäöü Straße", "𝒜𝒜𝒜𝒜𝒜𝒜 Hof", "İİİ abc Platz", "ΟΔΟΣ ΑΒΓ Δ", "kurz", "a b c d e f g", "", "Neulindenauer Hofgarten bei der alten Mühle", "12 34", "Quai de la Gare", "(alt) x"]
    synonyms = ["Linden, Lindenau, Linden Hof", "NEULINDEN HOFGARTEN", "linden  hof;Linden", None, "", "kurz", "äöüÄÖÜ STRAßEN", "x𝒜𝒜𝒜𝒜𝒜𝒜 hof", "i̇i̇i̇ abc platz", "οδος αβγ δε οδος", "a b c d e f gh", "neulindenauer hofgarten bei der alten mühlen, Neulindenauer Hofgarten", "Quai de l'Est|Quai de la", "linden", "[(alt) x]"]
    found = spark.createDataFrame([(n % 3, e) for n, e in enumerate(entities)], "doc_id long, entity string")
    places = spark.createDataFrame(list(enumerate(synonyms)), "id int, synonyms string").withColumn("name", F.lit(None).cast("string"))
    prefixes = {" ".join([w for w in e.split(" ") if not any(c.isdecimal() for c in w)][:k]) for e in entities for k in range(1, len(e) + 2)}
    low = {r["s"]: r["l"] for r in spark.createDataFrame([(s,) for s in {*prefixes, *filter(None, synonyms)}], "s string").withColumn("l", F.lower("s")).collect()}
    for least in (0, 1, 5, 8):
        want = set()
        for n, e in enumerate(entities):
            words = [w for w in e.split(" ") if not any(c.isdecimal() for c in w)]
            for p in (" ".join(words[:k]) for k in range(1, len(words) + 1)):
                want |= {(n % 3, p, i) for i, s in enumerate(synonyms) if s and len(p) > least and low[p] in low[s]}
        assert set(rows(E.validate_locations(found, places, in_synonyms=True, min_length=least))) == want
    monkeypatch.setattr(E, "MOST_STARTS", 2)
    assert set(rows(E.validate_locations(found, places, in_synonyms=True, min_length=8))) == want


def test_synonyms_are_not_broadcast(spark):
    """What explode makes of many long synonyms does not come to the driver, though Spark takes it for small."""
    name = lambda n: F.concat(F.lit("Linden"), F.translate(F.md5(n.cast("string")), "0123456789", "ghijklmnop"))
    found = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(name(F.col("id")), F.lit(" Mitte")).alias("entity"))
    long = F.concat_ws(", ", *[name(F.col("id") + n) for n in (0, 30_000, 60_000)])
    places = spark.range(2_000).select(F.col("id"), F.lit("x").alias("name"), long.alias("synonyms"))
    told = E.validate_locations(found, places, in_synonyms=True)
    assert told.count() == 2_000
    counted = told.groupBy().count()
    counted.collect()

    def broadcast_rows(node):
        kind = node.getClass().getSimpleName()
        own = node.metrics().apply("numOutputRows").value() if kind == "BroadcastExchangeExec" else 0
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        children = node.children()
        return own + (broadcast_rows(inner) if inner is not None else 0) + sum(broadcast_rows(children.apply(i)) for i in range(children.size()))

    assert broadcast_rows(counted._jdf.queryExecution().executedPlan()) <= 4_000


def test_relational_sinks(spark, tmp_path):
    kw = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.1)], "doc_id long, term string, score double")
    cat = spark.createDataFrame([("a", "m", True, ["o1", "o2"])], "term string, morphem string, iscore boolean, ontologies array<string>")
    passages = spark.createDataFrame([(1, "a", ["satz"])], "doc_id long, word string, passages array<string>")
    tables = relational.persist_keywords(kw, cat, passages)
    relational.write_tables(tables, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "nlp_terms_ontologies")).count() == 2
    again = relational.insert_missing(tables["documents_terms"], spark.read.parquet(str(tmp_path / "nlp_documents_terms")), ["document_id", "term_id"])
    assert again.count() == 0
    ids = relational.get_or_create(kw.withColumnRenamed("term", "name"), spark.createDataFrame([("A", 7)], "name string, id long"), "name")
    assert {r["name"]: r["id"] for r in ids.collect()}["a"] == 7
    meta = spark.createDataFrame([("n", None, "u")], "name string, author string, uri string")
    docs = relational.document_rows(meta)
    assert docs.collect()[0]["author"] == "unknown"
    assert relational.mark_analysed(docs, docs).collect()[0]["is_analysed"]
    with pytest.raises(Exception, match="URI"):
        relational.document_rows(spark.createDataFrame([("n", None, None)], "name string, author string, uri string")).collect()
    mapping = spark.createDataFrame([(1, ["old"]), (2, ["stay"])], "k long, text_passages array<string>")
    fresh = spark.createDataFrame([(1, ["new"])], "k long, text_passages array<string>")
    assert rows(relational.update_passages(mapping, fresh, ["k"])) == [(1, ("new",)), (2, ("stay",))]


def test_graph(spark):
    docs = spark.createDataFrame([(1, "n", None, "u")], "doc_id long, name string, author string, uri string")
    kw = spark.createDataFrame([(1, "a", 0.5)], "doc_id long, term string, score double")
    cat = spark.createDataFrame([("a", "m", True, ["o"])], "term string, morphem string, iscore boolean, ontologies array<string>")
    nodes, edges = graph.keyword_graph(docs, kw, cat)
    assert sorted(r["label"] for r in nodes.collect()) == ["Document", "Keyword", "Ontology", "Term"]
    assert edges.count() == 7
    assert graph.missing_edges(edges, edges).count() == 0
    cleaned = spark.range(1).select(graph.clean_keys(F.create_map(F.lit("a-b: c"), F.lit("v"))).alias("m")).collect()[0]["m"]
    assert cleaned == {"abc": "v"}


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"type": "Term", "term": "t", "isCore": True, "ontologies": ["o"], "zzz": 1}, {"type": "ALKIS", "name": "n", "categorie": "c", "code": 3}]))
    terms, land = readers.catalog(spark, str(tmp_path / "c.json"))
    assert (terms.count(), land.collect()[0]["code"]) == (1, 3)
    (tmp_path / "w.txt").write_bytes(b"# no\r\nalpha \r\nbeta\n\nalpha\n")
    assert rows(readers.word_list(spark, str(tmp_path / "w.txt"))) == [("alpha",), ("beta",)]
    fields = [""] * 19
    fields[0], fields[1], fields[3], fields[4], fields[5], fields[7] = "5", 'Na"me', "x,y,x", "1.5", "2.5", "PPL"
    (tmp_path / "g.txt").write_text("\t".join(fields) + "\n")
    assert rows(readers.gazetteer_dump(spark, str(tmp_path / "g.txt"))) == [(5, 'Na"me', ("x", "y"), 1.5, 2.5, "PPL")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p.html").write_text("<html><title> Titel </title><script>x</script><p>A&amp;B</p></html>")
    parsed = readers.parse(readers.files(spark, str(tmp_path / "d")).select("path", "content")).collect()[0]
    assert (parsed["text"], parsed["meta"]["title"]) == ("Titel A&B", "Titel")
    got = readers.fetch(spark.createDataFrame([(str(tmp_path / "w.txt"),), ("/none",), (None,)], "uri string")).collect()
    assert [r["content"] is None for r in got] == [False, True, True]


def test_settings(tmp_path):
    Settings(similarity=50.0).store(str(tmp_path / "s"))
    assert Settings.load(str(tmp_path / "s"), complete=True) == Settings(similarity=50.0)
    with pytest.raises(ValueError, match="unknown"):
        Settings.of({"nope": "1"})
    with pytest.raises(ValueError, match="missing"):
        Settings.of({"similarity": "1"}, complete=True)


def test_pipeline(spark):
    text = "Das Planungsamt prüft den Bebauungsplan und die Verwaltung beschließt den Umbau der Schule am Markt. " * 3
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    cat = spark.createDataFrame([("Schule",)], "name string")
    for single in (True, False):
        kw, passages = pipeline.analyse_keywords(docs, cat, Settings(every_single_sentence=single, min_term_count=2))
        assert [r["term"] for r in kw.collect()] == ["Schule"]
        assert passages.count() == 1


def test_stream_queue(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(src)
    for _ in range(2):
        run_queue(spark, src, out, ck, lambda b: b.select("doc_id", F.upper("text").alias("t")), ["doc_id"], "doc_id long, text string").awaitTermination()
    assert rows(spark.read.parquet(out).drop("batch")) == [(1, "A"), (2, "B")]
    spark.createDataFrame([(2, "b"), (3, "c"), (3, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    run_queue(spark, src, out, ck, lambda b: b.select("doc_id", F.upper("text").alias("t")), ["doc_id"], "doc_id long, text string", across_batches=True).awaitTermination()
    assert rows(spark.read.parquet(out).drop("batch")) == [(1, "A"), (2, "B"), (3, "C")]


def test_equal_entities_are_searched_once(spark):
    """Entities of many documents are asked once, and where a name begins nowhere nothing is shipped."""
    found = spark.createDataFrame([(i, "In der Lindauer Allee 17") for i in range(50)] + [(1, "am Weg 3"), (1, "")], "doc_id long, entity string")
    names = spark.createDataFrame([("Lindauer Allee",), ("Allee",), ("Weg",), (None,), ("",)], "n string")
    assert rows(E.name_tails(found, names)) == [("In der Lindauer Allee 17", "Allee 17"), ("In der Lindauer Allee 17", "Lindauer Allee 17"), ("am Weg 3", "Weg 3")]
    assert E.containing_names(found, names).count() == 101


def test_runs_give_the_matches_of_the_pattern(spark):
    import re

    text = "Am Alten Hof 5a. Die EG 7 und Das Haus ohne Zahl, Weg. 12-14; Große Straße des Ortes\nABC Allee 123456 Ä Xy 9/1"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r["entity"] for r in E.pattern_entities(docs).collect()}
    assert got == {m.replace("str.", "straße").replace("Str.", "Straße") for m in re.findall(E.ADDRESS, text)}


def test_passages_from_the_texts(spark):
    found = spark.createDataFrame([(1, "Am Hof", 5, "A"), (1, "Am Hof", 5, "A"), (1, "Weg", 7, ""), (2, "Allee", 0, None)], "doc_id long, name string, number int, suffix string")
    docs = spark.createDataFrame([(1, "Im Am Hof 5|Der Am Hof|Am Hof 5"), (3, "Weg 7")], "doc_id long, text string")
    got = rows(E.addresses_with_passages(found, docs, lambda t: F.split(t, "[|]")))
    assert got == [(1, "Am Hof", 5, "A", ("Am Hof 5", "Im Am Hof 5")), (1, "Weg", 7, "", None), (2, "Allee", 0, None, None)]


def test_only_named_places_meet_origins(spark, monkeypatch):
    asked, near = [], E.near_points
    monkeypatch.setattr(E, "near_points", lambda p, *a: (asked.append(p.count()), near(p, *a))[1])
    places = spark.createDataFrame([(1, "Lindau", 50.0, 9.0), (1, "Lindau", 50.0, 9.0), (2, "Elsewhere", 50.0, 9.001)], "id long, name string, latitude double, longitude double")
    found = spark.createDataFrame([(7, "lindau Mitte")], "doc_id long, entity string")
    got = E.locations_near_origins(found, places, places.withColumnRenamed("id", "origin_id"), 5000.0)
    assert rows(got) == [(7, "lindau", 1, 1), (7, "lindau", 2, 1)]
    assert asked == [2]
