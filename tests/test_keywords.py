import pytest
from conftest import rows

from quarrymill.operators import catalog, lines, textrank, tfidf
from quarrymill.operators import tokens as tok


def corpus(spark, sentences, doc=1):
    data = [(doc, s, p, t, "NN") for s, sent in enumerate(sentences) for p, t in enumerate(sent)]
    return spark.createDataFrame(data, "doc_id long, sent_id int, pos int, term string, pos_tag string")


def scores(df):
    return {r["term"]: r["score"] for r in df.collect()}


def test_tfidf(spark):
    got = scores(tfidf.tfidf(corpus(spark, [["a", "b"], ["a", "c"]])))
    assert got == pytest.approx({"a": 0, "b": 0.150515, "c": 0.150515}, abs=1e-6)


def test_last_sentence_decides(spark):
    c = corpus(spark, [["a", "a", "b"], ["a", "c", "d", "e"], ["f", "g"]])
    assert scores(tfidf.tfidf(c))["a"] == pytest.approx(0.044023, abs=1e-6)
    assert scores(tfidf.tfidf(c, agg="max"))["a"] == pytest.approx(2 / 3 * 0.176091, abs=1e-5)


def test_normalisation(spark):
    c = corpus(spark, [["a", "b"], ["c", "d", "e", "f"]])
    got = scores(tfidf.tfidf(c, "double"))
    assert got["c"] / got["a"] == pytest.approx(0.75)
    assert tfidf.tfidf(c.limit(0), "double").count() == 0


def test_textrank_one_iteration(spark):
    c = corpus(spark, [["A", "B", "C"]])
    assert scores(textrank.textrank(c, 3, 1)) == pytest.approx({"A": 0.703163, "B": 0.703163, "C": 0.105474}, abs=1e-6)
    assert scores(textrank.textrank(c, 3, 1, normalise=False)) == pytest.approx({"A": 1.85, "B": 1.0, "C": 0.15})
    assert textrank.textrank(corpus(spark, [["A", "B"]]), 3).count() == 0


@pytest.mark.parametrize("direction", ["out", "in"])
def test_textrank_engines_agree(spark, direction):
    c = corpus(spark, [list("abcdea"), list("bdfgh"), list("ccabx")]).union(corpus(spark, [list("qwert")], 2))
    g = textrank.edges(c, 4)
    a = {(r["doc_id"], r["term"]): r["score"] for r in textrank.rank_by_groups(g, 5, True, direction).collect()}
    b = {(r["doc_id"], r["term"]): r["score"] for r in textrank.rank_by_joins(g, 5, True, direction).collect()}
    assert a == pytest.approx(b)
    mixed = {(r["doc_id"], r["term"]): r["score"] for r in textrank.textrank(c, 4, 5, direction=direction, group_edges=10).collect()}
    assert mixed == pytest.approx(a)
    assert all(r["src"] != r["dst"] for r in g.collect())


def test_linked_terms_keep_one_more(spark):
    got = {r["term"]: r for r in textrank.linked_terms(textrank.edges(corpus(spark, [list("abcde")]), 5), 1).collect()}
    assert got["a"]["links_out"] == ["b", "c"]
    assert got["a"]["links_in"] == []


def test_merge_and_catalog(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "doc_id long, term string, score double")
    b = spark.createDataFrame([(1, "x", 0.5)], "doc_id long, term string, score double")
    merged = catalog.merge_keywords([a, b])
    assert rows(merged) == [(1, "x", 0.5), (1, "y", 2.0)]
    names = spark.createDataFrame([("y", 1), ("near",  2)], "name string, code int")
    assert rows(catalog.filter_by_catalog(merged, names)) == [(1, "y", 2.0)]
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("near", [0.9, 0.1]), ("y", [0.0, 1.0])], "word string, vector array<double>")
    assert rows(catalog.filter_by_catalog(merged, names, vectors)) == [(1, "near", 0.5), (1, "y", 2.0)]


def test_passages(spark):
    w = spark.createDataFrame([(1, "Haus"), (2, "Haus"), (1, "")], "doc_id long, word string")
    s = spark.createDataFrame([(1, "Das Haus."), (1, "Das Haus."), (1, "haus"), (2, "Hof")], "doc_id long, sentence string")
    assert rows(catalog.text_passages(w, s)) == [(1, "Haus", ("Das Haus.",))]


def test_line_operators(spark):
    docs = spark.createDataFrame([(1, "Eine lange Zeile mit sehr vielen Wörtern darin\n12\nkurz\nDoppelt steht dies\nDoppelt steht dies\n1 . 2 . 3\nZu-\nsammen"), (2, "kurz\n12"), (3, None)], "doc_id long, text string")
    all_lines = lines.to_lines(docs)
    assert [r["line"] for r in lines.drop_unimportant(all_lines).filter("doc_id = 1").orderBy("line_no").collect()] == ["Eine lange Zeile mit sehr vielen Wörtern darin"]
    assert lines.drop_unimportant(all_lines).filter("doc_id = 2").count() == 2
    assert "1 . 2 . 3" not in [r["line"] for r in lines.drop_contents(all_lines).collect()]
    assert "Doppelt steht dies" not in [r["line"] for r in lines.drop_repeated(all_lines).collect()]
    assert "Zusammen" in [r["line"] for r in lines.join_hyphenated(all_lines).collect()]


def test_tags(spark):
    t = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate(["Haus", "12", ".", "und", "geht"])], "doc_id long, sent_id int, pos int, term string")
    assert [r["pos_tag"] for r in tok.tag(t).orderBy("pos").collect()] == ["NN", "CARD", "$.", "FUNC", "OTHER"]


def test_catalog_takes_all_similar_words(spark):
    # all 1,500 words are above the limit
    words = [f"w{i}" for i in range(1500)]
    vectors = spark.createDataFrame([("name", [1.0, 0.0]), *((w, [1.0, 0.0001 * i]) for i, w in enumerate(words))], "word string, vector array<double>")
    keywords = spark.createDataFrame([(i, w, 1.0) for i, w in enumerate(words)], "doc_id long, term string, score double")
    names = spark.createDataFrame([("name",)], "name string")
    assert catalog.filter_by_catalog(keywords, names, vectors).count() == 1500


def test_text_keywords_stage_no_passages(spark, monkeypatch):
    from quarrymill.plans import more_queries

    def refuse(df, name):
        raise AssertionError(name)

    monkeypatch.setattr(catalog, "staged", refuse)
    assert more_queries.text_keywords(spark, "/root/testdata/sf0.001").count() > 0


def test_linked_terms_shuffle_tokens_once(spark):
    from quarrymill.operators import tokens

    tagged = spark.createDataFrame([(1, s, i, t, "NN") for s in (0, 1) for i, t in enumerate("abcdeba")], "doc_id long, sent_id int, pos int, term string, pos_tag string")
    got = textrank.linked_terms(textrank.edges(tokens.corpus(tagged, by_document=True)), 1)
    assert rows(got) == rows(textrank.linked_terms(textrank.edges(tokens.corpus(tagged)), 1))
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window") == 0
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_textrank_stages_edges_without_their_order(spark, monkeypatch):
    seen, staged = [], textrank.staged
    monkeypatch.setattr(textrank, "staged", lambda df, name: (seen.append((name, df.columns)), staged(df, name))[1])
    assert textrank.textrank(corpus(spark, [list("abcde")])).count() == 5
    assert seen == [("edges", ["doc_id", "src", "dst", "weight"])]
