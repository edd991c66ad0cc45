import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.functions.stemmer import german_stem


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize(("a", "b"), [("frühr-er", "frührer"), ("U-Bahn", "U-Bahn"), ("Robert-August-Staße", "Robert-August-Staße"), ("ab-cd-", "abcd"), ("-abc", "abc"), ("abc-", "abc-")])
def test_hyphen_repair(spark, a, b):
    assert one(spark, a, T.repair_hyphen) == b


@pytest.mark.parametrize(("entity", "numbers"), [
    ("Lindauer Allee 17", [(17, "")]), ("Lindauer Allee 17-20", [(17, ""), (18, ""), (19, ""), (20, "")]), ("Berlinerweg 18/20", [(18, ""), (20, "")]), ("Weg 12a", [(12, "A")]), ("Weg 12a-c", [(12, "C")])])
def test_house_numbers(spark, entity, numbers):
    got = one(spark, entity, lambda c: T.house_numbers(T.number_part(c)))
    assert [(h["number"], h["suffix"]) for h in got] == numbers


def test_contents_percent(spark):
    assert one(spark, "1 . 2 . 3", T.contents_percent) == 100
    assert one(spark, "", T.contents_percent) == 0
    # three of five in single precision is a little more than 60 percent
    assert one(spark, "1.2 Haus Baum Wort", lambda c: T.contents_share(F.lit(1), F.lit(1), F.lit(1), F.lit(2))) == 61


def test_joining_and_expanding(spark):
    assert one(spark, ["Haus", ",", "Hof"], T.join_tokens, "array<string>") == "Haus, Hof"
    assert one(spark, "Lindauer str. 5, Berliner Str. 6, alte str. 7", T.expand_street) == "Lindauer straße 5, Berliner Straße 6, alte str. 7"


def test_splitting(spark):
    assert one(spark, "a\nb\n\n", lambda c: T.java_split(c, "\n")) == ["a", "b"]
    assert one(spark, "", lambda c: T.java_split(c, "\n")) == [""]
    assert one(spark, "Eins. Zwei! Drei", T.split_sentences) == ["Eins.", "Zwei!", "Drei"]
    assert one(spark, "\t a \n", T.java_trim) == "a"


@pytest.mark.parametrize(("w", "s"), [("aufeinander", "aufeinand"), ("häuser", "haus"), ("jahrhunderte", "jahrhundert"), ("freiheiten", "freiheit"), ("kategorischen", "kategor"), ("wohnung", "wohnung")])
def test_stemmer(w, s):
    assert german_stem(w) == s


def test_similar_lines_are_split_once(spark):
    from quarrymill.operators import lines

    df = spark.createDataFrame([(1, 0, "Der alte Hof"), (1, 1, "der  HOF"), (1, 2, "x"), (2, 0, "allein")], "doc_id long, line_no int, line string")
    got = lines.similar_lines(df, 2)
    assert {(r["line_no"], r["similarity"]) for r in got.collect()} == {(0, 67), (1, 67)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(lower") <= 4
