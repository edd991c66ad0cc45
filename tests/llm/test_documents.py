from difflib import SequenceMatcher

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm import addresses, personal, scans, sentences

DOCS = "doc_id long, text string, lang string, origin string, start_pos string, kind string"


def docs(spark, texts, origin="digital", lang="de"):
    return spark.createDataFrame([(i, t, lang, origin, "x", "y") for i, t in enumerate(texts)], DOCS)


SENTENCES = [
    ("de", "Das gilt z. B. hier. Der Rat (vgl. S. 5) tagt am 4. Oktober 2015. Ende", ["Das gilt z. B. hier.", "Der Rat (vgl. S. 5) tagt am 4. Oktober 2015.", "Ende"]),
    ("de", "„Zu laut!“, sagte sie. Läden usw. Der Plan folgt.", ["„Zu laut!“, sagte sie.", "Läden usw.", "Der Plan folgt."]),
    ("de", "Die u. Co. KG mit Sitz in A-Stadt. Nr. 5 fehlt.Dann 1.000,50 EUR inkl. MwSt. Ist das so?! Ja.", ["Die u. Co. KG mit Sitz in A-Stadt.", "Nr. 5 fehlt.", "Dann 1.000,50 EUR inkl. MwSt.", "Ist das so?!", "Ja."]),
    ("de", "Zu prüfen:\n1. Kosten\n2. Lärm\n\nMit Gruß", ["Zu prüfen:", "1. Kosten", "2. Lärm", "Mit Gruß"]),
    ("de", "Ein Satz geht\nüber Zeilen am 3.\nMai weiter. Mail a.B@X.TEST bitte.", ["Ein Satz geht\nüber Zeilen am 3.\nMai weiter.", "Mail a.B@X.TEST bitte."]),
    ("en", 'Mr. Smith left at 9.30 a.m. The U.S. style map. "Is it?" asked one. See Fig. 5.', ["Mr. Smith left at 9.30 a.m.", "The U.S. style map.", '"Is it?" asked one.', "See Fig. 5."]),
    ("fr", "« C'est trop tard ! » a dit une riveraine. Qui paie ? « La rue. » Fin.", ["« C'est trop tard ! » a dit une riveraine.", "Qui paie ?", "« La rue. »", "Fin."]),
    ("ru", "Шум и т. д. в отчёте. «Шумно!» — сказала соседка. До 2028 г. работ.", ["Шум и т. д. в отчёте.", "«Шумно!» — сказала соседка.", "До 2028 г. работ."]),
    ("el", "Ποιος πληρώνει; Αφορά π.χ. τον θόρυβο· μένει.", ["Ποιος πληρώνει;", "Αφορά π.χ. τον θόρυβο· μένει."]),
    ("zh", "居民说：“太窄了。”“何时开工？”一位老人问道。工期……不清楚。", ["居民说：“太窄了。”", "“何时开工？”一位老人问道。", "工期……不清楚。"]),
    ("ja", "「狭い。」と述べた。「いつ？」委員会は5.3メートル。", ["「狭い。」と述べた。", "「いつ？」", "委員会は5.3メートル。"]),
    ("th", "ใครจะจ่าย เริ่มเมื่อใด 94 วัน", ["ใครจะจ่าย", "เริ่มเมื่อใด 94 วัน"]), ("hi", "यह ठीक नहीं है। काम कब?", ["यह ठीक नहीं है।", "काम कब?"]), ("ar", "قالت: «ضيق.» من يدفع؟", ["قالت: «ضيق.»", "من يدفع؟"]),
    ("de", "Das regelt § 4 ff. Abs. 2 und §§ 42 f. Nr. 3, aber nicht S. 5 f. Dann folgt mehr.", ["Das regelt § 4 ff. Abs. 2 und §§ 42 f. Nr. 3, aber nicht S. 5 f.", "Dann folgt mehr."]),
    ("es", "El Sr. López vive en la Avda. Real con los suyos. Véase la pág. 5 del plan, etc. Las obras empiezan hoy.", ["El Sr. López vive en la Avda. Real con los suyos.", "Véase la pág. 5 del plan, etc.", "Las obras empiezan hoy."]),
    ("it", "Il Sig. Rossi parla di alberi, ecc. Anche la fig. 3 della pag. 9 è nuova.", ["Il Sig. Rossi parla di alberi, ecc.", "Anche la fig. 3 della pag. 9 è nuova."]),
    ("nl", "Het plan van dhr. Jansen is niet klaar. Zie blz. 4 voor een kaart met bijv. wegen.", ["Het plan van dhr. Jansen is niet klaar.", "Zie blz. 4 voor een kaart met bijv. wegen."]),
    ("pl", "Budynek przy ul. Długiej jest nowy. Zob. rys. 5 oraz np. Warszawę, itd. Plan nie jest gotowy.", ["Budynek przy ul. Długiej jest nowy.", "Zob. rys. 5 oraz np. Warszawę, itd.", "Plan nie jest gotowy."]),
    ("de", " \n\t ", []), (None, "SELECT 1", ["SELECT 1"]),
]


@pytest.mark.parametrize(("lang", "text", "parts"), SENTENCES)
def test_sentences(lang, text, parts):
    assert [text[s:e] for s, e in sentences.sentence_spans(text, lang)] == parts


def test_sentence_operator(spark):
    got = rows(sentences.split_sentences(docs(spark, ["A b. C d.", None, "", "Wort. " * 5000])).select("doc_id", "sent_no"))
    assert len(got) == 2 + 5000
    assert sentences.split_sentences(docs(spark, []).limit(0)).count() == 0


PII = [
    ("Bitte an max.muster (at) firma (punkt) de oder 030 23125-295.", {("email", "max.muster (at) firma (punkt) de"), ("phone", "030 23125-295")}),
    ("Steuer-ID 03 983 007 141 und Az. IV-87/21-0, DIN 1840-1, am 04.08.2015.", {("id_number", "03 983 007 141")}),
    ("Wohnhaft Am Mispelwinkel 45a, 10054 Dorf; Schloßstr. Nr. 8 in 10020 Au.", {("address", "Am Mispelwinkel 45a, 10054 Dorf"), ("address", "Schloßstr. Nr. 8 in 10020 Au")}),
    ("Er wohnt in 12, rue de la Gare. The house at 36 b Apple Mews is empty.", {("address", "12, rue de la Gare"), ("address", "36 b Apple Mews")}),
    ("Tel. null drei null vier fünf sechs sieben acht neun bitte.", {("phone", "null drei null vier fünf sechs sieben acht neun")}),
    ("Die Werte 14325 7 7 38 0427 99 924223 und 10 @ 5 Punkte, @wer, 12.500 EUR.", set()),
    ("Mail: kаrl@ａb.de über", {("email", "kаrl@ａb.de")}),
    ("He gave AB 12 34 56 C and CE123456D today.", {("id_number", "AB 12 34 56 C"), ("id_number", "CE123456D")}),
    ("An kaleth+plan@ planwerk.example oder j.x @bau.test, 10 @ 5 Punkte, na @ Hof. Ende.", {("email", "kaleth+plan@ planwerk.example"), ("email", "j.x @bau.test")}),
    ("邮箱 li（at）firma（dot）cn 。", {("email", "li（at）firma（dot）cn")}),
]


@pytest.mark.parametrize(("text", "found"), PII)
def test_identifiers(text, found):
    norm = personal.normalise(text)
    assert {(k, text[slice(*norm.source(s, e))]) for s, e, k in personal.identifiers(norm).found} == found


def test_names(spark):
    texts = [
        "Herr Arno Beispiel kam.", "Frau Arno Beispiel ging.", "Mit freundlichen Grüßen\n\nBerta Muster", "Dr. Berta Muster lobt.", "Für Beispiel, Arno erwidert B. Muster. Die Arno-Beispiel-Schule und der Musterplatz 5 bleiben.",
        None, "", "ARNO BEISPIEL sagt: Die Untere Behörde prüft.",
    ]
    df = docs(spark, texts)
    got = {(r["doc_id"], texts[r["doc_id"]][r["start_pos"] : r["end_pos"]]) for r in personal.find_personal(df).filter("kind = 'name'").collect()}
    assert got == {(0, "Arno Beispiel"), (1, "Arno Beispiel"), (2, "Berta Muster"), (3, "Berta Muster"), (4, "Beispiel, Arno"), (4, "B. Muster"), (7, "ARNO BEISPIEL")}
    red = {r["doc_id"]: r["text"] for r in personal.redact(df).collect()}
    assert red[0] == "Herr <NAME> kam." and red[5] is None and red[6] == ""
    assert personal.find_personal(df.limit(0)).count() == 0


ALONE = [
    ("Herr Mueller kam zu spät.", ["Mueller"]), ("Sehr geehrte Frau Dr. Weber,\nbitte", ["Weber"]), ("Mr. Smith left; Mme Dubois aussi.", ["Smith", "Dubois"]), ("Der Herr Bürgermeister und die Frau Präsidentin tagen.", []),
    ("M. Dupont est venu et la rue est une impasse, les autres non.", ["Dupont"]), ("Herr Dr. Arno Muster sprach.", ["Arno Muster"]), ("Prof. Klein, Dr. Groß", ["Klein", "Groß"]),
]


@pytest.mark.parametrize(("text", "names"), ALONE)
def test_surname_after_title(text, names):
    norm = personal.normalise(text)
    got = [c for c in personal.name_candidates(norm, personal.identifiers(norm), None, personal.landmarks([norm.text])[2][0]) if c[-1]]
    assert [norm.text[c[0] : c[1]] for c in got] == names


def test_three_names(spark):
    texts = ["Herr Anna Muster kam. Frau Maria Klein kam.", "Herr Maria Klein ging. Frau Anna Klein auch.", "Heute sprach Anna Maria Klein hier. Der Rat Neue Mitte tagt.", "Господин Иван Петрович Смирнов пришёл."]
    got = {(r["doc_id"], texts[r["doc_id"]][r["start_pos"] : r["end_pos"]]) for r in personal.find_personal(docs(spark, texts)).filter("doc_id >= 2").collect()}
    assert (2, "Anna Maria Klein") in got and not any("Mitte" in n for _, n in got)


def test_landmarks_lose_nothing():
    """Names and house numbers found from landmarks are those found by trying every place."""
    texts = ["Am Hof 5, 10001 Au; Schloßstr. 7b.\nAlt-Moabit 3", "", "12 bis, rue de la Gare", "A. B. Muster, Jo (Ada von der Au) x@Y Z", "Straße 12345 und 3.5 Weg 7,5 Allee 8", "14–16 Old Mill Lane"]
    follow, precede, capitals = personal.landmarks(texts)
    for t, f, p, c in zip(texts, follow, precede, capitals, strict=True):
        digits = [i for i in range(len(t)) if t[i].isdigit() and (i == 0 or not t[i - 1].isdigit() and t[i - 1] not in ".,/-–" and not t[i - 1].isalpha())]
        assert personal.addresses(t, f, p) == personal.addresses(t, [i for i in digits if i and t[i - 1].isspace()], digits)
        every = [i for i in range(len(t)) if personal._NAME.match(t, i)]
        assert [i for i in c if personal._NAME.match(t, i)] == [i for i in every if t[i:].split()[0].rstrip(",") not in personal.NOT_NAMES]


PAGE = "Umweltbericht Test\nDer Rat prüft heute die lange Straßen-\nplanung und dann prüft er die Planung\nim Umfeld der alten Schule. Die Verwal-\n\n- {} -\n"


def test_scans(spark):
    scan = PAGE.format(1) + "Umweltbericht Test\ntung prüft die P1anung. Wir m e i n e n das auch.\nDer Rat prüft Rad- und Wege, dann die Rad-\nund Wege heute noch einmal genau."
    other = "Die Straßenplanung und die Verwaltung prüft die Planung. " * 3
    df = spark.createDataFrame([(1, scan, "de", "scan", "x", "y"), (2, other, "de", "digital", "x", "y"), (3, None, "de", "scan", "x", "y"), (4, "", "de", "scan", "x", "y"), (5, "x", "de", None, "x", "y")], DOCS)
    got = rows(scans.line_findings(df))
    assert got == sorted([(1, 1, "furniture"), (1, 2, "split"), (1, 4, "split"), (1, 6, "furniture"), (1, 7, "furniture"), (1, 8, "misread")], key=repr)
    text = {r["doc_id"]: r["text"] for r in scans.repaired_text(df).collect()}
    assert "Straßenplanung und" in text[1] and "Verwaltung prüft die Planung." in text[1] and "meinen das" in text[1] and "- 1 -" not in text[1]
    assert set(text) == {1, 4}
    assert scans.line_findings(df.limit(0)).count() == 0


def test_numbers_in_a_column_stay():
    lines = ["Der Rat prüft die Zahlen der alten Schulen im", "Norden der Stadt und nennt sie je Jahr so:", "1985", "2310", "1986", "2544", "Danach sinkt die Zahl wieder, wie die Tafel", "im Anhang der Begründung ausführlich zeigt.", "1", "2", "3"]
    assert scans.furniture(lines).isdisjoint(range(2, 11))
    pages = [x for n in (7, 8, 10) for x in ("Der Rat prüft heute die Planung der Schule,", "und er prüft sie morgen noch einmal genauer", f"{n}")]
    assert {2, 5, 8} <= scans.furniture([*pages, "weil die Zahl der Kinder in der Stadt wieder"])
    roman = ["Der Rat prüft heute die Planung der Schule,", "ii", "und er prüft sie morgen noch einmal genauer", "iii", "weil die Zahl der Kinder in der Stadt wieder"]
    assert {1, 3} <= scans.furniture(roman)
    assert [scans.page_value(scans._PAGE.match(x)) for x in ("- 3 -", "Seite l2 von 30", "iv", "1O", "5/12")] == [3, 12, 4, 10, 5]


def test_header_of_one_word_with_errors():
    text = "Der Rat prüft heute die lange Planung und dann\nprüft er die Planung im Umfeld der Schule."
    lines = "\n".join(f"{h}\n{text}\n- {i} -" for i, h in enumerate(("Umweltbericht", "Umweltberlcht", "Umwe1tbericht"), 1)).split("\n")
    assert {0, 4, 8} <= scans.furniture(lines)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde ", min_size=8, max_size=30), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["", "a", "xy"])), max_size=5))
def test_signature_loses_no_similar_line(a, edits):
    b = a
    for i, new in edits:
        b = b[:i] + new + b[i + 1 :]
    like = a == b or SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85
    assert scans._alike(a, b, scans._signature(a), scans._signature(b)) == like


def test_fixes_are_words():
    fixes = {"P1an": "Plan", "Str@ße": "Straße"}
    assert scans._fixed("Der P1an, „P1an“ und P1anung; Alte-Str@ße.", fixes) == "Der Plan, „Plan“ und P1anung; Alte-Straße."


ADDRESSES = "address_id long, strnam string, hausnr string, hausnrz string, bez_name string, plz string, entity_text string, town string, n string"


def test_addresses(spark):
    same = [
        ("Am Hof", "5", "a", "Neudorf", "10001", None), ("am Hof", "5a", None, "OT Neudorf", None, None), (None, None, None, None, None, "10001 Neudorf, Am Hof Nr. 5 A"), ("Am Hof", "5", "A", None, "10001", None),
        ("Gartenstraße", "9 bis 15", None, "Neudorf", "10001", None), ("Garten-Str.", "9-15", "", "NEUDORF", None, None), (None, None, None, None, None, "9–15 Gartenstrasse; D-10001"), ("Gartenstarße", "9 - 15", None, "Neudorf", "10001", None),
        ("Gartenstraße", "9", None, "Neudorf", "10001", None), ("Gartenweg", "9 bis 15", None, "Neudorf", "10001", None), ("Am Hof", None, None, "Neudorf", "10001", None), ("Am Hof", "5", "b", "Neudorf", "10001", None), ("Am Hof", "5", "a", "Altdorf", "20001", None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r, "t", "n") for i, r in enumerate(same)] + [(0, *same[0], "t", "n")], ADDRESSES)
    got = rows(addresses.same_place(df))
    want = [(a, b) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b]
    assert got == sorted(want, key=repr)
    assert addresses.same_place(df.limit(0)).count() == 0


def test_two_misreadings_of_words_the_vocabulary_has(spark):
    counts = {"der": 10_000_000, "Bereich": 957, "Bcrcich": 2, "zwischen": 2000, "zwischcn": 36, "zvvischcn": 12, "Rückbauzone": 60, "Rückbanzone": 12, "weil": 6239, "wen": 1}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    assert rows(scans._verdicts(words, vocabulary)) == [("Bcrcich", "Bereich"), ("Rückbanzone", "Rückbauzone"), ("zvvischcn", "zwischen"), ("zwischcn", "zwischen")]


def test_chains_of_spellings(spark):
    """Two letters apart in a chain of three spellings are one place; another number is not."""
    spelt = ["Abendrotweg"] * 5 + ["Abendrodweg"] * 2 + ["Abemdrodweg"]
    data = [(i, s, "7", None, "Neudorf", "10001", None, "t", "n") for i, s in enumerate(spelt)] + [(100, "Abendrotweg", "8", None, "Neudorf", "10001", None, "t", "n")]
    df = spark.createDataFrame(data, ADDRESSES)
    assert rows(addresses.places(df)) == sorted([(i, 0) for i in range(8)] + [(100, 100)], key=repr)
    assert addresses.same_place(df).count() == 8 * 7 // 2


def test_two_spoilt_spellings(spark):
    """Both streets of a house spoilt, in different letters; two well-known streets stay apart."""
    data = [("Amselgaartenstraße", "38", "Neudorf"), ("Amsekgartenstraße", "38", "Neudorf")] + [(s, str(n), "Neudorf") for s in ("Haselangerweg", "Amselangerweg") for n in range(1, 6)]
    data += [("Birkenweg", str(n), "Hohenrawerder") for n in range(60, 120)] + [("Birkenweg", "60", "Hohenrwaerder")]
    df = spark.createDataFrame([(i, s, n, None, t, None, None, "t", "n") for i, (s, n, t) in enumerate(data)], ADDRESSES)
    assert rows(addresses.same_place(df)) == [(0, 1), (12, 72)]


def test_large_place_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(addresses, "PAIR_BLOCK", 7)
    df = spark.createDataFrame([(i, "Am Hof", "5", None, "Neudorf", None, None, "t", "n") for i in range(60)], ADDRESSES)
    got = rows(addresses.same_place(df))
    assert got == sorted([(a, b) for a in range(60) for b in range(a + 1, 60)], key=repr)


def test_variants(spark):
    df = spark.createDataFrame([("abba",), ("a",)], "s string").select(addresses.variants(F.col("s")).alias("v"))
    assert [sorted(r["v"]) for r in df.collect()] == [sorted({"abba", "bba", "aba", "abb"}), sorted({"a", ""})]
