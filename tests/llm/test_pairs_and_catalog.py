import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows

from quarrymill.llm import catalog_match, cooccurrence, queries
from quarrymill.llm.cooccurrence import ConfigurationNull, pairs_together

SCHEMA = "doc_id long, sent_id int, term string, item string, n long"


def brute(tokens, min_count, min_lift):
    baskets = {}
    for d, s, t, *_ in tokens:
        if t is not None and t.strip():
            baskets.setdefault((d, s), set()).add(t.strip().lower())
    n = Counter(i for b in baskets.values() for i in b)
    ab = Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2))
    return {p: c for p, c in ab.items() if c >= min_count and c * len(baskets) >= min_lift * n[p[0]] * n[p[1]]}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "WIDE_BASKET", 6)
    rng = random.Random(2)
    words = [f"W{i}" for i in range(30)] + ["Äpfel", "hot"]
    tokens = [(d, s, rng.choice([" hot", rng.choice(words), rng.choice(words).upper() + " "]), "x", 1) for d in range(40) for s in range(5) for _ in range(rng.randint(1, 12))]
    tokens += [(1, 1, None, "x", 1), (1, 2, "  ", "x", 1)] + tokens[:50]
    df = spark.createDataFrame(tokens, SCHEMA)
    for count, lift in ((3, 0.0), (4, 1.5)):
        got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in pairs_together(df, ["doc_id", "sent_id"], "term", count, lift).collect()}
        assert got == brute(tokens, count, lift)
    assert pairs_together(df.limit(0), ["doc_id", "sent_id"], "term").count() == 0


def test_tail_of_the_null():
    # equal baskets and items: the null is a plain binomial
    null = ConfigurationNull(np.array([100.0]), np.array([50.0]), np.array([5.0]), np.array([1000.0]))
    mean, tail = null.expected_and_tail(np.array([100.0]), np.array([100.0]), np.array([25.0]))
    p = (mean / 1000)[0]
    exact = -math.log10(sum(math.comb(1000, k) * p**k * (1 - p) ** (1000 - k) for k in range(25, 200)))
    assert mean[0] == pytest.approx(10, rel=0.05)
    assert tail[0] == pytest.approx(exact, abs=0.25)


def test_surprise_needs_more_than_popularity(spark):
    rng = random.Random(3)
    tokens = [(d, 0, w, "x", 1) for d in range(600) for w in {rng.choice("abcdefgh") for _ in range(3)} | ({"p", "q"} if d % 20 == 0 else set())]
    got = {(r["item_a"], r["item_b"]): r["q_value"] for r in pairs_together(spark.createDataFrame(tokens, SCHEMA), ["doc_id", "sent_id"], "term", 5).collect()}
    assert got[("p", "q")] < 1e-6
    assert got[("a", "b")] > 0.01


def test_null_keys_and_wide_baskets(spark, monkeypatch):
    """A basket of several blocks, one beside a null key, one item for all: every pair once."""
    monkeypatch.setattr(cooccurrence, "WIDE_BASKET", 10)
    tokens = [(1, 1, f"w{i}", "x", 1) for i in range(83)] + [(None, s, w, "x", 1) for s in (1, None) for w in "abc"] + [(2, 1, "w1", "x", 1), (2, 1, "w2", "x", 1)]
    df = spark.createDataFrame(tokens, SCHEMA)
    got = [(r["item_a"], r["item_b"], r["n_ab"]) for r in pairs_together(df, ["doc_id", "sent_id"], "term", 1).collect()]
    assert len(got) == len(set(got)) == 83 * 82 // 2 + 3
    assert {(a, b): n for a, b, n in got} == brute(tokens, 1, 0.0)


def test_tail_against_exact_sums(monkeypatch):
    """Unequal baskets: the Poisson-binomial tail by convolution; memory bounds change nothing."""
    counts, weights, sizes, baskets = np.array([5.0, 40.0, 200.0]), np.array([60.0, 23.0, 3.0]), np.array([2.0, 4.0, 9.0]), np.array([250.0, 150.0, 80.0])
    null = ConfigurationNull(counts, weights, sizes, baskets)
    assert null.rounds < 500
    for n in counts:
        assert (null.probabilities(np.array([n])) * baskets).sum() == pytest.approx(n, rel=1e-6)
    q = (null.probabilities(np.array([40.0])) * null.probabilities(np.array([200.0])))[0]
    dist = np.array([1.0])
    for p, m in zip(q, baskets, strict=True):
        for _ in range(int(m)):
            dist = np.convolve(dist, [1 - p, p])
    for k in (30, 40, 60):
        mean, tail = null.expected_and_tail(np.array([40.0]), np.array([200.0]), np.array([float(k)]))
        assert mean[0] == pytest.approx((q * baskets).sum())
        assert tail[0] == pytest.approx(-math.log10(dist[k:].sum()), abs=0.25)
    monkeypatch.setattr(cooccurrence, "CELLS", 3)
    assert np.allclose(ConfigurationNull(counts, weights, sizes, baskets).y, null.y)


ENTRIES = [(1, "Energiefläche", "m"), (2, "Klimazone", "m"), (3, "überörtlicher Stadtplatz", "m"), (4, "Brückengutachten", "m"), (5, "Klimakarte", "m"), (6, "Brückenkarte", "m"), (7, "Uferkarte", "m"), (8, "Uferzone", "m"), (9, "Brückenzone", "m"), (10, "Klimagutachten", "m")]
MEANT = [
    ("energieflaeche", 1), ("Enеrgiefläche", 1), ("Energifläche", 1), ("ENERGIE-FLÄCHE", 1), ("Energieflä.", 1), ("Thema: Klimazone", 2), ("Klimazonen", 2), ("Stadtplatz, überörtlicher", 3), ("Stadtplatz (überörtlicher)", 3), ("überörtlicher stadtplatz - Anlage 2", 3),
    ("Brükcengutachten", 4), ("#Klimakarte?", 5), ("Ufergutachten", -1), ("Gitarrenkurs", -1), ("n/a", -1), ("...", -1), ("Klima", -1), ("Klima.", -1), ("x" * 5000, -1),
]


def test_catalog(spark):
    data = [(i, v, "g") for i, (v, _) in enumerate(MEANT)] + [(0, MEANT[0][0], "g"), (100, None, "g"), (101, " \t", "g"), (102, "Klimazone", "g"), (None, "x", "g")]
    keywords = spark.createDataFrame(data, "id long, keyword string, grams string")
    entries = spark.createDataFrame([*ENTRIES, (11, None, "m")], "term_id long, term string, value string")
    got = {r["keyword_id"]: r["term_id"] for r in catalog_match.match_catalog(keywords, entries).collect()}
    assert got == {i: t for i, (_, t) in enumerate(MEANT)}
    assert catalog_match.match_catalog(keywords.limit(0), entries).count() == 0
    assert {r["term_id"] for r in catalog_match.match_catalog(keywords, entries.limit(0)).collect()} == {-1}


def test_prefix_join_loses_no_similar_pair(spark):
    rng = random.Random(4)
    forms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(60)})
    keys = [catalog_match.trigrams(f) for f in forms]
    freq = Counter(g for k in keys for g in k)
    order = [sorted(k, key=lambda g: (freq[g], g)) for k in keys]
    t = catalog_match.SIMILARITY
    for a, b in itertools.combinations(range(len(forms)), 2):
        j = len(set(order[a]) & set(order[b])) / len(set(order[a]) | set(order[b]))
        pre = lambda x: set(x[: len(x) - math.ceil(len(x) * t - 1e-9) + 1])
        assert j < t or pre(order[a]) & pre(order[b])


def test_edit_distance():
    assert catalog_match.edit_distance("abcd", "abdc", 2) == 1
    assert catalog_match.edit_distance("abcd", "xyzw", 2) == 3
    assert rows is not None


def test_registered_pairs_have_no_floor(spark, tmp_path):
    # "rar" and "selten" share 3 of 2,000 sentences, "rar" and "w0" one
    words = [(d, 0, f"w{d % 20}") for d in range(2000)] + [(d, 0, f"v{d % 7}") for d in range(2000)] + [(d, 0, t) for d in (0, 21, 42) for t in ("rar", "selten")]
    spark.createDataFrame(words, "doc_id long, sent_id int, term string").write.parquet(str(tmp_path / "tagged_tokens.parquet"))
    together = Counter((r["item_a"], r["item_b"]) for r in queries.p3_all_counts(spark, str(tmp_path)).collect())
    assert set(together) == set(brute(words, 1, 0.0)) and max(together.values()) == 1
    assert ("rar", "selten") in {(r["item_a"], r["item_b"]) for r in queries.p3_surprising(spark, str(tmp_path)).collect()}


def test_compound_parts(spark):
    """The joins give the parts that the definition gives."""
    forms = {a + b for a in ("wasser", "garten", "verkehrs", "stadt") for b in ("planung", "schutz", "bericht", "konzept")} | {"park", "ab"}
    after, longer, ends = {}, {}, {}
    for f in forms:
        for c in range(3, len(f) - 2):
            after[f[c:]] = after.get(f[c:], 0) + 1
    for e, n in after.items():
        longer[e[1:]] = max(longer.get(e[1:], 0), n)
    able = {e for e, n in after.items() if n > 2 and longer.get(e, 0) < n}
    last = {e for e in able if not any(e[c:] in able for c in range(1, len(e) - 2))}
    for f in forms:
        for c in range(3, len(f) - 2):
            ends.setdefault(f[:c], []).append(f[c:] in last)
    first = {p for p, k in ends.items() if len(k) > 1 and sum(k) >= 0.8 * len(k)}
    got = catalog_match.compound_parts(spark.createDataFrame([(f,) for f in sorted(forms)], "form string"), "form")
    assert [{r["part"] for r in g.collect()} for g in got] == [first, last]
    assert {"planung", "schutz"} <= last and "wasser" in first


def test_similar_forms_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aben") for _ in range(rng.randint(2, 9))) for _ in range(160)})
    sides = [spark.createDataFrame([(w, catalog_match.trigrams(w)) for w in part], "form string, grams array<string>") for part in (words[:100], words[60:])]
    want = set()
    for a in words[:100]:
        for b in words[60:]:
            x, y = set(catalog_match.trigrams(a)), set(catalog_match.trigrams(b))
            if len(x & y) / len(x | y) >= 0.25:
                want.add((a, b))
    for block in (50_000, 9):
        monkeypatch.setattr(catalog_match, "GRAM_BLOCK", block)
        got = [(r["form"], r["entry_form"]) for r in catalog_match.similar_forms(*sides, 0.25).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_edits_equal_distance(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abeuoenst") for _ in range(rng.randint(4, 14))) for _ in range(120)]
    pairs = [(a, b, 0.5) for w in words for a, b in [(w, w[:2] + w[3] + w[2] + w[4:]), (w + "en", w), (w.replace("ue", "u"), w), (w[1:], w), (w, words[0])]]
    df = spark.createDataFrame(sorted(set(pairs)), "form string, entry_form string, jaccard double")
    got = catalog_match.scored_pairs(df).collect()
    assert len(got) > 300
    for r in got:
        assert r["edits"] == min(catalog_match.distance(r["form"], r["entry_form"]), catalog_match.allowed(len(r["entry_form"])) + 1)
