"""Mapping freely entered values to the entries of a reference list.

A set-similarity join with prefix filter: values and entries become sets of trigrams ordered from
rare to frequent over both sides; only rare prefixes are joined, hot trigrams in parts; length and
position filters cut the candidates, the Jaccard similarity of the rest is computed exactly. A pair
comes out at its first common trigram only, so nothing is made distinct afterwards. Of the candidates
the closest by edit distance (transpositions count once) is kept if it is near enough and no other
entry is as near; an abbreviated value stands for the only entry with its beginning; a value that
is a clean compound of known parts, but no entry, means none. All of it is joins and aggregates,
whatever the size of either side; Python counts transpositions in the few pairs that may have some.

Null and blank values and values equal to an entry give no row; several rows of one id count as
one (the greatest value). Values that mean no entry get ``-1``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.lookalikes import fold_lookalikes
from quarrymill.tables import staged

#: Jaccard similarity of trigram sets that a candidate needs: the least that values of two wrong
#: letters in eight have with what they mean. Bigrams at 0.35 give twice as many candidates.
SIMILARITY = 0.25
#: The part of an entry that an abbreviated value must give, and its least letters.
BEGINNING, BEGINNING_LETTERS = 0.25, 4
#: A trigram is joined in parts of about this many forms.
GRAM_BLOCK = 50_000
NO_ENTRY = -1
# Words that introduce a keyword, and endings of inflected German words.
LABELS = r"(?:thema|themen|stichwort|schlagwort|betr(?:eff|ifft)?|bzgl|kategorie|begriff|keyword|zu|re)"
ENDINGS = ("es", "en", "er", "e", "s", "n")

_LABEL = regex.compile(rf"^\s*[#*•\-–]*\s*{LABELS}\s*(?:[.:=–-]\s*|\s+)(?=\S)", regex.I)
_TAILS = [regex.compile(p, regex.I) for p in (r"\s*[(\[{][^)\]}]*[)\]}]\s*$", r"\s+[/|–—-]\s+.*$", r"\s+\d{1,4}\s*$", r"\s*[,;]?\s*(?:anlage|nr|teil|stand)\.?\s*\d+\s*$")]


def normal_form(s: str) -> str:
    """Lower case Latin letters and digits only; lookalikes folded, umlauts written out."""
    s = fold_lookalikes(unicodedata.normalize("NFKC", s)).lower()
    s = s.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss").replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if c.isalnum())


def readings(value: str) -> list[str]:
    """What the value may stand for: as it is, without labels, without additions, turned round."""
    out = [value]
    bare = _LABEL.sub("", value)
    if turned := regex.fullmatch(r"\s*([^()]+?)\s*\(([^()]+)\)\s*", bare):
        out.append(f"{turned[2]} {turned[1]}")
    for tail in _TAILS:
        bare = tail.sub("", bare)
    out.append(bare)
    if bare.count(",") == 1:
        a, b = bare.split(",")
        out.append(f"{b} {a}")
    return list(dict.fromkeys(f for f in map(normal_form, out) if f))


def trigrams(form: str) -> list[str]:
    """The set of trigrams of the padded form; a repeated one is numbered."""
    padded, seen, out = f"  {form} ", {}, []
    for i in range(len(padded) - 2):
        g = padded[i : i + 3]
        seen[g] = seen.get(g, 0) + 1
        out.append(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def allowed(n: int) -> int:
    """Errors allowed in a form of ``n`` letters."""
    return 0 if n < 4 else 1 if n < 8 else 2 if n < 13 else 3 if n < 20 else 4


def stems(form: str) -> list[str]:
    return [form] + [form[: -len(e)] for e in ENDINGS if form.endswith(e) and len(form) - len(e) >= 4]


def flattened(form: str) -> str:
    """Written-out umlauts as one letter, so that an error in one counts once."""
    return form.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def distance(form: str, entry: str) -> float:
    """Edits between form and entry; an inflectional ending of the form counts half an edit."""
    most, flat = allowed(len(entry)), flattened(entry)
    best = float(most + 1)
    for i, stem in enumerate(stems(form)):
        edits = edit_distance(stem, entry, most)
        if edits:
            edits = min(edits, max(1, edit_distance(flattened(stem), flat, most)))
        best = min(best, edits + 0.5 * (i > 0))
    return best


def _swaps(a: str, b: str) -> bool:
    """Whether two neighbours of ``a`` stand the other way round somewhere in ``b``."""
    return any(a[i] != a[i + 1] and a[i + 1] + a[i] in b for i in range(len(a) - 1))


# The same on columns -----------------------------------------------------------------------------


def _flattened(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("ae"), F.lit("a")), F.lit("oe"), F.lit("o")), F.lit("ue"), F.lit("u"))


def _allowed(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 4, 0).when(n < 8, 1).when(n < 13, 2).when(n < 20, 3).otherwise(4)


def _stems(c: Column) -> Column:
    """The form, then the form without each ending it has."""
    cut = [F.when(F.endswith(c, F.lit(e)) & (F.length(c) >= len(e) + 4), F.substring(c, F.lit(1), F.length(c) - len(e))) for e in ENDINGS]
    return F.concat(F.array(c), F.filter(F.array(*cut), lambda x: x.isNotNull()))


def _plain_distance(form: Column, entry: Column) -> Column:
    """``distance`` with a transposition counting twice; null beyond twice the allowed errors."""

    def of(stem: Column, i: Column) -> Column:
        whole, flat = F.levenshtein(stem, entry, 8), F.levenshtein(_flattened(stem), _flattened(entry), 8)
        flat = F.when(flat >= 0, F.greatest(flat, F.lit(1)))
        edits = F.when(whole == 0, 0).otherwise(F.least(F.when(whole > 0, whole), flat))
        return F.when(edits <= 2 * _allowed(entry), edits + F.when(i > 0, 0.5).otherwise(0.0))

    return F.array_min(F.transform(_stems(form), of))


def compound_parts(entries: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """First parts and last parts, one string column ``part`` each, of which the entries are made
    up: a last part follows several first parts, loses some of them with one letter more and holds
    no shorter last part; a first part stands before last parts in at least four of five entries."""
    form = F.col(col)
    cuts = entries.select(form, F.explode(F.sequence(F.lit(3), F.greatest(F.length(form) - 3, F.lit(3)))).alias("at")).filter(F.length(form) >= F.col("at") + 3)
    split = staged(cuts.select(F.substring(form, F.lit(1), F.col("at")).alias("first"), F.substring(form, F.col("at") + 1, F.length(form)).alias("last")), "splits")
    after = split.groupBy("last").agg(F.count(F.lit(1)).alias("n"))
    longer = after.select(F.expr("substring(last, 2)").alias("last"), "n").groupBy("last").agg(F.max("n").alias("longer"))
    able = staged(after.filter("n > 2").join(longer, "last", "left").filter("longer IS NULL OR longer < n").select("last"), "able")
    inner = able.filter(F.length("last") > 3).select("last", F.explode(F.transform(F.sequence(F.lit(2), F.length("last") - 2), lambda i: F.substring(F.col("last"), i, F.length("last")))).alias("tail"))
    holding = inner.join(able.select(F.col("last").alias("tail")), "tail", "left_semi").select("last").distinct()
    last = staged(able.join(holding, "last", "left_anti").select(F.col("last").alias("part")), "last_parts")
    ended = split.join(last.select(F.col("part").alias("last"), F.lit(1).alias("known")), "last", "left").groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"))
    return ended.filter((F.col("n") > 1) & (F.col("known") >= 0.8 * F.col("n"))).select(F.col("first").alias("part")), last


def similar_forms(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """``(form, entry_form, jaccard)`` of all pairs of the ``(form, grams)`` of both sides whose
    trigram sets are at least so similar, each pair once."""
    grams = left.select(F.explode("grams").alias("g")).unionByName(right.select(F.explode("grams").alias("g")))
    # numbers that rise from rare to frequent stand for the trigrams
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "g").select("g", "n", F.monotonically_increasing_id().alias("rank"))
    rarity = staged(rarity, "rarity")

    def prefixes(df: DataFrame, key: str, tag: str) -> DataFrame:
        long = df.select(F.col("form").alias(key), F.explode("grams").alias("g")).join(rarity, "g")
        sets = long.groupBy(key).agg(F.sort_array(F.collect_list("rank")).alias(f"ranks_{tag}"))
        size = F.size(f"ranks_{tag}")
        return sets.select(key, f"ranks_{tag}", size.alias(f"n_{tag}"), F.posexplode(F.slice(f"ranks_{tag}", F.lit(1), size - F.ceil(size * similarity - 1e-9).cast("int") + 1)).alias(f"at_{tag}", "rank"))

    hot = rarity.filter(F.col("n") > GRAM_BLOCK).select("rank", F.ceil(F.col("n") / F.lit(GRAM_BLOCK)).cast("int").alias("parts"))
    a, b = prefixes(left, "form", "a"), prefixes(right, "entry_form", "b")
    a, b = (x.join(hot, "rank", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for x in (a, b))
    a = a.withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int")).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * F.lit(similarity / (1 + similarity)) - 1e-9)
    within = (F.col("n_a") >= F.col("n_b") * similarity) & (F.col("n_b") >= F.col("n_a") * similarity)
    reach = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1) >= need
    # of ordered sets the first common member is the rarest: there the pair comes out
    common = F.array_intersect("ranks_a", "ranks_b")
    alike = F.size(common) * F.lit(1 + similarity) >= F.lit(similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = a.join(b, ["rank", "part"]).filter(within & reach).filter(alike).filter(F.get(common, F.lit(0)) == F.col("rank"))
    pairs = pairs.select("form", "entry_form", "n_a", "n_b", F.size(common).alias("common"))
    return pairs.select("form", "entry_form", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"))


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """``(form, entry_form, jaccard, edits)`` of the pairs that differ in at most 3 letters and a
    quarter of the longer form; ``edits`` is ``distance``: one more than allowed if there are more,
    so that an entry too far to be meant may still show that a long value is not clear."""
    longest = F.greatest(F.length("form"), F.length("entry_form"))
    most = 3 + longest / 4
    edits = F.when(longest <= 36, F.levenshtein("form", "entry_form", 12)).otherwise(F.levenshtein("form", "entry_form"))
    near = pairs.filter((edits >= 0) & (edits <= most))
    near = near.withColumn("edits", _plain_distance(F.col("form"), F.col("entry_form")).cast("double")).withColumn("most", (_allowed(F.col("entry_form")) + 1).cast("double"))

    def count_swaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edits = [m if e != e else min(m, e if e <= 1 or not _swaps(f, x) and not _swaps(flattened(f), flattened(x)) else distance(f, x)) for f, x, e, m in zip(b["form"], b["entry_form"], b["edits"], b["most"], strict=True)]
            yield b[["form", "entry_form", "jaccard"]].assign(edits=edits)

    return near.mapInPandas(count_swaps, "form string, entry_form string, jaccard double, edits double")


def match_catalog(values: DataFrame, entries: DataFrame, id_col: str = "id", value_col: str = "keyword", entry_id: str = "term_id", entry_col: str = "term", similarity: float = SIMILARITY) -> DataFrame:
    """``(keyword_id, term_id)`` for every id with a value that is no entry itself."""
    text = F.regexp_replace(F.col(value_col), r"[\s\p{Z}\p{Cf}]+", "")
    wanted = values.filter(F.col(id_col).isNotNull() & (F.length(text) > 0)).groupBy(F.col(id_col).alias("keyword_id")).agg(F.max(value_col).alias("value"))
    entries = entries.filter(F.col(entry_col).isNotNull()).groupBy(F.col(entry_col).alias("entry")).agg(F.min(entry_id).cast("long").alias("term_id"))
    wanted = staged(wanted.join(entries.select(F.col("entry").alias("value")), "value", "left_anti"), "values")

    def forms(batches: Iterator[pd.DataFrame], all_readings: bool) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, f, v.rstrip().endswith((".", "…")), trigrams(f)) for v in b["value"] for f in (readings(v) if all_readings else [normal_form(v)]) if f]
            yield pd.DataFrame(rows, columns=["value", "form", "cut", "grams"])

    schema = "value string, form string, cut boolean, grams array<string>"
    asked = staged(wanted.select("value").distinct().mapInPandas(lambda it: forms(it, True), schema), "forms")
    listed = staged(entries.select("entry", "term_id").join(entries.select(F.col("entry").alias("value")).mapInPandas(lambda it: forms(it, False), schema), F.col("entry") == F.col("value")).select("form", "grams", "term_id"), "entries")
    known = listed.groupBy("form").agg(F.min("term_id").alias("term_id"), F.first("grams").alias("grams"))

    different = asked.groupBy("form").agg(F.first("grams").alias("grams"), F.max("cut").alias("cut"))
    scored = scored_pairs(similar_forms(different.select("form", "grams"), known.select("form", "grams"), similarity))
    by_edits = scored.groupBy("form", "edits").agg(F.min(F.struct((-F.col("jaccard")).alias("order"), "entry_form")).alias("m"), F.count(F.lit(1)).alias("as_near"))
    best = by_edits.groupBy("form").agg(F.min(F.struct("edits", "m.order", "m.entry_form", "as_near")).alias("b")).select("form", "b.*")
    best = staged(best.filter((F.col("as_near") == 1) & (F.col("edits") <= _allowed(F.col("entry_form")) + F.when(F.col("edits") % 1 > 0, 0.5).otherwise(0.0))), "best")

    # compounds of known parts that are no entry
    first, last = compound_parts(known.select("form"), "form")
    stem = best.filter("edits > 0").select("form", "entry_form", F.explode(_stems(F.col("form"))).alias("stem"))
    inflected = stem.filter("stem = entry_form").select("form")
    cuts = stem.filter(F.length("stem") >= 6).select("form", "stem", F.explode(F.sequence(F.lit(3), F.length("stem") - 3)).alias("at"))
    cuts = cuts.select("form", F.substring("stem", F.lit(1), F.col("at")).alias("first"), F.substring("stem", F.col("at") + 1, F.length("stem")).alias("last"))
    made = cuts.join(first.withColumnRenamed("part", "first"), "first", "left_semi").join(last.withColumnRenamed("part", "last"), "last", "left_semi").select("form").distinct().join(inflected, "form", "left_anti")
    closest = best.join(made, "form", "left_anti").select("form", "entry_form", "edits", "order")

    # abbreviated values: the only entry with this beginning
    begun = known.select(F.col("form").alias("entry_form"), F.explode(F.sequence(F.lit(BEGINNING_LETTERS), F.greatest(F.length("form"), F.lit(BEGINNING_LETTERS)))).alias("n"))
    begun = begun.filter((F.length("entry_form") > F.col("n")) & (F.col("n") >= BEGINNING * F.length("entry_form"))).groupBy(F.substring("entry_form", F.lit(1), F.col("n")).alias("form")).agg(F.min("entry_form").alias("entry_form"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    abbreviated = asked.filter("cut").select("value", "form").join(begun.select("form", "entry_form"), "form").select("value", "entry_form", F.lit(0.25).alias("edits"), F.lit(0.0).alias("order"))

    decided = asked.select("value", "form").join(closest, "form").select("value", "entry_form", "edits", "order").unionByName(abbreviated)
    chosen = decided.groupBy("value").agg(F.min(F.struct("edits", "order", "entry_form")).alias("best")).select("value", F.col("best.entry_form").alias("form"))
    mapped = chosen.join(known.select("form", "term_id"), "form").select("value", "term_id")
    return wanted.join(mapped, "value", "left").select("keyword_id", F.coalesce("term_id", F.lit(NO_ENTRY).cast("long")).alias("term_id"))
