"""Postal address records that denote the same place.

Every record is parsed to street, house number with suffix, town and postcode. Towns are settled
by postcode (each belongs to the town most of its records name) and by deletion neighbourhoods of
frequent town names; streets likewise by frequency. Each different address is then expanded into
its plausible forms - the street as it is and with any one letter left out -, every form is hashed
with town and house number, and addresses that share any hash are joined; different numbers or
suffixes never share one. A place is a connected component of that join, so that a chain of
spellings stays together. Records of equal parsed addresses are grouped before any expansion.

Records without a house number, street, or both town and postcode denote no place. Repeated rows
of one id count once (the greatest row).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.catalog_match import flattened
from quarrymill.llm.lookalikes import fold_lookalikes
from quarrymill.tables import staged

# Street types with their abbreviations, words before a street name, before a town
# and before a house number.
STREET_TYPES = {
    "strasse": "strasse", "str": "strasse", "weg": "weg", "platz": "platz", "pl": "platz", "allee": "allee", "all": "allee", "gasse": "gasse", "g": "g", "ufer": "ufer", "damm": "damm", "ring": "ring",
    "chaussee": "chaussee", "ch": "chaussee", "pfad": "pfad", "steig": "steig", "promenade": "promenade", "prom": "promenade", "markt": "markt", "zeile": "zeile", "stieg": "stieg", "bogen": "bogen", "kai": "kai",
    "street": "street", "st": "street", "road": "road", "rd": "road", "lane": "lane", "ln": "lane", "avenue": "avenue", "av": "avenue", "ave": "avenue", "rue": "rue",
}
LEADS = r"(?:am|an der|an den|an dem|im|in der|in den|zum|zur|auf dem|auf der|unter den|unter der|hinter der|hinter dem|vor dem|vor der|bei der|beim|alte[rs]?|neue[rs]?)"
PLACE_WORDS = r"(?:ot|ortsteil|stadt|gemeinde|ort|bezirk|markt|kreisstadt|hansestadt|landkreis)"
NUMBER_WORDS = r"(?:haus(?:nummer|nr)?|nummer|nr|no|hnr|#)\.?"

_POSTCODE = regex.compile(r"(?<![\p{L}\d])(?:D\s*[-–]?\s*|DE\s*[-–]\s*)?(\d{5})(?!\d)", regex.I)
_NUMBER = regex.compile(rf"(?:(?<![\p{{L}}]){NUMBER_WORDS}\s*)?(?<![\d])(\d{{1,4}})(?!\d)\s*(?:([a-z])(?![\p{{L}}]))?(?:\s*(?:-|–|—|‐|‑|/|bis|\+|u\.|und)\s*(\d{{1,4}})(?!\d)\s*(?:([a-z])(?![\p{{L}}]))?|\s*[-–/]\s*([a-z])(?![\p{{L}}]))?", regex.I)
_TYPE_END = regex.compile(r"(?:strasse|str|weg|platz|pl|allee|all|gasse|ufer|damm|ring|chaussee|pfad|steig|promenade|zeile|street|road|lane|rd|avenue)\.?$")
_LEAD = regex.compile(rf"^{LEADS}\s")
_BLANKS, _NO_WORD, _NO_LETTER, _HAS_LETTER = (regex.compile(x) for x in (r"[^\S\n]+", r"[^\p{L}\p{N}]+", r"[^\p{L}]+", r"\p{L}"))
_DOT_END, _SHORT_TYPE = regex.compile(r"\.\s*$"), regex.compile(r"(pl|all)$")
_PLACE_WORDS = regex.compile(rf"^(?:{PLACE_WORDS}\.?\s+)+")
_SEGMENTS = regex.compile(r"[,;()\n|]|\s[-–—]\s(?!\d)|(?<!\d)\s[-–—]\s")
_AROUND = regex.compile(r"^[\x01\s.:\-–—]+|[\s:\-–—]+$")


#: Equal spellings are normalised once; this many are remembered per worker and function.
REMEMBERED = 50_000
#: A town two letters off must be so much rarer than the one it is taken for.
FAR_RATIO = 50
#: Street forms of at least so many letters met at most so often may be spoilt forms of one name.
TWIN_LETTERS, RARE = 10, 2
#: Records of one place are paired in blocks of about this many.
PAIR_BLOCK = 1_000


@lru_cache(REMEMBERED)
def plain(s: str) -> str:
    """Lower case, lookalikes and widths folded, umlauts written out, one blank at a time."""
    s = fold_lookalikes(unicodedata.normalize("NFKC", s)).lower()
    s = s.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss").replace("­", "").replace("​", "")
    return _BLANKS.sub(" ", s).strip()


@lru_cache(REMEMBERED)
def street_form(s: str) -> str:
    """Street without blanks, dots and hyphens, its type in one spelling."""
    words = flattened(_NO_WORD.sub(" ", plain(s))).split()
    if not words:
        return ""
    if words[-1] in STREET_TYPES:
        words[-1] = STREET_TYPES[words[-1]]
    joined = "".join(words)
    for end in ("strasse", "str"):
        if joined.endswith(end) and len(joined) > len(end):
            return joined[: -len(end)] + "strasse"
    if _DOT_END.search(s) and (m := _SHORT_TYPE.search(joined)):
        return joined[: -len(m[1])] + STREET_TYPES[m[1]]
    return joined


@lru_cache(REMEMBERED)
def town_form(s: str) -> str:
    return flattened(_NO_LETTER.sub("", _PLACE_WORDS.sub("", plain(s))))


def house_number(m: regex.Match) -> tuple[str, str]:
    """Number or range, and suffix, of a match."""
    first, suffix, last, last_suffix, suffix_to = m.groups()
    number = str(int(first))
    if last and int(last) != int(first):
        return f"{number}{(suffix or '').lower()}-{int(last)}", (last_suffix or "").lower()
    if suffix_to:
        return number, f"{(suffix or '').lower()}-{suffix_to.lower()}"
    return number, (suffix or last_suffix or "").lower()


def _is_street(segment: str) -> bool:
    return bool(_LEAD.match(segment)) or bool(_TYPE_END.search(segment.rstrip(" .") + ("." if segment.endswith(".") else "")))


def parse_text(text: str) -> tuple[str, str, str, str, str]:
    """Street, number, suffix, town and postcode of one written address, each '' if missing."""
    s = plain(text.replace("\r", "\n"))
    postcode = town = street = number = suffix = ""
    after_code = False
    if m := _POSTCODE.search(s):
        postcode = m[1]
        s = s[: m.start()] + "\n\x01" + s[m.end() :]
    words: list[tuple[str, bool]] = []
    for seg in _SEGMENTS.split(s):
        after_code = seg.startswith("\x01")
        seg = _AROUND.sub("", seg)
        if not seg:
            continue
        m = None
        for m in _NUMBER.finditer(seg):
            if not number:
                break
            m = None
        if m is None:
            words.append((seg, after_code))
            continue
        number, suffix = house_number(m)
        before, after = seg[: m.start()].strip(" -–.:") if seg[: m.start()].strip()[-1:] != "." else seg[: m.start()].strip(), seg[m.end() :].strip(" -–:")
        if before and not _HAS_LETTER.search(before):
            before = ""
        if before and after:
            street = street or before
            words.append((after, False))
        elif before:
            street = street or before
        elif after:
            street = street or after
        # a number alone belongs to the street beside it
    for seg, coded in words:
        if not _HAS_LETTER.search(seg):
            continue
        if not street and _is_street(seg) and not (coded and any(_is_street(w) for w, _ in words if w != seg)):
            street = seg
        elif not town and (coded or street != seg):
            town = seg
    if not street and number and len([w for w, _ in words if _HAS_LETTER.search(w)]) == 2:
        street = next(w for w, _ in words if w != town and _HAS_LETTER.search(w))
    return street_form(street), number, suffix, town_form(town), postcode


def parse_fields(strnam: str | None, hausnr: str | None, hausnrz: str | None, bez_name: str | None, plz: str | None) -> tuple[str, str, str, str, str]:
    number = suffix = ""
    if hausnr and (m := _NUMBER.search(plain(hausnr))):
        number, suffix = house_number(m)
    if hausnrz and hausnrz.strip():
        suffix = regex.sub(r"[^\p{L}\p{N}-]", "", plain(hausnrz)) or suffix
    code = _POSTCODE.search(plz or "")
    return street_form(strnam or ""), number, suffix, town_form(bez_name or ""), code[1] if code else ""


def variants(c: Column) -> Column:
    """The string and the string without any one letter, each once."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), without))


def _expanded(df: DataFrame, keys: list[str], form: str, letters: int = 1) -> DataFrame:
    """One row per form of ``form`` with up to so many letters left out: the hash of the keys with it."""
    wide = df.filter(F.length(form) > 0).select(*keys, form, "n", F.explode(variants(F.col(form))).alias("variant"))
    for _ in range(letters - 1):
        wide = wide.select(*keys, form, "n", F.explode(variants(F.col("variant"))).alias("variant")).distinct()
    return wide.select(*keys, form, "n", F.xxhash64(*keys, "variant").alias("hash"))


def _close(a, b):  # noqa: ANN001
    return F.levenshtein(F.col(a), F.col(b), 2).between(1, 2)


def frequent_forms(df: DataFrame, form: str, ratio: int, letters: int = 1) -> DataFrame:
    """``(form, better)``: forms one or two letters away from one ``ratio`` times as frequent, or
    from one that is itself so corrected: the most frequent at the end of the chain is taken. Words
    of under five letters stay. ``letters``: how many may have to be left out of either form."""
    wide = staged(_expanded(df.filter(F.length(form) >= 5), [], form, letters), "variants")
    # per hash only the most frequent form can correct the others
    top = wide.groupBy("hash").agg(F.max(F.struct("n", form)).alias("top"))
    found = wide.join(top.select("hash", F.col("top.n").alias("top_n"), F.col(f"top.{form}").alias("top_form")), "hash")
    found = found.filter((F.col("top_form") != F.col(form)) & (F.col("top_n") >= F.col("n") * ratio) & _close(form, "top_form"))
    better = staged(found.groupBy(form).agg(F.max(F.struct("top_n", "top_form")).alias("best")).select(form, F.col("best.top_form").alias("better")), "better")
    # every step multiplies the frequency, so chains end soon
    while True:
        onward = better.select(F.col(form).alias("better"), F.col("better").alias("further"))
        if better.join(onward.select("better"), "better", "left_semi").isEmpty():
            return better
        better = staged(better.join(onward, "better", "left").select(form, F.coalesce("further", "better").alias("better")), "better")


def _weight(here: Column, everywhere: Column) -> Column:
    """Number of records with a form under its keys, then everywhere, as one number."""
    return F.shiftleft(here, 32) + F.least(everywhere, F.lit((1 << 32) - 1))


def _everywhere(weight: Column) -> Column:
    return weight.bitwiseAND(F.lit((1 << 32) - 1))


def rare_twins(different: DataFrame, keys: list[str], form: str) -> DataFrame:
    """``(keys, form, n, hash)``: pairs of rare forms under the same keys, both spoilt, that are two
    letters apart and so share no hash; each pair gets one. They meet by their first or last letters.
    A form is rare if all records hold it at most ``RARE`` times: two real names are not taken for
    one."""
    rare = different.filter((_everywhere(F.col("n")) <= RARE) & (F.length(form) >= TWIN_LETTERS))
    ends = F.array(F.concat(F.lit("<"), F.substring(form, 1, 4)), F.concat(F.substring(form, -8, 8), F.lit(">")))
    keyed = staged(rare.select(*keys, form, "n", F.explode(ends).alias("end")), "rare")
    other = keyed.select(*keys, "end", F.col(form).alias("other"), F.col("n").alias("other_n"))
    pairs = keyed.join(other, [*keys, "end"]).filter((F.col(form) < F.col("other")) & _close(form, "other")).dropDuplicates([*keys, form, "other"])
    hash_ = F.xxhash64(*keys, form, "other", F.lit("pair"))
    both = F.explode(F.array(F.struct(F.col(form).alias("f"), F.col("n").alias("m")), F.struct(F.col("other").alias("f"), F.col("other_n").alias("m"))))
    return pairs.select(*keys, both.alias("x"), hash_.alias("hash")).select(*keys, F.col("x.f").alias(form), F.col("x.m").alias("n"), "hash")


def joined_spellings(different: DataFrame, keys: list[str], form: str) -> DataFrame:
    """``(keys, form, better)`` of forms that share a hash with others under the same keys: the form
    with the greatest ``n`` of the connected component. A form that is alone gives no row.

    Only hashes of several forms are kept; the greatest form then passes from hash to form and back
    until nothing changes. A form that more than ``RARE`` records hold keeps its own name, so that two
    real names a letter apart stay apart. No group is gathered: both ways are aggregates."""
    wide = _expanded(different, keys, form)
    shared = wide.groupBy("hash").agg(F.min(form).alias("a"), F.max(form).alias("b")).filter("a <> b").select("hash")
    links = staged(wide.join(shared, "hash", "left_semi").unionByName(rare_twins(different, keys, form)), "links")
    # names that many records hold are names of their own: they give their label and take none
    rare = _everywhere(F.col("n")) <= RARE
    labels = links.select(*keys, form, F.struct("n", form).alias("label"), rare.alias("takes")).distinct()
    while True:
        labels = staged(labels, "labels")
        by_hash = links.join(labels, [*keys, form]).groupBy("hash").agg(F.max("label").alias("label"))
        best = links.join(by_hash, "hash").groupBy(*keys, form).agg(F.max("label").alias("best"))
        passed = staged(labels.join(best, [*keys, form]).select(*keys, form, F.when(F.col("takes"), F.col("best")).otherwise(F.col("label")).alias("label"), "takes", (F.col("takes") & (F.col("best") != F.col("label"))).alias("changed")), "passed")
        if passed.filter("changed").isEmpty():
            return labels.select(*keys, form, F.col(f"label.{form}").alias("better"))
        labels = passed.drop("changed")


def addressed(df: DataFrame) -> DataFrame:
    """``(address_id, town, number, suffix, street)``, towns and streets settled."""
    cols = ["strnam", "hausnr", "hausnrz", "bez_name", "plz", "entity_text"]
    records = df.filter(F.col("address_id").isNotNull()).groupBy("address_id").agg(F.max(F.struct(*[F.col(c).cast("string").alias(c) for c in cols])).alias("r")).select("address_id", "r.*")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = lambda v: v if isinstance(v, str) else None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                text = r.entity_text if isinstance(r.entity_text, str) else ""
                parsed = parse_text(text) if text.strip() else parse_fields(*map(field, (r.strnam, r.hausnr, r.hausnrz, r.bez_name, r.plz)))
                rows.append((r.address_id, *parsed))
            yield pd.DataFrame(rows, columns=["address_id", "street", "number", "suffix", "town", "plz"])

    parsed = staged(records.mapInPandas(parse, "address_id long, street string, number string, suffix string, town string, plz string"), "parsed")
    parsed = parsed.filter((F.col("street") != "") & (F.col("number") != "") & ((F.col("town") != "") | (F.col("plz") != "")))

    # towns: spelling by frequency, then the main town of each postcode
    towns = parsed.filter("town <> ''").groupBy("town").agg(F.count(F.lit(1)).alias("n"))
    spelt = parsed
    for ratio, letters in ((3, 1), (FAR_RATIO, 2)):
        better = frequent_forms(towns, "town", ratio, letters)
        spelt = spelt.join(better, "town", "left").withColumn("town", F.coalesce("better", "town")).drop("better")
    by_code = spelt.filter("town <> '' AND plz <> ''").groupBy("plz", "town").agg(F.count(F.lit(1)).alias("n")).groupBy("plz").agg(F.max(F.struct("n", "town")).alias("m")).select("plz", F.col("m.town").alias("main"))
    settled = spelt.join(by_code, "plz", "left")
    settled = settled.withColumn("town", F.when(F.col("town") == "", F.coalesce("main", F.concat(F.lit("#"), "plz"))).when(F.levenshtein("town", "main", 3) >= 0, F.col("main")).otherwise(F.col("town")))

    # streets: spelling by frequency over all towns, then within one town and house number
    settled = staged(settled.select("address_id", "street", "number", "suffix", "town"), "settled")
    better = frequent_forms(settled.groupBy("street").agg(F.count(F.lit(1)).alias("n")), "street", 4)
    fixed = staged(settled.join(better, "street", "left").withColumn("street", F.coalesce("better", "street")).drop("better"), "fixed")
    keys = ["town", "number", "suffix"]
    # the address written most often in its house, then the street known best, names the place
    known = fixed.groupBy("street").agg(F.count(F.lit(1)).alias("all"))
    different = fixed.groupBy(*keys, "street").agg(F.count(F.lit(1)).alias("here")).join(known, "street")
    different = staged(different.select(*keys, "street", _weight(F.col("here"), F.col("all")).alias("n")), "different")
    better = joined_spellings(different, keys, "street")
    return fixed.join(better, [*keys, "street"], "left").select("address_id", *keys, F.coalesce("better", "street").alias("street"))


def _sized_places(df: DataFrame) -> DataFrame:
    """``(address_id, place, n)``, ``n`` being the number of the place's records."""
    keys = ["town", "number", "suffix", "street"]
    found = staged(addressed(df), "addressed")
    named = found.groupBy(*keys).agg(F.min("address_id").alias("place"), F.count(F.lit(1)).alias("n"))
    return found.join(named, keys).select("address_id", "place", "n")


def places(df: DataFrame) -> DataFrame:
    """``(address_id, place)``: the place is the smallest id of its records; records that denote
    none are left out. This is the form for places of very many records."""
    return _sized_places(df).select("address_id", "place")


def same_place(df: DataFrame) -> DataFrame:
    """``(address_id_a, address_id_b)``, a < b: two records of the same place. The records of a
    place are paired in blocks, so that no task has a whole large place."""
    found = staged(_sized_places(df).filter("n > 1"), "places")
    blocks = F.ceil(F.col("n") / F.lit(PAIR_BLOCK)).cast("int")
    own = found.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("address_id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = own.select("place", F.col("address_id").alias("address_id_a"), F.col("own").alias("i"), others.alias("j"))
    b = own.select("place", F.col("address_id").alias("address_id_b"), F.col("own").alias("j"), others.alias("i"))
    return a.join(b, ["place", "i", "j"]).filter("address_id_a < address_id_b").select("address_id_a", "address_id_b")
