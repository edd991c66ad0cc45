"""Places and street addresses in texts, and their validation against gazetteer and register."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators.proximity import great_circle_m, near_points
from quarrymill.tables import staged

# Pattern of written addresses (repetitions possessive, which matches the same) and
# the default origin.
ADDRESS = r"(?:[A-Z][ a-zäüöß-]++)++(?:\. | |\.|)\d{1,3}[a-zA-Z\-/]{0,2}\d{0,3}[a-zA-Z]?"
# The same with a number that may be missing: runs of words are passed over once, not from each of their capitals.
_RUNS = r"(?:[A-Z][ a-zäüöß-]++)++(?:(?:\. | |\.|)\d{1,3}[a-zA-Z\-/]{0,2}\d{0,3}[a-zA-Z]?)?+"
ORIGIN = (52.530644, 13.383068)
#: Numbers of first letters by which names meet the texts that may contain them: a name takes the
#: greatest that it has.
KEY_LETTERS = (1, 2, 3, 5, 8, 12, 20)
#: Different first letters of names up to which only tails that begin with one of them are asked.
MOST_LETTERS = 5_000
#: Different beginnings of prefixes that are broadcast; if there are more, shorter ones are taken.
MOST_STARTS = 100_000
MAX_DISTANCE_M, MAX_STREETS, MAX_SECTIONS, MIN_LENGTH = 12_500.0, 10, 2, 5


def pattern_entities(documents: DataFrame, pattern: str = ADDRESS) -> DataFrame:
    """``(doc_id, entity)``: all different matches, street abbreviations written out."""
    runs = F.regexp_extract_all("text", F.lit(_RUNS if pattern == ADDRESS else pattern), F.lit(0))
    found = documents.filter(F.col("text").isNotNull()).select("doc_id", F.explode(runs).alias("entity"))
    if pattern == ADDRESS:
        found = found.filter(F.col("entity").rlike("[0-9]"))
    return found.select("doc_id", T.expand_street(F.col("entity")).alias("entity")).distinct()


def capitalised_entities(tokens: DataFrame, min_words: int = 2) -> DataFrame:
    """``(doc_id, entity)``: runs of capitalised tokens of a sentence, the default recogniser."""
    order = Window.partitionBy("doc_id", "sent_id").orderBy("pos")
    breaks = F.sum(F.when(F.col("term").rlike(r"^\p{Lu}\p{L}"), 0).otherwise(1)).over(order)
    runs = tokens.withColumn("run", breaks).filter(F.col("term").rlike(r"^\p{Lu}\p{L}"))
    grouped = runs.groupBy("doc_id", "sent_id", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return grouped.filter(F.size("t") >= min_words).select("doc_id", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("entity")).distinct()


def entities(documents: DataFrame, recognised: DataFrame | None = None, pattern: str = ADDRESS) -> DataFrame:
    """Entities by pattern and by a recogniser, each once."""
    by_pattern = pattern_entities(documents, pattern)
    return by_pattern if recognised is None else by_pattern.unionByName(recognised.select("doc_id", "entity")).distinct()


def address_candidates(found: DataFrame) -> DataFrame:
    """``(doc_id, entity, name, number, suffix)``: one row per house number an entity stands for;
    entities without digits or with four digits in a row are none. ``doc_id`` may be missing."""
    own = [c for c in ("doc_id", "entity") if c in found.columns]
    able = found.filter(F.col("entity").rlike(r"\p{Nd}") & ~F.col("entity").rlike(r"\p{Nd}{4,}"))
    split = able.select(*own, T.name_part(F.col("entity")).alias("name"), F.explode(T.house_numbers(T.number_part(F.col("entity")))).alias("h"))
    return split.select(*own, "name", F.col("h.number").alias("number"), F.col("h.suffix").alias("suffix"))


def name_tails(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(entity, tail)``: the part of each entity from where a known name is first met in it, at any
    letter. Names meet the places of entities by a hash of their first letters (``KEY_LETTERS``), so
    there is no nested loop; the whole name is compared where they meet. Null and empty names are
    contained in nothing."""
    known = staged(names.select(F.col(names.columns[0]).alias("name")).filter(F.length("name") > 0).distinct(), "names")
    letters = [r[0] for r in known.select(F.substring("name", 1, 1)).distinct().limit(MOST_LETTERS + 1).collect()]
    size = F.greatest(*[F.when(F.length("name") >= n, n).otherwise(0) for n in KEY_LETTERS])
    known = known.select("name", F.xxhash64(F.substring(F.col("name"), F.lit(1), size)).alias("key"))
    at = F.sequence(F.lit(1), F.length("entity"))
    if len(letters) <= MOST_LETTERS:
        at = F.filter(at, lambda i: F.substring(F.col("entity"), i, F.lit(1)).isin(letters))
    places = texts.select("entity").filter(F.length("entity") > 0).distinct().select("entity", F.explode(at).alias("at"))
    keys = F.array_distinct(F.array(*[F.xxhash64(F.substring(F.col("entity"), F.col("at"), F.lit(n))) for n in KEY_LETTERS]))
    met = places.withColumn("key", F.explode(keys)).join(known, "key").filter(F.expr("locate(name, entity)") == F.col("at"))
    return met.select("entity", F.substring(F.col("entity"), F.col("at"), F.length("entity")).alias("tail")).distinct()


def containing_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """``(doc_id, entity)``: the tails of each document's entities (``name_tails``). Equal entities of
    many documents are searched once."""
    tails = name_tails(found, names)
    return found.select("doc_id", "entity").join(tails, "entity").select("doc_id", F.col("tail").alias("entity")).distinct()


def like_join(left: DataFrame, pattern: str, right: DataFrame, value: str) -> DataFrame:
    """Rows of both sides where ``value`` is like ``pattern`` without regard to case, ``%`` and ``_``
    being wildcards. Patterns without wildcards are joined by equality; others, if there are any, meet
    values by up to three letters of their first literal part and are compared there."""
    wild = F.col(pattern).rlike(r"[%_]")
    plain_only = left.filter(wild).isEmpty()
    plain = left.filter(~wild).withColumn("_key", F.lower(pattern)).join(right.withColumn("_key", F.lower(value)), "_key").drop("_key")
    if plain_only:
        return plain
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.array(*[F.substring(F.lower(value), i, F.lit(n)) for n in (1, 2, 3)]))
    keyed = right.withColumn("_key", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct(F.flatten(grams)))))
    asked = left.filter(wild).withColumn("_key", F.lower(F.regexp_extract(pattern, r"([^%_]{1,3})", 1)))
    return plain.unionByName(asked.join(keyed, "_key").filter(F.ilike(F.col(value), F.col(pattern))).drop("_key"))


def match_register(candidates: DataFrame, register: DataFrame) -> DataFrame:
    """``candidates`` with ``section`` and ``feature_id`` of the register rows they may denote, each
    once: the street name like the candidate's; the house number equal, unless it is 0, which stands
    for the whole street; the suffix like the candidate's, if that has one - without a suffix any
    will do; the section like the candidate's ``bez_name``, where there is such a column and it is
    not blank. Case is ignored. Register rows without street or number are matched by none."""
    rows = register.filter(F.col("strnam").isNotNull()).select("strnam", F.trim("hausnr").alias("hausnr"), F.coalesce(F.trim("hausnrz"), F.lit("")).alias("hausnrz"), "feature_id", F.col("bez_name").alias("section")).distinct()
    asked = candidates.filter(F.col("name").isNotNull())
    any_number, any_suffix = F.col("number") == 0, F.coalesce(F.col("suffix"), F.lit("")) == ""
    numbered = asked.filter(~any_number).withColumn("_number", F.col("number").cast("string"))
    # street and number in one join; only whole streets are joined by the name alone
    by_number = like_join(numbered.withColumn("_pattern", F.concat("name", F.lit("\x01"), "_number")), "_pattern", rows.filter(F.col("hausnr").isNotNull()).withColumn("_value", F.concat("strnam", F.lit("\x01"), "hausnr")), "_value")
    by_number = by_number.filter(any_suffix | F.ilike(F.col("hausnrz"), F.col("suffix"))).drop("_number", "_pattern", "_value")
    met = by_number.unionByName(like_join(asked.filter(any_number), "name", rows, "strnam"))
    if "bez_name" in candidates.columns:
        met = met.filter((F.coalesce(F.trim("bez_name"), F.lit("")) == "") | F.ilike(F.col("section"), F.col("bez_name")))
    return met.select(*candidates.columns, "section", "feature_id").distinct()


def street_sections(register: DataFrame) -> DataFrame:
    """``(strnam, n_addresses, sections)``: different addresses and sorted sections of each street."""
    named = register.filter(F.col("strnam").isNotNull())
    return named.groupBy("strnam").agg(F.count_distinct("feature_id").alias("n_addresses"), F.sort_array(F.collect_set("bez_name")).alias("sections"))


def validate_addresses(found: DataFrame, register: DataFrame, max_streets: int = MAX_STREETS, max_sections: int = MAX_SECTIONS) -> DataFrame:
    """``(doc_id, entity, name, number, suffix, section, feature_id)`` of the register rows that an
    entity denotes, read from where a street or section name begins in it: candidates with at most
    ``max_streets`` addresses; those of their sections that are entities of the document, or the
    only one; at most ``max_sections`` of them. Rows without a section are none."""
    key = ["entity", "name", "number", "suffix"]
    known = register.select(F.col("strnam").alias("name")).unionByName(register.select(F.col("bez_name").alias("name")))
    # what an entity may denote does not depend on the document: it is asked once for equal entities
    texts = found.select("entity").distinct()
    tails = staged(name_tails(texts, known), "tails")
    candidates = staged(address_candidates(tails.select(F.col("tail").alias("entity")).distinct()), "candidates")
    met = staged(match_register(candidates, register).filter(F.col("section").isNotNull()), "register")
    guarded = met.groupBy(*key).agg(F.count_distinct("feature_id").alias("n"), F.count_distinct("section").alias("n_sections")).filter(F.col("n").between(1, max_streets))
    able = met.join(guarded, key).join(texts.select(F.col("entity").alias("section"), F.lit(True).alias("named")), "section", "left")
    able = staged(able.filter((F.col("n_sections") == 1) & F.lit(max_sections >= 1) | F.col("named") & (F.col("n_sections") > 1)), "able")
    answered = staged(tails.join(able.select(F.col("entity").alias("tail")).distinct(), "tail", "left_semi"), "answered")
    places = found.select("doc_id", "entity").join(answered, "entity").select("doc_id", F.col("tail").alias("entity")).distinct()
    cols = ["doc_id", *key, "section", "feature_id"]
    one, several = places.join(able.filter("n_sections = 1"), "entity").select(*cols), able.filter("n_sections > 1")
    if several.isEmpty():
        return one
    named = found.select("doc_id", F.col("entity").alias("section")).distinct()
    chosen = places.join(several, "entity").join(named, ["doc_id", "section"], "left_semi")
    few = chosen.groupBy("doc_id", *key).agg(F.count_distinct("section").alias("n_chosen")).filter(F.col("n_chosen") <= max_sections)
    return one.unionByName(chosen.join(few, ["doc_id", *key], "left_semi").select(*cols))


def _able_words(min_length: int) -> Column:
    """Words of ``entity`` without digits, none where even all of them are not longer than the minimum."""
    words = F.filter(F.split("entity", " "), lambda w: ~w.rlike(r"\p{Nd}"))
    return F.when(F.length(F.array_join(words, " ")) > min_length, words)


def _able_prefixes(words: Column, min_length: int) -> Column:
    """"A", "A B", "A B C" of at least one word, longer than the minimum; each begins with the first of them."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    return F.filter(prefixes, lambda p: F.length(p) > min_length)


def _prefixes(found: DataFrame, min_length: int) -> DataFrame:
    """As ``entity_prefixes``, but those that several entities of a document have are repeated."""
    able = found.select("doc_id", _able_words(min_length).alias("words")).filter(F.col("words").isNotNull())
    return able.select("doc_id", F.explode(_able_prefixes(F.col("words"), min_length)).alias("prefix"))


def entity_prefixes(found: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(doc_id, prefix)``: "A", "A B", "A B C" of words without digits, longer than the minimum."""
    return _prefixes(found, min_length).distinct()


def gazetteer(locations: DataFrame) -> DataFrame:
    """Different gazetteer rows with synonyms as array (plain comma-separated lists)."""
    return locations.dropDuplicates(["id"]).withColumn("synonyms", F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != ""))


def validate_locations(found: DataFrame, places: DataFrame, in_synonyms: bool = False, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(doc_id, prefix, id)``: prefixes of entities that name a gazetteer entry, or with
    ``in_synonyms`` are contained in its ``synonyms`` (a string, or an array of them), case ignored."""
    names = places.select(F.lower("name").alias("key"), "id")
    # not to be broadcast: Spark takes prefixes for as few as their entities, since it does not count what explode adds
    named = _prefixes(found, min_length).hint("merge").join(names, F.lower("prefix") == F.col("key")).select("doc_id", "prefix", "id")
    return (named.unionByName(_prefixes_in_synonyms(found, places, min_length)) if in_synonyms else named).distinct()


def _prefixes_in_synonyms(found: DataFrame, places: DataFrame, min_length: int) -> DataFrame:
    """``(doc_id, prefix, id)``, repeated where a prefix stands several times: prefixes of entities
    contained in ``synonyms``. All prefixes of an entity begin with its shortest one, so that alone is
    searched, and the others are compared where it meets. It meets the places of synonyms by a hash
    of its first letters, as names meet entities in ``name_tails``; only places are asked where some
    shortest prefix may begin, with the numbers of letters that such prefixes have."""
    sizes = [min_length + 1, *(n for n in KEY_LETTERS if n > min_length + 1)]
    words = found.select("doc_id", _able_words(min_length).alias("words")).filter(F.col("words").isNotNull())
    shortest = words.select("doc_id", "words", F.lower(_able_prefixes(F.col("words"), min_length)[0]).alias("prefix"))
    size = F.greatest(*[F.when(F.length("prefix") >= n, n).otherwise(sizes[0]) for n in sizes])
    asked = shortest.select("doc_id", F.array_join("words", " ").alias("entity"), "prefix", size.alias("size"))
    starts = asked.groupBy(F.substring("prefix", 1, sizes[0]).alias("start")).agg(F.collect_set("size").alias("sizes"), F.max(F.length(F.lower("entity"))).alias("most"))
    starts, letters = staged(starts, "starts"), sizes[0]
    first = lambda n: F.substring("start", 1, n)
    while letters and starts.select(first(letters)).distinct().limit(MOST_STARTS + 1).count() > MOST_STARTS:
        letters -= 1
    starts = starts.groupBy(first(letters).alias("start")).agg(F.array_distinct(F.flatten(F.collect_list("sizes"))).alias("sizes"), F.max("most").alias("most"))
    text = F.lower(F.array_join("synonyms", ",") if places.schema["synonyms"].dataType.typeName() == "array" else F.col("synonyms"))
    written = places.select("id", text.alias("text")).filter(F.length("text") >= sizes[0])
    at = written.select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text") - sizes[0] + 1)).alias("at"))
    at = at.withColumn("start", F.substring(F.col("text"), F.col("at"), F.lit(letters))).join(F.broadcast(starts), "start")
    at = at.select("id", F.substring(F.col("text"), F.col("at"), F.col("most")).alias("tail"), F.explode("sizes").alias("size")).filter(F.length("tail") >= F.col("size"))
    tails = at.select("id", "tail", F.xxhash64(F.substring(F.col("tail"), F.lit(1), F.col("size"))).alias("key"))
    asked = asked.select("doc_id", "entity", F.xxhash64(F.substring(F.col("prefix"), F.lit(1), F.col("size"))).alias("key"))
    # neither to be broadcast: of the tails, too, Spark does not count what explode adds
    met = asked.hint("merge").join(tails, "key").select("doc_id", "id", "tail", F.explode(_able_prefixes(F.split("entity", " "), min_length)).alias("prefix"))
    return met.filter(F.startswith("tail", F.lower("prefix"))).select("doc_id", "prefix", "id")


def distance_from(lat: Column, lon: Column, origin: tuple[float, float] = ORIGIN) -> Column:
    return great_circle_m(lat, lon, F.lit(origin[0]), F.lit(origin[1]))


def reference_distance(lat: Column, lon: Column, origin: tuple[float, float] = ORIGIN) -> Column:
    """Compatibility: coordinates converted to radians twice, kilometres."""
    twice = lambda d: F.radians(F.radians(d))
    a, b, o_a, o_b = twice(lat), twice(lon), twice(F.lit(origin[0])), twice(F.lit(origin[1]))
    h = F.pow(F.sin((a - o_a) / 2), 2) + F.cos(a) * F.cos(o_a) * F.pow(F.sin((b - o_b) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(h))


def locations_near(found: DataFrame, places: DataFrame, origin: tuple[float, float] = ORIGIN, max_distance_m: float = MAX_DISTANCE_M, min_length: int = MIN_LENGTH, in_synonyms: bool = True) -> DataFrame:
    """``(doc_id, word, id)``: words of entities that name a place, or one of its synonyms, within
    a distance of the origin. A bounding box cuts the gazetteer before any distance is computed."""
    reach = max_distance_m / 111_000.0
    # a degree of longitude is shortest at the end of the box that is nearer to a pole
    edge = math.cos(math.radians(min(90.0, abs(origin[0]) + reach)))
    wide = reach / edge if edge > 1e-9 else 360.0
    apart = F.abs(F.col("longitude") - F.lit(origin[1]))
    box = places.filter(F.col("latitude").between(origin[0] - reach, origin[0] + reach) & (F.least(apart, 360 - apart) <= wide))
    near = box.filter(distance_from(F.col("latitude"), F.col("longitude"), origin) <= max_distance_m)
    names = near.select(F.lower("name").alias("key"), "id")
    if in_synonyms:
        names = names.unionByName(near.select(F.explode(F.transform("synonyms", F.lower)).alias("key"), "id"))
    words = found.select("doc_id", F.explode(F.split("entity", " ")).alias("word")).filter(~F.col("word").rlike(r"\p{Nd}") & (F.length("word") > min_length)).distinct()
    return words.withColumn("key", F.lower("word")).join(names.distinct(), "key").select("doc_id", "word", "id").distinct()


def locations_near_origins(found: DataFrame, places: DataFrame, origins: DataFrame, max_distance_m: float = MAX_DISTANCE_M, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(doc_id, word, origin_id, id)``: words of entities that name a place within a distance of any
    of the origins ``(origin_id, latitude, longitude)``."""
    names = places.select("id", F.lower("name").alias("key")).distinct()
    words = found.select("doc_id", F.explode(F.split("entity", " ")).alias("word")).filter(~F.col("word").rlike(r"\p{Nd}") & (F.length("word") > min_length)).distinct()
    # only places that a word names are paired with origins; neither side repeats a row, nor does the result
    hits = staged(words.withColumn("key", F.lower("word")).join(names, "key").select("doc_id", "word", "id"), "hits")
    near = near_points(places.join(hits.select("id").distinct(), "id", "left_semi"), origins, max_distance_m)
    return hits.join(near, "id").select("doc_id", "word", "origin_id", "id")


def display_keys(addresses: DataFrame) -> DataFrame:
    """Adds ``keys``: the forms under which an address may stand in a text, in order of preference -
    with suffix, without, the street alone. A number 0 or null has no form of its own."""
    number, suffix = F.when(F.col("number") != 0, F.col("number").cast("string")), F.lower(F.nullif(F.col("suffix"), F.lit("")))
    forms = F.array(F.concat(F.col("name"), F.lit(" "), number, suffix), F.concat(F.col("name"), F.lit(" "), number), F.col("name"))
    return addresses.withColumn("keys", F.filter(forms, lambda k: k.isNotNull()))


def address_passages(addresses: DataFrame, passages: DataFrame) -> DataFrame:
    """``addresses`` with ``passages``: those of the first display key that has some, else none.
    ``passages`` is ``(doc_id, word, passages)``."""
    cols = addresses.columns
    keyed = display_keys(addresses).select(*cols, F.posexplode("keys").alias("at", "word"))
    met = keyed.join(passages.select("doc_id", "word", "passages"), ["doc_id", "word"], "left")
    return met.groupBy(*cols).agg(F.min_by("passages", F.when(F.col("passages").isNotNull(), F.col("at"))).alias("passages"))


def addresses_with_passages(addresses: DataFrame, documents: DataFrame, sentences: Callable[[Column], Column]) -> DataFrame:
    """Different ``addresses``, each with the ``passages`` of its first display key that has some, as
    ``address_passages`` gives them, taken from the texts themselves: addresses meet the text of their
    document once, and no passage is shuffled."""
    cols, none = [c for c in addresses.columns if c != "doc_id"], F.array().cast("array<string>")
    own = addresses.groupBy("doc_id").agg(F.collect_set(F.struct(*cols)).alias("_all"))
    # split before the join: after it the text would be split for every address
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", sentences(F.col("text")).alias("_told"))
    met = own.join(texts, "doc_id", "left").select("doc_id", "_told", F.explode("_all").alias("_own")).select("doc_id", "_own.*", "_told")
    standing = F.aggregate("keys", none, lambda have, k: F.when(F.size(have) > 0, have).otherwise(F.filter("_told", lambda s: F.contains(s, k))))
    return display_keys(met).select(*addresses.columns, F.nullif(F.sort_array(F.array_distinct(standing)), none).alias("passages"))


def probable(found: DataFrame, least: float, probability_col: str = "probability") -> DataFrame:
    """Entities of a recogniser whose probability is at least ``least``; those without one stay out."""
    return found.filter(F.col(probability_col) >= least)
