"""Column functions on strings: splitting, cleaning and counting, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default patterns of the text layer.
CLEANING = r"[^–\-\wäÄöÖüÜß,./]"
TOKEN = r"[\p{L}\p{N}_]+(?:[-–/][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}]"
SENTENCE_END = r"([.!?])\s+"
TERM_CHARACTERS = r"^[a-zA-ZäÄüÜöÖß()/-–]*$"
HYPHENS = ("–", "-", "\u00ad")
MARK = "\u0001"


def java_trim(c: Column) -> Column:
    """Strip all characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def java_split(c: Column, pattern: str) -> Column:
    """Split by a pattern without the empty parts at the end; an empty string is one part."""
    parts = F.split(c, pattern)
    last = F.aggregate(F.transform(parts, lambda p, i: F.when(F.length(p) > 0, i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.when(F.length(c) == 0, F.array(c)).otherwise(F.slice(parts, F.lit(1), last))


def split_sentences(c: Column) -> Column:
    """Default sentence splitter: after a final mark that white space follows."""
    return F.split(F.regexp_replace(c, SENTENCE_END, f"$1{MARK}"), MARK)


def unwrap_lines(c: Column) -> Column:
    """Join words cut at line ends and turn line breaks into blanks before segmentation."""
    return F.replace(F.replace(F.replace(c, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("- "), F.lit(""))


def tokenize(c: Column) -> Column:
    """Default tokenizer: words with inner hyphens or slashes, other marks alone."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def repair_hyphen(c: Column) -> Column:
    """Join a term of two parts at a hyphen if the second begins in lower case."""
    return F.regexp_replace(c, r"^([^-]*)-(\p{Ll}[^-]*)-*$", "$1$2")


def clean_term(c: Column, pattern: str = CLEANING) -> Column:
    """Remove unwanted characters, then repair a hyphen inside the term."""
    return repair_hyphen(F.regexp_replace(c, pattern, ""))


def clean_tokens(tokens: Column, pattern: str = CLEANING, min_length: int = 2) -> Column:
    """Cleaned terms of at least ``min_length`` characters."""
    return F.filter(F.transform(tokens, lambda t: clean_term(t, pattern)), lambda t: F.length(t) >= min_length)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def term_count(line: Column, min_length: int = 2) -> Column:
    """Parts between single white-space characters made of term characters, longer than ``min_length``."""
    return F.size(F.filter(F.split(java_trim(line), r"\s"), lambda p: p.rlike(TERM_CHARACTERS) & (F.length(p) > min_length)))


def contents_share(dots: Column, digits: Column, blanks: Column, terms: Column) -> Column:
    """Percentage of table-of-contents characters, in single precision, rounded up."""
    n = dots + digits + blanks
    share = (n.cast("double") / F.nullif(n + terms, F.lit(0)).cast("double")).cast("float")
    return F.coalesce(F.ceil(share * F.lit(100.0).cast("float")).cast("int"), F.lit(0))


def contents_percent(line: Column, min_length: int = 2) -> Column:
    return contents_share(count_matches(line, r"\."), count_matches(line, r"\p{Nd}"), count_matches(line, " "), term_count(line, min_length))


def only_digits(c: Column) -> Column:
    """True also for the empty string."""
    return c.rlike(r"^\p{Nd}*$")


def contains_keepword(c: Column, keepwords: list[str]) -> Column:
    """Case-insensitive containment of any word."""
    if not keepwords:
        return F.lit(False)
    low = F.lower(c)
    out = F.lit(False)
    for w in keepwords:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def ends_with_hyphen(c: Column) -> Column:
    out = F.lit(False)
    for h in HYPHENS:
        out = out | F.endswith(c, F.lit(h))
    return out


def join_tokens(tokens: Column) -> Column:
    """Blanks between tokens, none before a token of one character."""
    glued = F.array_join(F.transform(tokens, lambda t, i: F.when((i == 0) | (F.length(t) == 1), t).otherwise(F.concat(F.lit(" "), t))), "")
    return F.trim(glued)


def expand_street(c: Column) -> Column:
    """The first ``str.`` and the first ``Str.`` written out."""
    return F.regexp_replace(F.regexp_replace(c, r"^((?s:.*?))str\.", "$1straße"), r"^((?s:.*?))Str\.", "$1Straße")


def line_overlap(left: Column, right: Column) -> Column:
    """Percentage of words of the longer line for which the shorter's words are contained in it,
    without regard to case, rounded up."""
    a, b = F.split(F.lower(left), r"\s+"), F.split(F.lower(right), r"\s+")
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    joined = F.array_join(long, " ")
    return F.ceil(F.size(F.filter(short, lambda w: F.contains(joined, w))) * F.lit(100.0) / F.size(long)).cast("int")


def sentence_similarity(left: Column, right: Column) -> Column:
    """Distinct common terms over the sum of the logarithms of both lengths; 0 without overlap."""
    log = lambda c: F.when(F.size(c) > 1.9, F.log10(F.size(c).cast("double"))).otherwise(F.lit(0.0))
    common = F.size(F.array_intersect(left, right))
    return F.when((common == 0) | (log(left) + log(right) == 0), F.lit(0.0)).otherwise(common / (log(left) + log(right)))


def name_part(c: Column) -> Column:
    """Everything up to the last two neighbouring letters."""
    return F.trim(F.regexp_extract(c, r"^((?s:.*)\p{L}{2})((?s:.*))$", 1))


def number_part(c: Column) -> Column:
    """What follows the last two neighbouring letters; all of it if there are none."""
    return F.trim(F.when(c.rlike(r"\p{L}{2}"), F.regexp_extract(c, r"^((?s:.*)\p{L}{2})((?s:.*))$", 2)).otherwise(c))


#: A range of house numbers wider than this gives its two ends only.
WIDEST_RANGE = 9_999


def house_numbers(c: Column) -> Column:
    """``array<struct(number, suffix)>``: a hyphen between two parts fills the range, a slash
    lists; letters are an upper-case suffix, a missing number is the last one before. Ranges wider
    than ``WIDEST_RANGE`` give their ends."""

    def parsed(parts: Column) -> Column:
        digits = F.transform(parts, lambda p: F.regexp_replace(p, r"\P{Nd}", ""))
        last = lambda i: F.get(F.reverse(F.filter(F.slice(digits, F.lit(1), i + 1), lambda d: d != "")), F.lit(0))
        return F.transform(parts, lambda p, i: F.struct(F.try_to_number(last(i), F.lit("99999999")).cast("int").alias("number"), F.upper(F.regexp_replace(p, r"[\p{Nd}\s]", "")).alias("suffix")))

    bare = F.regexp_replace(c, r"\s", "")
    ranged, listed = F.split(bare, "-"), F.split(bare, "/")
    ends = parsed(ranged)
    first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    low, high = F.least(first["number"], last["number"]), F.greatest(first["number"], last["number"])
    suffix_at = lambda n: F.when(n == last["number"], last["suffix"]).when(n == first["number"], first["suffix"]).otherwise(F.lit(""))
    between = F.when(high - low <= WIDEST_RANGE, F.sequence(low, high)).otherwise(F.array_distinct(F.array(low, high)))
    span = F.when((F.size(ranged) == 2) & first["number"].isNotNull() & last["number"].isNotNull(), F.transform(between, lambda n: F.struct(n.alias("number"), suffix_at(n).alias("suffix"))))
    return F.filter(F.coalesce(span, parsed(listed)), lambda h: h["number"].isNotNull())
