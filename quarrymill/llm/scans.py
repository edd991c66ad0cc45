"""Repair of text extracted from scanned pages.

Page furniture is found per document: page numbers (in any usual form, digits possibly misread)
that rise from page to page, carry a word for page or marks around them, or stand at an edge of the
text or of a form feed, and lines at page edges that repeat fuzzily, or stand alone there though the wrapping shows
that they are no part of a paragraph. Numbers one below the other are a column of a table and stay. Cut words and misread characters are decided by the
vocabulary of the whole corpus: the parts and the joined or corrected form are looked up by joins,
so neither the texts nor the vocabulary go to one task. Words at line edges of scans, which may be
fragments, do not count for the vocabulary.

Null, empty and blank texts give no lines; lines are separated by ``\\n`` and counted from 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.tables import bounded_batches, bounded_broadcast, staged

#: Verdicts on words, and vocabularies, are broadcast up to this many bytes, shuffled beyond; a word
#: with its count takes about so many.
BROADCAST_BYTES, WORD_BYTES = 64 << 20, 64
#: Proposals of corrections leave Python in batches of about so many.
PROPOSED_TOGETHER = 50_000
#: A correction must be this many times as frequent as what it corrects.
RATIO = 3
#: So many times where the word is not rare, or two readings are undone in it.
SURE_RATIO = 20
#: A word is rare up to this share of all words of the vocabulary, five at least.
RARE_SHARE = 4e-6
#: A word that is in the vocabulary must be so long for two readings to be undone in it.
TWICE_LETTERS = 5
# Marks of a cut word; words after a hyphen that stays; readings of characters.
HARD, SOFT = "-‐‑–", "¬­"
SUSPENDED = "und oder bzw sowie bis and or et ou u"
#: What was read -> what may have stood there.
MISREADINGS = {
    "0": "oOöaeuü", "1": "liIt", "2": "zZ", "3": "eaäBö", "4": "aAh", "5": "sSß", "6": "bäGöeaüo", "7": "tTz", "8": "BßaSeg", "9": "gqpeaou", "!": "ilt", "|": "lit", "$": "sS", "@": "a", "€": "e", "£": "f", "§": "s",
    "c": ["e", "o"], "e": ["c"], "n": ["u", "ri", "ii"], "u": ["n", "ü", "ll"], "f": ["t"], "t": ["f", "l"], "h": ["b", "li"], "b": ["h"], "i": ["l", "j", "t"], "l": ["i", "t", "I"], "I": ["l"], "o": ["ö", "c", "e"], "a": ["ä", "o"], "s": ["ß"], "ß": ["B"], "B": ["ß"], "v": ["y"], "y": ["v"],
    "rn": ["m"], "m": ["rn", "in", "ni", "nn"], "ri": ["n"], "vv": ["w"], "w": ["vv"], "ii": ["ü", "u", "n"], "li": ["h"], "cl": ["d"], "d": ["cl"], "in": ["m"], "ni": ["m"], "nn": ["m"], "lc": ["k"], "k": ["lc"], "ll": ["u"], "fi": ["h"], "tl": ["d"], "ü": ["ii", "u"], "ö": ["o"], "ä": ["a"], "é": ["e", "6"], "è": ["e"], "g": ["q"], "q": ["g"], "S": ["5"], "D": ["O"], "O": ["D", "Q"], "G": ["C"], "C": ["G"], "E": ["F"], "F": ["E"], "P": ["F"], "H": ["li"], "M": ["lVl", "IVI"], "rri": ["m"], "iri": ["m"], "ıı": ["n"],
}
LONGEST_READING = max(map(len, MISREADINGS))

_DIGITS = r"[\dlIOo|SB]"
_PAGE = regex.compile(
    rf"(?:(?P<label>Seite|Page|page|S\.|p\.|P\.|Blatt|Bl\.|Pg\.?|Folha|Стр\.)\s*(?P<n>{_DIGITS}{{1,4}})(?:\s*(?:von|of|sur|de|/|из)\s*{_DIGITS}{{1,4}})?|[-–—\[(|•*~=<]*\s*(?=.*(?:\d|\bl\b))(?P<n>{_DIGITS}{{1,4}})\s*[-–—\])|•*~=>]*"
    rf"|(?P<n>{_DIGITS}{{1,4}})\s*(?:/|von|of|sur)\s*{_DIGITS}{{1,4}}|[-–—\[(]*\s*(?=[ivxlcIVXLC])(?P<roman>(?:[xX]{{0,3}})(?:[iI][xXvV]|[vV]?[iI]{{0,3}}|[vV]?l{{0,3}}))\s*[-–—\])]*)$"
)
_READ_AS_DIGIT = str.maketrans("lIOo|SB", "1100158")
_ROMAN = {"i": 1, "l": 1, "v": 5, "x": 10}
#: Page numbers may rise by so much from one found to one of the next so many.
PAGE_STEP = 3
_EDGE_NUMBER = regex.compile(rf"^(?:[-–\[(|]?\s*(?=[\dl]){_DIGITS}{{1,4}}\s*[-–\])|]?\s{{2,}})(?=\p{{L}})|\s{{2,}}[-–\[(|]?\s*(?:(?:Seite|Page|S\.|p\.)\s*)?(?=[\dl]){_DIGITS}{{1,4}}\s*[-–\])|]?$")
_END = regex.compile(r"[.!?:;,…][\"”“»«’')\]]*$")
_INNER_END = regex.compile(r"[\p{Ll}\d][.!?]+[”“\")]*\s+\p{Lu}")
_SPACED = regex.compile(r"(?<!\S)(?:[\p{L}\p{N}!|] ){3,}[\p{L}\p{N}!|](?=[.,;:!?)“”\"]*(?:\s|$))")
_SPLIT = regex.compile(r"[\s–—/„“”\"«»‚‘()\[\]{}<>,;:…]+|(?<=\p{L})[-‐‑](?=\p{L})")


_BEGINS = regex.compile(r"[\p{Lu}\dlI\[(-]")
_FIGURES = regex.compile(r"[\d.,\s%]+$")
_TAIL = regex.compile(r"(?<![\p{L}\p{M}\p{N}!|~‐‑-])[\p{L}\p{M}\p{N}!|~]++(?:[-‐‑][\p{L}\p{M}\p{N}]++)*+([-‐‑–\u00ac\u00ad])?$")
_HEAD = regex.compile(r"\s*([\p{L}\p{M}\p{N}!|~]+)")
_HAS_LETTER, _LETTER, _LOWER = regex.compile(r"\p{L}"), regex.compile(r"\p{L}"), regex.compile(r"\p{Ll}")
_LAST_PART = regex.compile(r"[-‐‑]")
_AROUND_WORD = ".!?'’*_-‐‑¬\u00ad~|"


def words_of(line: str) -> list[str]:
    """Words of a line without punctuation around them; marks inside a word stay."""
    return [w for w in (x.strip(_AROUND_WORD).strip() for x in _SPLIT.split(line)) if w]


def width_of(lines: list[str]) -> int:
    """The width lines were wrapped at: the longest line that others come close to."""
    sizes = sorted((len(x.rstrip()) for x in lines if x.strip()), reverse=True)
    for close in (3, 1):
        for i, n in enumerate(sizes):
            if sum(1 for m in sizes[i + 1 : i + 1 + close] if m >= 0.9 * n) == close:
                return n
    return sizes[0] if sizes else 0


def _signature(s: str) -> int:
    """The set of neighbouring characters of a line as bits."""
    out = 0
    for i in range(len(s) - 1):
        out |= 1 << ((ord(s[i]) * 31 + ord(s[i + 1])) & 255)
    return out


def _alike(a: str, b: str, bits_a: int, bits_b: int) -> bool:
    """Equal but for a few characters: a similarity of 0.85 at least. A character of ``a`` without
    a partner takes away two of its neighbourhoods, one of ``b`` one; lines that lack more of each
    other's are not compared further."""
    if a == b:
        return True
    both = len(a) + len(b)
    matched = -(-0.85 * both // 2)
    if matched > min(len(a), len(b)):
        return False
    free_a, free_b = len(a) - matched, len(b) - matched
    if (bits_a & ~bits_b).bit_count() > 2 * free_a + free_b or (bits_b & ~bits_a).bit_count() > 2 * free_b + free_a:
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85


def page_value(m: regex.Match) -> int:
    """The value of a page number, in digits or Roman."""
    if not m["roman"]:
        return int(m["n"].translate(_READ_AS_DIGIT))
    parts = [_ROMAN[c] for c in m["roman"].lower()]
    return sum(-p if p < max(parts[i + 1 :], default=0) else p for i, p in enumerate(parts))


def page_numbers(lines: list[str], plain: list[str], filled: list[int]) -> set[int]:
    """Indices of lines that are page numbers."""
    seen = [(k, i, m) for k, i in enumerate(filled) if (m := _PAGE.match(plain[i])) and m.end() > m.start()]
    found, values = set(), [page_value(m) for _, _, m in seen]
    # numbers in a column have a number above or below; a page number has not
    places = {k for k, _, _ in seen}
    single = [k - 1 not in places and k + 1 not in places for k, _, _ in seen]
    for at, (k, i, m) in enumerate(seen):
        edge = k in (0, len(filled) - 1) or "\f" in lines[i] or "\f" in lines[filled[k + 1]]
        bare = plain[i] == (m["n"] or m["roman"])
        if m["label"] or (edge or not bare) and single[at]:
            found.add(i)
        for later in range(at + 1, min(at + 1 + PAGE_STEP, len(seen))):
            if single[at] and single[later] and 1 <= values[later] - values[at] <= PAGE_STEP:
                found |= {i, seen[later][1]}
    return found


def furniture(lines: list[str]) -> set[int]:
    """Indices of lines that belong to the page."""
    plain = [x.replace("\f", "").strip() for x in lines]
    filled = [i for i, x in enumerate(plain) if x]
    if not filled:
        return set()
    width = width_of([x for x in plain if x])
    place = {i: k for k, i in enumerate(filled)}
    numbers = page_numbers(lines, plain, filled)

    def stands_alone(i: int) -> bool:
        """No final mark, and the next line's first word would have fitted."""
        if i in numbers or _END.search(plain[i]) or len(plain[i]) > 0.95 * width and len(plain[i]) > 40:
            return False
        k = place[i] + 1
        if k >= len(filled):
            return True
        after = next((j for j in filled[k:] if j not in numbers), None)
        first = plain[after].split()[0] if after is not None else ""
        return len(plain[i]) + 1 + len(first) <= width or any(not plain[j] for j in range(i + 1, filled[k]))

    def begins(i: int) -> bool:
        return bool(_BEGINS.match(plain[i]))

    alone = [i for i in filled if stands_alone(i) and begins(i) and not _FIGURES.match(plain[i])]
    bare = {i: _EDGE_NUMBER.sub("", plain[i]).strip() for i in alone}
    bits = {x: _signature(x) for x in set(bare.values())}
    groups: list[list[int]] = []
    equal: dict[str, list[int]] = {}
    for i in alone:
        if bare[i] in equal:
            equal[bare[i]].append(i)
            continue
        for g in groups:
            if _alike(bare[g[0]], bare[i], bits[bare[g[0]]], bits[bare[i]]):
                g.append(i)
                break
        else:
            groups.append([i])
            equal[bare[i]] = groups[-1]
    found = set(numbers)
    repeated = {i for g in groups if len(g) > 1 for i in g}

    def begins_page(i: int) -> bool:
        k = place[i]
        return k == 0 or "\f" in lines[i] or filled[k - 1] in found

    def ends_page(i: int) -> bool:
        k = place[i]
        return k == len(filled) - 1 or filled[k + 1] in found or "\f" in lines[filled[k + 1]]

    def after_paragraph(i: int) -> bool:
        """The line before is finished, and this one's first word would have fitted there."""
        k = place[i] - 1
        if k < 0 or filled[k] in found:
            return True
        before = plain[filled[k]]
        return bool(_END.search(before)) and len(before) + 1 + len(plain[i].split()[0]) <= width

    while True:
        more = {i for i in alone if i not in found and (i in repeated or _EDGE_NUMBER.search(plain[i]) or begins_page(i) or ends_page(i) and after_paragraph(i) and not _INNER_END.search(plain[i]))}
        if not more:
            break
        found |= more
    # other copies of a header or footer, however they are placed
    heads = {bare[i] for i in found if i in bare and len(bare[i]) >= 6}
    longest = max(map(len, heads), default=0) / 0.85 * 1.15
    for i in filled:
        if i not in found and heads and not _END.search(plain[i]):
            own = _EDGE_NUMBER.sub("", plain[i]).strip()
            if own in heads or len(own) <= longest and (mine := _signature(own)) and any(_alike(own, h, mine, bits[h]) for h in heads):
                found.add(i)
    return found


def scan_lines(text: str) -> list[tuple]:
    """``(line_no, furniture?, spaced?, words, cut, left, right)`` of every filled line. ``cut``
    is the mark at the line's end ('' if none), ``left`` and ``right`` the words on both sides of
    the line break where the word may go on, else null; then whether the line is full, and the next
    and the last line of running text, 0 if none."""
    lines = text.split("\n")
    page = furniture(lines)
    body = [i for i, x in enumerate(lines) if x.strip() and i not in page]
    width = width_of([lines[i] for i in body])
    after = {i: body[k + 1] for k, i in enumerate(body[:-1])}
    before = {j: i for i, j in after.items()}
    rows = []
    for i in sorted(page | set(body)):
        if i in page:
            rows.append((i + 1, True, False, [], "", None, None, False, 0, 0))
            continue
        line = lines[i].replace("\f", "").replace("\r", "").rstrip()
        cut, left, right = "", None, None
        j = after.get(i)
        gap = j is not None and (j == i + 1 or any(k in page for k in range(i + 1, j)))
        if gap:
            tail = _TAIL.search(line, len(line) - len(line.rsplit(None, 1)[-1]))
            head = _HEAD.match(lines[j].lstrip("\f"))
            if tail and head and _LETTER.match(head[1]) and _HAS_LETTER.search(tail[0]):
                cut = tail[1] or ""
                word = tail[0][: -len(cut)] if cut else tail[0]
                left, right = _LAST_PART.split(word)[-1] if not cut else word, head[1]
                if not left or (not cut and not _LOWER.match(right)):
                    cut, left, right = "", None, None
        spaced = bool(_SPACED.search(line))
        rows.append((i + 1, False, spaced, words_of(_SPACED.sub(" ", line) if spaced else line), cut, left, right, len(line) >= width - 2, after.get(i, -1) + 1, before.get(i, -1) + 1))
    return rows


def corrections(word: str) -> set[str]:
    """Forms of which the word may be a misreading: one reading undone, or one odd mark left out."""
    out = set()
    for i in range(len(word)):
        for n in range(1, LONGEST_READING + 1):
            for right in MISREADINGS.get(word[i : i + n], ()) if i + n <= len(word) else ():
                out.add(word[:i] + right + word[i + n :])
        if not word[i].isalpha() and (word[i] not in ".'’" or len(word) > 5 and "." not in word[i + 2 : i + 3]):
            out.add(word[:i] + word[i + 1 :])
    return out - {word}


def vocabulary(documents: DataFrame) -> DataFrame:
    """``(word, n)`` of words of letters in all texts, without those at line edges of scans."""
    inner = F.when(F.col("origin") == "scan", F.regexp_replace("text", r"(?m)^\s*\S+|\S+\s*$", " ")).otherwise(F.col("text"))
    word = r"(?<![\p{L}\p{M}\p{N}|~$@!'’])\p{L}[\p{L}\p{M}'’]*+(?![\p{N}|~$@€£§]|!\p{L})"
    words = documents.filter(F.col("text").isNotNull()).select(F.explode(F.regexp_extract_all(inner, F.lit(word), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _bounded(vocabulary: DataFrame, rows: int) -> DataFrame:
    """The vocabulary for a join: broadcast while it is small, else merged; the other side, which
    may be much larger, is never broadcast."""
    return F.broadcast(vocabulary) if rows * WORD_BYTES <= BROADCAST_BYTES else vocabulary.hint("merge")


def _verdicts(words: DataFrame, vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, right)``: words that are misreadings of much commoner ones."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("seen")).join(vocabulary.withColumnRenamed("n", "known"), "word", "left").select("word", F.coalesce("known", F.lit(0)).alias("known"), "seen")
    # a word seen as often as the most frequent could not be outnumbered
    most, total, n_vocab = (x or 0 for x in vocabulary.agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).collect()[0])
    rare = max(5.0, RARE_SHARE * total)
    suspects = staged(counted.filter((F.length("word") >= 3) & F.col("word").rlike(r"\p{L}") & (F.col("known") * ratio <= most)), "suspects")

    def propose(batches: Iterator[pa.RecordBatch], twice: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, counts, rights = [], [], []
            for word, known in zip(b.column("word").to_pylist(), b.column("known").to_pylist(), strict=True):
                if sum(c.isalpha() for c in word) < 2:
                    continue
                first = corrections(word)
                if twice:
                    first = {c for f in first for c in corrections(f)}
                forms = [f for f in first if f.isalpha() or "'" in f or "’" in f]
                words += [word] * len(forms)
                counts += [known] * len(forms)
                rights += forms
                if len(words) >= PROPOSED_TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(rights, pa.string())], names=["word", "known", "right"])
                    words, counts, rights = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(rights, pa.string())], names=["word", "known", "right"])

    schema = "word string, known long, right string"

    def judged(source: DataFrame, twice: bool) -> DataFrame:
        proposed = source.select("word", "known").mapInArrow(lambda it: propose(it, twice), schema)
        met = proposed.join(_bounded(vocabulary.withColumnRenamed("word", "right"), n_vocab), "right")
        commoner = F.lit(SURE_RATIO) if twice else F.when(F.col("known") > rare, F.lit(SURE_RATIO)).otherwise(F.lit(ratio))
        return met.filter((F.col("n") >= commoner * F.col("known")) & (F.col("n") >= 2)).groupBy("word").agg(F.max(F.struct("n", "right")).alias("b")).select("word", F.col("b.right").alias("right"))

    once = staged(judged(suspects, False), "once")
    # two readings are undone where one gives nothing, or another misreading
    settled = once.join(once.select(F.col("word").alias("right")), "right", "left_anti")
    able = (F.col("known") == 0) | (F.length("word") >= TWICE_LETTERS) & (F.col("known") * SURE_RATIO <= most)
    twice = staged(judged(suspects.filter(able).join(settled.select("word"), "word", "left_anti"), True), "twice")
    return staged(once.join(twice.select("word"), "word", "left_anti").unionByName(twice), "verdicts")


def _analysed(documents: DataFrame) -> DataFrame:
    scans = documents.filter((F.col("origin") == "scan") & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    kinds = {"doc_id": pa.int64(), "line_no": pa.int64(), "page": pa.bool_(), "spaced": pa.bool_(), "words": pa.list_(pa.string()), "cut": pa.string(), "left": pa.string(), "right": pa.string(), "full": pa.bool_(), "next_no": pa.int64(), "last_no": pa.int64()}

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, *r) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for r in scan_lines(text)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return staged(bounded_batches(scans).mapInArrow(analyse, "doc_id long, line_no long, page boolean, spaced boolean, words array<string>, cut string, left string, right string, full boolean, next_no long, last_no long"), "lines")


def _splits(lines: DataFrame, vocab: DataFrame, n_vocab: int) -> DataFrame:
    """``(doc_id, line_no, next_no, left, right)`` of lines whose last word goes on in the next line."""
    pairs = lines.filter(F.col("left").isNotNull()).select("doc_id", "line_no", "next_no", "cut", "left", "right", "full")
    lower = F.col("right").rlike(r"^\p{Ll}")
    marked = pairs.filter(F.col("cut") != "").withColumn("last", F.regexp_extract("left", r"([^-‐‑]+)$", 1))
    soft = marked.filter(F.col("cut").isin(*SOFT))
    hard = marked.filter(~F.col("cut").isin(*SOFT) & lower & F.col("last").rlike(r"\p{L}$") & (F.length("last") > 1))
    # all words to be looked up go to the vocabulary in one join
    hard = hard.select("*", F.lit(True).alias("marked"))
    bare = pairs.filter((F.col("cut") == "") & lower).select("*", F.col("left").alias("last"), F.lit(False).alias("marked"))
    asked = hard.unionByName(bare).withColumn("joined", F.concat("last", "right"))
    own = [c for c in asked.columns if c not in ("doc_id", "line_no")]
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("word")) for r in ("joined", "last", "right")]))
    words = asked.select("doc_id", "line_no", F.struct(*own).alias("own"), roles.alias("r")).select("doc_id", "line_no", "own", "r.role", "r.word")
    met = words.join(_bounded(vocab, n_vocab), "word", "left")
    counts = [F.coalesce(F.max(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"n_{r}") for r in ("joined", "last", "right")]
    asked = staged(met.groupBy("doc_id", "line_no").agg(F.first("own").alias("own"), *counts).select("doc_id", "line_no", "own.*", "n_joined", "n_last", "n_right"), "line_breaks")
    # a hyphen stays between two words that are never written as one
    hard = asked.filter("marked")
    suspended = F.lower("right").isin(SUSPENDED.split()) & ((F.col("n_joined") == 0) | (F.col("n_last") > 0))
    hard = hard.filter(~suspended & ((F.col("n_joined") > 0) | (F.col("n_last") == 0) | (F.col("n_right") == 0) | (F.length("last") > 3) & (F.length("right") > 3)))
    bare = asked.filter("NOT marked")
    broken = (F.col("n_joined") >= 2) & (F.least("n_last", "n_right") * 20 <= F.col("n_joined")) & (F.least("n_last", "n_right") <= 2)
    unknown = (F.col("n_last") == 0) & (F.col("n_right") == 0) & F.col("full") & F.col("left").rlike(r"^[\p{L}\p{M}]+$") & F.col("right").rlike(r"^[\p{L}\p{M}]+$")
    bare = bare.filter(broken | unknown)
    keep = ["doc_id", "line_no", "next_no", "left", "right"]
    return soft.select(*keep).unionByName(hard.select(*keep)).unionByName(bare.select(*keep))


def repair_evidence(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines, splits ``(doc_id, line_no, left, right)``, misreadings ``(doc_id, line_no, word,
    right)`` and the vocabulary of all scans."""
    lines = _analysed(documents)
    vocab = staged(vocabulary(documents), "vocabulary")
    n_vocab = vocab.count()
    splits = staged(_splits(lines, vocab, n_vocab), "splits")
    # words of body lines, without the halves of cut words, which count as the joined word
    cuts = splits.select("doc_id", "line_no", F.lit(1).alias("cuts"))
    goes_on = cuts.select("doc_id", F.col("line_no").alias("last_no"), F.col("cuts").alias("goes_on"))
    body = lines.filter(~F.col("page")).select("doc_id", "line_no", "last_no", "words").join(cuts, ["doc_id", "line_no"], "left").join(goes_on, ["doc_id", "last_no"], "left")
    first, less = F.coalesce("goes_on", F.lit(0)), F.coalesce("goes_on", F.lit(0)) + F.coalesce("cuts", F.lit(0))
    whole = body.select("doc_id", "line_no", F.explode(F.slice("words", first + 1, F.greatest(F.size("words") - less, F.lit(0)))).alias("word"))
    last_part = F.regexp_extract("left", r"([^-‐‑]+)$", 1)
    joined = splits.select("doc_id", "line_no", "next_no", F.concat(last_part, "right").alias("word"), F.length(last_part).alias("n_left"))
    verdicts = _verdicts(whole.select("word").unionByName(joined.select("word")), vocab)
    small = bounded_broadcast(verdicts.withColumnRenamed("right", "corrected"), verdicts.count() * 2 * WORD_BYTES, BROADCAST_BYTES)
    wrong = whole.join(small, "word").select("doc_id", "line_no", "word", F.col("corrected").alias("right"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("word"), F.length("corrected")))), lambda i: F.substring(F.col("word"), F.lit(1), i) == F.substring(F.col("corrected"), F.lit(1), i)))
    halves = joined.join(small, "word").select("doc_id", F.when(same < F.col("n_left"), F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"), "word", F.col("corrected").alias("right"))
    return lines, splits, wrong.unionByName(halves), vocab


def line_findings(documents: DataFrame) -> DataFrame:
    """``(doc_id, line_no, kind)``, kind being ``furniture``, ``split`` or ``misread``."""
    lines, splits, wrong, _ = repair_evidence(documents)
    page = lines.filter("page").select("doc_id", "line_no", F.lit("furniture").alias("kind"))
    spaced = lines.filter("spaced").select("doc_id", "line_no", F.lit("misread").alias("kind"))
    return page.unionByName(splits.select("doc_id", "line_no", F.lit("split").alias("kind"))).unionByName(spaced).unionByName(wrong.select("doc_id", "line_no", F.lit("misread").alias("kind"))).distinct()


def repaired_text(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of every scan with a text: paragraphs in one line each, without page
    furniture, cut words joined and misread words corrected."""
    lines, splits, wrong, _ = repair_evidence(documents)
    row = lambda df, kind, line, word, right: df.select("doc_id", F.lit(kind).alias("kind"), line.alias("line_no"), word.alias("word"), right.alias("right"))
    none, number = F.lit(None).cast("string"), F.col("line_no")
    found = row(lines.filter("page"), "page", number, none, none).unionByName(row(splits, "cut", number, none, none)).unionByName(row(wrong, "fix", F.lit(None).cast("long"), F.col("word"), F.col("right")))
    # all that is known of a text comes to it in one join
    known = found.groupBy("doc_id").agg(F.collect_set(F.struct("kind", "line_no", "word", "right")).alias("found"))
    scans = documents.filter((F.col("origin") == "scan") & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                of = {kind: [x for x in found or () if x["kind"] == kind] for kind in ("page", "cut", "fix")}
                texts.append(rebuilt(text, {x["line_no"] for x in of["page"]}, {x["line_no"] for x in of["cut"]}, {x["word"]: x["right"] for x in of["fix"]}))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return bounded_batches(scans.join(known, "doc_id", "left")).mapInArrow(rebuild, "doc_id long, text string")


def rebuilt(text: str, page: set[int], cut: set[int], fixes: dict[str, str]) -> str:
    """The text without the lines of ``page``; the last word of lines in ``cut`` goes on."""
    out, joined, broken = "", False, False
    for no, line in enumerate(text.replace("\r", "").split("\n"), 1):
        line = line.replace("\f", "").strip()
        if no in page:
            continue
        if not line:
            broken = not joined
            continue
        if joined:
            out = regex.sub(r"[-‐‑–¬­]$", "", out) + line
        elif not out:
            out = line
        else:
            out += ("\n\n" if broken else " ") + line
        joined, broken = no in cut, False
    out = _SPACED.sub(lambda m: m.group().replace(" ", ""), out)
    return _fixed(out, fixes) if fixes else out


def _fixed(text: str, fixes: dict[str, str]) -> str:
    """The text with its words, as ``words_of`` takes them, replaced."""
    out, at = [], 0
    for m in [*_SPLIT.finditer(text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end]
        word = piece.strip(_AROUND_WORD).strip()
        out.append(piece.replace(word, fixes[word], 1) if word in fixes else piece)
        if m:
            out.append(m.group())
            at = m.end()
    return "".join(out)
