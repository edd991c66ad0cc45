"""Personal information in free text: found, located and replaced by typed placeholders.

A text is normalised by small transducers that keep a map to the source: lookalike letters, wide
and foreign digits, spelled digits, at/dot disguises, invisible characters and words cut at line
ends of scans. Identifiers are matched in the normalised text and their spans mapped back. Names
are candidates of capitalised words and initials; a lexicon of given names and surnames, learnt
from titles, salutations and signatures of the whole corpus, decides on those without a title.
The lexicon is applied by joins on the candidates' words.

Where to look is found first: one array pass over the code points of many texts marks numbers and
capitalised words before others, so that the patterns run at those places only.

Offsets count code points from 0 in the source, ends are exclusive. Null, empty and blank texts
have no findings; findings of one text do not overlap.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.lookalikes import fold_lookalikes
from quarrymill.tables import bounded_batches, bounded_broadcast, staged

#: Name words are broadcast up to this many rows, shuffled beyond.
BROADCAST_NAMES = 500_000
#: A word enters the lexicon when seen so often in a sure place, and in so large a share of all.
SURE_TIMES, SURE_SHARE = 2, 0.02
#: How far before a name its title may begin, before a house number its street, before an identity
#: number its label, in code points.
TITLE_REACH, STREET_REACH, LABEL_REACH = 24, 90, 120
#: Texts are marked together up to this many code points at a time.
MARKED_TOGETHER = 1_000_000

# Digit words, disguises, labels, titles, street words.
DIGIT_WORDS = {
    "null": "0", "eins": "1", "ein": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
AT = r"(?:at|ät|æt|a|@|arobase|klammeraffe)"
DOT = r"(?:dot|punkt|point|\.)"
ID_LABELS = (
    r"Steuer-?\s?(?:ID|Identifikationsnummer|nummer|Nr\.?)|steuerliche Identifikationsnummer|IdNr\.?|(?:Renten|Sozial|Kranken)?[Vv]ersicherungs(?:nummer|-?Nr\.?)|RVNR|"
    r"(?:Personal)?[Aa]usweis(?:nummer|-?\s?Nr\.?)?|(?:Reise)?[Pp]ass(?:nummer|-?\s?Nr\.?)|[Pp]assport\s(?:number|no\.?)|(?:[Nn]ational\s)?[Ii]nsurance\s(?:number|no\.?)|[Ss]ocial\s[Ss]ecurity\s(?:number|no\.?)|SSN|NINO|"
    r"[Tt]ax\s(?:ID|number|no\.?)|[Ii]dentity\s(?:card|number)|ID\s(?:card|number|no\.?)|[Nn]uméro\s(?:de\s)?(?:sécurité\ssociale|passeport|fiscal)|[Ss]écurité\ssociale|[Cc]arte\sd'identité|[Pp]asseport|NIR|ИНН|СНИЛС|паспорт"
)
TITLES = r"Herrn?|Frau|Fr\.|Hr\.|Dr\.|Prof\.|Mag\.|Dipl\.-Ing\.|Mr\.?|Mrs\.?|Ms\.?|Miss|M\.|MM\.|Mme|Mlle|Monsieur|Madame|gez\.|i\.\s?[AV]\.|Signed:?|Dear|Liebe[rs]?|Sehr geehrte[rs]?"
#: Titles that a surname alone may follow, titles that may stand between, offices that are no surnames.
PERSONAL_TITLES = "Herr Herrn Frau Hr Fr Mr Mrs Ms Miss M Mme Mlle Monsieur Madame Mademoiselle Dr Prof"
OFFICES = (
    "Präsident Bürgermeister Oberbürgermeister Minister Direktor Senator Stadtrat Rat Doktor Professor Abgeordneter Abgeordnete Vorsitzender Vorsitzende Kollege Kollegin Rechtsanwalt Rechtsanwältin Stadträtin Nachbar Amtsleiter Landrat Landrätin Richter "
    "President Chairman Chairwoman Speaker Mayor Minister Chair Secretary Maire Président Présidente Ministre Directeur Directrice"
)
CLOSINGS = r"(?:Mit\s(?:freundlichen|besten|herzlichen)\s)?(?:Grüßen|Grüße|Gruß)|Hochachtungsvoll|(?:Kind|Best|Warm)\s[Rr]egards|Yours\s(?:sincerely|faithfully|truly)|Sincerely|Cordialement|Salutations|(?:Bien\sà\svous)"
PARTICLES = r"(?:von|van|de|du|der|den|zu|zur|vom|di|da|la|le|ten|ter|del|della|dos)"
TYPES = r"(?:straße|strasse|str\.?|weg|platz|pl\.|allee|all\.|gasse|ufer|damm|ring|chaussee|pfad|steig|promenade|zeile|stieg|markt|bogen|kai)"
NEVER = "Jahr Jahre Januar Februar März April Mai Juni Juli August September Oktober November Dezember Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Entwurf Anlage Abschnitt Punkt Teil Blatt Plan Absatz Satz Artikel Kapitel Seite Abs Umfang Ortsteil Bereich Zeitraum Haushalt Rahmen"
EN_TYPES = r"(?:Street|St\.|Road|Rd\.?|Lane|Ln\.?|Close|Mews|Avenue|Ave\.?|Drive|Dr\.|Court|Ct\.|Gardens|Terrace|Square|Way|Crescent|Place|Hill|Row|Walk|Grove|Parade)"
FR_TYPES = r"(?:rue|av\.|avenue|bd\.?|boulevard|chemin|place|pl\.|quai|allée|impasse|route|cours|square|passage|villa)"
NOT_NAMES = frozenset(
    "Der Die Das Den Dem Des Ein Eine Einer Eines Und Oder Im Am Zum Zur Für Auf Mit Nach Bei Von Aus Herr Herrn Frau Dr Prof Mr Mrs Ms Miss Mme Mlle The This That These Those And For From With Le La Les Un Une Des Du Et Pour Selon Dans Sur "
    "Nr Abs Art Abb Anlage Blatt Satz Teil Part Fig Sec Tel Fax Ist Wer Wie Was Wo Wann Sie Er Es Wir Ihr Ich So Zu In An Liebe Dear Sehr".split()
)

_WORD = r"\p{Lu}(?:\p{Ll}[\p{Ll}\p{M}'’]*(?:\p{Lu}\p{Ll}+)?|\p{Lu}+)(?:-\p{Lu}(?:\p{Ll}+|\p{Lu}+))?"
_INITIAL = r"\p{Lu}\."
_AFTER = r"(?![\p{L}\p{N}@]|-\p{L}|\s(?:School|Schule|Street|Road|Lane|Close|Mews|Square|Avenue|Platz|Weg|Straße|Str\.|Allee|Gasse|Ufer|Damm|Gymnasium|Grundschule|Park|Haus|Halle|Stiftung|College|University)\b)"
_NAME = regex.compile(
    # first a cheap look: a capitalised word before another one
    rf"(?=\p{{Lu}}[\p{{L}}\p{{M}}.'’\-]*+,?\s(?:{PARTICLES}\s){{0,2}}\p{{Lu}})(?<![\p{{L}}\p{{N}}\-@])(?:(?P<s1>{_WORD}),\s(?P<g1>{_WORD}|{_INITIAL})(?:\s{_INITIAL})?|(?P<g2>{_WORD}|{_INITIAL})(?:\s{_INITIAL}){{0,2}}(?:\s{PARTICLES}){{0,2}}\s(?P<s2>{_WORD})){_AFTER}"
)
#: A third word that may end the name.
_THIRD = regex.compile(rf"\s(?P<s>{_WORD}){_AFTER}")
#: Endings of Russian patronymics, which are the middle one of three names.
_PATRONYMIC_JVM = r"(?iu)^\p{IsCyrillic}+(?:ович|евич|ич|овна|евна|ична)$"
_TITLE_WORDS = frozenset(PERSONAL_TITLES.split())
_OFFICES = frozenset(w for office in OFFICES.split() for w in (office, office + "in"))
_ONE_NAME = regex.compile(rf"(?:{'|'.join(sorted(_TITLE_WORDS, key=len, reverse=True))})\.?\s(?:(?:Dr|Prof|Mag|Dipl)\.(?:-?\s?(?:Ing|med|phil|jur|h\.\s?c)\.)?\s){{0,3}}(?P<s>{_WORD}){_AFTER}")
_TITLE_BEFORE = regex.compile(rf"(?r)(?<!\p{{L}})(?:{TITLES})\s+")
_CLOSING = regex.compile(rf"(?:^|\n)[^\S\n]*(?:{CLOSINGS})[^\n]{{0,20}}\s*\n\s*(?:(?:gez\.|i\.\s?[AV]\.|Signed:?)\s*)?")
#: Parts of words of which every closing formula holds one.
_CLOSING_HINTS = ("Grüß", "Gruß", "Hochachtungs", "egards", "incerely", "aithfully", "ruly", "Cordialement", "Salutations", "Bien à")
_BY_ORDER = regex.compile(r"(?r)(?<!\p{L})[iI]\.\s?")
_SCHOOL_BEFORE = regex.compile(r"(?r)(?:[ÉéEe]cole|Schule|School|Platz|Straße|rue|avenue|quai|allée|collège|lycée)\s(?:de\s|du\s|de\sla\s)?")

_WS = r"(?:[^\S\n]+|[^\S\n]*\r?\n[^\S\n]*)"
_SUFFIX = r"(?:\s?(?:bis|ter)\b|\s?[a-zA-Z](?![\p{L}\p{N}]))?"
_RANGE = rf"\d{{1,4}}{_SUFFIX}(?:\s?[-–/]\s?\d{{1,4}}{_SUFFIX})?(?![\p{{L}}\d]|[.,]\d)"
_TOWN = rf"(?:(?:,{_WS}?|{_WS}in{_WS}|{_WS}|{_WS}?\()\b(?:D-|F-)?\d{{5}}{_WS}(?:(?:Bad|Sankt|St\.|Neu|Alt|Groß|Klein) )?\p{{Lu}}[\p{{L}}\p{{M}}]+(?:-\p{{Lu}}\p{{L}}+)*)?"
_CAP = r"\p{Lu}[\p{L}\p{M}]+"
#: An address is looked for around its number: the street before it, or after it.
_STREET_NUMBER = regex.compile(
    rf"(?r)(?<![\p{{L}}\-])(?:(?:{_CAP}[- ])?(?:{_CAP}-)*\p{{Lu}}[\p{{L}}\p{{M}}]*?{TYPES}|(?:{_CAP}(?:-|{_WS})){{1,3}}(?i:{TYPES})|(?:Am|An\s(?:der|den|dem)|Zum|Zur|Im|In\s(?:der|den)|Auf\s(?:dem|der)|Unter\s(?:den|der)|Hinter\s(?:dem|der)|Vor\s(?:dem|der)|Beim|Bei\sder){_WS}(?!(?:{'|'.join(NEVER.split())})\b){_CAP}(?:-\p{{Lu}}\p{{L}}+)*)"
    rf",?{_WS}(?:(?:Nr|No|Hausnr|Haus)\.?{_WS}?)?"
)
_AFTER_STREET = regex.compile(rf"{_RANGE}{_TOWN}")
_NUMBER_STREET = regex.compile(
    rf"\d{{1,4}}(?:\s?[-–]\s?\d{{1,4}})?{_SUFFIX},?{_WS}(?:(?:\p{{Lu}}[\p{{L}}\p{{M}}'’]+{_WS}){{1,3}}{EN_TYPES}(?![\p{{L}}\-])|{FR_TYPES}{_WS}(?:(?:de\sla|de\sl['’]|des|de|du|d['’])\s*)?\p{{Lu}}[\p{{L}}\p{{M}}'’\-]+(?:\s\p{{Lu}}[\p{{L}}\p{{M}}'’\-]+)?){_TOWN}"
)
_NUMBER_WORDS = frozenset(("Nr", "No", "Hausnr", "Haus"))
_STREET_LEADS = frozenset("Am der den dem Zum Zur Im Beim".split())
_TYPE_ENDS = tuple("straße strasse str str. weg platz pl. allee all. gasse ufer damm ring chaussee pfad steig promenade zeile stieg markt bogen kai".split())
_LEADING_WORD = regex.compile(r"(?:Das|Der|Die|Haus|Grundstück|Anschrift|Adresse|Gebäude|Objekt|Wohnung)\s+(?=\p{Lu})")
_LOCAL_PART = regex.compile(r"(?r)(?<![\p{L}\d._%+\-@])[\p{L}\d](?:[\p{L}\d._%+\-]*[\p{L}\d_])?")
_HOST = regex.compile(r"@(?:[\p{L}\d](?:[\p{L}\d\-]*[\p{L}\d])?\.)+\p{L}{2,}(?![\p{L}\d@])")
_S = r"[ \-./‑–]{0,3}\s?"
_PHONE = [
    regex.compile(p)
    for p in (
        rf"(?<![\p{{L}}\d+])(?:\+|00)[1-9]\d{{0,2}}{_S}(?:\(0\)\s?)?(?:\(\d{{1,5}}\)\s?)?\d(?:[ \-./‑–]{{0,3}}\s?\d){{5,12}}(?![\d\p{{L}}]|[ ,.]\d)",
        r"(?<![\p{L}\d+])\(0\d{1,5}\)[ /\-]{0,2}\s?\d(?:(?:[ \-/.‑–]|\s[\-–/]\s|\n)?\d){3,9}(?![\d\p{L}]|[ ,.]\d)",
        r"(?<![\p{L}\d+])(?:1[-. ])?\(\d{3}\)\s?\d{3}[-. ]\d{4}(?![\d\p{L}]|[ ,.]\d)",
        r"(?<![\p{L}\d+/\-.,])(?<!\d )(?!\d{2}\.\d{2}\.\d{4}(?!\d))0[1-9]\d{0,4}(?:\s?[\-/.‑–]\s?|\s)\d(?:(?:[ \-/.‑–]|\s[\-–/]\s|\n)?\d){4,9}(?![\d\p{L}]|[ ,.]\d)",
        r"(?<=(?:Tel|Telefon|Fon|Mobil|Handy|Fax|Phone|phone|Call|call|tel|Tél|tél)(?:\.|:|\s)\s*)\d(?:(?:[ \-/.‑–]|\s[\-–/]\s|\n)?\d){5,13}(?![\d\p{L}]|[ ,.]\d)",
        r"(?<![\p{L}\d+/\-.,])(?<!\d )\d{3}-\d{3}-\d{4}(?![\d\p{L}]|[ ,.-]\d)",
    )
]
_ID_VALUE = r"(?=[A-Z\d .\-/]{0,24}\d)(?:[A-Z]{0,3}\d[A-Z\d]*|[A-Z]{1,3}(?=[\s\-]?\d))(?:[\s\-/][A-Z\d]*\d[A-Z\d]*|[\s\-/][A-Z]{1,2}(?![\p{L}]))*"
_ID_LABEL = regex.compile(rf"(?<![\p{{L}}])(?:{ID_LABELS})(?:\s*(?:Nr\.?|No\.?|n°|number|:|ist|lautet|is|est|=))*\s*")
_LABELLED_ID = regex.compile(rf"{_ID_VALUE}(?![\p{{L}}\d])")
_BARE_ID = regex.compile(r"(?=\d\d|\d \d|[A-Z][A-Z] ?\d)(?<![\p{L}\d\-/.])(?<!\d )(?:\d{2} ?\d{6} ?[A-Z] ?\d{3}|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2})(?![\p{L}\d]|[\-/. ]\d)")
#: Stretches that may hold a phone number, an identity number without a label, one with a label.
_DIGITS_TOGETHER = regex.compile(r"\d(?:[\s\-./‑–()]{0,6}+\d){5,}+")
_LONG_NUMBER = regex.compile(r"\d(?:[ \-]?[\dA-Z]){6,}+")
_LABELLED_NUMBER = regex.compile(r"\d(?:[\s\-/]?[A-Z]{0,3}[\s\-/]?\d){4,}+")


class Normal:
    """A normalised text with the source span of every character."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None):
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])


def rewrite(base: Normal, edits: list[tuple[int, int, str]]) -> Normal:
    """Apply non-overlapping replacements ``(start, end, new)`` of a normalised text."""
    if not edits:
        return base
    n = len(base.text)
    starts = base.starts if base.starts is not None else np.arange(n)
    ends = base.ends if base.ends is not None else np.arange(1, n + 1)
    parts, s_parts, e_parts, at = [], [], [], 0
    for a, b, new in edits:
        parts += [base.text[at:a], new]
        s_parts += [starts[at:a], np.full(len(new), starts[a])]
        e_parts += [ends[at:a], np.full(len(new), ends[b - 1])]
        at = b
    parts.append(base.text[at:])
    s_parts.append(starts[at:])
    e_parts.append(ends[at:])
    return Normal("".join(parts), np.concatenate(s_parts).astype(np.int64), np.concatenate(e_parts).astype(np.int64))


_INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
_CHARS = regex.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]+|[\u0300-\u036f]+")


def _one_for_one() -> dict[int, str]:
    """Wide letters and signs, letters of mathematics, foreign digits and blanks as plain ones."""
    out = {c: unicodedata.normalize("NFKC", chr(c)) for a, b in ((0xFF01, 0xFF5F), (0x1D400, 0x1D800)) for c in range(a, b)}
    out |= {c: str(unicodedata.digit(chr(c))) for c in range(128, 0x1FC00) if unicodedata.category(chr(c)) == "Nd"}
    out |= dict.fromkeys([0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
    return {c: new for c, new in out.items() if len(new) == 1 and new != chr(c)}


_PLAIN = _one_for_one()
_PLAIN_POINTS = np.arange(0x110000, dtype="<u4")
_PLAIN_POINTS[list(_PLAIN)] = [ord(c) for c in _PLAIN.values()]


def _plain(text: str) -> str:
    return _PLAIN_POINTS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tobytes().decode("utf-32-le", "surrogatepass")
_CUT = regex.compile(r"(?<=\p{L})[-‐‑¬­][^\S\n]*\r?\n\s*(?=\p{Ll})")
_BRACKETED_AT = rf"[(\[{{<]\s*{AT}\s*[)\]}}>]"
_AT = regex.compile(rf"{_BRACKETED_AT}|&#64;|&commat;|-at-|_at_", regex.I)
_BARE_AT = regex.compile(r"(?:@|at|ät)(?<=\s(?:@|at|ät))(?=\s)|@(?<=\s@)|@(?=\s)", regex.I)
_HAS_AT = regex.compile(_BRACKETED_AT, regex.I)
_DOTTED_NEXT = regex.compile(r"[\p{L}\d\-]+\s*(?:\(|\[|\{)?\s*(?:dot|punkt|point)\b", regex.I)
#: An at sign with a blank on one side, before a plain host.
_LOOSE_AT = regex.compile(r"(?<=[\p{L}\d])(?:@\s+|\s+@)(?=(?:[\p{Ll}\d][\p{Ll}\d\-]*\.)+\p{Ll}{2,}(?![\p{L}\d@]))")
_DOMAIN = regex.compile(rf"@[\p{{L}}\d\-]+(?:(?:\.|\s*[(\[{{<]\s*{DOT}\s*[)\]}}>]\s*|\s+(?:dot|punkt|point)\s+)[\p{{L}}\d\-]+)+", regex.I)
_DOT = regex.compile(rf"\s*[(\[{{<]\s*{DOT}\s*[)\]}}>]\s*|\s+(?:dot|punkt|point)\s+", regex.I)
_BRACKETED_DOT = regex.compile(rf"[(\[{{<]\s*{DOT}\s*[)\]}}>]", regex.I)
_SPELLED = regex.compile(rf"(?<!\p{{L}})(?:(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}|\d)(?!\p{{L}})[\s,\-–/]*){{6,}}", regex.I)
#: Digit words of which a spelled number holds at least two.
_TELLING = frozenset(DIGIT_WORDS) - {"ein", "un", "oh"}
_DIGIT_WORD = regex.compile(r"\p{L}+", regex.I)
#: Cheap signs of a disguise; texts without any are not searched for it.
_AT_SIGNS = ("&#64;", "&commat;", "-at-", "_at_")
_DOT_WORDS = ("dot", "punkt", "point")


def _between_words(t: str, a: int, b: int) -> tuple[int, int] | None:
    """The span with the blanks around it, if a letter or digit stands on both sides."""
    while a and t[a - 1].isspace():
        a -= 1
    while b < len(t) and t[b].isspace():
        b += 1
    return (a, b) if a and b < len(t) and t[a - 1].isalnum() and t[b].isalnum() else None


def _at_edits(t: str, dotted: bool) -> list[tuple[int, int, str]]:
    """Disguised at signs; those without brackets count before a word for a dot."""
    spans = [span for m in _AT.finditer(t) if (span := _between_words(t, *m.span()))]
    if dotted:
        spans += [span for m in _BARE_AT.finditer(t) if (span := _between_words(t, *m.span())) and _DOTTED_NEXT.match(t, span[1])]
    spans += [m.span() for m in _LOOSE_AT.finditer(t)] if "@ " in t or " @" in t or "@\n" in t or "\n@" in t else []
    out: list[tuple[int, int, str]] = []
    for span in sorted(set(spans)):
        if not out or out[-1][1] <= span[0]:
            out.append((*span, "@"))
    return out


def normalise(text: str, scanned: bool = False, odd: bool = True, bracketed: bool = True) -> Normal:
    """Undo disguises one transducer after the other. ``odd`` false: the text is known to hold
    neither invisible nor combining characters nor foreign digits, wide letters and blanks;
    ``bracketed`` false: and no closing bracket behind the last letter of a disguised at sign."""
    out = Normal(text if text.isascii() else fold_lookalikes(text), None, None)
    if odd:
        plain, edits = _plain(out.text), []
        for m in _CHARS.finditer(plain):
            a, c = m.start(), m.group()
            if c[0] in _INVISIBLE:
                if not (scanned and "\u00ad" in c):
                    edits.append((a, m.end(), ""))
            elif a and plain[a - 1].isalpha() and (new := unicodedata.normalize("NFC", plain[a - 1] + c)) != plain[a - 1] + c:
                edits.append((a - 1, m.end(), new))
        out = rewrite(Normal(plain, None, None), edits)
    if scanned:
        out = rewrite(out, [(m.start(), m.end(), "") for m in _CUT.finditer(out.text)])
    low = out.text.lower()
    dotted = ("@" in low or " at " in low or " ät " in low) and any(h in low for h in _DOT_WORDS)
    if dotted or "@" in low or bracketed and _HAS_AT.search(low) or any(h in low for h in _AT_SIGNS):
        out = rewrite(out, _at_edits(out.text, dotted))
        if "@" in out.text:
            out = rewrite(out, [(*span, ".") for m in _BRACKETED_DOT.finditer(out.text) if (span := _between_words(out.text, *m.span()))])
            out = rewrite(out, [(m.start(), m.end(), ".") for d in _DOMAIN.finditer(out.text) for m in _DOT.finditer(out.text, d.start(), d.end())])
    if len(_TELLING.intersection(low.replace("-", " ").replace(",", " ").split())) < 2:
        return out
    edits = []
    for run in _SPELLED.finditer(out.text):
        words = [m for m in _DIGIT_WORD.finditer(out.text, run.start(), run.end()) if m.group().lower() in DIGIT_WORDS]
        if len(words) >= 4:
            edits += [(m.start(), m.end(), DIGIT_WORDS[m.group().lower()]) for m in words]
    return rewrite(out, edits)


# Kinds of code points, as bits: capital, letter or mark, digit, blank, joining mark, odd character.
_CAPITAL, _LETTER, _DIGIT, _BLANK, _JOINING, _ODD = 1, 2, 4, 8, 16, 32


def _kinds() -> np.ndarray:
    """The kind of every code point, from its category."""
    by_category = {"Lu": _CAPITAL | _LETTER, "Ll": _LETTER, "Lt": _LETTER, "Lm": _LETTER, "Lo": _LETTER, "Nd": _DIGIT, "Nl": _DIGIT, "No": _DIGIT}
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x1FC00):
        kinds[c] = by_category.get(unicodedata.category(chr(c)), _BLANK if chr(c).isspace() else 0)
    kinds[0x20000:0x32000] = _LETTER
    for c in ".,/-–":
        kinds[ord(c)] |= _JOINING
    for c in [*_PLAIN, *map(ord, _INVISIBLE), *range(0x300, 0x370)]:
        kinds[c] |= _ODD
    return kinds


_KINDS = _kinds()


def _joined_kinds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and kinds of the texts, each followed by a line break, and where each begins."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return points, _KINDS[points], begins


def _per_text(places: np.ndarray, begins: np.ndarray) -> list[list[int]]:
    """Places in the joined texts as places in each."""
    cuts = np.searchsorted(places, begins)
    return [(places[a:b] - s).tolist() for a, b, s in zip(cuts[:-1], cuts[1:], begins[:-1], strict=True)]


def _code(word: str) -> int:
    """A word of up to five code points below 4096 as one number."""
    out = 0
    for c in word.ljust(5, "\0"):
        out = out * 4096 + ord(c)
    return out


def _codes(points: np.ndarray, at: np.ndarray, size: np.ndarray, lower: bool = False) -> np.ndarray:
    """The same of words at many places; -1 for longer words."""
    out = np.zeros(len(at), np.int64)
    for i in range(5):
        c = np.minimum(points[np.minimum(at + i, len(points) - 1)], 4095)
        if lower:
            c = c + 32 * ((c >= 65) & (c <= 90))
        out = out * 4096 + np.where(i < size, c, 0)
    return np.where(size <= 5, out, -1)


_PARTICLE_CODES = np.array([_code(w) for w in "von van de du der den zu zur vom di da la le ten ter del dos".split()] + [_code("della")])
_NEVER_FIRST = np.array([_code(w) for w in NOT_NAMES - _TITLE_WORDS if len(w) <= 5])
_LEAD_CODES = np.array([_code(w) for w in _STREET_LEADS])
_NUMBER_WORD_CODES = np.array([_code(w + d) for w in ("Nr", "No", "Haus") for d in ("", ".")])
#: Last letters of street types, and of words for a house number; first letters of French ones.
_TYPE_TAILS = np.array(sorted({_code(w.rstrip(".")[-3:]) for w in _TYPE_ENDS} | {_code("snr")}))
_FRENCH_HEADS = np.array(sorted({_code(w) for w in "ru av bd bo ch pl qu al im ro co sq pa vi".split()}))


def signs(texts: list[str]) -> tuple[list[bool], list[bool]]:
    """Of each text whether it holds characters that a transducer would change one by one, and
    whether a bracket closes behind the last letter of a disguised at sign."""
    points, kinds, begins = _joined_kinds(texts)
    odd = np.diff(np.searchsorted(np.flatnonzero(kinds & _ODD), begins)) > 0
    close = np.flatnonzero((points == 41) | (points == 93) | (points == 125) | (points == 62))
    inner = points[np.maximum(close - 1, 0)]
    inner = np.where((_KINDS[inner] & _BLANK) > 0, 64, inner)
    telling = close[np.isin(inner, [ord(c) for c in "tTaA@eE"])]
    return odd.tolist(), (odd | (np.diff(np.searchsorted(telling, begins)) > 0)).tolist()


def landmarks(texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """Of each text the places of numbers that may follow a street, of those that may stand before
    one, and of capitals that may begin a name: before another capitalised word, or one behind up to
    two particles."""
    points, kinds, begins = _joined_kinds(texts)
    before = np.concatenate([[_BLANK], kinds[:-1]]).astype(np.uint8)
    blank = (kinds & _BLANK) > 0
    starts = np.flatnonzero(~blank & ((before & _BLANK) > 0))
    if not len(starts):
        return [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    n = len(starts)
    capital = np.append((kinds[starts] & _CAPITAL) > 0, [False] * 6)
    last_point = len(points) - 1

    digit = (kinds & _DIGIT) > 0
    first = np.flatnonzero(digit & ((before & (_LETTER | _DIGIT | _JOINING)) == 0))
    stop = np.flatnonzero(digit & ~np.append(digit[1:], False)) + 1
    last = stop[np.searchsorted(stop, first, "right")]
    after = points[np.minimum(last, last_point)]
    decimal = ((after == ord(".")) | (after == ord(","))) & digit[np.minimum(last + 1, last_point)]
    first = first[(last - first <= 4) & ~decimal]
    token = np.searchsorted(starts, first, "right") - 1
    # the word before ends like a street, stands behind a word that leads one, or means a number
    open_ = (token > 0) & (starts[token] == first)
    word = token[open_] - 1
    a, b = starts[word], ends[word]
    tail = b - np.isin(points[b - 1], [44, 46])
    tail = np.maximum(tail - (np.isin(points[tail - 1], [44, 46]) & (tail > a)), a)
    ending = lambda k: _codes(points, np.maximum(tail - k, a), np.minimum(tail - a, k), True)
    lead = np.maximum(word - 1, 0)
    street = np.isin(ending(3), _TYPE_TAILS) | np.isin(ending(2), [_code("pl")]) | np.isin(_codes(points, a, b - a), _NUMBER_WORD_CODES) | np.isin(_codes(points, starts[lead], ends[lead] - starts[lead]), _LEAD_CODES)
    follows = first[open_][street]
    # two capitalised words come soon, or one that begins like a French street type
    soon = np.zeros(len(first), bool)
    for k in range(1, 5):
        at = np.minimum(token + k, n - 1)
        soon |= capital[token + k] & capital[token + k + 1] | np.isin(_codes(points, starts[at], np.minimum(ends[at] - starts[at], 2)), _FRENCH_HEADS)
    precedes = first[soon]

    short = np.flatnonzero(~capital[:n] & (ends - starts <= 5))
    particle = np.zeros(n + 6, bool)
    particle[short] = np.isin(_codes(points, starts[short], ends[short] - starts[short]), _PARTICLE_CODES)
    leads = capital[1 : n + 1] | particle[1 : n + 1] & (capital[2 : n + 2] | particle[2 : n + 2] & capital[3 : n + 3])
    begin = np.flatnonzero(((kinds & _CAPITAL) > 0) & ((before & (_LETTER | _DIGIT)) == 0))
    joint = points[np.maximum(begin - 1, 0)]
    begin = begin[(joint != ord("-")) & (joint != ord("@"))]
    token = np.searchsorted(starts, begin, "right") - 1
    begin, token = begin[leads[token]], token[leads[token]]
    size = ends[token] - begin
    # the word ends in a letter or comma; in a point only after an initial or a title
    end_kind, end_point = kinds[ends[token] - 1], points[ends[token] - 1]
    fit = ((end_kind & _LETTER) > 0) | np.isin(end_point, [ord(c) for c in ",'’"]) | (end_point == ord(".")) & (size <= 5)
    begin, token, size = begin[fit], token[fit], size[fit]
    begin = begin[~np.isin(_codes(points, begin, size - (points[ends[token] - 1] == ord(","))), _NEVER_FIRST)]
    return _per_text(follows, begins), _per_text(precedes, begins), _per_text(begin, begins)


def _may_be_street(words: list[str]) -> bool:
    """Whether the words before a number end like a street."""
    if words and words[-1].rstrip(".") in _NUMBER_WORDS:
        words = words[:-1]
    if not words:
        return False
    last = words[-1].rstrip(",").lower()
    return last.endswith(_TYPE_ENDS) or len(words) > 1 and words[-2] in _STREET_LEADS


def addresses(t: str, follow: list[int], precede: list[int]) -> list[tuple[int, int]]:
    """Spans of street and house number, with postcode and town if they follow. ``follow`` and
    ``precede``: places of numbers as ``landmarks`` gives them."""
    out, end = [], 0
    behind, ahead = set(follow), set(precede)
    for n in sorted(behind | ahead):
        if n < end:
            continue
        if n in behind:
            left = max(end, n - STREET_REACH)
            street = _STREET_NUMBER.match(t, left, n) if _may_be_street(t[left:n].rsplit(None, 3)[-3:]) else None
            if street and (rest := _AFTER_STREET.match(t, n)):
                a = street.start()
                while lead := _LEADING_WORD.match(t, a, n):
                    a = lead.end()
                end = rest.end()
                out.append((a, end))
                continue
        if n in ahead and (whole := _NUMBER_STREET.match(t, n)):
            end = whole.end()
            out.append((n, end))
    return out


class Spans:
    """Taken spans, without overlaps."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.found, (a,))
        return (at == 0 or self.found[at - 1][1] <= a) and (at == len(self.found) or self.found[at][0] >= b)

    def take(self, a: int, b: int, kind: str) -> None:
        if b > a and self.free(a, b):
            bisect.insort(self.found, (a, b, kind))


def identifiers(norm: Normal, follow: list[int] | None = None, precede: list[int] | None = None) -> Spans:
    """Spans in the normalised text of all but names, by certainty of kind; ``follow`` and
    ``precede``: places of numbers as ``landmarks`` gives them."""
    t, spans = norm.text, Spans()
    at, end = t.find("@"), 0
    while at >= 0:
        if (local := _LOCAL_PART.match(t, end, at)) and (host := _HOST.match(t, at)):
            end = host.end()
            spans.take(local.start(), end, "email")
        at = t.find("@", max(at + 1, end))
    if follow is None or precede is None:
        follow, precede = (x[0] for x in landmarks([t])[:2])
    size, done = len(t), 0
    for c in _LABELLED_NUMBER.finditer(t):
        if c.start() < done:
            continue
        for label in _ID_LABEL.finditer(t, max(done, c.start() - LABEL_REACH), c.start() + 1):
            if (m := _LABELLED_ID.match(t, label.end())) and m.start() <= c.start() < m.end():
                done = m.end()
                if sum(x.isdigit() for x in m.group()) >= 5:
                    spans.take(*m.span(), "id_number")
    for c in _LONG_NUMBER.finditer(t):
        for m in _BARE_ID.finditer(t, max(0, c.start() - 3), min(size, c.end() + 3)):
            spans.take(*m.span(), "id_number")
    for a, b in addresses(t, follow, precede):
        spans.take(a, b, "address")
    for c in _DIGITS_TOGETHER.finditer(t):
        a, b = max(0, c.start() - 4), min(size, c.end() + 3)
        for p in _PHONE:
            for m in p.finditer(t, a, b):
                if 6 <= sum(x.isdigit() for x in m.group()) <= 15:
                    spans.take(m.start(), m.end(), "phone")
    return spans


def is_french(text: str, lang: str | None) -> bool:
    """By common words, the declared language deciding ties."""
    french = sum(text.count(w) for w in (" le ", " la ", " les ", " est ", " une "))
    other = sum(text.count(w) for w in (" der ", " die ", " und ", " the ", " of "))
    return french > other or french == other and str(lang).lower().startswith("fr")


def name_candidates(norm: Normal, taken: Spans, lang: str | None, capitals: list[int]) -> list[tuple[int, int, str, str, str, bool]]:
    """``(start, end, given, middle, surname, sure?)`` in the normalised text; they may overlap.
    ``given`` is '' for an initial or a surname alone, ``middle`` the second of three names; words
    in title case. ``capitals``: places as ``landmarks`` gives them."""
    t, out = norm.text, []
    signed = {m.end() for m in _CLOSING.finditer(t)} if any(w in t for w in _CLOSING_HINTS) else ()
    french = None
    for a in capitals:
        m = _NAME.match(t, a)
        given, surname = (m["g1"] or m["g2"], m["s1"] or m["s2"]) if m else ("", "")
        if given in NOT_NAMES or given in _TITLE_WORDS or surname in NOT_NAMES or given == "M." or not m:
            if t[a] in "HFMDP" and (one := _ONE_NAME.match(t, a)) and one["s"] not in NOT_NAMES and one["s"] not in _OFFICES and taken.free(*one.span("s")):
                if t.startswith("M.", a):
                    french = is_french(t, lang) if french is None else french
                if (not out or out[-1][:2] != one.span("s")) and (french or not t.startswith("M.", a)) and not ((full := _NAME.match(t, one.start("s"))) and NOT_NAMES.isdisjoint(full.group("s1", "s2", "g1", "g2"))):
                    out.append((*one.span("s"), "", "", one["s"].title(), True))
            if not m or given in NOT_NAMES or given in _TITLE_WORDS or surname in NOT_NAMES:
                continue
        b = m.end()
        if not taken.free(a, b):
            continue
        left = max(0, a - TITLE_REACH)
        if given.endswith("."):
            if _BY_ORDER.match(t, left, a):
                continue
            if given == "M." and m["g2"]:
                french = is_french(t, lang) if french is None else french
                if french:
                    continue
        if _SCHOOL_BEFORE.match(t, left, a):
            continue
        sure = bool(_TITLE_BEFORE.match(t, left, a)) or a in signed and t[b : b + 1] in ("", "\n", "\r")
        given = "" if given.endswith(".") else given.title()
        out.append((a, b, given, "", surname.title(), sure))
        if given and m["g2"] and (third := _THIRD.match(t, b)) and third["s"] not in NOT_NAMES and taken.free(a, third.end()):
            out.append((a, third.end(), given, surname.title(), third["s"].title(), sure))
    return out


def _surname_parts(c):  # noqa: ANN001, ANN202
    return F.array_distinct(F.concat(F.array(c), F.split(c, "-")))


def _found(documents: DataFrame, id_col: str, text_col: str, lang_col: str | None, origin_col: str | None) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    scanned = F.coalesce(F.col(origin_col) == "scan", F.lit(False)) if origin_col else F.lit(False)
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"), scanned.alias("scanned")).filter(F.length("text") > 0)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            sizes = np.cumsum([len(t) for t in b["text"]]) // MARKED_TOGETHER
            for _, part in b.groupby(sizes, sort=False):
                norms = [normalise(t, bool(scan), *s) for t, scan, *s in zip(part["text"], part["scanned"], *signs(part["text"].tolist()), strict=True)]
                for doc, lang, norm, follow, precede, letters in zip(part["doc_id"], part["lang"], norms, *landmarks([n.text for n in norms]), strict=True):
                    known = identifiers(norm, follow, precede)
                    rows += [(doc, *norm.source(s, e), kind, None, None, None, True) for s, e, kind in known.found]
                    rows += [(doc, *norm.source(s, e), "name", *parts) for s, e, *parts in name_candidates(norm, known, lang, letters)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos", "kind", "given", "middle", "surname", "sure"])

    return staged(bounded_batches(source).mapInPandas(find, "doc_id long, start_pos long, end_pos long, kind string, given string, middle string, surname string, sure boolean"), "found")


def name_lexicon(candidates: DataFrame) -> DataFrame:
    """``(role, word)`` with role ``given`` or ``surname``: words met in sure places often enough."""
    candidates = candidates.filter(F.col("middle") == "")
    given = candidates.filter(F.col("given") != "").select(F.lit("given").alias("role"), F.col("given").alias("word"), "sure")
    surname = candidates.select(F.lit("surname").alias("role"), F.explode(_surname_parts(F.col("surname"))).alias("word"), "sure")
    counted = given.unionByName(surname).groupBy("role", "word").agg(F.count(F.lit(1)).alias("n"), F.count_if("sure").alias("sure"))
    return counted.filter((F.col("sure") >= SURE_TIMES) & (F.col("sure") >= SURE_SHARE * F.col("n"))).select("role", "word")


def find_personal(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", origin_col: str | None = "origin") -> DataFrame:
    """``(doc_id, start_pos, end_pos, kind)`` of all texts."""
    found = _found(documents, id_col, text_col, lang_col, origin_col)
    names = found.filter(F.col("kind") == "name")
    lexicon = staged(name_lexicon(names), "lexicon")
    n = lexicon.count()
    role = lambda r, c: bounded_broadcast(lexicon.filter(F.col("role") == r).select(F.col("word").alias(c), F.lit(True).alias(f"known_{c}")), n, BROADCAST_NAMES)
    # titles decide alone; other candidates need both words in the lexicon
    triples, pairs = names.filter("middle <> ''"), names.filter("middle = ''")
    unsure = pairs.filter(~F.col("sure")).withColumn("part", F.explode(_surname_parts(F.col("surname"))))
    unsure = unsure.join(role("surname", "part"), "part").join(role("given", "given"), "given", "left").filter(F.col("known_given") | (F.col("given") == ""))
    # of three names the middle one must be a given name too, or a patronymic, and the last a surname
    whole = triples.withColumn("part", F.explode(_surname_parts(F.col("surname")))).join(role("surname", "part"), "part", "left").join(role("given", "given"), "given", "left").join(role("given", "middle"), "middle", "left")
    patronymic = F.col("middle").rlike(_PATRONYMIC_JVM)
    whole = whole.filter(F.col("known_part") & F.col("known_middle") & (F.col("sure") | F.col("known_given")) | patronymic & (F.col("sure") | F.col("known_given") | F.col("known_part")))
    keep = ["doc_id", "start_pos", "end_pos", "kind"]
    kept = pairs.filter("sure").select(*keep, F.lit(1).alias("rank")).unionByName(unsure.select(*keep, F.lit(2).alias("rank"))).unionByName(whole.select(*keep, F.lit(0).alias("rank")))
    spans = kept.groupBy("doc_id").agg(F.collect_set(F.struct("start_pos", "end_pos", "rank")).alias("spans"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, spans in zip(b["doc_id"], b["spans"], strict=True):
                chosen: list[tuple[int, int]] = []
                last = -1
                for s in sorted(spans, key=lambda s: (s["start_pos"], s["rank"], -s["end_pos"])):
                    if s["start_pos"] >= last:
                        chosen.append((s["start_pos"], s["end_pos"]))
                        last = s["end_pos"]
                rows += [(doc, s, e, "name") for s, e in chosen]
            yield pd.DataFrame(rows, columns=keep)

    settled = spans.mapInPandas(settle, "doc_id long, start_pos long, end_pos long, kind string")
    return found.filter(F.col("kind") != "name").select(*keep).unionByName(settled)


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", origin_col: str | None = "origin") -> DataFrame:
    """``(doc_id, text)`` of every document, findings replaced by ``<EMAIL>``, ``<PHONE>``,
    ``<ID_NUMBER>``, ``<ADDRESS>`` and ``<NAME>``; null texts stay null."""
    spans = find_personal(documents, id_col, text_col, lang_col, origin_col).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id", "left")

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["spans"], strict=True):
                parts, at = [], 0
                for s in spans if spans is not None else ():
                    parts += [text[at : s["start_pos"]], f"<{s['kind'].upper()}>"]
                    at = s["end_pos"]
                out.append("".join(parts) + text[at:] if isinstance(text, str) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out})

    return texts.mapInPandas(replace, "doc_id long, text string")
