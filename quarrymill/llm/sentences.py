"""Sentence boundaries across languages and scripts.

Candidates are the places after final marks with the closing quotes and brackets that follow. Each
is decided by the first rule whose two patterns match the text before and after it: rules common
to all texts first, then those of the scripts and languages found in the block, then the rest.
Blank lines always end a sentence, list items begin one on their own line, in Thai a blank between
letters ends one, and other line breaks are blanks.

Offsets count code points from 0, ends are exclusive, sentences carry no white space around them.
Null, empty and blank texts have none. Whole texts are read, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.tables import bounded_batches

L = r"[\p{L}\p{M}]"
OPEN = r"[\"'„“”«»‹›‚‘’(\[{「『（〈《【]"
BREAK, JOIN = True, False

_BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x85 ])[^\S\n\r\x85 ]*(?:\r\n|[\n\r\x85 ])\s*| \s*")
_CANDIDATE = regex.compile(
    r"(?:[.!?…。．！？｡।॥؟۔‼⁇⁈⁉]+|(?<=[\p{Greek}\p{M}\d\)»])[;;])"
    r"(?:(?:[”“’»«›‹\)\]}」』）〉》】]|\"(?![\p{L}\p{N}])|'(?![\p{L}\p{N}]))+|[   ]»)?"
)

# Abbreviations, by language. NUMBERED ones stand before a number or code, TITLES
# before a name, INNER ones never end a sentence, FINAL ones may.
NUMBERED = {
    "de": "Nr Nrn Abb Abs Abschn Anl Art Aufl Az Bd Bl Fl Flst Hs Jh Kap Lfd lfd Rn Rz S Seiten Sp Str Tab Tel Fax Ziff Z Buchst H Pos",
    "en": "No no Nos nos Fig fig Figs Sec sec Secs Ch ch p pp P Vol vol Art art Nr Para para Eq Tab Tel Ext",
    "fr": "n no art Art fig Fig p pp chap vol al éd t",
    "ru": "стр рис табл гл ст п пп № кв д корп оф", "el": "αρ σελ αριθ κεφ παρ εικ", "hi": "क्र पृ", "ar": "ص رقم ج",
}
TITLES = {
    "de": "Dr Prof Dipl Ing Hr Fr Frl Mag St Hl Pfr Reg Min Med Bgm gez i", "en": "Mr Mrs Ms Messrs Dr Prof St Rev Hon Gen Col Capt Lt Sgt Sr", "fr": "M MM Mme Mlle Dr Pr Me St Ste av bd",
    "ru": "ул им г-н пр просп пл пер наб о св проф акад", "el": "κ κα κκ Δρ", "hi": "डॉ श्री", "ar": "د أ م",
}
INNER = {
    "de": "allg bes bzgl bzw ca dgl ebd einschl entspr erg evtl exkl gem ggf ggfs inkl insb insbes lt max mind min nördl östl südl westl rd sog s o u v vgl Vgl z zzgl zzt Hrsg d i ehem gegr geb kath ev Mio Mrd Mo Di Mi Do Fr Sa So Jan Feb Aug Sept Okt Nov Dez",
    "en": "approx Approx ca cf e eg ie i viz vs est incl excl Jan Feb Aug Sept Oct Nov Dec", "fr": "env Env ex cf c v resp",
    "ru": "т е напр ок см тыс млн млрд руб", "el": "π χ δηλ βλ κ", "hi": "कि मी", "ar": "",
}
FINAL = {"de": "usw etc MwSt ff f Co KG h Chr Uhr Std Min", "en": "etc Ltd Inc Corp Co Jr Sr a.m p.m", "fr": "etc", "ru": "д п г гг в вв", "el": "κτλ λπ", "hi": "", "ar": ""}
# The same of further languages in Latin script, which are used where their function words prevail.
FURTHER = {
    "es": {"NUMBERED": "núm nº art arts pág págs fig vol cap tel apdo", "TITLES": "Sr Sra Srta Dr Dra Prof D Dª Ing Lic Arq Av Avda Ud Uds", "INNER": "aprox máx mín p ej vid cf c s", "FINAL": "etc S.A S.L a.C d.C"},
    "it": {"NUMBERED": "n nn art artt pag pagg fig vol cap tel", "TITLES": "Sig Sigg Sig.ra Dott Dott.ssa Prof Ing Arch Avv On S", "INNER": "ca es max min cfr vd c s", "FINAL": "ecc S.p.A S.r.l a.C d.C"},
    "pt": {"NUMBERED": "nº núm art arts pág págs fig vol cap tel", "TITLES": "Sr Sra Dr Dra Prof Eng Arq Av D", "INNER": "aprox máx mín p ex cf c s", "FINAL": "etc S.A Lda Ltda a.C d.C"},
    "nl": {"NUMBERED": "nr nrs art blz fig hfdst par tel", "TITLES": "dhr mevr mw dr prof ir ing drs mr", "INNER": "ca bijv bv d w z o a i v m incl excl max min resp evt", "FINAL": "enz etc B.V N.V"},
    "pl": {"NUMBERED": "nr art ust pkt poz rys str tab tel", "TITLES": "dr prof inż mgr ul al pl os św", "INNER": "np tzn tj ok m in r.b ww max min", "FINAL": "itd itp in r w tys mln"},
    "tr": {"NUMBERED": "No no md s sf şek tel", "TITLES": "Dr Prof Doç Av Sn Cad Sok Mah", "INNER": "örn bkz yak vs maks min", "FINAL": "vb vd A.Ş Ltd Şti"},
}
#: Function words that tell them from each other and from German, English and French.
FURTHER_WORDS = {
    "es": "el|los|las|y|con|por|del|una|como|más|pero|está", "it": "il|della|che|per|gli|nel|sono|anche|di|con|dello|alla", "pt": "os|dos|das|não|uma|com|para|ao|pela|são|em",
    "nl": "het|een|van|niet|met|zijn|voor|dat|ook|wordt|aan", "pl": "się|jest|nie|oraz|przez|przy|dla|że|na|została", "tr": "ve|bir|bu|için|ile|olarak|değil|daha|olan|çok",
}
#: A text with fewer function words of German, English or French in so many characters is tried for
#: the further languages.
SPARSE = 120
#: Abbreviations of FINAL that go on before a NUMBERED one: "§§ 4 f. Nr. 2".
CITING = {"de": "f ff", "en": "f ff seq"}
MONTHS = (
    "Jan(?:uar|uary)?|Jän(?:ner)?|Feb(?:ruar|ruary|er)?|März|Mär|Apr(?:il)?|Mai|Juni?|Juli?|Aug(?:ust)?|Sept?(?:ember)?|Okt(?:ober)?|Nov(?:ember)?|Dez(?:ember)?|"
    "Quartal|Halbjahr|Jahrhundert|Jh|Änderung|Auflage|Bauabschnitt|Obergeschoss|Stock|OG|UG|Auslegung|Sitzung|Fassung|Nachtrag|Abschnitt"
)
ORDINAL_LEADS = "der|die|das|dem|den|des|am|vom|zum|zur|bis|im|ab|beim|ein|eine|einem|einen|einer|seit|und|oder|sowie|ihre?r?|seine?r?|jede[rsnm]?|diese[rsnm]?|nach|vor"


def _words(names: str) -> str:
    # letters with marks may be decomposed
    import unicodedata

    out = []
    for w in sorted(names.split(), key=len, reverse=True):
        forms = {w, unicodedata.normalize("NFD", w)}
        out += [regex.escape(f) for f in sorted(forms)]
    return "|".join(out) or r"(?!)"


def _table(lang: str) -> list[tuple[bool, str, str]]:
    b = r"(?<![\p{L}\p{M}\p{N}])"
    numbered, titles, inner, final = FURTHER[lang].values() if lang in FURTHER else (t[lang] for t in (NUMBERED, TITLES, INNER, FINAL))
    return [
        (JOIN, rf"{b}(?:{_words(numbered)})\.", r"\s*(?:[(+§]*\p{N}|§|[IVXLC]+\b|\p{Lu}{1,4}[/\-–.]?\s?\p{N}|\p{Lu}\b(?![.'’\s]\s*\p{Ll}))"),
        (JOIN, rf"{b}(?:{_words(titles)})\.", rf"\s*(?:\p{{Lu}}|{L})"),
        (JOIN, rf"{b}(?:{_words(inner)})\.", r"\s*\S"),
        (JOIN, rf"\d\s*(?:{_words(CITING.get(lang, ''))})\.", rf"\s+(?:{_words(numbered)})\.\s*\p{{N}}"),
        (BREAK, rf"{b}(?:{_words(final)})\.", r"\s+[\p{Lu}\p{Lo}\"„“«»(\[]"),
    ]


#: Ordered rules ``(break?, before, after)``; the first that matches decides.
COMMON: list[tuple[bool, str, str]] = [
    (BREAK, r"", r"\s*\Z"),
    (JOIN, r"", r"\s*[,;:·،؛、，；：]"),
    (JOIN, r"[”“\"»«’'›‹]", r"\s*[–—-]\s"),
    # a sentence goes on in lower case, whatever the mark
    (JOIN, r"", r"\s+\p{Ll}"),
    (JOIN, r"(?:…|\.\.)", r"\s*[\p{Ll}\p{Lo}]"),
    # nothing between: only a new capitalised word or an opening quote begins a sentence
    (JOIN, r"(?<![\p{L}\p{M}])\p{L}\p{M}*\.", r"[\p{L}\p{N}]"),
    (JOIN, r"[.!?…]", r"[^\s\p{Lu}\p{Lo}„“«\"(\[]"),
    (JOIN, r"[.!?…]", r"\p{Lu}(?![\p{Ll}\p{M}'’\s])"),
]
FIRMS: list[tuple[bool, str, str]] = [
    (JOIN, r"(?<![\p{L}\p{N}])Co\.", r"\s*(?:KG|KGaA|OHG|GmbH)"),
    (JOIN, r"(?<![\p{L}\p{N}])Ltd\.", r"\s*(?:&|and\b|Sons)"),
]
LATIN: list[tuple[bool, str, str]] = [
    (JOIN, r"(?i:str|pl|all|av|bd|rd)\.", r"\s*(?:\d|(?:Nr|No|Haus)\b)"),
    (BREAK, r"\d{1,2}\.\s?\d{1,2}\.\s?\d{2,4}\.", r"\s"),
    # ordinals and days of German dates
    (JOIN, r"(?<![\p{L}\p{N}.,/])\d{1,2}\.", rf"\s+(?:{MONTHS})(?![\p{{Ll}}])"),
    (JOIN, rf"(?i:(?<!{L})(?:{ORDINAL_LEADS}))\s+(?:\d{{1,3}}\.(?:\s*(?:/|und|bis|oder|–)\s*))?\d{{1,3}}\.", r"\s+\p{L}"),
    (JOIN, r"(?<![\p{L}\p{N}.,/])\d{1,2}\.", r"\s*\d{1,2}\."),
    # initials, but not letters that count plans or parts
    (BREAK, r"(?<!\p{L})(?:Anlage|Teil|Part|Annex|Block|Plan|Variante|Option|Abschnitt|Haus|Gebäude|Bauteil|Zone|Phase|Los)\s\p{Lu}\.", r"\s+\p{Lu}"),
    (JOIN, r"(?<![\p{L}\p{N}\-–/])\p{Lu}\p{M}*\.", r"\s*(?:\p{Lu}|\p{Ll})"),
    (JOIN, r"(?<![\p{L}\p{N}\-–/])\p{Lu}\p{M}*\.", r"-\p{Lu}"),
]
CJK: list[tuple[bool, str, str]] = [
    (JOIN, r"…", r"."),
    (BREAK, r"[：:，,][“「『\"][^“”「」『』]*[。！？!?…]+[”」』\"]", r""),
    (JOIN, r"[。！？!?…]+[」』]", r"\s?(?:と|って|という|との|の|を|が|は|に|も|で|へ|から|など)"),
    (JOIN, r"[。！？!?…]+[”』\"]", r"(?:的|之|这|那|等|是|[^。！？!?“”\n]{0,12}(?:说|道|问|喊|叫|答|表示|回应|写)[^。！？!?“”\n]{0,4}[。！？!?])"),
    (BREAK, r"[。！？｡．!?]", r""),
]
REST: list[tuple[bool, str, str]] = [
    (JOIN, r"[.…]", r"(?=\S)[^\s\p{Lu}\p{Lo}„“«\"(\[]"),
    (BREAK, r"", r""),
]


def _plain_word(langs: tuple[str, ...]) -> tuple[bool, str, str]:
    """Most marks: after a word that is no abbreviation anywhere, before a capitalised word."""
    tables = [names for t in (NUMBERED, TITLES, INNER, FINAL) for names in t.values()] + [names for lang in langs if lang in FURTHER for names in FURTHER[lang].values()]
    short = " ".join(w for names in tables for w in names.split() if len(w) > 2)
    return BREAK, rf"(?<!(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_words(short)}))(?<=\p{{L}}{{3}})[.!?]", r"\s+\p{Lu}\p{Ll}"


@cache
def rules(langs: tuple[str, ...]) -> list[tuple[bool, regex.Pattern]]:
    """The cascade for a block: each rule as one pattern with both contexts."""
    latin = bool({"de", "en", "fr"} & set(langs))
    table = [_plain_word(langs), *COMMON] if latin else list(COMMON)
    if "cjk" in langs:
        table += CJK
    if latin:
        table += FIRMS
    for lang in langs:
        if lang in NUMBERED or lang in FURTHER:
            table += _table(lang)
    table += LATIN if latin else LATIN[-2:] if "ru" in langs or "el" in langs else []
    return [(kind, regex.compile(rf"(?<={before})(?={after})" if before else rf"(?={after})")) for kind, before, after in table + REST]


_SCRIPTS = [("cjk", r"[\p{Han}\p{Hiragana}\p{Katakana}]"), ("th", r"\p{Script=Thai}"), ("hi", r"\p{Devanagari}"), ("ar", r"\p{Arabic}"), ("el", r"\p{Greek}"), ("ru", r"\p{Cyrillic}"), ("latin", r"\p{Latin}")]
_SCRIPTS = [(k, regex.compile(p)) for k, p in _SCRIPTS]
_LANGS = {"de": "de", "ger": "de", "deu": "de", "en": "en", "eng": "en", "fr": "fr", "fra": "fr", "fre": "fr"}
_TELL = {k: regex.compile(rf"(?<!\p{{L}})(?:{v})(?!\p{{L}})", regex.I) for k, v in {"de": "der|die|das|und|ist|nicht|mit|von|den|im|zu|auf", "en": "the|of|and|is|at|by|to|for|with", "fr": "le|la|les|des|est|une|du|et|pour|au"}.items()}

_TELL_FURTHER = {k: regex.compile(rf"(?<!\p{{L}})(?:{v})(?!\p{{L}})", regex.I) for k, v in FURTHER_WORDS.items()}


def scripts(text: str) -> tuple[str, ...]:
    return ("latin",) if text.isascii() else tuple(k for k, p in _SCRIPTS if p.search(text))


def latin_order(text: str, declared: str | None) -> tuple[str, ...]:
    """Languages in Latin script, the likeliest first: by function words, then as declared."""
    first = _LANGS.get((declared or "").lower()[:3]) or _LANGS.get((declared or "").lower()[:2])
    score = {k: len(p.findall(text)) + (0.5 if k == first else 0) for k, p in _TELL.items()}
    best, told = max(score.values()), (declared or "").lower()[:2]
    if best * SPARSE < len(text) or told in FURTHER:
        further = {k: len(p.findall(text)) + (0.5 if k == told else 0) for k, p in _TELL_FURTHER.items()}
        likeliest = max(further, key=further.__getitem__)
        if further[likeliest] > best:
            score[likeliest] = further[likeliest]
    return tuple(sorted(score, key=lambda k: -score[k]))


def languages(found: tuple[str, ...], latin: tuple[str, ...]) -> tuple[str, ...]:
    """Rule tables in order: the scripts found, then the languages in Latin script."""
    return tuple(k for k in found if k != "latin") + (latin if "latin" in found or not found else ())


_ADDRESS = regex.compile(r"@|://|www\.", regex.I)
_SPACE = regex.compile(r"\s")
_THAI = regex.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])")
_MARKER = regex.compile(r"\s*(?:\(?(?:\d{1,3}|\p{L})[.)])(?=\s)")
_FIRST_ITEM = regex.compile(r"[^\S\n\r]*(?:([-–—*•◦▪‣·○●■□✓➢])|(\()?(\d{1,3}|\p{L})([.)]))(?=[^\S\n\r]+\S)")
_ITEM = regex.compile(r"(?<=[\n\r])[^\S\n\r]*(?:([-–—*•◦▪‣·○●■□✓➢])|(\()?(\d{1,3}|\p{L})([.)]))(?=[^\S\n\r]+\S)")


def _addresses(block: str) -> list[tuple[int, int]]:
    """Spans without white space around web and mail addresses."""
    spans, end = [], 0
    for m in _ADDRESS.finditer(block):
        if m.start() < end:
            continue
        start = next((x.end() for x in regex.finditer(r"(?r)\s", block, endpos=m.start())), 0)
        end = x.start() if (x := _SPACE.search(block, m.end())) else len(block)
        spans.append((start, end))
    return spans


def _list_starts(block: str) -> list[int]:
    """Where list items begin on their own line."""
    starts: list[int] = []
    kind: tuple | None = None
    due: str | None = None
    at_start = _FIRST_ITEM.match(block)
    for m in ([at_start] if at_start else []) + list(_ITEM.finditer(block)):
        bullet, opened, label, closing = m.groups()
        before = block[: m.start()].rstrip()
        intro = not before or before[-1] in ":;："
        this = (bullet,) if bullet else (opened, closing, label.isdigit())
        following = label and (label == due)
        starts_list = intro and (bullet or label in ("1", "a", "A", "i", "I") or (closing == ")" and len(label) <= 2))
        if (kind == this and (bullet or following)) or starts_list or (bullet in tuple("•◦▪‣●■□✓➢") and bullet):
            if m.start():
                starts.append(m.start())
            kind = this
            due = (str(int(label) + 1) if label.isdigit() else chr(ord(label) + 1)) if label else None
    return starts


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Spans of the sentences of a text."""
    if not text or not text.strip():
        return []
    spans: list[tuple[int, int]] = []
    found = scripts(text)
    latin = latin_order(text, lang) if "latin" in found or not found else ()
    at = 0
    for gap in [*_BLANK_LINE.finditer(text), None]:
        end = gap.start() if gap else len(text)
        if end > at:
            for s, e in _block_spans(text[at:end], found, latin):
                spans.append((at + s, at + e))
        at = gap.end() if gap else end
    return spans


def _closed(block: str, start: int, end: int) -> int:
    """End of a mark without quotes that open what follows instead of closing what precedes."""
    p = end
    for k in range(start, end):
        c = block[k]
        if c == "“" and block.count("„", 0, k) <= block.count("“", 0, k) or c == "«" and block.count("»", 0, k) <= block.count("«", 0, k) or c == "»" and block.count("«", 0, k) <= block.count("»", 0, k):
            p = k
            break
    return start + len(block[start:p].rstrip())


def _block_spans(block: str, found: tuple[str, ...], latin: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    if not block.strip():
        return
    langs = languages(found if len(found) < 2 else scripts(block), latin)
    table = rules(langs)
    cuts = set(_list_starts(block)) if "\n" in block or "\r" in block else set()
    markers = {}
    for c in [0, *cuts]:
        if m := _MARKER.match(block[c : c + 12]):
            markers[c + m.end()] = True
    shielded = _addresses(block)
    for m in _CANDIDATE.finditer(block):
        p = m.end()
        mark = m.group()
        if len(mark) > 1:
            p = _closed(block, m.start(), p)
        if p in markers or any(s < m.start() and p < e for s, e in shielded):
            continue
        if mark[0] in ";;" and "el" not in langs:
            continue
        for kind, pattern in table:
            if pattern.match(block, p):
                if kind:
                    cuts.add(p)
                break
    if "th" in langs:
        cuts.update(m.start() for m in _THAI.finditer(block))
    at = 0
    for cut in [*sorted(cuts), len(block)]:
        piece = block[at:cut]
        core = piece.strip()
        if core:
            start = at + len(piece) - len(piece.lstrip())
            yield start, start + len(core)
        at = cut


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``(doc_id, sent_no, start_pos, end_pos, sentence)`` of every text; a map without shuffle."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")).filter(F.col("text").isNotNull())

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                rows += [(doc, i, s, e, text[s:e]) for i, (s, e) in enumerate(sentence_spans(text, lang if isinstance(lang, str) else None))]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_no", "start_pos", "end_pos", "sentence"])

    return bounded_batches(source).mapInPandas(split, "doc_id long, sent_no int, start_pos long, end_pos long, sentence string")
