"""Letters of other scripts that look like Latin ones."""

from __future__ import annotations

import regex

# Cyrillic and Greek letters with a Latin lookalike.
LOOKALIKE = str.maketrans(
    "АВЕКМНОРСТУХаеорсухіјѕԁԛԝһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχ",
    "ABEKMHOPCTYXaeopcyxijsdqwh" + "ABEZHIKMNOPTYXaeikvoptux",
)


_MIXED = regex.compile(r"[\p{L}\p{M}]*[\p{Cyrillic}\p{Greek}][\p{L}\p{M}]*")
_FOREIGN = regex.compile("[\u0370-\u03ff\u0400-\u052f]")
_LATIN = regex.compile(r"\p{Latin}")


def fold_lookalikes(s: str) -> str:
    """Replace lookalikes one by one in words that also hold Latin letters; length stays."""
    if s.isascii() or not _FOREIGN.search(s):
        return s
    return _MIXED.sub(lambda m: m.group().translate(LOOKALIKE) if _LATIN.search(m.group()) else m.group(), s)
