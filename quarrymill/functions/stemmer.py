"""A light German stemmer after the published Snowball description."""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the description.
VOWELS = frozenset("aeiouyäöü")
S_ENDING, ST_ENDING = frozenset("bdfghklmnrt"), frozenset("bdfghklmnt")


def _regions(w: str) -> tuple[int, int]:
    """Starts of the two regions after the first, and second, non-vowel that follows a vowel."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    first = after(0)
    return max(3, first), after(first) if first < len(w) else len(w)


@lru_cache(maxsize=100_000)
def german_stem(word: str) -> str:
    w = word.lower().replace("ß", "ss")
    # u and y between vowels are consonants
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in VOWELS and w[i + 1] in VOWELS else c for i, c in enumerate(w))
    r1, r2 = _regions(w)

    def ends(*suffixes: str) -> str:
        return next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s)), "")

    s = ends("em", "ern", "er", "e", "en", "es", "s")
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in S_ENDING):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = ends("en", "er", "est", "st")
    if s and len(w) - len(s) >= r1 and (s != "st" or (w[-3:-2] in ST_ENDING and len(w) >= 6)):
        w = w[: -len(s)]
    s = ends("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")
    if s and len(w) - len(s) >= r2:
        if s in ("end", "ung"):
            w = w[: -len(s)]
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            if w[-len(s) - 1 : -len(s)] != "e":
                w = w[: -len(s)]
        elif s in ("lich", "heit"):
            w = w[: -len(s)]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[: -len(s)]
            for t in ("lich", "ig"):
                if w.endswith(t) and len(w) - len(t) >= r2:
                    w = w[: -len(t)]
                    break
    return w.replace("U", "u").replace("Y", "y").replace("ä", "a").replace("ö", "o").replace("ü", "u")
