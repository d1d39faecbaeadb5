"""Text functions: folding, tokens, query cleaning, snippets, stemming."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.types import StringType
from pyspark.sql import Column, functions as F


def _accents() -> tuple[str, str]:
    """Latin letters with marks and what they decompose to, made from the Unicode tables."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold(c: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # Only words with letters beyond ASCII go through the table.
    return F.transform(words, lambda w: F.when(w.rlike(r"[^\x00-\x7F]"), F.translate(w, ACCENTED, PLAIN)).otherwise(w))


def sanitize_query(c: Column) -> Column:
    """Everything but word characters and white space becomes a space."""
    return F.trim(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def snippet(c: Column, lines: int = 10) -> Column:
    """The first lines, with dots on a line of their own if there are more."""
    parts = F.split(c, "\n", -1)
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n..."))).otherwise(c)


def contains_pattern(path: Column, pattern: str) -> Column:
    """Substring filter on a path; ``%`` and ``_`` in the pattern are wildcards, case does not matter."""
    return F.lower(path).like(f"%{pattern.lower()}%")


_VOWEL = "aeiou"


def _forms(w: str) -> str:
    """The word as a string of c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in _VOWEL or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _forms(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _forms(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _forms(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _forms(w)[-3:] == "cvc" and w[-1] not in "wxy"


# Fixed values of the published algorithm (Porter 1980), steps 2, 3 and 4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(w: str) -> str:
    """The Porter stem of a lower-case word."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and _has_vowel(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if hit:
        stem = w[: -len(hit)]
        if _measure(stem) > 1 and (hit != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


_stems: dict[str, str] = {}


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Porter stems; each distinct word is worked out once while the dictionary fits."""
    out = []
    for w in words:
        s = None if w is None else _stems.get(w)
        if s is None and w is not None:
            if len(_stems) > 1_000_000:
                _stems.clear()
            s = _stems[w] = porter(w)
        out.append(s)
    return pd.Series(out, dtype=object)
