"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980; with the author's later rules for -bli and -logi)."""

from __future__ import annotations

import re

#: The rules of steps 2 to 4, as suffix and replacement.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_FORM = re.compile(r"c*((?:v+c+)*)v*\Z")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or x == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _FORM.match(_shape(stem))[1]))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _twice(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replaced(word: str, rules) -> str:
    """By the longest suffix that a rule has, if what is before it has a measure above 0."""
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found and _measure(word[: -len(found[0])]) > 0:
        return word[: -len(found[0])] + found[1]
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word. Words of up to two letters, and those with other characters than a-z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                rest = word[: -len(suffix)]
                if "v" in _shape(rest):
                    word = rest
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _twice(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default="")
    rest = word[: len(word) - len(suffix)]
    if suffix and _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
        word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short(rest):
            word = rest
    if _measure(word) > 1 and _twice(word) and word.endswith("l"):
        word = word[:-1]
    return word
