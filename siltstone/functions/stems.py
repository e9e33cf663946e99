"""English lexemes: words without function words, by their stems (the published Porter2 rules)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the stemmer: forms that follow no rule, and suffixes with what takes their place.
FORMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
FORMS |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


def _suffix(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _region(word: str, start: int) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch("[aeiouy][^aeiouy]", word))


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a word in small letters."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in FORMS:
        return FORMS[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word.lstrip("'"))
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    second = _region(w, first)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in KEPT:
        return w
    if s := _suffix(w, ("eed", "eedly")):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= first else w
    elif (s := _suffix(w, ("ed", "edly", "ing", "ingly"))) and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif first >= len(w) and _short_end(w):
            w += "e"
    w = re.sub("(?<=.[^aeiouy])[yY]$", "i", w)
    if (s := _suffix(w, SECOND)) and len(w) - len(s) >= first and (s != "ogi" or w[:-3].endswith("l")) and (s != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(s)] + SECOND[s]
    if (s := _suffix(w, THIRD)) and len(w) - len(s) >= (second if s == "ative" else first):
        w = w[: -len(s)] + THIRD[s]
    if (s := _suffix(w, FOURTH)) and len(w) - len(s) >= second and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= second or (len(w) - 1 >= first and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.lower()


def lexemes(stop_words: list[str]):
    """A column function text -> stems of its words, without function words."""
    stop = frozenset(stop_words)

    @F.pandas_udf(ArrayType(StringType()))
    def analyze(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [stem(w) for w in WORD.findall(t.lower()) if w not in stop], na_action="ignore")

    return analyze
