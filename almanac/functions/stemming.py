"""English stop words and stems, as a full-text index keeps them."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that are not indexed.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don should now""".split()

# The public Snowball algorithm for English: words apart, and endings with what takes their place.
_APART = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_APART |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_LATER = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()

_V, _NV = "[aeiouy]", "[^aeiouy]"
_SHORT = re.compile(rf"(?:^{_V}{_NV}|{_NV}{_V}[^aeiouywxY])$")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    head = re.match("gener|commun|arsen", w)
    one = head.end() if head else (m.end() if (m := re.search(_V + _NV, w)) else len(w))
    two = one + m.end() if (m := re.search(_V + _NV, w[one:])) else len(w)
    return one, two


def _longest(w: str, endings) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words with other letters stay as they are."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _APART:
        return _APART[word]
    w = re.sub(f"(^|{_V})y", lambda m: m[1] + "Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    # endings of the plural
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _LATER:
        return w
    # endings of the past and of participles
    if (end := _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))) in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(_V, w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    w = re.sub(f"(?<=.{_NV})[yY]$", "i", w)
    if (end := _longest(w, (*_STEP2, "ogi", "li"))) and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif end == "li":
            w = w[:-2] if re.search("[cdeghkmnrt]li$", w) else w
        else:
            w = w[: -len(end)] + _STEP2[end]
    if (end := _longest(w, (*_STEP3, "ative"))) and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + _STEP3[end]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    if (end := _longest(w, (*_STEP4, "ion"))) and len(w) - len(end) >= r2:
        if end != "ion" or w[-4:-3] in ("s", "t"):
            w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of arrays of words; each worker process keeps those of the words it met."""
    return words.map(lambda row: None if row is None else [stem(w) for w in row])
