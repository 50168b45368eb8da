"""Stems: words cut back to what their inflected forms share, by the rules of a language.

English and German follow the published Snowball rules (a word's regions, then lists of
suffixes of which the longest is taken), French and Spanish the published light rules,
which take off endings of number and gender. Words of other languages, stop words and
words with digits stay as they are. A batch's different words are stemmed once each.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from findling.functions.text import LANGUAGES, stop_words

# The suffixes and endings of the published rules, longest first where it matters.
EN_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
EN_KEPT_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
EN_SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence",
    "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
    "ogi": "og", "li": "",
}
EN_THIRD = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "",
    "ical": "ic", "ness": "", "ful": "",
}
EN_FOURTH = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion", "al", "er", "ic",
)
EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_EN_REGION = re.compile(r"[aeiouy][^aeiouy]")
_EN_VOWEL = re.compile(r"[aeiouy]")
_EN_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DE_REGION = re.compile(r"[aeiouyäöü][^aeiouyäöü]")


def _regions(word: str, region: re.Pattern, first: int | None = None) -> tuple[int, int]:
    """Where the regions behind the first and the second vowel and consonant begin."""
    if first is None:
        found = region.search(word)
        first = found.end() if found else len(word)
    found = region.search(word, first)
    return first, found.end() if found else len(word)


def _ending(word: str, endings) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


def english(word: str) -> str:
    if len(word) <= 2 or word in EN_KEPT:
        return word
    if word in EN_SPECIAL:
        return EN_SPECIAL[word]
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    head = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    one, two = _regions(word, _EN_REGION, len(head) if head else None)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _EN_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in EN_KEPT_LATER:
        return word

    end = _ending(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= one:
            word = word[: -len(end)] + "ee"
    elif end and _EN_VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(EN_DOUBLES):
            word = word[:-1]
        elif one >= len(word) and _EN_SHORT.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _ending(word, EN_SECOND)
    if end and len(word) - len(end) >= one:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and not before.endswith(tuple("cdeghkmnrt"))):
            word = before + EN_SECOND[end]

    end = _ending(word, EN_THIRD)
    if end and len(word) - len(end) >= (two if end == "ative" else one):
        word = word[: -len(end)] + EN_THIRD[end]

    end = _ending(word, EN_FOURTH)
    if end and len(word) - len(end) >= two and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]

    last = len(word) - 1
    if word[-1] == "e" and (last >= two or last >= one and not _EN_SHORT.search(word[:-1])):
        word = word[:-1]
    elif word[-1] == "l" and last >= two and word[-2] == "l":
        word = word[:-1]
    return word.replace("Y", "y")


def german(word: str) -> str:
    word = re.sub(r"(?<=[aeiouyäöü])([uy])(?=[aeiouyäöü])", lambda m: m[1].upper(), word.replace("ß", "ss"))
    one, two = _regions(word, _DE_REGION)
    one = max(one, min(3, len(word)))

    end = _ending(word, ("ern", "em", "er", "en", "es", "e", "s"))
    if end and len(word) - len(end) >= one and (end != "s" or word[-2:-1] in tuple("bdfghklmnrt")):
        word = word[: -len(end)]
        if end in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]

    end = _ending(word, ("est", "en", "er", "st"))
    if end and len(word) - len(end) >= one:
        if end != "st" or len(word) >= 6 and word[-3] in "bdfghklmnt":
            word = word[: -len(end)]

    end = _ending(word, ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"))
    if end and len(word) - len(end) >= two:
        before = word[: -len(end)]
        if end in ("end", "ung"):
            word = before
            if word.endswith("ig") and len(word) - 2 >= two and word[-3:-2] != "e":
                word = word[:-2]
        elif end in ("ig", "ik", "isch"):
            word = word if before.endswith("e") else before
        else:
            word = before
            more = _ending(word, ("er", "en") if end in ("lich", "heit") else ("lich", "ig"))
            if more and len(word) - len(more) >= (one if end in ("lich", "heit") else two):
                word = word[: -len(more)]
    return word.translate(str.maketrans("UYäöü", "uyaou"))


def french(word: str) -> str:
    if len(word) < 6:
        return word
    if word.endswith("x"):
        return word[:-2] + "l" if word.endswith("aux") else word
    for end in "sreé":
        if word.endswith(end):
            word = word[:-1]
    return word[:-1] if word[-1] == word[-2] else word


def spanish(word: str) -> str:
    if len(word) < 5:
        return word
    word = word.translate(str.maketrans("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii"))
    if word[-1] in "oae":
        return word[:-1]
    if word.endswith("eses"):
        return word[:-2]
    if word.endswith("ces"):
        return word[:-3] + "z"
    return word[:-2] if word.endswith(("os", "as", "es")) else word


RULES = {"en": english, "de": german, "fr": french, "es": spanish}


@lru_cache(maxsize=1 << 18)
def stem(word: str, lang: str | None) -> str:
    """The stem of a lower-cased word that is no stop word."""
    rule = RULES.get(lang or "")
    return rule(word) if rule and word.isalpha() else word


def stemmed(words: Column, lang: Column) -> Column:
    """The array of lower-cased ``words`` with stems in their place; stop words stay."""
    dropped = {code: frozenset(stop_words(code)) for code in LANGUAGES}  # lists of the driver

    @F.arrow_udf("array<string>")
    def stems(words: pa.Array, lang: pa.Array) -> pa.Array:
        sizes = words.value_lengths().fill_null(0).to_numpy()
        flat, codes = words.flatten().dictionary_encode(), lang.dictionary_encode()
        langs = [*codes.dictionary.to_pylist(), None]
        # Each word of each language once: by its language's number, then by its own.
        own = codes.indices.fill_null(len(langs) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = flat.dictionary.to_pylist()
        key = np.repeat(own, sizes) * len(known) + flat.indices.to_numpy(zero_copy_only=False)
        place = np.zeros(len(langs) * len(known), np.int64)
        place[key] = 1
        met = np.flatnonzero(place)
        place[met] = np.arange(len(met))
        none = frozenset()
        out = [
            w if w in dropped.get(code or "", none) else stem(w, code)
            for code, w in ((langs[k // len(known)], known[k % len(known)]) for k in met.tolist())
        ]
        ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        rows = pa.array(out, pa.string()).take(pa.array(place[key]))
        return pa.ListArray.from_arrays(ends, rows, mask=words.is_null())

    return stems(words, lang)
