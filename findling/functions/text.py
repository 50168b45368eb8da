"""Tokens, stop words, sentences and term coverage as column expressions."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}

NON_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"[.!?]\s+"


@lru_cache(maxsize=None)
def stop_words(lang: str) -> tuple[str, ...]:
    """Spark ML's own stop-word list, lower-cased, as shipped in its jar."""
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if jars:
        with zipfile.ZipFile(jars[0]) as jar:
            name = f"org/apache/spark/ml/feature/stopwords/{LANGUAGES[lang]}.txt"
            words = jar.read(name).decode("utf-8").splitlines()
    else:
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords(LANGUAGES[lang])
    return tuple(sorted({w.strip().lower() for w in words if w.strip()}))


# The same as SQL text, for use inside composed array expressions.
WHITESPACE_TOKENS = r"array_remove(split({0}, '\\s+'), '')"


def whitespace_tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, stop words included."""
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


@lru_cache(maxsize=None)
def _word_list(lang: str) -> str:
    """The stop words that a token can equal, as a SQL list.

    One parsed expression, as building the list of literals word by word would
    take the driver longer than many a query runs.
    """
    return ", ".join(f"'{w}'" for w in stop_words(lang) if w.isalnum())


def likely_language(text: str) -> Column:
    """The language whose stop words make up the most words; ties by code, ``en`` without any."""
    words = rf"array_remove(split(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), '')"
    counts = [
        f"struct(size(filter({words}, x -> x IN ({_word_list(code)}))) AS n, {-rank} AS place, '{code}' AS code)"
        for rank, code in enumerate(sorted(LANGUAGES))
    ]
    best = F.expr(f"greatest({', '.join(counts)})")
    return F.when(best["n"] > 0, best["code"]).otherwise(F.lit("en"))


def token_stop_words() -> dict[str, list[str]]:
    """The stop words that a token can equal, by language; for the driver, to send to tasks."""
    return {code: [w for w in stop_words(code) if w.isalnum()] for code in LANGUAGES}


def stop_word_marks(words: pa.Array, langs: pa.DictionaryArray, stops: dict[str, list[str]]) -> np.ndarray:
    """Whether each of ``words`` is a stop word, a row per language of the dictionary of ``langs``
    and a last one for no language; as ``is_stop_word`` tells."""
    marks = np.zeros((len(langs.dictionary) + 1, len(words)), bool)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        if lang in stops:
            marks[i] = pc.is_in(words, value_set=pa.array(stops[lang], words.type)).to_numpy(zero_copy_only=False)
    return marks


def is_stop_word(term: str, lang: str) -> Column:
    """Whether the column ``term`` is a stop word; compiles, unlike a test inside a lambda."""
    found = [f"({lang} = '{code}' AND {term} IN ({_word_list(code)}))" for code in LANGUAGES]
    return F.expr(f"coalesce({' OR '.join(found)}, false)")


def _without_stop_words(items: str, term: str, lang: str) -> Column:
    kept = [
        f"WHEN '{code}' THEN filter({items}, x -> {term} NOT IN ({_word_list(code)}))"
        for code in LANGUAGES
    ]
    return F.expr(f"CASE {lang} {' '.join(kept)} ELSE {items} END")


def drop_stop_words(tokens: str, lang: str) -> Column:
    """The array column ``tokens`` without the stop words of ``lang``; for short texts."""
    return _without_stop_words(tokens, "x", lang)


def placed_tokens(tokens: str, lang: str) -> Column:
    """The same as ``(term, pos)`` structs; positions are counted before words are dropped."""
    placed = f"transform({tokens}, (t, i) -> struct(t AS term, i AS pos))"
    return _without_stop_words(placed, "x.term", lang)


def bigrams(tokens: Column) -> Column:
    """Distinct neighbouring pairs, joined by a blank."""
    pairs = F.zip_with(
        tokens,
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def coverage(wanted: Column, have: Column) -> Column:
    """Share of ``wanted`` (distinct) that occurs in ``have``; 0 when nothing is wanted."""
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.array_intersect(wanted, have)) / n).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), "")


def steady(value: Column) -> Column:
    """Round a double that was summed in no fixed order; negative zero becomes zero."""
    return F.round(value, 6) + F.lit(0.0)
