"""The text analysis that search, schema similarity and matching share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stop words of the search analyser.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
              "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def camel_to_snake(name: Column) -> Column:
    """`orderStatusCode` -> `order_status_code`."""
    starts = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=[\p{Lu}])(?=\p{Lu}\p{Ll})"
    return F.lower(F.regexp_replace(name, starts, "_"))


def name_tokens(name: Column) -> Column:
    """Lower-case tokens of a table or column name, cut at case changes and everything but letters and digits of any script."""
    return F.filter(F.split(camel_to_snake(F.regexp_replace(name, r"\.csv$", "")), "[^\\p{L}\\p{M}\\p{N}]+"), lambda t: t != "")


def analyse(text: Column, stop: bool = True) -> Column:
    """Search terms of a text, in order: `_` and `.csv` separate, possessives and stop words go, all lower case."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.csv", " "), "['’]s\\b", "")
    terms = F.filter(F.split(clean, "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    return F.filter(terms, lambda t: ~t.isin(*STOP_WORDS)) if stop else terms


def _stem(word: str) -> str:
    """A light English stem: plural and verb endings, where at least three letters remain."""
    for end, put in (("ies", "y"), ("sses", "ss"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("es", "e"), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 3 and not (end == "s" and word.endswith(("ss", "us", "is"))):
            return word[: len(word) - len(end)] + put
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_terms(terms: pd.Series) -> pd.Series:
    """Stems of a list of terms (Arrow batches); optional, since everything else stays in the JVM."""
    known: dict[str, str] = {}
    return terms.map(lambda ts: None if ts is None else [known.setdefault(t, _stem(t)) for t in ts])


def fuzzy_edits(term: Column) -> Column:
    """How many edits a fuzzy match allows: 0 up to two letters, 1 up to five, else 2."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)
