"""Segmentation of text without spaces between words, as an Arrow-batched UDF, where a segmenter (jieba) is installed.

Only texts with Han characters are sent to Python; the others, and all where no segmenter is there, are cut in the JVM:
see text.tokens()."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import clean_for_index, tokens

MEANINGFUL = re.compile(r"[^\d\W_]|[^\W\d]")
SEGMENTER = "jieba"


def installed() -> bool:
    return importlib.util.find_spec(SEGMENTER) is not None


def segments(text: Column, segmenter: str = SEGMENTER) -> Column:
    """Words in lower case; null for null. segmenter: a module with lcut(text)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        cut = importlib.import_module(segmenter).lcut if texts.notna().any() else None
        return texts.map(lambda t: None if t is None else [w for w in (x.strip().lower() for x in cut(t)) if MEANINGFUL.search(w)])

    return run(text)


def segmented_tokens(text: Column, stop_words: Iterable[str] = (), segmenter: str = SEGMENTER) -> Column:
    """Tokens by the segmenter for texts with Han characters, by text.tokens() for others."""
    stop = sorted({*stop_words})
    clean = clean_for_index(F.coalesce(text, F.lit("")))
    words = segments(F.when(clean.rlike("[一-鿿]"), clean), segmenter)
    return F.coalesce(F.filter(words, lambda t: ~t.isin(stop)) if stop else words, tokens(text, stop))
