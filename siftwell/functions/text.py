"""Text functions as column expressions: cleaning, tokens, highlights, snippets, explanations, hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of Han characters, and runs of other letters and numbers.
WORD = r"[一-鿿]+|[\p{L}\p{N}&&[^一-鿿]]+"
HAN = "^[一-鿿]"
#: Runs of letters and numbers without Han characters that have a letter or a number that isn't a plain digit.
PLAIN = r"(?<!\p{Nd})\p{Nd}*+[\p{L}\p{Nl}\p{No}&&[^一-鿿]][\p{L}\p{N}&&[^一-鿿]]*"
#: A token stays if it has a letter or a number that isn't a plain digit.
MEANING = r"[\p{L}\p{Nl}\p{No}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def clean_for_index(text: Column) -> Column:
    """Without tags and URLs, blanks collapsed, control characters dropped."""
    for pattern, by in ((r"<[^>]+>", " "), (r"https?://\S+", " "), (r"(?U)\s+", " "), (CONTROL, "")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def without_marks(text: Column) -> Column:
    """As clean_for_index(), but for blanks, which tokens don't see."""
    for pattern, by in ((r"<[^>]+>", " "), (r"https?://\S+", " "), (r"[\x00-\x08\x0e-\x1f\x7f]", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean_crawled(text: Column) -> Column:
    """Without entities, blanks collapsed, control characters dropped; null as empty."""
    for pattern, by in ((r"&[a-z]+;", " "), (r"(?U)\s+", " "), (CONTROL, "")):
        text = F.regexp_replace(F.coalesce(text, F.lit("")), pattern, by)
    return F.trim(text)


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case words in their order, repeats included, without stop words and words of digits only.

    Words are runs of letters and numbers. Han characters, which have no spaces between words, become overlapping pairs
    where they are more than one; siftwell.functions.segment cuts them into words."""
    stop = sorted({*stop_words})

    def cut(t: Column) -> Column:
        words = F.filter(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.when(w.rlike(HAN) & (F.length(w) > 1), pairs(w)).otherwise(F.array(w)))), lambda w: w.rlike(MEANING))
        words = F.when(t.rlike("[一-鿿]"), words).otherwise(F.regexp_extract_all(t, F.lit(PLAIN), F.lit(0)))
        return F.filter(words, lambda w: ~w.isin(stop)) if stop else words

    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
    return once(F.lower(without_marks(F.coalesce(text, F.lit("")))), cut)


def summary(content: Column, size: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size), F.lit("...")))


def content_hash(title: Column, content: Column) -> Column:
    return F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(content, F.lit(""))).cast("binary"))


def document_id(number: Column, file_type: Column) -> Column:
    """nk_000001 for pages, nk_file_000001 for attachments."""
    return F.when(file_type == "html", F.format_string("nk_%06d", number)).otherwise(F.format_string("nk_file_%06d", number))


def quoted(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def highlight(text: Column, keywords: Iterable[str], tag: str = "mark") -> Column:
    """Every keyword in <mark>, longer ones first, whatever the case."""
    words = sorted({k for k in keywords if k}, key=lambda k: (-len(k), k))
    text = F.coalesce(text, F.lit(""))
    if not words:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(map(quoted, words)) + ")", f"<{tag}>$1</{tag}>")


def plain_snippet(content: Column, keywords: Iterable[str], size: int = 300, lead: int = 50) -> Column:
    """From `lead` characters before the first keyword on, with dots where it is cut; the head if there is none."""
    content = F.coalesce(content, F.lit(""))
    words = [k for k in keywords if k]
    hits = [F.nullif(F.locate(k.lower(), F.lower(content)), F.lit(0)) for k in words]
    hit = F.least(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(None).cast("int")
    start = F.greatest(hit - 1 - lead, F.lit(0))  # from 0
    head = F.concat(F.substring(content, 1, size), F.when(F.length(content) > size, "...").otherwise(""))
    part = F.concat(
        F.when(start > 0, "...").otherwise(""), F.substr(content, start + 1, F.lit(size)), F.when(start + size < F.length(content), "...").otherwise("")
    )
    return F.when(hit.isNull(), head).otherwise(part)


def snippet(content: Column, keywords: Iterable[str], size: int = 300) -> Column:
    keywords = list(keywords)
    return highlight(plain_snippet(content, keywords, size), keywords)


def explanation(title: Column, content: Column, source: Column, terms: Column) -> Column:
    """Which terms (an array) stand in title, text and source; 模糊匹配 if none does."""

    def part(name: str, column: Column) -> Column:
        text = F.lower(F.coalesce(column, F.lit("")))
        found = F.filter(terms, lambda t: text.contains(F.lower(t)))
        return F.when(F.size(found) > 0, F.concat(F.lit(name + ": "), F.array_join(found, ", ")))

    parts = (part("标题命中", title), part("正文命中", content), part("来源匹配", source))
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("模糊匹配"))
