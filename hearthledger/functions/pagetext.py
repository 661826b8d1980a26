"""Page-text operators: sanitising, legibility gates, snippets. Column expressions over whole texts."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entities decoded before reading, in this order. Fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode_entities(bare), r"[ \t\n\f\r]+", " "))


def page_title(c: Column) -> Column:
    return F.nullif(decode_entities(F.regexp_extract(c, "<title>([^<]*)</title>", 1)), F.lit(""))


def clean_value(c: Column) -> Column:
    """A value of at least two characters that is not punctuation only."""
    return F.when((F.length(c) >= 2) & ~c.rlike(r"^[.,;:!?\- ]*$"), c)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"[ \t\n\f\r]+"), lambda w: w != "")


def digit_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+(?:[.,][0-9]+)*)"), F.lit(1)))


def layer_recall(layer: Column, read: Column) -> Column:
    """Share of the layer's number tokens that the read text holds; null below five."""
    return F.when(F.size(layer) >= 5, F.size(F.array_intersect(layer, read)) / F.size(layer))


def garbled(token: Column) -> Column:
    """A token no writing has: symbols beside letters, or letters without a vowel, four and longer."""
    return (token.rlike("[A-Za-z]") & token.rlike("[#$%&*|<>]")) | (F.length(token) >= 4) & token.rlike("^[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+$")


def garble_share(c: Column) -> Column:
    """Share of impossible tokens; null below forty tokens."""
    w = words(c)
    return F.when(F.size(w) >= 40, F.size(F.filter(w, garbled)) / F.size(w))


def repetitive_share(c: Column) -> Column:
    """Share of characters inside one- to three-character units repeated four times and more."""
    return F.coalesce(F.try_divide(F.length(c) - F.length(F.regexp_replace(c, r"(?s)(.{1,3}?)\1{3,}", "")), F.length(c)), F.lit(0.0))


def sanitized(c: Column) -> Column:
    """Reader marks and escapes out, entities decoded, blanks collapsed; lines stay lines, three and more empty ones become two."""
    bare = F.regexp_replace(F.regexp_replace(c, r"<\|/?(?:ref|det)\|>", ""), r"\\\\[()]", "")
    lines = F.regexp_replace(F.regexp_replace(decode_entities(bare), r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def scrubbed(values: Column) -> Column:
    """Strings of an array without tags, entities decoded; one-character values stay, empty ones become null."""
    return F.transform(values, lambda v: F.nullif(strip_html(v), F.lit("")))


def _loops(text: str | None) -> tuple[int, float | None, float | None]:
    w = [x for x in re.split(r"[ \t\n\f\r]+", text or "") if x]
    n = len(w)
    if not n:
        return 0, None, None
    token = max(Counter(w).values()) / n
    if n < 60:
        return n, token, None
    worded = {x for x in set(w) if sum(c.isascii() and c.isalpha() for c in x) >= 3}
    best = 0.0
    for k in (2, 3):
        counts = Counter(zip(*(w[i:] for i in range(k)), strict=False))
        best = max(best, k * max((c for g, c in counts.items() if not worded.isdisjoint(g)), default=0) / n)
    return n, token, min(1.0, best)


@F.pandas_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("token", T.DoubleType()), T.StructField("phrase", T.DoubleType())]))
def loops(texts: pd.Series) -> pd.DataFrame:
    """Tokens; share of the most frequent one; share of tokens in the most frequent phrase of two or three tokens, one of which has
    three letters (null below sixty tokens). Counted within a text: no shuffle, and several times faster than array lambdas."""
    return pd.DataFrame(list(map(_loops, texts)), columns=["tokens", "token", "phrase"]).astype({"tokens": "int64", "token": "float64", "phrase": "float64"})


def boxes(c: Column) -> Column:
    """Boxes (x1, y1, x2, y2), thousandths of the page, that a reader printed as [[x1, y1, x2, y2]]."""
    part = lambda k: F.regexp_extract_all(c, F.lit(r"\[\[\s*(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\s*\]\]"), F.lit(k))
    return F.transform(F.arrays_zip(*(part(k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"), 1))), lambda b: F.struct(*(b[n].cast("int").alias(n) for n in ("x1", "y1", "x2", "y2"))))


def skipped_fraction(c: Column) -> Column:
    """Share of the page that printed boxes cover, one at most."""
    area = F.aggregate(boxes(c), F.lit(0.0), lambda s, b: s + F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0)))
    return F.least(F.lit(1.0), area / 1_000_000)


def vertical_band(c: Column) -> Column:
    """Whether all boxes lie in a band narrower than 0.30 and taller than 0.40 of the page."""
    far = lambda hi, lo: (F.array_max(F.transform(boxes(c), lambda b: b[hi])) - F.array_min(F.transform(boxes(c), lambda b: b[lo]))) / 1000
    return F.coalesce((far("x2", "x1") < 0.30) & (far("y2", "y1") > 0.40), F.lit(False))


def marks_unread(c: Column) -> Column:
    """Six choices and more are printed and none is filled."""
    filled = c.rlike(r"(?i)\[\s*x\s*\]|☒|☑|\(\s*x\s*\)")
    return (F.size(F.regexp_extract_all(c, F.lit(r"(\[\s*\]|☐|□|\(\s*\))"), F.lit(1))) >= 6) & ~filled


def broken_numbers(c: Column) -> Column:
    """Numbers torn apart ("1,2 34.50") on a page that prints amounts."""
    torn = F.regexp_extract_all(c, F.lit(r"([0-9],[0-9]{1,2} [0-9]{1,2}\.[0-9]{2}|[0-9]+\. [0-9]{2}(?![0-9]))"), F.lit(1))
    return F.when(c.rlike(r"\$ ?[0-9]"), torn).otherwise(F.array().cast("array<string>"))


def content_lost(ink: Column, pixels: Column, chars: Column) -> Column:
    """Three per cent of the page is ink, but the text holds fewer characters than such ink prints."""
    share = F.try_divide(ink, pixels)
    return F.coalesce((share >= 0.03) & (chars < ink * 0.006), F.lit(False))


def flag_codes(c: Column) -> Column:
    """Distinct codes of a JSON list whose items are strings or objects with a code."""
    items = F.from_json(c, "array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.code"), x)), lambda x: x.isNotNull() & (x != ""))))


def headings(c: Column) -> Column:
    """Lines in capitals, of three letters and more and at most 80 characters, the first five."""
    line = lambda x: (F.length(x) <= 80) & (F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 3) & (x == F.upper(x))
    return F.slice(F.filter(F.transform(F.split(c, "\n"), F.trim), line), 1, 5)


def snippet(c: Column, limit: int = 900) -> Column:
    """Headings, the head of 600 characters, up to three amounts with context and two dates, cut at ``limit``."""
    amounts = F.slice(F.regexp_extract_all(c, F.lit(r"((?:[^\s]+\s+){0,5}\$[0-9][0-9,.]*)"), F.lit(1)), 1, 3)
    dates = F.slice(F.regexp_extract_all(c, F.lit(r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"), F.lit(1)), 1, 2)
    listed = lambda a, by: F.nullif(F.array_join(a, by), F.lit(""))
    return F.substring(F.concat_ws(" | ", listed(headings(c), " / "), F.substring(c, 1, 600), listed(amounts, " ; "), listed(dates, " ; ")), 1, limit)


def without_lines(c: Column, lines: Column) -> Column:
    """The text without the lines whose trimmed form is in ``lines``."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~F.array_contains(lines, F.trim(x))), "\n")
