"""Page-text gates bound to pages and documents."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthledger.functions import pagetext as P
from hearthledger.functions.normalise import nearest
from hearthledger.plans.registry import Tables, query

_ENTITIES = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&amp;', '&')"
_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda w: w <> '')"


@query("SELECT page_id, md5(trim(regexp_replace(" + _ENTITIES.format(r"regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + r", '[ \t\n\f\r]+', ' ', 'g'))) AS text_md5 FROM pages")
def strip_html(t: Tables) -> DataFrame:
    """Plain text of pages, by digest."""
    return t.pages.select("page_id", F.md5(P.strip_html(F.col("html"))).alias("text_md5"))


@query("SELECT page_id, nullif(" + _ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + ", '') AS title FROM pages")
def page_title(t: Tables) -> DataFrame:
    """Titles with entities decoded."""
    return t.pages.select("page_id", P.page_title(F.col("html")).alias("title"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS tokens, frac4(max(n)::DOUBLE / sum(n)) AS share, max(n)::DOUBLE / sum(n) >= 0.5 AS degenerate FROM c GROUP BY 1 HAVING sum(n) >= 60
""")
def dominant_token(t: Tables) -> DataFrame:
    """Share of the most frequent token of texts of sixty tokens and more, counted within the row."""
    held = t.documents.select("doc_id", P.loops(F.col("text")).alias("l")).filter("l.tokens >= 60")
    return held.select("doc_id", "l.tokens", nearest(F.col("l.token"), 4).alias("share"), (F.col("l.token") >= 0.5).alias("degenerate"))


@query(f"""
WITH a AS (SELECT doc_id, {_WORDS} AS w FROM documents), l AS (SELECT doc_id, w, len(w) AS n FROM a WHERE len(w) >= 60),
g AS (SELECT doc_id, n, 2 AS k, unnest(list_transform(range(1, n), lambda i: w[i:i+1])) AS g FROM l UNION ALL SELECT doc_id, n, 3, unnest(list_transform(range(1, n - 1), lambda i: w[i:i+2])) FROM l),
c AS (SELECT doc_id, n, k, g, count(*) AS c FROM g WHERE len(list_filter(g, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 3)) > 0 GROUP BY 1, 2, 3, 4),
b AS (SELECT doc_id, max(least(1.0, k::DOUBLE * c / n)) AS s FROM c GROUP BY 1)
SELECT l.doc_id, frac4(coalesce(s, 0.0)) AS share, coalesce(s, 0.0) >= 0.35 AS looping FROM l LEFT JOIN b USING (doc_id)
""")
def repeated_phrase(t: Tables) -> DataFrame:
    """Share of tokens inside the most frequent phrase of two or three tokens that holds a word, counted within the row."""
    shares = t.documents.select("doc_id", P.loops(F.col("text")).alias("l")).filter("l.tokens >= 60").withColumn("s", F.col("l.phrase"))
    return shares.select("doc_id", nearest(F.col("s"), 4).alias("share"), (F.col("s") >= 0.35).alias("looping"))


@query(f"""
WITH a AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, frac4(len(list_filter(w, lambda x: (regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[#$%&*|<>]')) OR (length(x) >= 4 AND regexp_matches(x, '^[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+$'))))::DOUBLE / len(w)) AS share,
  len(list_filter(w, lambda x: (regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[#$%&*|<>]')) OR (length(x) >= 4 AND regexp_matches(x, '^[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+$'))))::DOUBLE / len(w) >= 0.12 AS garbled FROM a WHERE len(w) >= 40
""")
def garble_share(t: Tables) -> DataFrame:
    """Share of impossible tokens and whether a text layer counts as garbled."""
    share = P.garble_share(F.col("text"))
    return t.documents.select("doc_id", share.alias("s")).filter("s IS NOT NULL").select("doc_id", nearest(F.col("s"), 4).alias("share"), (F.col("s") >= 0.12).alias("garbled"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')))::INTEGER AS numbers FROM documents")
def digit_tokens(t: Tables) -> DataFrame:
    """Distinct number tokens of a text."""
    return t.documents.select("doc_id", F.size(P.digit_tokens(F.col("text"))).alias("numbers"))


@query(r"""
WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT source, md5(line) AS line, count(DISTINCT doc_id) AS docs FROM l WHERE length(line) >= 12 GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3
""")
def repeated_lines(t: Tables) -> DataFrame:
    """Lines of twelve characters and more on three documents of a source and more."""
    lines = t.documents.select("source", "doc_id", F.explode(F.transform(F.split("text", "\n"), F.trim)).alias("line")).filter(F.length("line") >= 12)
    return lines.groupBy("source", F.md5("line").alias("line")).agg(F.countDistinct("doc_id").alias("docs")).filter("docs >= 3")


@query(None)
def snippets(t: Tables) -> DataFrame:
    """Snippets of all texts, without the lines that repeat on three documents of the source (back-references to the anti join's lines have no SQL twin)."""
    lines = t.documents.select("source", "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), F.trim))).alias("line")).filter(F.length("line") >= 12)
    often = lines.groupBy("source", "line").agg(F.count("*").alias("docs")).filter("docs >= 3")
    own = lines.join(often.select("source", "line"), ["source", "line"]).groupBy("doc_id").agg(F.collect_set("line").alias("repeated"))
    docs = t.documents.select("doc_id", "text").join(own, "doc_id", "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))
    return docs.select("doc_id", P.snippet(P.without_lines(F.col("text"), F.col("repeated"))).alias("snippet"))


@query(None)
def repetitive_share(t: Tables) -> DataFrame:
    """Share of characters in repeated short units (back-references, so no RE2 twin)."""
    return t.documents.select("doc_id", nearest(P.repetitive_share(F.col("text")), 4).alias("share"))


@F.pandas_udf(T.DoubleType())
def deflate_ratio(texts: pd.Series) -> pd.Series:
    raw = texts.fillna("").str.encode("utf-8")
    return raw.map(lambda b: len(zlib.compress(b)) / len(b) if len(b) >= 300 else None)


@query(None)
def degenerate_pages(t: Tables) -> DataFrame:
    """Texts that compress below a tenth, are half one token, or 35 % one phrase of two or three words.

    zlib has no built-in form: one vectorised function. Compression and token need 300 bytes, the phrase 60 tokens with a word in it.
    """
    found = t.documents.select("doc_id", deflate_ratio(F.col("text")).alias("ratio"), P.loops(F.col("text")).alias("l")).select("doc_id", "ratio", "l.token", "l.phrase")
    held = (F.col("ratio") < 0.10) | (F.col("ratio").isNotNull() & (F.col("token") >= 0.5)) | (F.col("phrase") >= 0.35)
    return found.filter(held).select("doc_id", *(nearest(F.col(c), 4).alias(c) for c in ("ratio", "token", "phrase")))


@query(r"""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN n_chars < 40 THEN 'short' WHEN regexp_matches(text, '[#$%&*|]{3}') THEN 'symbols' WHEN text = upper(text) THEN 'capitals' ELSE 'keep' END AS reason FROM documents
""")
def second_read_queue(t: Tables) -> DataFrame:
    """The ordered gate cascade: the first reason that holds."""
    c = F.col("text")
    reason = F.when(F.trim(c) == "", "blank").when(F.col("n_chars") < 40, "short").when(c.rlike("[#$%&*|]{3}"), "symbols").when(c == F.upper(c), "capitals").otherwise("keep")
    return t.documents.select("doc_id", reason.alias("reason"))


def passage_hits(t: Tables) -> DataFrame:
    """doc_id, item_id: benchmark passages printed whole in documents, candidates by words inside the passage, then the full text."""
    # a passage may begin and end inside a word: whole words within it, without the first and the last, decide on candidates
    w = P.words(F.col("text"))
    inner = F.slice(P.words(F.col("text")), 2, 5)
    asked = t.benchmark.select("item_id", F.col("text").alias("passage"), F.when(F.size(P.words(F.col("text"))) >= 7, F.array_join(inner, " ")).alias("lead"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 5), " "))
    places = t.documents.select("doc_id", w.alias("w")).select("doc_id", F.explode(F.array_distinct(grams)).alias("lead"))
    hits = places.join(asked.filter("lead is not null"), "lead").select("doc_id", "item_id", "passage").distinct()  # texts are fetched for hits only
    found = t.documents.select("doc_id", "text").join(hits, "doc_id").filter(F.contains("text", "passage")).select("doc_id", "item_id")
    # passages of fewer than seven words have no such part: a stated set against all texts
    short = t.documents.select("doc_id", "text").join(asked.filter("lead is null and passage <> ''"), F.contains("text", "passage")).select("doc_id", "item_id")
    return found.union(short)


@query("""
SELECT item_id, count(*) AS pages, min(doc_id) AS first FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1
""")
def value_on_page(t: Tables) -> DataFrame:
    """Documents that print a benchmark passage whole."""
    return passage_hits(t).groupBy("item_id").agg(F.countDistinct("doc_id").alias("pages"), F.min("doc_id").alias("first"))


_BOX = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS x1, l_partkey::INT % 400 AS y1, l_quantity::INT + l_suppkey::INT % 500 AS x2, l_partkey::INT % 400 + round(l_discount * 6000)::INT AS y2 FROM lineitem"


def _printed_boxes(t: Tables) -> DataFrame:
    """Orders as pages: each line prints one box, as the reader writes it."""
    x1, y1 = F.col("l_quantity").cast("int"), F.pmod(F.col("l_partkey").cast("int"), F.lit(400))
    box = F.format_string("<|det|>[[%d, %d, %d, %d]]<|/det|>", x1, y1, x1 + F.pmod(F.col("l_suppkey").cast("int"), F.lit(500)), y1 + F.round(F.col("l_discount") * 6000).cast("int"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(box)), "\n").alias("page"))


@query(f"""
SELECT l_orderkey, frac4(least(1.0, sum((x2 - x1) * (y2 - y1))::DOUBLE / 1000000)) AS share, (max(x2) - min(x1))::DOUBLE / 1000 < 0.30 AND (max(y2) - min(y1))::DOUBLE / 1000 > 0.40 AS band FROM ({_BOX}) GROUP BY 1
""")
def printed_boxes(t: Tables) -> DataFrame:
    """Share of a page that printed boxes cover, and whether they stand in a tall, narrow band."""
    page = F.col("page")
    return _printed_boxes(t).select("l_orderkey", nearest(P.skipped_fraction(page), 4).alias("share"), P.vertical_band(page).alias("band"))
