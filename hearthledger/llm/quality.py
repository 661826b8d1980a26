"""Quality rules (operator 4).

Two verdicts on every whole text. The base rules count words, symbols, repeated lines and repeated
three-word windows. The method is a hashed n-gram log-likelihood ratio: word unigrams and bigrams fall
into ``2**hash_bits`` cells, a *target* multinomial is counted over trusted documents (labelled
``quality = 1``) and a *raw* multinomial over every document of the corpus; a document scores
``sum(log p_target(g) - log p_raw(g)) / number of its n-grams`` and is kept when that mean reaches a
fixed threshold.

Corpus counts cover all documents, target counts all trusted ones. Trusted ids are broadcast while a count
shows them few; beyond, the join shuffles. What the driver holds is one table of ``2**hash_bits`` cells,
whatever the input size. The pseudo-counts grow with the target's n-grams, so that the ratios, and with
them the meaning of the threshold, stay the same when the corpus grows.

Defined cases: a null or empty text has no words and fails the base rules; with no trusted documents
every ratio is 0 and the base rules decide alone; repeated rows are judged row by row; other columns of
the input, whatever their names, are passed through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, in_batches, table, utf8

HASH_BITS = 18
#: Pseudo-count that draws the ratio of a cell with little evidence towards 0; the least one.
SHRINK = 16.0
#: n-grams of the target up to which the pseudo-count is SHRINK; beyond, it grows in proportion (that of the 0.1 tables, where THRESHOLD was set).
SHRINK_MASS = 2_753_901
#: Trusted ids are broadcast only up to so many rows; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Mean log-ratio below which a document is rejected. On the labelled rows of the 0.1 tables clean text
#: scores above -0.04, symbol, capital or table junk below -0.18.
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)

VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("llr", T.DoubleType()),
    ]
)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number in order of first occurrence, and the distinct words."""
    seen: dict[bytes, int] = {}
    for w in words:
        if w not in seen:
            seen[w] = len(seen)
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), list(seen)


def ngram_cells(ids: np.ndarray, distinct: list[bytes], bits: int = HASH_BITS) -> np.ndarray:
    """Cells of the document's word unigrams and bigrams."""
    if not len(ids):
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))[ids]
    shift = np.uint64(64 - bits)
    one = (h + np.uint64(1)) * _MIX >> shift
    two = ((h[:-1] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[1:] + np.uint64(7)) * _MIX) * _MIX >> shift
    return np.concatenate([one, two]).astype(np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words covered by three-word windows that occur at least twice (every occurrence, the first included)."""
    n = len(ids)
    if n < 4:
        return 0
    v = int(ids.max()) + 1
    if v < 1 << 20:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # three numbers don't fit one integer: number the pairs first
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        keys = pair[:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def code_points(raw: bytes) -> int:
    a = np.frombuffer(raw, np.uint8)
    return int(len(a) - np.count_nonzero((a & 0xC0) == 0x80))


def judge(text: bytes, ratio: np.ndarray, threshold: float, bits: int) -> tuple:
    words = text.split()
    ids, distinct = word_ids(words)
    chars = code_points(text) - (len(text) - sum(map(len, words)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    repeats = repeated_words(ids)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    cells = ngram_cells(ids, distinct, bits)
    llr = float(ratio[cells].mean()) if len(cells) else 0.0
    return (len(words), chars, symbols, duplicate_lines(text), repeats, failed, not failed and llr >= threshold, llr)


def _cell_counts(docs: DataFrame, target: DataFrame, bits: int, broadcast_rows: int) -> DataFrame:
    """(cell, raw, target) over every document; each task sums its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            for text, good in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                ids, distinct = word_ids(text.split())
                got = np.bincount(ngram_cells(ids, distinct, bits), minlength=0)
                raw[: len(got)] += got
                if good:
                    trusted[: len(got)] += got
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["cell", "raw", "target"])

    # null ids match nothing; the second key keeps them from one task of a shuffled join
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(4096))).otherwise(0).alias("spread")
    known = target.select("doc_id", F.lit(0).cast("long").alias("spread"), F.lit(True).alias("good"))
    known = F.broadcast(known) if target.count() <= broadcast_rows else known
    flagged = docs.select("doc_id", "text", spread).join(known, ["doc_id", "spread"], "left")
    parts = in_batches(flagged.select("text", F.coalesce("good", F.lit(False)).alias("good")), run, "cell long, raw long, target long")
    return parts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, labels: DataFrame, bits: int = HASH_BITS, broadcast_rows: int = BROADCAST_ROWS) -> np.ndarray:
    """log p_target - log p_raw of each cell, shrunk by pseudo-counts; all zero where nothing is trusted."""
    target = durable(labels.filter("quality = 1").select(F.col("doc_id").cast("long")).distinct(), "quality-trusted")
    found = _cell_counts(docs, target, bits, broadcast_rows).toArrow()  # 2**bits rows at most
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    at = found["cell"].to_numpy()
    raw[at], good[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    if not good.sum():
        return np.zeros(1 << bits, np.float32)
    expected = raw * (good.sum() / raw.sum())
    shrink = SHRINK * max(1.0, good.sum() / SHRINK_MASS)
    return np.log((good + shrink) / (expected + shrink)).astype(np.float32)


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = HASH_BITS, out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out`` (fields of VERDICT); all other columns pass through."""
    name = out
    while name in docs.columns:
        name = f"_{name}"
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, bits))
    at = docs.columns.index("text")
    fields, kind = VERDICT.fieldNames(), to_arrow_type(VERDICT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in batches:
            found = [dict(zip(fields, judge(t, ratio, threshold, bits), strict=True)) for t in utf8(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, name])

    return in_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, VERDICT)]))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge_documents(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    found = judge_documents(docs, table(spark, sf_dir, "labels"), out="_quality")
    return found.filter(F.col(found.columns[-1]).getField("kept")).select(*docs.columns)
