"""Best-fit packing (operator 1): documents become token pieces, pieces fill sequences of at most CAPACITY ids.

Best-fit decreasing needs all lengths in one order, but only lengths: the plan is made over the histogram
of piece lengths (at most CAPACITY rows). A segment tree over remaining capacities gives, for a length, the
tightest open capacity in logarithmic time; equal pieces are placed in runs, because pieces of one length
go on filling the tightest bin until it holds no more. The plan is a bounded list of runs
``(length, first and last rank, first bin, pieces a bin, offset)``, exactly what one-at-a-time best-fit
decreasing gives. Pieces learn their rank within their length from hashed slices, whose counts are
summed up first, so that no task sees all pieces of a length, and meet their run in a broadcast join of
that bounded list.

A document is its token ids followed by END. Only documents longer than CAPACITY are cut; all pieces but
the first are full.

Tokenising: text is cut at single spaces wherever both neighbours are no white space; there the
tokenizer's own pre-tokenizer cuts too, so ids of the parts concatenate to the ids of the text, and parts
are cached. Texts with other white space at such places are encoded whole. Parts go through the same
vocabulary as byte-pair ranks, which is several times faster on short strings than the tokenizer itself;
tests hold both to equal ids.

Defined cases: a null or empty text is one piece holding END; repeated rows are packed as often as they
occur; a null doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, from_columns, in_batches, table

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length are ranked in hashed slices of about so many.
SLICE_ROWS = 65_536
#: Rows before each slice are broadcast only up to so many slices; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Parts kept in a worker's cache before it is emptied.
CACHE = 150_000
_SPECIAL = "<|"


class Encoder(dict):
    """Part of a text (with its leading space) -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str, ranks: str, pattern: str):
        super().__init__()
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.parts = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.tokenizer is None:  # most texts never need it
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.parts.encode_ordinary(" " + part)
        got = self[part] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        for part in rest:
            if not part or part[0].isspace() or part[-1].isspace():
                return self.ids(text)
        if not first or first[-1].isspace() or _SPECIAL in text:
            return self.ids(text)
        return np.asarray(self.parts.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder; ``path`` defaults to the installed vocabulary file, its ranks lie beside it."""
    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, path.removesuffix(".json") + ".tiktoken", public_tokenizers.PATTERN)
    return _ENCODERS[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what full pieces leave."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on request, ids (binary, little-endian 32-bit)."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.asarray([END], "<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows, cols = [], [[] for _ in kinds]
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = enc.encode(text or "") + end
                    for n, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append(k)
                        for c, x in zip(cols, (n, start, length, zlib.crc32(own), own), strict=False):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], schema.fieldNames())

    return in_batches(docs.select("doc_id", F.col("text").cast("string")), run, schema)


class Capacities:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, count: int) -> None:
        if count:
            self.bins[left].append((first, count))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        got = self.bins[left].pop()
        self._mark(left)
        return got

    def _mark(self, left: int) -> None:
        i = left + self.size
        self.any[i] = bool(self.bins[left])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that has an open bin."""
        i = length + self.size
        while not self.any[i]:
            while i & 1:  # a right child: go up until there is a right neighbour
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: runs (length, lo, hi, bin, each, offset).

    The piece of rank j (lo <= j < hi) goes to bin + (j - lo) // each at offset + (j - lo) % each * length.
    """
    tree, runs, bins = Capacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        at, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                first, count = tree.take(room)
                each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, at, at + full * each, first, each, capacity - room))
                tree.put(room - each * length, first, full)
                at, left, first, count = at + full * each, left - full * each, first + full, count - full
            if count and left < each:  # fewer than fill one more bin
                if left:
                    runs.append((length, at, at + left, first, left, capacity - room))
                    tree.put(room - left * length, first, 1)
                    at, left, first, count = at + left, 0, first + 1, count - 1
                tree.put(room, first, count)
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut``, a written table of pieces, with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    parts = from_columns(spark, [(n, -(-c // SLICE_ROWS)) for n, c in histogram.items()], "length", "_parts")
    sliced = cut.join(F.broadcast(parts), "length").withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_parts")))
    counts = durable(sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n")), "pack-slices")  # one row for SLICE_ROWS pieces
    runs = from_columns(spark, plan(histogram, capacity), "_length", "_lo", "_hi", "_bin", "_each", "_offset")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "_slice", before.alias("_before"))
    order = W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.join(F.broadcast(bases) if counts.count() <= BROADCAST_ROWS else bases, ["length", "_slice"]).withColumn("_rank", F.row_number().over(order) - 1 + F.col("_before"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    step = F.col("_rank") - F.col("_lo")
    return placed.select(*cut.columns, (F.col("_bin") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.pmod(step, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def op1_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(durable(pieces(docs), "pack-pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents with their place in the sequences."""
    return pack(durable(pieces(docs.select("doc_id", "text")), "pack-pieces"))
