"""Sharding (operator 5), native: DataFrame and SQL functions only. Law ``bytes``: shard sizes near equal.

Minimax contiguous partition. Equal texts must share a shard, so the atoms that may not be split are cells
of the text's hash: CELLS ordered groups, each a union of whole groups of equal texts. Their byte sums are
one bounded aggregate, whatever the input holds. The smallest capacity for which SHARDS contiguous runs of
cells suffice lies between the largest cell (or the mean) and the total; it is found by binary search, each
probe filling shards greedily, and the cuts are those of the greedy pass at that capacity. Search and cuts
are SQL folds over the one array of cell sizes.

Every text then knows its shard from its hash alone. Slots are gapless: within a shard documents are
ordered by a hashed slice of their doc_id; slice counts are summed first (SHARDS * SLICES rows), rows are
numbered within slices. A group of copies, however large, spreads over all slices.

Defined cases: a null text counts 1 byte, has CRC 0 and is grouped with empty texts; repeated rows take a
slot each; a null doc_id is numbered like any other; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty

SHARDS = 16
CELL_DIGITS = 4
CELLS = 16**CELL_DIGITS
SLICES = 1024
LAW = "bytes"


def cell() -> Column:
    return F.conv(F.substring(F.md5(text_or_empty()), 1, CELL_DIGITS), 16, 10).cast("int")


def cuts(cells: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row: capacity and the last cell of each shard, from (cell, size)."""
    one = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "size"))).alias("cells"))
    fits = """aggregate(c, named_struct('n', 1L, 'room', mid), (s, x) -> CASE WHEN x.size <= s.room THEN named_struct('n', s.n, 'room', s.room - x.size)
      ELSE named_struct('n', s.n + 1L, 'room', mid - x.size) END, s -> s.n)"""
    low = f"greatest(array_max(transform(cells, x -> x.size)), cast(ceil(aggregate(cells, 0L, (a, x) -> a + x.size) / {shards}) as long))"
    search = f"""aggregate(sequence(1, 63), named_struct('lo', {low}, 'hi', aggregate(cells, 0L, (a, x) -> a + x.size)),
      (r, i) -> CASE WHEN r.lo >= r.hi THEN r ELSE transform(array((r.lo + r.hi) div 2), mid ->
        CASE WHEN {fits.replace('aggregate(c,', 'aggregate(cells,')} <= {shards} THEN named_struct('lo', r.lo, 'hi', mid) ELSE named_struct('lo', mid + 1L, 'hi', r.hi) END)[0] END, r -> r.hi)"""
    ends = """aggregate(cells, named_struct('ends', cast(array() as array<int>), 'last', -1, 'room', capacity),
      (s, x) -> CASE WHEN x.size <= s.room THEN named_struct('ends', s.ends, 'last', x.cell, 'room', s.room - x.size)
      ELSE named_struct('ends', array_append(s.ends, s.last), 'last', x.cell, 'room', capacity - x.size) END, s -> s.ends)"""
    return one.filter("size(cells) > 0").withColumn("capacity", F.expr(search)).select("capacity", F.expr(ends).alias("ends"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per document."""
    text = text_or_empty()
    read = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell().alias("cell"))
    read = durable(read, "shard-sizes")  # without texts
    found = cuts(read.groupBy("cell").agg(F.sum("size").alias("size")), shards).first()
    ends = found.ends if found else []
    # a cell's shard is the number of shards that end before it
    number = sum((F.when(F.col("cell") > e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    placed = read.select("doc_id", "size", "text_crc32", number.alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"))
    counts = durable(placed.groupBy("shard", "slice").agg(F.count("*").alias("n")), "shard-slices")
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("shard", "slice", before.alias("before"))  # shards * SLICES rows at most
    place = F.row_number().over(W.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size"))
    slot = (F.col("before") + place - 1).cast("long").alias("slot")
    return placed.join(F.broadcast(bases), ["shard", "slice"]).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
