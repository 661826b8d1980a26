"""Exact top-k search (operator 8): columnar branch-and-bound over integer vectors.

Every component x becomes floor(256 * x); the score is the integer inner product. Queries form blocks of at
most QUERY_BLOCK vectors, candidates chunks of some CHUNK vectors, both as rows of a table; nothing passes
through the driver. Chunks go in lanes; every lane of chunks meets every block of queries by a join on
(dimensions, block, lane), so that a hot block is spread over its lanes. A task lays a chunk out column by
column (vertical) and adds up scores dimension block by dimension block, the blocks with the largest query
mass first. After each block, the mass that is left bounds what a candidate can still gain (Cauchy-Schwarz
over the remaining dimensions); candidates that cannot reach the query's k-th best score so far are dropped
and the survivors compacted. A lane's chunks follow each other, so the k-th best scores of earlier ones bound
the later; only k rows per query and lane leave a task.

Ties go to the smaller vec_id: a candidate is dropped only when its bound is strictly below the k-th score.
Scores are exact: sums of magnitudes below 2**53 go through double-precision products, larger ones through
Python integers (a score outside 64 bits among the best fails the run rather than being wrong).

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part, neither
as query nor as candidate; a query meets the vectors of its own number of dimensions; rows that repeat a
vec_id are candidates each, never for their own vec_id, and queries each; with fewer than k candidates all
are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table

K = 5
QUERY_EVERY = 50
#: Queries and candidates that one task row holds; a worker multiplies QUERY_STEP queries at a time.
QUERY_BLOCK = 4096
CHUNK = 2048
QUERY_STEP = 512
#: Chunks that follow each other in one lane at most.
LANE = 64
DIMENSIONS = 16
SCALE = 256
_EXACT = 2.0**53


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array<double> of integers) of the vectors that take part."""
    # doubles from 2**52 on are whole; floor itself gives a long and would saturate
    scaled = lambda e: e.cast("double") * SCALE
    x = F.transform("embedding", lambda e: F.when(F.abs(scaled(e)) < 2.0**52, F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(scaled(e)) < float("inf")), F.lit(False)))
    return rows.filter(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), x.alias("v"))


class Best:
    """The k best (score, smaller vec_id first) of each query, and its k-th score."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [[] for _ in range(n)], [[] for _ in range(n)]
        self.bar = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([np.asarray(self.ids[q], np.int64), ids])
        top = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[top], i[top]
        if len(top) == self.k:
            self.bar[q] = self.scores[q][-1]


def search(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """One chunk in vertical layout (dimension x candidate) against a block of queries; the number of products spared."""
    dims, n = columns.shape
    order = np.argsort(-np.abs(queries).sum(axis=0), kind="stable")
    blocks = [order[i : i + DIMENSIONS] for i in range(0, dims, DIMENSIONS)]
    left_q = np.zeros((len(blocks) + 1, len(queries)))
    left_c = np.zeros((len(blocks) + 1, n))
    for b in range(len(blocks) - 1, -1, -1):  # remaining mass behind each block
        left_q[b] = left_q[b + 1] + (queries[:, blocks[b]] ** 2).sum(axis=1)
        left_c[b] = left_c[b + 1] + (columns[blocks[b]] ** 2).sum(axis=0)
    left_q, left_c = np.sqrt(left_q), np.sqrt(left_c)
    first = queries[:, blocks[0]] @ columns[blocks[0]]
    spared = 0
    for q in range(len(queries)):
        score, at = first[q], None
        for b in range(1, len(blocks) + 1):
            if np.isfinite(best.bar[q]):
                bound = score + left_q[b, q] * (left_c[b] if at is None else left_c[b, at])
                stay = np.flatnonzero(bound * (1 + 1e-9) + 1 >= best.bar[q]) if b < len(blocks) else np.flatnonzero(score >= best.bar[q])
                spared += (len(score) - len(stay)) * (len(blocks) - b)
                at = stay if at is None else at[stay]
                score = score[stay]
            if b == len(blocks) or not len(score):
                break
            part = columns[blocks[b]] if at is None else columns[blocks[b]][:, at]
            score = score + queries[q, blocks[b]] @ part
        own = ids if at is None else ids[at]
        other = own != query_ids[q]
        score, own = score[other], own[other]
        if len(score) > best.k:
            bar = np.partition(score, len(score) - best.k)[-best.k]
            keep = score >= bar
            score, own = score[keep], own[keep]
        if len(score):
            best.add(q, score, own)
    return spared


def _large(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """The same without bounds, in Python integers, for magnitudes that doubles don't hold."""
    q = [[int(x) for x in v] for v in queries]
    for c, i in zip(columns.T, ids, strict=True):
        c = [int(x) for x in c]
        for k, v in enumerate(q):
            if i != query_ids[k]:
                best.add(k, np.asarray([sum(a * b for a, b in zip(v, c, strict=True))], object), np.asarray([i]))


def _grouped(rows: DataFrame, size: int, name: str, order: DataFrame) -> DataFrame:
    """dims, number, vectors: rows (vec_id, v) in hashed groups of some ``size``; ``order`` (dims, n) counts them."""
    numbered = rows.withColumn("dims", F.size("v")).join(F.broadcast(order), "dims")  # one row for each number of dimensions
    slot = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / size)).alias(name)
    return numbered.select("dims", slot, F.struct("vec_id", "v").alias("one")).groupBy("dims", name).agg(F.collect_list("one").alias(f"{name}_rows"))


def topk(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best ``rows`` of each of ``queries`` (vec_id, v)."""
    spark = rows.sparkSession
    # the number of dimensions is a property of the model: a table of one row or a few
    counts = lambda df, least: durable(df.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")), least)
    chunks, blocks = counts(rows, "topk-counts"), counts(queries, "topk-query-counts")
    wide = F.least(F.ceil(F.col("n") / CHUNK), F.greatest(F.ceil(F.col("n") / (CHUNK * LANE)), F.lit(spark.sparkContext.defaultParallelism)))
    lanes = chunks.select("dims", wide.alias("lanes"))
    parts = blocks.select("dims", F.ceil(F.col("n") / QUERY_BLOCK).alias("blocks"))
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = durable(_grouped(queries, QUERY_BLOCK, "block", blocks), "topk-blocks")
    asked = asked.join(F.broadcast(lanes), "dims").select("dims", "block", "block_rows", up_to("lanes").alias("lane"))
    given = _grouped(rows, CHUNK, "chunk", chunks).join(F.broadcast(lanes), "dims").join(F.broadcast(parts), "dims")
    given = given.select("dims", "chunk", "chunk_rows", F.pmod("chunk", "lanes").alias("lane"), up_to("blocks").alias("block"))
    met = asked.join(given, ["dims", "block", "lane"]).sortWithinPartitions("dims", "block", "lane", "chunk")
    found = _searched(met.select("dims", "block", "lane", "block_rows", "chunk_rows"), k)
    rank = F.row_number().over(W.partitionBy("query_id", "dims", "block", "n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vectors(column: pa.ListArray, at: int) -> tuple[np.ndarray, np.ndarray]:
    one = column[at].values
    v = one.field("v").slice(one.offset, len(one)) if len(one.field("v")) != len(one) else one.field("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(one), -1), one.field("vec_id").to_numpy(zero_copy_only=False)


def _searched(met: DataFrame, k: int) -> DataFrame:
    def rows_of(key: tuple, ids: np.ndarray, at: int, best: Best) -> pa.RecordBatch:
        n = [j for j in range(len(best.ids)) for _ in best.ids[j]]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(n), pa.int32()), pa.array([key[1]] * len(n), pa.int64()), pa.array([at + j for j in n], pa.int32()), pa.array([int(ids[at + j]) for j in n], pa.int64()),
             pa.array([int(i) for x in best.ids for i in x], pa.int64()), pa.array([int(s) for x in best.scores for s in x], pa.int64())],
            ["dims", "block", "n", "query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, ids, bests = None, None, None, []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            for at, now in enumerate(keys):
                if now != key:
                    for i, best in bests:
                        yield rows_of(key, ids, i, best)
                    key = now
                    queries, ids = _vectors(b.column(3), at)
                    bests = [(i, Best(min(QUERY_STEP, len(ids) - i), k)) for i in range(0, len(ids), QUERY_STEP)]
                vectors, own = _vectors(b.column(4), at)
                columns = np.ascontiguousarray(vectors.T)
                top = np.sqrt((columns**2).sum(axis=0).max())
                for i, best in bests:
                    some = queries[i : i + QUERY_STEP]
                    safe = np.sqrt((some**2).sum(axis=1).max()) * top < _EXACT
                    (search if safe else _large)(some, ids[i : i + QUERY_STEP], columns, own, best)
        for i, best in bests:
            yield rows_of(key, ids, i, best)

    return met.mapInArrow(run, "dims int, block long, n int, query_id long, vec_id long, score long")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk(rows, rows.filter(f"vec_id % {QUERY_EVERY} = 0"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM d q JOIN d c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""
