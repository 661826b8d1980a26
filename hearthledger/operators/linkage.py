"""Record linkage: blocked candidate joins, first-match and mutual-best links, clusters, multiset differences."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthledger.functions import similarity as M


def pairs_within(rows: DataFrame, block: list[str], id_: str, keep: list[str]) -> DataFrame:
    """Ordered pairs of a block: an equi-join on the block with id < id; blocks must be selective."""
    a = rows.select(*block, *(F.col(c).alias(f"{c}_a") for c in [id_, *keep]))
    b = rows.select(*block, *(F.col(c).alias(f"{c}_b") for c in [id_, *keep]))
    return a.join(b, block).filter(F.col(f"{id_}_a") < F.col(f"{id_}_b"))


def prefix_keys(rows: DataFrame, block: str, id_: str, items: Column, least: Callable[[Column], Column], tag: str) -> DataFrame:
    """block, id, key: of each row's distinct items, rare ones first, as many that two rows sharing ``least(size)`` of them share a key."""
    each = rows.select(block, id_, F.posexplode(items).alias("_at", "_i"), F.size(items).alias("_n")).drop("_at")
    often = each.groupBy(block, "_i").agg(F.count("*").alias("_c"))
    ranked = each.join(often, [block, "_i"]).groupBy(block, id_).agg(F.array_sort(F.collect_list(F.struct("_c", "_i"))).alias("_s"), F.max("_n").alias("_n"))
    kept = F.slice("_s", 1, F.greatest(F.col("_n") - least(F.col("_n")) + 1, F.lit(1)).cast("int"))
    return ranked.select(block, id_, F.explode(kept).alias("_k")).select(block, id_, F.concat(F.lit(tag), F.col("_k._i")).alias("key"))


def candidates(keys: DataFrame, rows: DataFrame, block: str, id_: str, text: str) -> DataFrame:
    """id_a, id_b, text_a, text_b: rows of a block that share a key."""
    named = lambda n: keys.select(block, "key", F.col(id_).alias(f"{id_}_{n}"))
    met = named("a").join(named("b"), [block, "key"]).filter(F.col(f"{id_}_a") < F.col(f"{id_}_b")).select(f"{id_}_a", f"{id_}_b").distinct()
    texts = lambda n: rows.select(F.col(id_).alias(f"{id_}_{n}"), F.col(text).alias(f"{text}_{n}"))
    return met.join(texts("a"), f"{id_}_a").join(texts("b"), f"{id_}_b")


def alike(left: DataFrame, right: DataFrame, block: list[str], name: str, other: str, least: float) -> DataFrame:
    """block, name, other, score: distinct names of both sides alike by ``least`` (0.4 to 0.85) and more, each pair once. Candidates share a rare bigram, a rare word, or the given name's start and the last one's bigram."""
    distinct = lambda df, c: df.select(F.struct(*block).alias("_block"), F.col(c).alias("_name")).distinct()
    every = distinct(left, name).union(distinct(right, other)).distinct().filter("_name is not null").withColumn("_t", F.lower(F.trim("_name")))
    word, last = M.tokens(F.col("_t")), F.element_at(M.tokens(F.col("_t")), -1)
    by_bigram = prefix_keys(every, "_block", "_name", M.bigrams(F.col("_t")), lambda n: F.ceil(least / (2 - least) * n - 1e-9), "b")
    by_word = prefix_keys(every, "_block", "_name", F.array_distinct(word), lambda n: F.ceil(least * n - 1e-9), "w")
    starts = F.concat(F.array(last), M.bigrams(last))
    by_start = every.filter(F.size(word) > 1).select("_block", "_name", F.explode(starts).alias("_i"), F.substring("_t", 1, 3).alias("_s")).select("_block", "_name", F.concat(F.lit("s"), "_s", F.lit(" "), "_i").alias("key"))
    keys = by_bigram.union(by_word).union(by_start)
    side = lambda df, c, n: keys.join(distinct(df, c), ["_block", "_name"], "left_semi").withColumnRenamed("_name", n)
    met = side(left, name, "_a").join(side(right, other, "_b"), ["_block", "key"]).select("_block", "_a", "_b").distinct()
    scored = met.withColumn("score", M.name_similarity(F.col("_a"), F.col("_b"))).filter(F.col("score") >= least)
    return scored.select(*(F.col("_block")[b].alias(b) for b in block), F.col("_a").alias(name), F.col("_b").alias(other), "score")


def nearest_by(left: DataFrame, right: DataFrame, block: str, id_l: str, id_r: str, value: str) -> DataFrame:
    """id_l, id_r, score: for each left row the right row of the block with the nearest value, ties to the smaller id: one sorted pass, no product."""
    points = right.groupBy(block, value).agg(F.min(id_r).alias(id_r))
    both = left.select(block, value, F.col(id_l).alias("_l"), F.lit(None).cast(right.schema[id_r].dataType).alias("_r")).unionByName(points.select(block, value, F.lit(None).cast(left.schema[id_l].dataType).alias("_l"), F.col(id_r).alias("_r")))
    point = F.when(F.col("_r").isNotNull(), F.struct(F.col(value).alias("v"), F.col("_r").alias("r")))
    # rows of one value see each other: a range frame
    by = W.partitionBy(block).orderBy(value)
    below = F.last(point, ignorenulls=True).over(by.rangeBetween(W.unboundedPreceding, W.currentRow))
    above = F.first(point, ignorenulls=True).over(by.rangeBetween(W.currentRow, W.unboundedFollowing))
    found = both.withColumn("_a", below).withColumn("_b", above).filter("_l is not null")
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(value) - F.col(f"{c}.v")).alias("d"), F.col(f"{c}.r").alias("r")))
    best = F.least(away("_a"), away("_b"))  # nulls aside
    return found.withColumn("_n", best).filter("_n is not null").select(F.col("_l").alias(id_l), F.col("_n.r").alias(id_r), (-F.col("_n.d")).alias("score"))


def mutual_nearest(left: DataFrame, right: DataFrame, block: str, id_l: str, id_r: str, value: str) -> DataFrame:
    """Pairs that are each other's nearest."""
    there, back = nearest_by(left, right, block, id_l, id_r, value), nearest_by(right, left, block, id_r, id_l, value)
    return there.join(back.select(id_l, id_r), [id_l, id_r])


def nearest_one_to_one(left: DataFrame, right: DataFrame, block: str, id_l: str, id_r: str, value: str, durable) -> DataFrame:
    """Greedy nearest-first one-to-one links, ties to the smaller left, then right id; unknown values have no nearest. One Arrow function settles a block."""
    held = lambda df, side, id_: df.filter(F.col(value).isNotNull() & F.col(block).isNotNull() & ~F.isnan(value)).select(block, value, F.lit(side).alias("_side"), F.col(id_).alias("_id"))
    out = T.StructType([T.StructField(id_l, left.schema[id_l].dataType), T.StructField(id_r, right.schema[id_r].dataType), T.StructField("score", left.schema[value].dataType)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(nearest_first(rows[value].tolist(), rows["_side"].tolist(), rows["_id"].tolist()), columns=[id_l, id_r, "score"])

    return durable(held(left, 0, id_l).union(held(right, 1, id_r)).groupBy(block).applyInPandas(run, out))


def nearest_first(values: list, sides: list[int], ids: list) -> list[tuple]:
    """left, right, -distance: the nearest pair of a left (side 0) and a right id, then the nearest of the rest. Ids of one value queue in one place; only neighbouring places can hold the nearest pair."""
    queues: dict = {}
    for v, side, i in zip(values, sides, ids, strict=True):
        queues.setdefault(v, ([], []))[side].append(i)
    for q in queues.values():
        for ids_ in q:
            ids_.sort(reverse=True)  # the next one last
    line = sorted(queues)
    after, before, heap = dict(zip(line, line[1:], strict=False)), dict(zip(line[1:], line, strict=False)), []

    def offer(u, v):
        if queues[u][0] and queues[v][1]:
            heapq.heappush(heap, (abs(u - v) if u != v else 0.0, queues[u][0][-1], queues[v][1][-1], u, v))

    for u in line:
        offer(u, u)
        if u in after:
            offer(u, after[u])
            offer(after[u], u)
    found = []
    while heap:
        d, i, j, u, v = heapq.heappop(heap)
        if not (queues[u][0] and queues[v][1]):
            continue
        if (queues[u][0][-1], queues[v][1][-1]) != (i, j):
            offer(u, v)
            continue
        found.append((queues[u][0].pop(), queues[v][1].pop(), -d))
        offer(u, v)
        for w in {u, v}:
            if not queues[w][0] and not queues[w][1]:
                a, b = before.pop(w, None), after.pop(w, None)
                if a is not None:
                    after.pop(a)
                if b is not None:
                    before.pop(b)
                if a is not None and b is not None:
                    after[a], before[b] = b, a
                    offer(a, b)
                    offer(b, a)
    return found


def one_edit_pairs(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """Pairs of equal length that differ in one character other than the first: joined on the text with
    that position masked, so that no pair is compared that cannot match."""
    masked = rows.filter(F.length(text) >= 2).select(id_, text, F.explode(F.sequence(F.lit(2), F.length(text))).alias("at"))
    masked = masked.withColumn("rest", F.concat(F.substring(text, F.lit(1), F.col("at") - 1), F.lit("\u0001"), F.substring(text, F.col("at") + 1, F.lit(1_000_000))))
    return pairs_within(masked, ["at", "rest"], id_, [text]).filter(F.col(f"{text}_a") != F.col(f"{text}_b")).drop("at", "rest")


def first_match(links: DataFrame, item: str, order: list[Column]) -> DataFrame:
    """Each item goes to the first of its matches."""
    return links.withColumn("_p", F.row_number().over(W.partitionBy(item).orderBy(*order))).filter("_p = 1").drop("_p")


def clusters(edges: DataFrame, nodes: DataFrame, id_: str, durable) -> DataFrame:
    """id, cluster: the smallest id each node reaches over (a, b) edges; min-label propagation with shortcuts."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = durable(nodes.select(F.col(id_).alias("v"), F.col(id_).alias("l")))
    while True:
        near = both.join(label.withColumnsRenamed({"v": "b"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        up = label.select(F.col("v").alias("m"), F.col("l").alias("top"))
        step = label.join(near, "v", "left").select("v", "l", F.least("l", F.coalesce("m", "l")).alias("m")).join(up, "m", "left")
        step = durable(step.select("v", F.col("l").alias("old"), F.least("m", F.coalesce("top", "m")).alias("l")))
        label = step.select("v", "l")
        if step.filter("old <> l").isEmpty():
            return label.select(F.col("v").alias(id_), F.col("l").alias("cluster"))


def classes(rows: DataFrame, keys: list[str], id_: str, ids: str, most: int = 512) -> DataFrame:
    """keys, ids: the ids of rows alike in ``keys``, in arrays of at most ``most``."""
    every = rows.groupBy(*keys).agg(F.collect_list(id_).alias("_all"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / most).cast("int")), lambda k: F.slice("_all", k * most + 1, most))
    return every.select(*keys, F.explode(parts).alias(ids))


def each_pair(pairs: DataFrame, ids_a: str, ids_b: str, a: str, b: str) -> DataFrame:
    """``pairs`` of classes with a row for each pair of their ids; dealt out first, as one of them may stand for most rows."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n).withColumn(a, F.explode(ids_a)).drop(ids_a).withColumn(b, F.explode(ids_b)).drop(ids_b)


def slip_pairs(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """a, b: ids whose texts are one character substituted, dropped or added apart. Texts meet once each, on a text with one place masked or cut.

    Every join is told to sort: the planner does not see that a text is spread over its places, and would broadcast all of them."""
    rows = rows.select(F.col(id_).alias("k"), F.col(text).alias("t"))
    held = rows.select("t").distinct()
    places = F.sequence(F.lit(1), F.length("t"))
    cut = lambda mark: F.transform(places, lambda i: F.concat(F.left("t", i - 1), F.lit(mark), F.substring(F.col("t"), i + 1, F.length("t"))))
    spread = lambda mark, n: held.filter(F.length("t") > 0).select(F.col("t").alias(f"t_{n}"), F.explode(F.array_distinct(cut(mark))).alias("m")).hint("merge")
    swapped = spread("\u0001", "a").join(spread("\u0001", "b"), "m").filter("t_a < t_b").select("t_a", "t_b")
    added = spread("", "a").join(held.select(F.col("t").alias("t_b"), F.col("t").alias("m")).hint("merge"), "m").select("t_a", "t_b")
    named = lambda n: rows.select(F.col("k").alias(n), F.col("t").alias(f"t_{n}")).hint("merge")
    met = swapped.union(added).distinct().join(named("a"), "t_a").join(named("b"), "t_b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """order, first: rows whose key occurred before, and where. The minimum is partial; no window sees a hot key."""
    keyed = rows.select(order, key.alias("_k"))
    first = keyed.groupBy("_k").agg(F.min(order).alias("first"))
    return keyed.join(first, "_k").filter(F.col(order) > F.col("first")).select(order, "first")


def digit_slips(cents: int) -> list[int]:
    """Amounts, in cents, that differ in one printed digit; the leading character must agree."""
    shown = f"{cents / 100:.2f}"
    return [int((shown[:i] + d + shown[i + 1 :]).replace(".", "")) for i in range(1, len(shown)) if shown[i] != "." for d in "0123456789" if d != shown[i]]


def reachable(value: int, others: list[int]) -> bool:
    """Whether two to six of ``others`` sum up to ``value``, to the cent or one misread digit apart; two halves of up to three meet."""
    others = [o for o in others if o]
    if not value or len(others) < 2:
        return False
    halves: dict[int, list[int]] = {}
    for k in range(1, 4):
        for c in combinations(range(len(others)), k):
            halves.setdefault(sum(others[i] for i in c), []).append(sum(1 << i for i in c))
    for want in (value, value - 1, value + 1, *digit_slips(value)):
        if any(m & (m - 1) for m in halves.get(want, ())):
            return True
        for total, masks in halves.items():
            rest = halves.get(want - total)
            if rest and any(not a & b for a in masks for b in rest):
                return True
    return False


def totals_of(lines: list[dict], reference: int | None = None) -> list[bool]:
    """Lines (page, cents, untyped) that sum up others of their page; untyped ones also over all pages, or within 3 % of the reference total."""
    found = []
    for i, d in enumerate(lines):
        rest = [o for j, o in enumerate(lines) if j != i]
        value = d["cents"]
        held = value is not None and reachable(value, [o["cents"] for o in rest if o["page"] == d["page"] and o["cents"] is not None])
        if value and not held and d["untyped"]:
            held = reachable(value, [o["cents"] for o in rest if o["cents"] is not None])
            held = held or bool(reference and reference > 0 and abs(value - reference) / reference <= 0.03)
        found.append(held)
    return found


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def total_lines(lines: pd.Series, reference: pd.Series) -> pd.Series:
    """``totals_of`` for an array of a case's declared lines; a form's lines are few, their subsets are not a built-in's business."""
    return pd.Series([totals_of(list(a), None if pd.isna(r) else int(r)) for a, r in zip(lines, reference, strict=True)])
