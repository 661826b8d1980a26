"""MinHash near-duplicates (operator 6).

Texts are lower-cased (A-Z), cut into words, and compared by the Jaccard similarity of their distinct
shingles: of two words in the query, of STAGE_WIDTH words in the pipeline. The method is b-bit MinHash:

1. one pass over the texts takes ``BANDS * ROWS`` minima per document, hashes each band of ``ROWS``
   minima to a 64-bit key, and keeps only the low ``BITS`` bits of every minimum, packed in longs;
2. documents with equal word sequences become one class, stood for by one of its rows;
3. classes that share a band key are candidates. Their similarity is estimated from the packed bits by
   XOR and bit counts, corrected for chance collisions; clearly dissimilar pairs stop there
   (``ESTIMATE_FLOOR`` lies 4.5 standard deviations below the threshold);
4. a pair is linked only when its full shingle sets, held as sorted 64-bit hashes of every distinct shingle,
   satisfy ``100 * inter >= 80 * union``.

Groups are never expanded into all their pairs. First every member of a band key meets leaders only (the
key's least class): the most similar of its leaders, then those still in another component. Linked classes
become components. Keys whose members are then still in different components are *mixed*; only there can a
link be missing. Their members are put into blocks of some BLOCK classes or BLOCK_HASHES hashes, by the
member's largest mixed key and, where one component alone fills blocks, by that component. Two blocks are
compared, once, if a mixed key has members in both, unless both hold one and the same component; a block's
sets meet in matrix products, and only a spanning forest of the links leaves. So rows shipped follow the
members of mixed keys outside their key's main component, not pairs, and no link that candidate generation
saw is lost. What remains quadratic, in arithmetic and in blocks shipped, is a key of which many members are
similar to each other, below the threshold, in many components.

Hot groups: leaders are joined in slices counted beforehand; the joins on a band key carry three longs a
row and are inner joins that adaptive execution may split.

A pair at exactly 0.8 shares no band with probability (1 - 0.8**5)**30 = 7e-6.

Defined cases: a text without words (null, empty, white space) has an empty set and links with nothing;
a text shorter than a shingle has one, its sequence; every row is a document, also where rows share a
doc_id; a null doc_id takes no part (component_id null, kept); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, in_batches, scratch, table, utf8

ROWS, BANDS, BITS = 5, 30, 2
HASHES = ROWS * BANDS
PER_LONG = 30
THRESHOLD_PERCENT = 80
#: Words of a shingle in the query op6, and in the pipeline's stage.
WIDTH, STAGE_WIDTH = 2, 5
ESTIMATE_FLOOR = 0.62
#: A block holds about so many classes, or so many shingle hashes (8 bytes each), whichever is reached first.
BLOCK, BLOCK_HASHES = 256, 1 << 16
#: Shingles that two blocks share are compared so many at a time.
COLUMNS = 4096
#: Ids, or pairs of ids, are broadcast only up to so many rows (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(20_240_611)
_A = (_RNG.integers(0, 1 << 31, HASHES, np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _K2
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the distinct shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    distinct = dict.fromkeys(words)
    for w in distinct:
        distinct[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(distinct.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        short = len(h) < width
        n = 1 if short else len(h) - width + 1
        x = h[:n]
        for k in range(1, len(h) if short else width):
            x = _mixed(_mixed(x * _K1) + h[k : k + n])
        return np.unique(_mixed(x + _K3) if short else x)


def signature(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Packed low bits of the minima, and the band keys."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):  # bounded memory for very long texts
        np.minimum(low, (np.multiply.outer(x[i : i + 2048], _A) + _B).min(axis=0), out=low)
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, PER_LONG)
    packed = (bits << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _K3
    for r in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = _mixed(key * _K1 + r)
    return packed.astype(np.int64).tolist(), key.astype(np.int64).tolist()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, hash of the text, n_shingles, hash of the word sequence, packed minima, band keys; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part, cols = b.slice(i, 1024), [[] for _ in kinds]
                for text in utf8(part.column(2)):
                    w = words_of(text)
                    h = shingle_hashes(w, width)
                    sig, bands = signature(h) if len(h) else (None, None)
                    for col, x in zip(cols, (len(h), xxhash.xxh3_128_digest(b" ".join(w)) if w else None, sig, bands), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "th", "n_shingles", "seq", "sig", "bands"]
    return in_batches(_hashed(docs), run, "doc_id long, th long, n_shingles long, seq binary, sig array<long>, bands array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), _text_hash().alias("th"), F.col("text").cast("string"))


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity from the packed bits of columns ``a`` and ``b``."""
    differ = F.lit(0)
    for i in range(HASHES // PER_LONG):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def _few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table, broadcast when a count shows it small enough."""
    return F.broadcast(df) if df.count() <= rows else df


def connected(edges: DataFrame) -> DataFrame:
    """(v, l): the smallest vertex that each vertex of ``edges`` (a, b) reaches. Min-label hooking with shortcuts.

    The labels, one row a vertex, are broadcast while a count shows them small; then a round shuffles once.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "cc-edges")
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("l")), "cc-labels")
    small = labels.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda df: df)
    while True:
        near = both.join(sent(labels.withColumnsRenamed({"v": "b"})), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        hooked = near.join(sent(labels), "v").select("v", "l", F.least("l", "m").alias("m"))
        for k in range(2):  # two shortcuts a round
            up = labels.select(F.col("v").alias("m"), F.col("l").alias("top"))
            hooked = hooked.join(sent(up), "m", "left").select("v", "l", F.least("m", F.coalesce("top", "m")).alias("m"))
        step = durable(hooked.select("v", F.col("l").alias("old"), F.col("m").alias("l")), "cc-labels")
        labels = step.select("v", "l")
        if step.filter("old <> l").isEmpty():
            return labels


def spanning(left: pa.Array, right: pa.Array, same: bool) -> list[tuple[int, int]]:
    """Pairs of components that links between two blocks (arrays of v, comp, n, sig, hashes) join; a spanning forest."""
    sig, size, comp = ([np.asarray(side.field(c).flatten() if c == "sig" else side.field(c)) for side in (left, right)] for c in ("sig", "n", "comp"))
    sig = [x.view(np.uint64).reshape(-1, HASHES // PER_LONG) for x in sig]
    differ = np.zeros((len(size[0]), len(size[1])), np.int16)
    for k in range(HASHES // PER_LONG):
        x = sig[0][:, k, None] ^ sig[1][None, :, k]
        differ += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    chance = 2.0**-BITS
    may = (1 - differ / HASHES - chance) / (1 - chance) >= ESTIMATE_FLOOR
    may &= comp[0][:, None] != comp[1][None, :]
    may &= 100 * np.minimum(size[0][:, None], size[1][None, :]) >= THRESHOLD_PERCENT * np.maximum(size[0][:, None], size[1][None, :])
    if same:
        may = np.triu(may, 1)
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows):
        return []
    sets, owner = [], []
    for side, at in ((left, rows), (right, cols)):
        own = [np.frombuffer(side.field("hashes")[int(i)].as_buffer(), np.uint64) for i in at]
        sets.append(np.concatenate(own))
        owner.append(np.repeat(np.arange(len(at)), [len(x) for x in own]))
    common = np.intersect1d(*map(np.unique, sets), assume_unique=True)
    where = [np.searchsorted(common, x) for x in sets]
    hit = [common[np.minimum(w, len(common) - 1)] == x if len(common) else np.zeros(len(x), bool) for w, x in zip(where, sets, strict=True)]
    inter = np.zeros((len(rows), len(cols)), np.int64)
    for i in range(0, len(common), COLUMNS):
        m = []
        for o, w, h, at in zip(owner, where, hit, (rows, cols), strict=True):
            now = h & (w >= i) & (w < i + COLUMNS)
            one = np.zeros((len(at), COLUMNS), np.float32)
            one[o[now], w[now] - i] = 1
            m.append(one)
        inter += (m[0] @ m[1].T).astype(np.int64)
    linked = may[np.ix_(rows, cols)] & (100 * inter >= THRESHOLD_PERCENT * (size[0][rows][:, None] + size[1][cols][None, :] - inter))
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while c in top:
            c = top[c]
        return c

    found = []
    i, j = np.nonzero(linked)
    for a, b in dict.fromkeys(zip(comp[0][rows[i]].tolist(), comp[1][cols[j]].tolist(), strict=True)):
        ra, rb = root(a), root(b)
        if ra != rb:
            found.append((a, b))
            top[max(ra, rb)] = min(ra, rb)
    return found


def block_links(met: DataFrame) -> DataFrame:
    """a, b: components joined by links, from pairs of blocks (left, right, same)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [(b.column(c).values, b.column(c).offsets.to_numpy()) for c in (0, 1)]
            for k, same in enumerate(b.column(2).to_pylist()):
                found = spanning(*(v.slice(o[k], o[k + 1] - o[k]) for v, o in sides), same)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    return in_batches(met.select("left", "right", "same"), run, "a long, b long")


def shingled(docs: DataFrame, alive: DataFrame, repeated: bool, width: int) -> DataFrame:
    """v, n, sig, hashes of the rows that stand for the classes ``alive`` (doc_id, th, v, n, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                got = [shingle_hashes(words_of(t), width).tobytes() for t in utf8(part.column(3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(got, pa.binary())], ["v", "n", "sig", "hashes"])

    few = F.broadcast(alive) if alive.count() <= BROADCAST_ROWS // 4 else alive
    found = _hashed(docs).join(few, ["doc_id", "th"]).select("v", "n", "sig", "text")
    found = in_batches(found, run, "v long, n long, sig array<long>, hashes binary")
    return found.dropDuplicates(["v"]) if repeated else found


_NODE = ("v", "comp", "n", "sig", "hashes")


def _parts(sizes: DataFrame, *key: str) -> DataFrame:
    """``parts``: blocks that the classes of a key (count ``members``, shingles ``mass``) need."""
    return sizes.select(*key, F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("mass") / BLOCK_HASHES)).alias("parts"))


def star_links(pairs: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: components joined by links of ``pairs`` (x, y, nx; a written table). A leader y comes once to each block of its members."""
    sizes = durable(_parts(pairs.groupBy("y").agg(F.count("*").alias("members"), F.sum("nx").alias("mass")), "y"), "neardup-leads")
    nodes = sets.join(comp, "v")
    few = _few(sizes)
    leads = nodes.join(few, nodes.v == few.y).select("y", F.struct(*_NODE).alias("lead"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    slots = _leader_slices(pairs, sizes)
    members = nodes.join(slots, nodes.v == slots.x).select("y", "part", F.struct(*_NODE).alias("node"))
    blocks = members.groupBy("y", "part").agg(F.collect_list("node").alias("right"))
    return block_links(blocks.join(leads, ["y", "part"]).select(F.array("lead").alias("left"), "right", F.lit(False).alias("same")))


def _leader_slices(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """x, y, part. Leaders of one block need no join; the others' table is small beside the pairs."""
    large = durable(sizes.filter("parts > 1"), "neardup-large")
    small = _few(large)
    placed = pairs.select("x", "y").join(small, "y", "left")
    return placed.select("x", "y", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))


def mixed_links(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: components joined by links among the members (key, v, comp) of mixed keys."""
    size = durable(open_.groupBy("key").agg(F.count("*").alias("members")), "neardup-mixed-sizes")
    home = open_.join(size, "key").groupBy("v").agg(F.max(F.struct("members", "key"))["key"].alias("home"), F.min("comp").alias("comp"))
    home = durable(home.join(sets.select("v", "n"), "v"), "neardup-homes")
    own = home.groupBy("home", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("mass"))
    own = durable(own.withColumn("alone", F.when((F.col("members") >= BLOCK) | (F.col("mass") >= BLOCK_HASHES), F.col("comp"))), "neardup-own")
    parts = durable(_parts(own.groupBy("home", "alone").agg(F.sum("members").alias("members"), F.sum("mass").alias("mass")), "home", "alone"), "neardup-parts")
    group = own.select("home", "comp", "alone").join(parts.withColumnsRenamed({"home": "h", "alone": "a"}), (F.col("home") == F.col("h")) & F.col("alone").eqNullSafe(F.col("a"))).select("home", "comp", "alone", "parts")
    group = durable(group, "neardup-groups")
    placed = home.join(_few(group), ["home", "comp"]).select("v", "comp", F.xxhash64("home", "alone", F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block"))
    placed = durable(placed, "neardup-placed")
    blocks = sets.join(placed, "v").groupBy("block").agg(F.collect_list(F.struct(*_NODE)).alias("nodes"))
    blocks = durable(blocks, "neardup-blocks")
    seen = open_.select("key", "v").join(placed, "v").groupBy("key", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    seen = durable(seen, "neardup-seen")
    one, other = seen.withColumnsRenamed({"block": "p"}), seen.withColumnsRenamed({"block": "q", "lo": "lo2", "hi": "hi2"})
    # a key whose members lie in one block needs that block only
    met = one.join(other, "key").filter("p <= q and not (lo = hi and lo2 = hi2 and lo = lo2)").select("p", "q").distinct()
    met = durable(met, "neardup-block-pairs")
    left, right = blocks.withColumnsRenamed({"block": "p", "nodes": "left"}), blocks.withColumnsRenamed({"block": "q", "nodes": "right"})
    return block_links(met.join(left, "p").join(right, "q").select("left", "right", (F.col("p") == F.col("q")).alias("same")))


def joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp`` (v, comp) with the components of ``edges`` (a, b; a written table) merged."""
    if edges.isEmpty():
        return comp
    root = _few(connected(edges).withColumnsRenamed({"v": "was"}))
    return durable(comp.join(root, comp.comp == root.was, "left").select("v", F.coalesce("l", "comp").alias("comp")), "neardup-comp")


def components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th, n_shingles, node, component_id, one row per input row; shingles of ``width`` words. Rows of a component share ``node``."""
    with scratch(docs.sparkSession):
        sigs = durable(signatures(docs, width).withColumn("row", F.monotonically_increasing_id()), "neardup-sigs")
        nodes = sigs.filter("n_shingles > 0 and doc_id is not null")
        copies = nodes.groupBy("seq").agg(F.min("row").alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("c")).filter("c > 1").drop("c")
        copies = durable(copies, "neardup-copies")
        repeated = not copies.isEmpty()
        whole = nodes.join(_few(copies), "seq", "left").select("row", "doc_id", "th", "n_shingles", F.coalesce("first", "row").alias("v"), F.coalesce("least", "doc_id").alias("least"), "sig", "bands")
        member = durable(whole.select("row", "doc_id", "th", "n_shingles", "v", "least", *(F.when(F.col("v") == F.col("row"), F.col(c)).alias(c) for c in ("sig", "bands"))), "neardup-classes")
        reps = member.filter("bands is not null")
        keyed = reps.select("v", F.explode("bands").alias("key"))
        shared = durable(keyed.groupBy("key").agg(F.min("v").alias("y"), F.max("v").alias("hi")).filter("y < hi").select("key", "y"), "neardup-keys")
        inside = durable(keyed.join(shared, "key").select("key", "v", "y"), "neardup-keyed")
        alive = inside.select("v").distinct()
        alive = durable(reps.select("doc_id", "th", "v", F.col("n_shingles").alias("n"), "sig").join(alive, "v"), "neardup-alive")
        sets = durable(shingled(docs, alive, repeated, width), "neardup-sets")
        met = inside.filter("v <> y").select(F.col("v").alias("x"), "y").distinct().join(alive.select(F.col("v").alias("x"), F.col("n").alias("nx"), F.col("sig").alias("sx")), "x")
        met = durable(met, "neardup-met")
        ends = alive.select(F.col("v").alias("y"), F.col("n").alias("ny"), F.col("sig").alias("sy")).join(_few(durable(met.select("y").distinct(), "neardup-ends")), "y", "left_semi")
        may = (100 * F.least("nx", "ny") >= THRESHOLD_PERCENT * F.greatest("nx", "ny")) & (F.col("like") >= ESTIMATE_FLOOR)
        pairs = durable(met.join(ends, "y").withColumn("like", estimate("sx", "sy")).filter(may).select("x", "y", "nx", "like"), "neardup-pairs")
        comp = alive.select("v", F.col("v").alias("comp"))
        # each class meets the leader it resembles most, then those still elsewhere
        nearest = durable(pairs.groupBy("x").agg(F.max(F.struct("like", -F.col("y"), "y", "nx")).alias("b")).select("x", "b.y", "b.nx"), "neardup-nearest")
        comp = joined(comp, durable(star_links(nearest, comp, sets), "neardup-links"))
        apart = pairs.join(comp.select(F.col("v").alias("x"), F.col("comp").alias("cx")), "x").join(comp.select(F.col("v").alias("y"), F.col("comp").alias("cy")), "y").filter("cx <> cy")
        apart = durable(apart.select("x", "y", "nx"), "neardup-apart")
        comp = joined(comp, durable(star_links(apart, comp, sets), "neardup-links"))
        now = durable(inside.select("key", "v").join(comp, "v"), "neardup-now")
        mixed = durable(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key"), "neardup-mixed")
        if not mixed.isEmpty():
            open_ = durable(now.join(mixed, "key"), "neardup-open")
            comp = joined(comp, durable(mixed_links(open_, sets), "neardup-more-links"))
        placed = member.select("doc_id", "th", "n_shingles", "v", "least").join(comp, "v", "left").withColumn("node", F.coalesce("comp", "v"))
        placed = durable(placed.select("doc_id", "th", "n_shingles", "node", "least"), "neardup-placed-rows")
        least = placed.groupBy("node").agg(F.min("least").alias("component_id"), F.count("*").alias("c")).filter("c > 1").drop("c")
        final = placed.join(_few(durable(least, "neardup-least")), "node", "left").select("doc_id", "th", "n_shingles", "node", F.coalesce("component_id", "least").alias("component_id"))
        rest = sigs.filter("n_shingles = 0 or doc_id is null").select("doc_id", "th", "n_shingles", F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"))
        return durable(final.union(rest), "neardup-components", keep=True)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _not_in(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are (left_semi) or are not (left_anti) among ``rows`` (doc_id, th)."""
    few = _few(rows)
    return docs.join(few, (docs["doc_id"].cast("long") == few["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == few["th"]), how)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates one document with the smallest doc_id stays, once; texts without words and null doc_ids stay."""
    found = components(docs.select("doc_id", "text"), STAGE_WIDTH)
    gone = durable(found.filter("doc_id <> component_id").select("doc_id", "th").distinct(), "neardup-gone")
    first = found.filter("doc_id = component_id and node is not null")
    twice = durable(first.groupBy("node").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th")).alias("m")).filter("c > 1").select("node", "m.doc_id", "m.th"), "neardup-twice")
    kept = _not_in(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    # rows that share doc_id and component: one stays, the last in the order of its values as JSON
    again = durable(first.join(_few(twice.select("node")), "node").select("doc_id", "th", "node").distinct(), "neardup-again")
    few = _few(again.withColumnsRenamed({"doc_id": "_again_id", "th": "_again_th", "node": "_again_node"}))
    row, on = F.struct(*(docs[c] for c in docs.columns)), (docs["doc_id"].cast("long") == few["_again_id"]) & (F.xxhash64(docs["text"].cast("string")) == few["_again_th"])
    one = docs.join(few, on).groupBy(few["_again_node"]).agg(F.max_by(row, F.to_json(row)).alias("row"))
    return _not_in(kept, again.select("doc_id", "th"), "left_anti").union(one.select("row.*"))


#: Word sets joined through an inverted index, links confirmed on full sets, reachability by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.doc_id WHERE r.root < b.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id, min(r.root) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
