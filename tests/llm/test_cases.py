"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthledger.llm import common, htmltext, langid, mixing, neardup, packing, pii, pipeline, quality, registry, sharding, topk, toxicity

LONG = "word " * 30_000 + "end"
TEXTS = [(1, None, "b"), (2, "", None), (3, LONG, "a"), (4, "one two three", "a"), (4, "one two three", "a"), (None, "one two three", "b"), (5, " \t\n", "c"), (6, "ünï ☃ 漢字", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(d, t, s, 0, 1, 2.0) for d, t, s in TEXTS], "doc_id long, text string, source string, size int, kept int, score double")
    return common.durable(rows, "test-docs")


@pytest.fixture(scope="module")
def none(docs):
    return common.durable(docs.limit(0), "test-none")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")


def test_packing(docs, none):
    got = packing.pack(common.durable(packing.pieces(docs), "test-pieces")).toPandas()
    assert got[got.doc_id == 1].length.tolist() == [1]
    assert len(got[got.doc_id == 4]) == 2
    long = got[got.doc_id == 3].sort_values("piece")
    assert (long.length[1:] == 1024).all() and (long.start == long.length.cumsum() - long.length).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    assert packing.pack(common.durable(packing.pieces(none), "test-pieces")).count() == 0


def one_at_a_time(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 64, 1024]))
    lengths = rng.integers(1, capacity + 1, 200).tolist() + rng.integers(1, capacity // 8 + 2, 100).tolist()
    fill, counts = {}, {n: lengths.count(n) for n in set(lengths)}
    for n, lo, hi, first, each, offset in packing.plan(counts, capacity):
        for j in range(hi - lo):
            b = first + j // each
            assert fill.get(b, 0) == offset + j % each * n
            fill[b] = fill.get(b, 0) + n
    assert sorted(capacity - x for x in fill.values()) == one_at_a_time(lengths, capacity)


@pytest.mark.parametrize("text", ["a  b", "\n a\n", "a \n b", " x", "x ", "é  \t y", "don't 'll  it's", "<|endoftext|> hi", "1 2 33 4444 55555", "漢字 ☃  z", "a  b", "x\x1c y"])
def test_parts_encode_like_the_whole(text):
    e = packing.encoder(None)
    assert e.encode(text) == e.ids(text)


def test_mixing(docs, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(TEXTS) and (got.taken <= 2 * got["size"]).all() and (got[got["size"] == 0].taken == 0).all()
    assert got[got.doc_id == 3]["size"].tolist() == [30_001]
    assert got.sort_values(list(got)).reset_index(drop=True).equals(mixing.mix(docs).toPandas().sort_values(list(got)).reset_index(drop=True))
    assert mixing.mix(none).count() == 0


def test_mixing_by_a_direct_solution(spark):
    """Targets by capping one source after the other, tilts by bisection over single documents."""
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.integers(0, 60)), str(rng.choice(["a", "b", "c", "d", "e"], p=[0.5, 0.3, 0.12, 0.06, 0.02]))) for i in range(900)] + [(900, "x y", None), (901, None, "z")]
    docs = common.durable(spark.createDataFrame(rows, "doc_id long, text string, source string"), "test-mix")
    size = {d: len((t or "").split()) for d, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    whole = {n: sum(size[d] for d, _, s in rows if s == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    capped: set = set()
    while True:
        level = (1.5 * sum(whole.values()) - sum(2 * whole[n] for n in capped)) / max(1, sum(weight[n] for n in names if n not in capped))
        more = {n for n in names if n not in capped and weight[n] * level > 2 * whole[n]}
        if not more:
            break
        capped |= more
    want = {n: 2.0 * whole[n] if n in capped else weight[n] * level for n in names}
    got = mixing.mix(docs).collect()
    source = {d: s for d, _, s in rows}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == whole[source[r.doc_id]] and math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-9)
    for n in names:
        own = [size[d] for d, _, s in rows if s == n and size[d]]
        taken = sum(r.taken for r in got if source[r.doc_id] == n)
        assert abs(taken - want[n]) <= max(own, default=0)
    histogram = common.durable(mixing.sizes(docs).groupBy("source", "size").agg(F.count("*").alias("n")), "test-histogram")
    for r in mixing.multipliers(histogram, common.durable(mixing.targets(histogram), "test-targets")).collect():
        own = [size[d] for d, _, s in rows if s == r.source and size[d]]
        if r.lam is not None and own:
            words = lambda lam: sum(x * min(2.0, math.exp(min(50.0, lam * x / r.mean))) for x in own)  # noqa: B023, E731
            assert math.isclose(words(r.lam), want[r.source], rel_tol=1e-5)


def test_mixing_stage_passes_clashing_columns_through(spark):
    rows = [(i % 7, "w " * (i % 5 + 1), "ab"[i % 2], i, -i, i * 2, "k") for i in range(60)]
    docs = common.durable(spark.createDataFrame(rows, "doc_id long, text string, source string, id int, times int, place int, row string"), "test-clash")
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows) and mixing.stage(spark, docs.limit(0), "").count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, match):
    d = re.sub("[^0-9]", "", match)
    luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if holds(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii_matches_the_base_rules(spark, none):
    texts = ["x 1.2.3.4.5.6.7.8 a@b.c+x@d.e.f..g@h.i +12 (345) 678-90-12 4111 1111-1111 1111 300.1.1.1 é4111111111111111é", "\x01a@b.co\x02 " + "1 " * 20_000, None, "", "a" * 60_000 + " " + "7" * 60_000, "0.0.0.0 ☃ 255.255.255.256 +1 2 3 4 5 6 7 8 9 0", "x@y.z" * 2000, "p@q.rs " * 3000]
    rows = common.durable(spark.createDataFrame([(i, t, "s", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, spans string, _t int, row int"), "test-pii")
    spans = common.durable(pii.spans_of(rows, doc_id=F.col("doc_id"), row=F.struct(*rows.columns)), "test-spans")
    weights = pii.fit(spans.select(F.inline("spans")).select("kind", "votes", "features"))
    got = spans.select("doc_id", pii._joined(F.filter("spans", lambda c: c.base)).alias("b"), pii._joined(pii.accepted(weights)).alias("all")).collect()
    for r in got:
        assert r.b == base_spans(texts[r.doc_id])
        assert set(r.b.split(",")) <= set(r.all.split(","))
    masked = {r.doc_id: r for r in pii.redact(spans, weights).collect()}
    assert masked[2].text is None and masked[3].text == "" and "@" not in masked[0].text and masked[7].text == "<EMAIL> " * 3000
    staged = pii.stage(spark, rows, "")  # columns with the names of working ones pass through
    assert staged.columns == rows.columns and {(r.spans, r._t, r.row) for r in staged.collect()} == {("s", 1, 2)}
    assert pii.spans_of(none, doc_id=F.col("doc_id")).count() == 0 and pii.stage(spark, none, "").count() == 0


def iban(country, account):
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{account}"


def labelled_texts(n=400, seed=3):
    """Texts of filler words, each with personal data that the base rules miss, or with a look-alike; and the private strings."""
    rng = np.random.default_rng(seed)
    filler = [f"{a}{b}" for a in ("lum", "tor", "ves", "kan", "pol") for b in ("a", "en", "is", "ot")]
    word = lambda: str(rng.choice(filler))
    hexes = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    digits = lambda k: "".join(rng.choice(list("0123456789"), k))
    given, out = pii.GIVEN.split(), []
    for i in range(n):
        family = word().capitalize()
        private = [
            lambda: ("my api token: ", "ghp_" + hexes(36)), lambda: ('secret = "', hexes(40)), lambda: ("password=", hexes(12) + "XyZ" + digits(4)),
            lambda: ("IBAN ", iban("DE", digits(18))), lambda: ("compte ", iban("FR", digits(23))),
            lambda: ("ssn ", f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"),
            lambda: ("signed, ", f"Dr. {rng.choice(given)} {family}"), lambda: ("my name is ", f"{rng.choice(given)} {family}"), lambda: ("ich heiße ", f"Frau {family}"),
            lambda: ("address: ", f"{rng.integers(1, 900)} {family} Street"), lambda: ("wohnhaft, Adresse ", f"{family}straße {rng.integers(1, 99)}"), lambda: ("habite ", f"{rng.integers(1, 99)} rue de {family}"),
        ]
        public = [
            lambda: ("commit ", hexes(40)), lambda: ("sha256 ", hexes(64)), lambda: ("checksum: ", hexes(32)), lambda: ("see page ", "x-" + word() * 5),
            lambda: ("order ", f"000-{rng.integers(10, 99)}-0000"), lambda: ("serial ", "DE" + digits(20)), lambda: ("at ", f"{word()}-{word()}-{word()}-{word()}-{word()}"),
        ]
        yes = i % 2 == 0
        kinds = private if yes else public
        before, match = kinds[i // 2 % len(kinds)]()
        after = '"' if before.endswith('"') else ""
        words = [word() for _ in range(20)]
        text = " ".join(words[:10]) + " " + before + match + after + " " + " ".join(words[10:])
        out.append((i, text, text.index(match), text.index(match) + len(match), yes))
    return out


def test_pii_method_adds_spans_that_the_base_rules_miss(spark):
    """Precision and recall of accepted spans beyond the base ones, on generated texts with look-alikes."""
    marked = labelled_texts()
    rows = spark.createDataFrame([(i, t) for i, t, *_ in marked], "doc_id long, text string")
    spans = common.durable(pii.spans_of(rows, doc_id=F.col("doc_id")), "test-labelled")
    weights = pii.fit(spans.select(F.inline("spans")).select("kind", "votes", "features"))
    got = spans.select("doc_id", F.inline(pii.accepted(weights))).filter("not base").select("doc_id", "start", "end").collect()
    found = {(r.doc_id, r.start, r.end) for r in got}
    want = {(i, a, b) for i, _, a, b, yes in marked if yes}
    assert len(found & want) / len(found) >= 0.95 and len(found & want) / len(want) >= 0.9, (len(found & want), len(found), len(want))


def test_quality_counts(docs, none, labels):
    got = quality.judge_documents(docs, labels).select("doc_id", "kept", "quality.*").toPandas()
    assert len(got) == len(TEXTS) and got["kept"].shape[1] == 2  # the input's own column and the verdict
    assert quality.judge_documents(none, labels).count() == 0
    text = "a b c a b c\nx\n\nx\n \n" + "# z"
    n_words, chars, symbols, dup, repeats, failed, *_ = quality.judge(text.encode(), np.zeros(1 << quality.HASH_BITS, np.float32), -1, quality.HASH_BITS)
    assert (n_words, chars, symbols, dup, repeats, failed) == (10, 10, 1, 1, 6, True)


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        w = rng.integers(0, 4, rng.integers(0, 40)).tolist()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        want = len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})
        assert quality.repeated_words(np.asarray(w, np.int64)) == want


def test_sharding(docs, none):
    got = sharding.shard(docs).toPandas()
    assert len(got) == len(TEXTS) and got[got.doc_id == 1]["size"].tolist() == [1] and got[got.doc_id == 3].text_crc32.tolist() == [zlib.crc32(LONG.encode())]
    assert got[got["size"] == 14].shard.nunique() == 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert sharding.shard(none).count() == 0


def test_cuts_are_minimax(spark):
    sizes = np.random.default_rng(1).integers(1, 1000, 300).tolist()
    found = sharding.cuts(spark.createDataFrame(list(enumerate(sizes)), "cell int, size long"), 7).first()

    def needed(c):
        n, room = 1, c
        for x in sizes:
            if x > room:
                n, room = n + 1, c
            room -= x
        return n

    assert needed(found.capacity) <= 7 and (found.capacity == max(sizes) or needed(found.capacity - 1) > 7)


def shingle_set(text, width=2):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width=2):
    """component of each row, rows being nodes."""
    sets, top = [shingle_set(t, width) for _, t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * len(sets[a] | sets[b]) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    least = {}
    for (d, _), c in zip(texts, top, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return [None if d is None else least[c] if s else d for (d, _), c, s in zip(texts, top, sets, strict=True)]


def test_neardup_by_brute_force(spark, none):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = rng.choice(words, 60).tolist()
        for _ in range(8):
            w = list(base)
            for i in rng.choice(60, rng.integers(0, 7), replace=False):
                w[i] = str(rng.choice(words))
            texts.append((len(texts), " ".join(w)))
    texts += [(900, None), (901, ""), (902, "solo"), (903, "SOLO"), (904, "solo  "), (None, "solo"), (905, LONG), (906, LONG + " more"), (907, "É é"), (908, "é é")]
    texts += [(5, texts[40][1]), (5, texts[5][1]), (5, texts[5][1])]  # repeated ids, with another text and with the same
    for width in (2, 5):
        docs = common.durable(spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, comp int, key int"), "test-near")
        got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in neardup.components(docs, width).collect())
        assert got == sorted((d is None, d or 0, c or 0) for (d, _), c in zip(texts, brute_components(texts, width), strict=True))
    assert neardup.components(none.select("doc_id", "text")).count() == 0


def test_neardup_family_below_the_threshold(spark, monkeypatch):
    """Many members of one key in many components: blocks, alone and mixed, give what brute force gives."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_HASHES", 1000)
    rng = np.random.default_rng(8)
    base, texts = [f"b{i}" for i in range(60)], []
    for i in range(150):
        w = list(base)
        for k in rng.choice(60, int(rng.integers(2, 8)), replace=False):
            w[k] = f"x{rng.integers(1000)}"
        texts.append((i, " ".join(w)))
    docs = common.durable(spark.createDataFrame(texts, "doc_id long, text string"), "test-family")
    got = {r.doc_id: r.component_id for r in neardup.components(docs).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(150)] == want and 10 < len(set(want)) < 150


def test_neardup_chain_ships_in_proportion(spark, monkeypatch):
    """A chain of documents, each near the next only: block pairs grow with the chain, not with its square."""
    shipped = []
    whole = neardup.block_links
    monkeypatch.setattr(neardup, "block_links", lambda met: (shipped.append(met.selectExpr("sum(size(left) + size(right)) AS n").first().n or 0), whole(met))[1])
    counts = []
    for n in (2000, 4000):
        shipped.clear()
        docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(id, id + 59), i -> concat('w', i))) AS text")
        found = neardup.components(common.durable(docs, "test-chain"))
        assert found.filter("component_id <> 0").count() == 0
        counts.append(sum(shipped))
    assert counts[1] < 2.5 * counts[0]


def test_blocks_find_a_spanning_forest():
    import pyarrow as pa

    rows = []
    for i, t in enumerate(["a b c d e f g h i j k l", "a b c d e f g h i j k m", "z y x w v u t s r q p o", "a b c d e f g h i j k l"]):
        h = neardup.shingle_hashes(neardup.words_of(t.encode()))
        rows.append({"v": i, "comp": i, "n": len(h), "sig": neardup.signature(h)[0], "hashes": h.tobytes()})
    kind = pa.struct([("v", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("sig", pa.list_(pa.int64())), ("hashes", pa.binary())])
    block = pa.array(rows, kind)
    assert neardup.spanning(block, block, True) == [(0, 1), (0, 3)]
    assert neardup.spanning(block.slice(2, 1), block, False) == []
    assert neardup.spanning(block.slice(1, 1), block.slice(2, 2), False) == [(1, 3)]


def test_language(docs, none):
    net = langid.Network(["de", "en"], hidden=4)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, net).filter("doc_id IN (1, 2, 5)").collect()}
    assert got == {(1, "und"), (2, "und"), (5, "und")}
    assert langid.identify(docs, net).filter("score < 0 OR score > 1").count() == 0
    assert langid.identify(none, net).count() == 0
    whole = net.predict([LONG.encode(), b"a", "é".encode() * 200])
    assert np.allclose(whole.sum(axis=1), 1, atol=1e-3)


def test_predictions_by_the_plain_network():
    """``predict`` reads windows of many texts side by side, in place and with a rational tanh; window by window gives the same."""
    net = langid.Network(["de", "en", "fr"], hidden=6, seed=3)
    texts = ["a", "kurz und gut", "mot " * 100, "é☃ " * 90, "x" * 128, "y" * 129]
    got = net.predict([t.encode() for t in texts])
    for t, p in zip(texts, got, strict=True):
        raw, total = t.encode(), np.zeros(3)
        for i in range(0, len(raw), langid.WINDOW):
            one = np.frombuffer(raw[i : i + langid.WINDOW], np.uint8)[None, :]
            e = np.exp(net.logits(net.states(one)[0]))[:, 0]
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
        assert np.allclose(p, total / len(raw), atol=1e-2), t


def test_letters_and_short_training_texts(spark):
    rows = [(i, t, "x") for i, t in enumerate(["²½①", "٣", "3,14 !", "ª", "漢", "a1"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.identify(docs, langid.Network(["x"])).filter("lang_pred = 'und'").collect()} == {0, 1, 2}
    short = spark.createDataFrame([(i, "oui non" if i % 2 else "ja nein", "fr" if i % 2 else "de") for i in range(300)], "doc_id long, text string, lang string")
    windows, labels, languages = langid.training_windows(short)
    assert len(windows) and set(labels.tolist()) == {0, 1} and languages == ["de", "fr"]
    got = langid.identify(short, langid.train(short)).join(short, "doc_id").filter("lang_pred <> lang").count()
    assert got == 0


def test_network_gradient():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    w, y = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(w, y)
    for k, at in (("x", (0, int(w[0, 2]), 4)), ("u", (1, 2, 5)), ("b", (0, 0, 1)), ("o", (4, 2)), ("c", (0,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = net.gradients(w, y)[0]
        net.p[k][at] = old - 1e-3
        down = net.gradients(w, y)[0]
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-5


def brute_topk(vectors, k=5):
    out = []
    scale = lambda v: [math.floor(256 * float(x)) for x in v]
    for q, a in vectors:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(scale(a), scale(b), strict=True)), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_topk_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.2, 40).astype(np.float32).tolist()) for i in range(300)]
    for i in range(7, 20):  # ties around the fifth place
        vectors[i] = (i, vectors[0][1])
    vectors += [(50, vectors[3][1]), (50, vectors[50][1]), (8, vectors[0][1]), (400, [0.5, -0.25]), (401, [1.0, 1.0]), (450, [2.0] * 3)]
    bad = [(301, None), (302, []), (350, [float("nan")] * 40), (303, [None] + [0.0] * 39), (None, [1.0] * 40)]
    rows = spark.createDataFrame([(i, v, "n", 0) for i, v in vectors + bad], "vec_id long, embedding array<float>, block string, score int")
    rows = topk.usable(common.durable(rows, "test-vectors"))
    for chunk, block, step in ((2048, 4096, 512), (16, 2, 1)):
        monkeypatch.setattr(topk, "CHUNK", chunk)
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        monkeypatch.setattr(topk, "QUERY_STEP", step)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(rows, rows.filter("vec_id % 50 = 0")).collect())
        assert got == brute_topk(vectors)
    assert topk.topk(rows.limit(0), rows.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    vectors = [(i, [2.0**40 + i, -(2.0**30), 0.1 * i]) for i in (0, 1, 2, 50)]
    rows = topk.usable(spark.createDataFrame([(i, [x / 2**20 for x in v]) for i, v in vectors], "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(rows, rows.filter("vec_id % 50 = 0")).collect())
    assert got == brute_topk([(i, [x / 2**20 for x in v]) for i, v in vectors])
    huge = topk.usable(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).first()
    assert huge.v == [2.56e32]


def test_toxicity(docs, none, labels, spark):
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    got = toxicity.score(docs, model).toPandas()
    assert len(got) == len(TEXTS) and got.score.between(0, 1).all()
    assert (toxicity.train(docs.select("doc_id", "text"), labels.limit(0)))[2] == 0.0
    assert toxicity.score(none, model).count() == 0


def test_ftrl_by_the_formula():
    """The published rule coordinate by coordinate, in plain Python."""
    rng = np.random.default_rng(4)
    found = [np.unique(rng.integers(0, 60, 15)) for _ in range(80)]
    marks = [float(3 in f) for f in found]
    z, n = {}, {}
    for _ in range(toxicity.PASSES):
        for f, y in zip(found, marks, strict=True):
            w = {}
            for i in [*f.tolist(), -1]:
                l1, zi, ni = 0.0 if i == -1 else toxicity.L1, z.get(i, 0.0), n.get(i, 0.0)
                w[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(ni)) / toxicity.ALPHA + toxicity.L2)
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    model = toxicity.Ftrl()
    for _ in range(toxicity.PASSES):
        for f, y in zip(found, marks, strict=True):
            model.learn(f, y)
    for i in z:
        assert math.isclose(model.z[i], z[i], abs_tol=1e-9) and math.isclose(model.n[i], n[i], abs_tol=1e-9)
    assert {int(c) for c in model.sparse()[0]} == {i for i in z if i >= 0 and abs(z[i]) > toxicity.L1}


def test_toxicity_features_by_hand():
    words = [b"alphabet", b"beta", b"alphabetic"]
    one = lambda *w: set(toxicity.cells(list(w)).tolist())
    got = set(toxicity.features(b"Alphabet, BETA alphabetic").tolist())
    assert got == set(toxicity.cells(words).tolist()) and one(b"alphabet") & one(b"alphabetic") and len(got) == 10  # 3 words, 2 pairs, 1 skip, 1 stem, 2 pairs, 1 skip of stems


def test_ftrl_learns_a_marked_word():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["sun", "tree", "road", "lamp", "door"], 12)) + (" vileword" if i % 3 == 0 else "") for i in range(300)]
    at, w, bias = toxicity.fit([toxicity.features(t.encode()) for t in texts], [float(i % 3 == 0) for i in range(300)])
    dense = np.zeros(1 << toxicity.BITS)
    dense[at] = w
    p = [toxicity._sigmoid(dense[toxicity.features(t.encode())].sum() + bias) for t in texts]
    assert all((x >= 0.7) == (i % 3 == 0) for i, x in enumerate(p)) and len(at) < 500


def held_out_rates(spark, name):
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES[name](spark, sf).filter("held_out")
    return got, common.table(spark, sf, "documents"), common.table(spark, sf, "labels")


def test_toxicity_on_held_out_rows(spark):
    got, _, labels = held_out_rates(spark, "op9_toxicity")
    r = got.join(labels, "doc_id").filter("toxic is not null").selectExpr("sum(toxic * predicted) AS hit", "sum(predicted) AS said", "sum(toxic) AS toxic").first()
    assert r.hit / r.said >= 0.95 and r.hit / r.toxic >= 0.65  # some 300 toxic rows to learn from in four languages


def test_languages_on_held_out_rows(spark):
    got, docs, _ = held_out_rates(spark, "op7_language_id")
    r = got.join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").selectExpr("avg(int(lang = lang_pred)) AS share").first()
    assert r.share >= 0.97


def test_html():
    crf = htmltext.train(60)
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home page</a></li></ul></nav><script>x('</p>')</script><article><h1>A &amp; B</h1><p><b>One  two\nthree.<br><p>Four &lt;five&gt; &#233;.</p></article><div class='comments'><p>Nice text indeed.</p></div><footer>&copy; us</footer>"
    assert htmltext.main_text(page, crf) == "A & B\nOne two three.\nFour <five> é."
    assert htmltext.main_text(None, crf) == "" == htmltext.main_text("", crf) == htmltext.main_text("<nav><a>x</a></nav><!-- ", crf)
    chains = htmltext.labelled_pages(20, 77)
    right = [a == b for c, y in chains for a, b in zip(crf.viterbi(crf.emissions(c)), y, strict=True)]
    assert np.mean(right) > 0.98


def test_html_depth_has_no_bound():
    crf = htmltext.train(60)
    deep = "<span>" * 3000
    page = f"<body><article><p>First words of a text.</p>{deep}<script>var x = 'leak';</script><style>p{{color:red}}</style><p>Last words of a text.</p></article>"
    assert [t for t, _ in htmltext.leaves(page)] == ["First words of a text.", "Last words of a text."] and "leak" not in htmltext.main_text(page, crf)
    nested = "<div>" * 20_000 + "x" + "</div>" * 20_000 + "</b>" * 20_000
    assert [t for t, _ in htmltext.leaves(nested)] == ["x"]
    assert [t for t, _ in htmltext.leaves("<ul><li>a<li>b<p>c<p>d</ul><p>e<div>f</div>g")] == ["a", "b", "c", "d", "e", "f", "g"]
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(htmltext.leaves(long)[0][0]) == 5 * 200_000 - 1


def test_crf_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    crf = htmltext.Crf()
    crf.t, crf.s = rng.normal(size=(2, 2)), rng.normal(size=2)
    for n in range(1, 7):
        e = rng.normal(size=(n, 2))
        ways = list(product((0, 1), repeat=n))
        score = np.asarray([crf.s[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(crf.t[y[i], y[i + 1]] for i in range(n - 1)) for y in ways])
        p = np.exp(score - score.max())
        p /= p.sum()
        assert crf.viterbi(e) == list(ways[int(score.argmax())])
        node, edge = crf.marginals(e)
        for i in range(n):
            assert np.allclose(node[i], [sum(q for q, y in zip(p, ways, strict=True) if y[i] == c) for c in (0, 1)])
        want = np.zeros((2, 2))
        for q, y in zip(p, ways, strict=True):
            for i in range(n - 1):
                want[y[i], y[i + 1]] += q
        assert np.allclose(edge, want)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert htmltext.extract(pages, htmltext.train(40)).count() == 2
    assert htmltext.extract(pages.limit(0), htmltext.Crf()).count() == 0


def test_digest_of_nothing():
    assert hashlib.sha256(base_spans(None).encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_quality_target_counts_every_trusted_document(spark):
    docs = common.durable(spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id) AS text"), "test-trusted")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    for rows in (1_000_000, 0):  # broadcast and shuffled
        assert not quality.log_ratios(docs, labels, broadcast_rows=rows).any()


def test_quality_ratios_do_not_depend_on_the_size_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(quality, "SHRINK_MASS", 10)
    rows = [(i, "clean words here" if i % 2 else "junk ## here") for i in range(40)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    twice = once.union(once.selectExpr("doc_id + 100", "text"))
    labels = spark.createDataFrame([(i + k, 1) for i in range(1, 40, 2) for k in (0, 100)], "doc_id long, quality int")
    assert np.allclose(quality.log_ratios(once, labels), quality.log_ratios(twice, labels), atol=1e-6)


def test_neardup_stage_by_brute_force(spark):
    rng = np.random.default_rng(6)
    words, texts = [f"w{i}" for i in range(400)], []
    for _ in range(10):
        base = rng.choice(words, 80).tolist()
        for _ in range(6):
            w = list(base)
            for i in rng.choice(80, rng.integers(0, 5), replace=False):
                w[i] = str(rng.choice(words))
            texts.append((len(texts), " ".join(w)))
    page = [f"p{i}" for i in range(200)]  # ten spread edits: 0.82 in two-word shingles, 0.6 in five-word ones
    texts += [(800, " ".join(page)), (801, " ".join("new" + w if i % 20 == 10 else w for i, w in enumerate(page)))]
    texts += [(900, None), (901, ""), (902, "a b c"), (903, "A b  C"), (904, "a b d"), (905, "a b c d e"), (906, "a b c d e f")]
    top = dict(zip([d for d, _ in texts], brute_components(texts, 5), strict=True))
    docs = common.durable(spark.createDataFrame(texts, "doc_id long, text string"), "test-near-stage")
    kept = sorted(r.doc_id for r in neardup.stage(spark, docs, "").collect())
    assert kept == [d for d in top if top[d] == d] and {800, 801, 904, 906} <= set(kept) and 903 not in kept


@pytest.mark.parametrize("mark", ["<![foo bar]>", "<![ x]>", "<![1]>", "<![>"])
def test_html_reads_on_after_an_unknown_marked_section(mark):
    assert [t for t, _ in htmltext.leaves(f"<p>a</p>{mark}<p>b</p><p>c</p>")] == ["a", "b", "c"]
    assert [t for t, _ in htmltext.leaves("<p>a</p><![foo bar")] == ["a"]


def test_mixing_stage_keeps_rows_with_null_and_repeated_ids(spark):
    rows = [(None if i % 3 else i % 10, f"{'abc'[i % 3]} " * (1 + i % 7), "xyzw"[i * i % 4] if i % 11 else None, i) for i in range(900)]
    docs = common.durable(spark.createDataFrame(rows, "doc_id long, text string, source string, n int"), "test-stage")
    want = mixing._mixed(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c")).filter("c > 0").collect()
    got = mixing.stage(spark, docs, "").collect()
    words, times, rows_of, where = {}, {}, {}, {}
    for d, t, s, n in rows:
        where[n] = (d, s, len(t.split()))
        rows_of[where[n]] = rows_of.get(where[n], 0) + 1
    for r in got:
        words[where[r.n]] = words.get(where[r.n], 0) + 1
        times[r.n] = times.get(r.n, 0) + 1
    assert words == {(r.doc_id, r.source, r["size"]): r.c for r in want}
    for n, k in where.items():  # spread evenly
        each = words.get(k, 0) / rows_of[k]
        assert np.floor(each) <= times.get(n, 0) <= np.ceil(each)


def brute_pipeline_input(rows):
    return [(d, t, s) for d, t, s in rows if len((t or "").split()) >= quality.MIN_WORDS]


def test_pipeline_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    rows = [(None if i % 4 == 0 else i, " ".join(rng.choice(words, 60 + i % 5)), "ab"[i % 2]) for i in range(60)]
    rows += [(1, rows[1][1], "a"), (500, rows[5][1], "b"), (501, "too short", "a"), (None, None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [r for r in brute_pipeline_input(rows) if r[0] != 500]  # a copy of document 5
    left.remove((1, rows[1][1], "a"))  # a repeated row goes once
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (quality.stage, neardup.stage, pii.stage):
        docs = common.durable(stage(spark, docs, str(tmp_path)), "test-pipeline")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=key) == sorted(left, key=key)
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    mixed = common.durable(mixing.stage(spark, docs, str(tmp_path)), "test-pipeline")
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken
    got, want = pipeline.run(spark, str(tmp_path)), packing.stage(spark, mixed, str(tmp_path))
    assert got.agg(F.sum("length")).first() == want.agg(F.sum("length")).first() and got.filter("doc_id is null").count() > 0


SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_bestfit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_source_mixing": "doc_id size source_size target taken",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_minhash_neardup": "doc_id n_shingles component_id kept",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_exact_topk": "query_id rank vec_id score",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_html_text": "page_id url text n_chars",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_keep_their_contracts(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert list(got)[: len(CONTRACTS[name].split())] == CONTRACTS[name].split()
    if "doc_id" in got:
        docs = common.table(spark, SF, "documents").select("doc_id", "text").toPandas()
        assert set(got.doc_id) == set(docs.doc_id) and (name == "op1_bestfit_packing" or len(got) == len(docs))
        texts = dict(zip(docs.doc_id, docs.text, strict=True))
    if name == "op1_bestfit_packing":
        enc = packing.encoder(None)
        for d, s in got.groupby("doc_id"):
            ids = enc.ids(texts[d] or "") + packing.struct.pack("<I", packing.END)
            for r in s.itertuples():
                own = ids[4 * r.start : 4 * (r.start + r.length)]
                assert len(own) == 4 * r.length and zlib.crc32(own) == r.ids_crc32
            assert 4 * s.length.sum() == len(ids)
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    if name == "op3_pii":
        for r in got.itertuples():
            base = base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    if name == "op5_sharding":
        sizes = got.groupby("shard")["size"].sum()
        assert set(got.shard) <= set(range(16)) and all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
        assert got.groupby("text_crc32").shard.nunique().max() == 1 and sizes.max() <= max(2 * sizes.sum() / 16, got.groupby("text_crc32")["size"].sum().max())


@pytest.mark.parametrize("name", registry.ORACLE)
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(registry.ORACLE[name]).df(), registry.QUERIES[name](spark, SF).toPandas()
    rows = lambda df: sorted(map(tuple, df[sorted(df)].astype(object).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_sharding_of_a_group_larger_than_a_shard(spark, none):
    rows = [(i, "copy " * 50 if i % 2 else f"text {i} " * (i % 9), 0, 0, "x") for i in range(600)] + [(7, "copy " * 50, 0, 0, "x"), (None, None, 0, 0, "x")]
    docs = common.durable(spark.createDataFrame(rows, "doc_id long, text string, cell int, slice int, shard string"), "test-shards")
    got = sharding.shard(docs).toPandas()
    assert len(got) == len(rows) and got[got["size"] == 251].shard.nunique() == 1
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))


@pytest.fixture
def batch_conf(spark):
    was = {k: spark.conf.get(k) for k in common.BATCH}
    yield {"rows": "spark.sql.execution.arrow.maxRecordsPerBatch", "bytes": "spark.sql.execution.arrow.maxBytesPerBatch"}
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("rows", "length"), [(2_000, 100), (300, 200_000)])
def test_workers_get_small_batches_and_all_rows(spark, batch_conf, rows, length):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    spark.conf.set(batch_conf["rows"], "10000")
    spark.conf.set(batch_conf["bytes"], "64m")
    long = spark.range(0, rows, 1, 1).select("id", F.repeat(F.lit("x"), length).alias("text"))
    got = common.in_batches(long, sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == rows
    assert max(r.n for r in got) <= 512 and max(r.size for r in got) < 10 << 20


def test_stages_bound_their_batches_and_keep_smaller_bounds(spark, docs, batch_conf):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for build in (lambda: quality.judge_documents(docs, labels), lambda: neardup.signatures(docs), lambda: packing.pieces(docs)):
        spark.conf.set(batch_conf["rows"], "-1")
        spark.conf.set(batch_conf["bytes"], "64m")
        build()
        assert [spark.conf.get(batch_conf[k]) for k in ("rows", "bytes")] == ["512", str(8 << 20)]
    spark.conf.set(batch_conf["rows"], "100")
    spark.conf.set(batch_conf["bytes"], "1m")
    packing.pieces(docs)
    assert [spark.conf.get(batch_conf[k]) for k in ("rows", "bytes")] == ["100", "1m"]


def test_packing_plan_starts_no_python_rdd(spark, docs):
    packed = packing.pack(common.durable(packing.pieces(docs), "test-pieces"))
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()
    assert packed.count() == common.durable(packing.pieces(docs), "test-pieces").count()
