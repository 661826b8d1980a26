"""Paired cases of the reconciliation, rule and score operators: what fires beside what must not."""

import hashlib
import hmac

from pyspark.sql import functions as F

from hearthledger.functions import pagetext as P
from hearthledger.functions import similarity as M
from hearthledger.operators import linkage as L
from hearthledger.operators import reconcile_records as R
from hearthledger.operators import review as V
from hearthledger.operators import state as S
from hearthledger.operators import taxonomy as X


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_hmac_is_the_standard_one(spark):
    rows = [("key", "text"), ("", ""), ("k" * 64, "x"), ("k" * 65, "longer than a block"), ("ключ", "☃")]
    got = spark.createDataFrame(rows, "k string, m string").select(V.hmac_sha256(F.col("k"), F.col("m")).alias("s")).collect()
    assert [r.s for r in got] == [hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in rows]


def test_same_member(spark):
    rows = [("Ana Lopez", "Ana Lopes", True), ("Ana Lopez", "Ana Lobos", False), ("Ana Lopez Mora", "Ana Lopez", True), ("Ana Lopez", "Eva Lopez", False), ("Ana", "Ana Lopez", False), ("An Li", "An Lo", False), ("Joseph Marsh", "Jos Marsh", True)]
    got = spark.createDataFrame(rows, "a string, b string, w boolean").select("w", M.same_member(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in got] == [r.w for r in got]


def test_amounts_and_accounts(spark):
    close = lambda a, b: one(spark, M.amounts_close(F.lit(a), F.lit(b)))
    assert close(6294.34, 6294.74) and close(100.0, 100.9) and not close(20.0, 50.0) and not close(100.0, 245.0)
    slip = lambda a, b: one(spark, M.account_slip(F.lit(a), F.lit(b)))
    assert slip("12345678", "12345978") and slip("123456789", "12345678") and not slip("1234567", "1234568") and not slip("12345678", "12345678")
    distinct = lambda a: one(spark, M.distinctive(F.lit(a)))
    assert distinct(73.19) and not distinct(100.0) and distinct(101.0) and not distinct(0.0)


def test_slip_pairs_by_brute_force(spark):
    texts = ["12345678", "12345679", "1234567", "2345678", "123945678", "99999999", "12345678"]
    got = {(r.a, r.b) for r in L.slip_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        s, g = sorted((a, b), key=len)
        return len(g) - len(s) == 1 and any(g[:i] + g[i + 1 :] == s for i in range(len(g)))

    assert got == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near(texts[i], texts[j])}


def test_one_to_one_by_a_plain_greedy_loop(spark):
    import random

    from hearthledger.operators.linkage import nearest_one_to_one
    from hearthledger.sources.session import written

    rng = random.Random(6)
    left, right = [[(rng.choice("ab"), k + i, float(rng.randint(0, 60))) for i in range(n)] for k, n in ((0, 40), (100, 25))]
    pairs = sorted((abs(x - y), i, j) for b, i, x in left for c, j, y in right if b == c)
    used, want = set(), []
    for d, i, j in pairs:
        if not {i, j} & used:
            used |= {i, j}
            want.append((i, j, -d))
    rows = lambda x, k: spark.createDataFrame(x, f"b string, {k} long, v double")
    got = [tuple(r) for r in nearest_one_to_one(rows(left, "l"), rows(right, "r"), "b", "l", "r", "v", written).collect()]
    assert len({i for i, *_ in got}) == len({j for _, j, _ in got}) == len(got) == len(want) and sorted(s for *_, s in got) == sorted(s for *_, s in want)


def test_greedy_links_by_a_plain_loop(spark):
    import random

    from hearthledger.operators import manifest as O
    from hearthledger.sources.session import written

    rng = random.Random(3)
    claims = sorted({(rng.randint(0, 2), rng.randint(0, 4) / 4, rng.randint(0, 30), 100 + rng.randint(0, 20)) for _ in range(150)}, reverse=True)
    claims = list({(i, j): (t, s, i, j) for t, s, i, j in claims}.values())
    used, want = set(), []
    for t, s, i, j in sorted(claims, reverse=True):
        if not {i, j} & used:
            used |= {i, j}
            want.append((t, s, i, j))
    rows = spark.createDataFrame(claims, "tier int, score double, i long, j long")
    assert sorted(tuple(r) for r in O.greedy(rows, "i", "j", ["tier", "score"], written).select("tier", "score", "i", "j").collect()) == sorted(want)
    assert O.greedy(rows.limit(0), "i", "j", ["tier", "score"], written).count() == 0
    m = spark.createDataFrame([("c", 1, "Ana Lopez", "1990-01-01"), ("c", 2, "Bea Moran", None), ("c", 3, "Carl Onslow", "2000-01-01"), ("c", 4, "Dora Quist", "1980-01-01")], "case string, i long, name string, dob string")
    h = spark.createDataFrame([("c", 10, "Ana Lopes", "1990-01-01"), ("c", 11, "Bea Moran", "1970-01-01"), ("c", 12, "Carl Onslow", "2001-01-01"), ("c", 13, "Evan Pryor", "1980-01-01")], "case string, j long, name string, dob string")
    got = {(r.i, r.j): r.tier for r in O.member_claims(m, h).collect()}
    assert got == {(1, 10): 2, (2, 11): 1, (3, 12): 0}


def test_income_reconciliation_tiers(spark):
    d = spark.createDataFrame([("c", "ana", 1, "wage", 1000.0), ("c", "ana", 2, "other", 5.0), ("c", "bea", 3, "child support", 70.0), ("c", "bea", 4, "pension", 9.0), ("e", "ana", 5, None, None)], '"case" string, member string, d_id long, type string, annual double'.replace('"', ""))
    v = spark.createDataFrame([("c", "ana", 10, "wage", 5000.0), ("c", "ana", 11, "wage", 1010.0), ("c", "ana", 12, "child support", 70.0)], "case string, member string, v_id long, type string, annual double")
    got = {r.d_id: (r.v_id, r.how) for r in R.reconcile_income(d, v, lambda a, b: a == b).collect()}
    assert got[1] == (11, "figure") and got[3] == (12, "household") and got[4] == (None, "declared_only") and got[5] == (None, "declared_only")
    assert got[2] == (None, "declared_only")  # two of the member's records are unclaimed


def test_asset_reconciliation_tiers(spark):
    kind = "case string, owner string, {} long, family string, number string, amount double"
    d = spark.createDataFrame([("c", "a", 1, "bank", "12345678", 5.0), ("c", "b", 2, "bank", None, 82.05), ("c", "b", 3, "cash", None, 100.0), ("c", "a", 4, "bank", "11112222", 7.0)], kind.format("d_id"))
    v = spark.createDataFrame([("c", "a", 10, "bank", "92345678", 900.0), ("c", "a", 11, "bank", "3333", 82.05), ("c", "a", 12, "cash", None, 100.0)], kind.format("v_id"))
    got = {r.d_id: (r.v_id, r.how) for r in R.reconcile_assets(d, v).collect()}
    assert got == {1: (10, "account"), 2: (11, "to the cent"), 3: (None, "declared_only"), 4: (None, "declared_only")}


def test_relation_and_repair(spark):
    rel = lambda a, b: one(spark, R.relation(F.lit(a), F.lit(b))["kind"])
    assert [rel(100.0, 105.0), rel(1000.0, 12000.0), rel(100.0, 10000.0), rel(100.0, 730.0)] == ["same", "period", "decimal", "other"]
    fix = lambda v, *x: one(spark, R.repaired(F.lit(v), F.array(*map(F.lit, x)), 300_000, 0.2))
    assert fix(612345.0, 6100.0) == 6123.45 and fix(612345.0, 1.0) == 612345.0 and fix(6000.0, 60.0) == 6000.0


def test_rents_settle_as_far_as_determined(spark):
    c = spark.createDataFrame([(1, None, 700.0, 50.0, None, 300.0), (2, 750.0, None, 50.0, None, None), (3, None, 700.0, None, None, None)], "k int, gross double, tenant double, utility double, contract double, assistance double")
    got = {r.k: (r.gross, r.tenant, r.utility, r.contract, r.assistance) for r in R.settled_rents(c).collect()}
    assert got == {1: (750.0, 700.0, 50.0, 1000.0, 300.0), 2: (750.0, 700.0, 50.0, None, None), 3: (None, 700.0, None, None, None)}


def test_taxonomy(spark):
    t = spark.createDataFrame([("Pay Stub", ["paystub", "check stub"], "income", "wages", ["income"], False, None), ("EIV Sheet", ["eiv"], "income", "eiv", [], True, "EIV Report")], "label string, aliases array<string>, category string, family string, routes array<string>, hud_only boolean, confirms string")
    rows = spark.createDataFrame([(1, "PAY STUB"), (2, "Check Stub (Previous)"), (3, "Receipt"), (4, None), (5, "eiv")], "k int, printed string")
    got = {r.k: (r.canonical, r.fit, r.category) for r in X.labelled(rows, "printed", t).collect()}
    assert got == {1: ("Pay Stub", "exact", "income"), 2: ("Pay Stub (Previous)", "alias", "ignore"), 3: ("Unknown", "none", "ignore"), 4: ("Unknown", "none", "ignore"), 5: ("EIV Sheet", "alias", "income")}
    hud = lambda p: one(spark, X.hud_programme(F.lit(p)))
    assert hud("Section 8 PBRA") and not hud("Section 42") and not hud("Colorado HFA") and hud("RAD conversion")


def test_marks_and_boxes(spark):
    yes = lambda t: one(spark, V.marked_yes(F.lit(t), "homeless"))
    assert yes("Are you homeless? [x] yes [ ] no") and not yes("Are you homeless? [ ] yes [x] no") and not yes("Are you homeless? Yes No") and yes("They are currently homeless.")
    assert one(spark, P.marks_unread(F.lit("[ ] a " * 6))) and not one(spark, P.marks_unread(F.lit("[ ] a " * 6 + "[x] b")))
    tall = "[[100, 0, 150, 200]] [[110, 300, 160, 700]]"
    assert one(spark, P.vertical_band(F.lit(tall))) and not one(spark, P.vertical_band(F.lit("[[0, 0, 900, 900]]"))) and not one(spark, P.vertical_band(F.lit("none")))
    assert abs(one(spark, P.skipped_fraction(F.lit("[[0, 0, 500, 400]]"))) - 0.2) < 1e-9
    assert one(spark, P.broken_numbers(F.lit("$ 5 and 1,2 34.50"))) == ["1,2 34.50"] and one(spark, P.broken_numbers(F.lit("1,2 34.50"))) == []


def test_snippets_and_repeated_lines(spark):
    text = "PAY STATEMENT\nEmployee Jane\nfooter line of the form\n" + "filler " * 120 + "\nnet pay for this period was $1,234.50 on 01/02/2024 and $9"
    got = one(spark, P.snippet(P.without_lines(F.lit(text), F.array(F.lit("footer line of the form")))))
    assert got.startswith("PAY STATEMENT | PAY STATEMENT\nEmployee Jane\nfiller") and "footer" not in got and "$1,234.50" in got and "01/02/2024" in got and len(got) <= 900
    phrase = lambda x: one(spark, P.loops(F.lit(x)))["phrase"]
    assert phrase("the same words " * 30) == 1.0 and phrase("a b " * 40) == 0.0 and phrase("too short") is None and one(spark, P.loops(F.lit(None).cast("string")))["tokens"] == 0


def test_throttle_runs_from_the_last_beat_let_through(spark):
    beats = [(1, s) for s in (0, 20, 40, 60, 80, 111, 300)]
    e = spark.createDataFrame([("u", i, s) for i, (_, s) in enumerate(beats)], "u string, i int, s int").selectExpr("u", "i", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts")
    assert sorted(r.i for r in S.throttled(e, "u", "ts", "i", 30).collect()) == [0, 2, 4, 5, 6]


def test_best_method_and_caps(spark):
    calcs = spark.createDataFrame([("a", "paystub-based", None, 9.0, 0), ("a", "ytd-based", None, 8.0, 1), ("a", "voi-based", "[audit] x", 7.0, 2)], "k string, method string, details string, annual double, ord int")
    assert V.best_calculation(calcs, ["k"]).first().annual == 8.0
    assert one(spark, V.declared_off(F.lit(100.0), F.array(F.lit(200.0), F.lit(105.0)))) is False and one(spark, V.declared_off(F.lit(100.0), F.array(F.lit(200.0)))) is True
    assert one(spark, V.reachable_sums(F.array(F.lit(1.1), F.lit(2.2)))) == [0.0, 1.1, 2.2, 3.3] and one(spark, V.reachable_sums(F.array(*(F.lit(float(2**k)) for k in range(16))), 1000)) is None


def test_sources_and_sinks_round_trip(spark, tmp_path):
    from hearthledger.sources import packets

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (folder / "b.bin").write_bytes(b"\xff\xd8\xff" + b"0" * 2_000_000)
    found = packets.binary_files(spark, str(folder), 1).select("length", packets.sniff_kind(F.col("content")).alias("kind")).collect()
    assert [(r.length, r.kind) for r in found] == [(10, "pdf")]
    rows = spark.createDataFrame([(1, "x \"y\"", None), (2, None, 2.5)], "k int, s string, d double")
    packets.write_payloads(rows, str(tmp_path / "out"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("a", T.StringType())])
    read = lambda x: one(spark, packets.parse_model_output(F.lit(x), kind))
    assert read('{"a": "1"}')["a"] == "1" and read(r'{"a": "5\% off"}')["a"] == r"5\% off" and read('{"a": ') is None or read('{"a": ')["a"] is None


def test_provenance_and_titles(spark):
    from hearthledger.operators import case_rules as C

    r = spark.createDataFrame([("c", 1, 1234.5), ("c", 2, 80.0), ("c", 3, 81.0), ("d", 4, 1234.5)], "case string, id long, amount double")
    p = spark.createDataFrame([("c", "net 1,234.50 and 80 dollars; 181.00")], "case string, text string")
    assert {x.id: x.amount for x in C.provenance(r, p, "id", "amount").collect()} == {1: 1234.5, 2: 80.0, 3: None, 4: None}
    assert one(spark, C.printed_title(F.lit("The PAY STUB detail"), ["Stub", "Pay Stub", "Lease"])) == "Pay Stub"
    keys = [one(spark, C.month_key(F.lit(x))) for x in ("2024-03", "2024-03-09", "03/2024", "3/15/2024", "Mar 2024", "March 2024", "13/2024", "soon")]
    assert keys == ["2024-03"] * 6 + [None, None]
