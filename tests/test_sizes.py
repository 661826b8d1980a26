"""Operators on tables with many copies: whole results without a broadcast, a round or a comparison for each copy."""

from pyspark.sql import functions as F

from hearthledger.functions import similarity as M
from hearthledger.operators import linkage as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slip_pairs_never_broadcast_and_keep_copies(spark):
    texts = ["12345678", "12345679", "12345678", "1234567", "1?345679", "123?5679", "5", ""]
    found = L.slip_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t")
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1), (0, 3), (1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (6, 7)]
    assert "Broadcast" not in plan(found)


def loop(claims):
    used, won = set(), set()
    for c in sorted(claims, reverse=True):
        if not set(c[-2:]) & used:
            used |= set(c[-2:])
            won.add(c)
    return won


def test_links_of_copies_by_a_plain_loop_over_all_claims(spark):
    import random

    from hearthledger.operators import manifest as O
    from hearthledger.sources.session import written

    rng = random.Random(8)
    names = ["red bolt", "red bolts", "red rod", "Redd bolt", "blue rod", "blue", "", None, "blue rod gear", "small blue rod"]
    row = lambda k: (rng.choice(["c", "d", None]), k, rng.choice(names), rng.choice(["x", "y", None]))
    m = spark.createDataFrame([row(k) for k in range(70)], "case string, i long, name string, dob string")
    h = spark.createDataFrame([row(k) for k in range(100, 160)], "case string, j long, name string, dob string")
    claims = {(r.tier, r.score, r.i, r.j) for r in O.member_claims(m, h).collect()}
    r, g = (df.select(F.col("case").alias("member"), F.col("dob").alias("type"), k, F.col("name").alias("source")) for df, k in ((m, "i"), (h, "j")))
    g = g.unionByName(spark.createDataFrame([("e", "x", 200, "blue")], "member string, type string, j long, source string"))
    r = r.unionByName(spark.createDataFrame([("e", "x", 201, "red"), ("e", "x", 202, None)], "member string, type string, i long, source string"))
    records = {(x.score, x.i, x.j) for x in O.record_claims(r, g).collect()}
    rounds = []

    def durable(df):
        rounds.append(1)
        return written(df)

    assert {(x.tier, x.score, x.i, x.j) for x in O.member_links(m, h, durable).collect()} == loop(claims)
    assert {(x.score, x.i, x.j) for x in O.record_links(r, g, durable).collect()} == loop(records)
    assert len(rounds) == 6  # whatever the number of copies


def test_alike_loses_no_pair(spark):
    from itertools import product

    names = [f"{a} {b}" for a, b in product(["Ana", "Anabel", "anna", "Jo", "J.", "Josef", "Joseph"], ["Lopez", "Lopes", "Lopez Mora", "Li", "Mora"])] + ["Ana", "", " ", "x"]
    df = spark.createDataFrame([("c", n) for n in names], "case string, n string")
    for least in (0.6, 0.72):
        every = df.crossJoin(df.select(F.col("n").alias("m"))).withColumn("s", M.name_similarity(F.col("n"), F.col("m"))).filter(F.col("s") >= least)
        assert {(r.n, r.m, r.score) for r in L.alike(df, df.select("case", F.col("n").alias("m")), ["case"], "n", "m", least).collect()} == {(r.n, r.m, r.s) for r in every.collect()}


def test_resolved_names_compare_a_name_once(spark, monkeypatch):
    from hearthledger.operators import case_rules as C

    asked = spark.createDataFrame([(c, k, n) for k, (c, n) in enumerate([("c", "Ana Lopes"), ("c", "ana lopez"), ("d", "Ana Lopez"), ("c", "Piet Quill"), ("c", None), (None, "Ana Lopez")] * 12)], "case string, ref long, name string")
    roster = spark.createDataFrame([("c", 2, "Ana Lopez"), ("c", 1, "Anabel Lopez"), ("c", 0, "Bea Moran")], "case string, ord long, member string")
    found = C.resolved_names(asked, roster)
    want = ["Ana Lopez", "Ana Lopez", None, None, None, None]
    assert [r.member for r in found.orderBy("ref").collect()] == want * 12
    seen = spark.sparkContext.accumulator(0)

    def counted(a, b):
        seen.add(1)
        return 1.0

    monkeypatch.setattr(M, "name_similarity", F.udf(counted, "double"))
    assert C.resolved_names(asked, roster).filter("member is not null").count() and 0 < seen.value <= 36  # 9 pairs of names, 36 asked rows with a name


def parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def calls(monkeypatch, module, name, result):
    """Replaces a predicate by one that says ``result`` and counts its calls on rows."""
    from pyspark.sql import SparkSession

    seen = SparkSession.getActiveSession().sparkContext.accumulator(0)

    def counted(*_):
        seen.add(1)
        return result

    monkeypatch.setattr(module, name, F.udf(counted, "boolean"))
    return seen


def test_same_members_compare_two_names_once(spark, tmp_path, monkeypatch):
    from hearthledger.plans.registry import QUERIES

    names = [("hot bolt", "SMALL", 1), ("hot rod", "SMALL", 3), ("hot rod", "LARGE", 3), ("H rod", "SMALL", 1), ("old rod", "SMALL", 1)]
    at = parts(spark, tmp_path, [(k, *names[k % 5][:1], "B", *names[k % 5][1:], 1.0) for k in range(100)])
    got = {tuple(r) for r in QUERIES["same_members"](spark, at).collect()}
    alike = {(0, 0), (0, 1), (0, 3), (1, 1), (1, 3), (2, 2), (1, 2), (3, 3), (4, 4)}
    assert got == {(a, b) for a in range(100) for b in range(a + 1, 100) if tuple(sorted((a % 5, b % 5))) in alike}
    seen = calls(monkeypatch, M, "same_member", True)
    assert QUERIES["same_members"](spark, at).count() == 80 * 79 // 2 + 20 * 19 // 2 and 0 < seen.value <= 50  # 11 pairs of names of two letters


def test_amount_tolerances_compare_two_amounts_once(spark, tmp_path, monkeypatch):
    from hearthledger.plans.registry import QUERIES

    at = parts(spark, tmp_path, [(k * 7, "n", "B", "T", 1, [100.0, 100.5, 150.0][k % 3]) for k in range(60)])
    got = {(r.x, r.y): (r.near, r.close, r.equal, r.distinctive) for r in QUERIES["amount_tolerances"](spark, at).collect()}
    assert len(got) == 60 * 59 and got[0, 21] == (True, True, True, False) and got[7, 0] == (True, True, False, True) and got[0, 14] == (False, True, False, False)
    seen = calls(monkeypatch, M, "amounts_close", True)
    assert QUERIES["amount_tolerances"](spark, at).count() == 60 * 59
    QUERIES["amount_tolerances"](spark, at).select("close").collect()
    assert 0 < seen.value <= 40  # 9 pairs of amounts


def test_a_class_is_cut_into_parts(spark):
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("k"))
    cut = L.classes(rows, ["k"], "id", "ids", 2)
    assert sorted((r.k, len(r.ids)) for r in cut.collect()) == [(0, 1), (0, 2), (0, 2), (1, 1), (1, 2), (1, 2)]


def test_one_to_one_of_copies_by_a_plain_loop(spark):
    import random

    from hearthledger.sources.session import written

    for seed in range(3):
        rng = random.Random(seed)
        left, right = ([(rng.choice("ab"), k + i, rng.choice([None, float("nan"), *map(float, range(n // 4))])) for i in range(n)] for k, n in ((0, 60), (100, 40)))
        used, want = set(), set()
        for d, i, j in sorted((abs(x - y), i, j) for b, i, x in left for c, j, y in right if b == c and None not in (x, y) and x - y == x - y):
            if not {i, j} & used:
                used |= {i, j}
                want.add((i, j, -d))
        rounds = []

        def durable(df, rounds=rounds):
            rounds.append(1)
            return written(df)

        rows = lambda x, k: spark.createDataFrame(x, f"b string, {k} long, v double")
        assert {tuple(r) for r in L.nearest_one_to_one(rows(left, "l"), rows(right, "r"), "b", "l", "r", "v", durable).collect()} == want
        assert len(rounds) == 1


def test_votes_take_words_as_the_sql_does(spark, tmp_path):
    from hearthledger.plans.registry import QUERIES

    rows = [(1, "einéle Haus", "de"), (2, "nïle der", "fr"), (3, "é le", "fr"), (4, "table", "de"), (5, None, "de"), (6, "THE der", None), (7, "the", "de"), (7, "der", "de"), (8, "lé x", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["title_disagreements"](spark, str(tmp_path)).select("g_id", "family", "voted").collect())
    assert got == [(1, "de", "fr"), (2, "fr", "de"), (7, "de", "en"), (8, "de", "fr")]
