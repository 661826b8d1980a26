"""Operators on small literal tables, and independence of row order."""

import datetime
import random
from itertools import combinations

from pyspark.sql import functions as F

from hearthledger.functions import similarity as M
from hearthledger.operators import classify, income, linkage, rules, scoring, state
from hearthledger.plans import registry
from hearthledger.sources.session import written


def test_weekly_ledger_is_summed_over_a_year(spark):
    start = datetime.date(2023, 1, 2)
    rows = [("a", start + datetime.timedelta(7 * i), 100.0) for i in range(60)] + [("b", start, 5.0)]
    got = {r.k: r for r in income.annualise_ledger(spark.createDataFrame(rows, "k string, d date, v double"), "k", "d", "v").collect()}
    assert got["a"].status == "full year" and got["a"].annual == 53 * 100.0
    assert got["b"].status == "rejected" and got["b"].annual is None


def test_sequence_repair(spark):
    rows = spark.createDataFrame([("m", 1, 6000.0), ("m", 2, 612345.0), ("m", 3, 9000.0)], "k string, d int, ytd double")
    got = {r.d: r.repaired for r in income.repair_sequence(rows, ["k"], "d", "ytd").collect()}
    assert got == {1: 6000.0, 2: 6123.45, 3: 9000.0}


def test_totals_need_two_components(spark):
    rows = [([("a", 10000, False), ("a", 25000, False), ("a", 35000, False)], None), ([("a", 10000, False), ("a", 10000, False)], None), ([("a", 637619, False), ("a", 600000, False), ("a", 37679, False)], None), ([("a", 100, False), ("b", 200, False), ("c", 300, False)], None), ([("a", 100, False), ("b", 200, False), ("c", 300, True)], None), ([("a", 9800, True), ("b", 500, False)], 10000), ([], None)]
    kind = "q array<struct<page:string,cents:long,untyped:boolean>>, ref long"
    got = spark.createDataFrame(rows, kind).coalesce(1).select(linkage.total_lines(F.col("q"), F.col("ref")).alias("t")).collect()
    assert [r.t for r in got] == [[False, False, True], [False, False], [True, False, False], [False] * 3, [False, False, True], [True, False], []]


def test_name_similarity(spark):
    same = spark.range(1).select(M.name_similarity(F.lit("Alma Dorr"), F.lit("Aima Dorr")).alias("a"), M.name_similarity(F.lit("Leo Dorr"), F.lit("Mia Dorr")).alias("b"), M.name_similarity(F.lit("Ana"), F.lit("ana ")).alias("c")).first()
    assert same.a >= 0.5 and same.b <= 0.40 and same.c == 1.0


def test_one_to_one_uses_each_side_once(spark):
    left = spark.createDataFrame([("n", 1, 10.0), ("n", 2, 11.0), ("m", 3, 5.0)], "b string, l int, v double")
    right = spark.createDataFrame([("n", 1, 10.4), ("n", 2, 40.0)], "b string, r int, v double")
    got = sorted((r.l, r.r) for r in linkage.nearest_one_to_one(left, right, "b", "l", "r", "v", written).collect())
    assert got == [(1, 1), (2, 2)]


def test_clusters_follow_chains(spark):
    nodes = spark.range(1, 7).withColumnRenamed("id", "n")
    edges = spark.createDataFrame([(6, 5), (5, 4), (4, 2)], "a long, b long")
    got = {r.n: r.cluster for r in linkage.clusters(edges, nodes, "n", written).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 2, 5: 2, 6: 2}


def test_finding_key_sorts_subjects(spark):
    key = rules.finding_key(F.lit("X"), F.create_map(F.lit("b"), F.lit("Two, Inc."), F.lit("a"), F.lit("One"), F.lit("c"), F.lit(None).cast("string")))
    empty = rules.finding_key(F.lit("X"), F.create_map().cast("map<string,string>"))
    got = spark.range(1).select(key.alias("k"), empty.alias("e")).first()
    assert got.k == "X:one:two_inc" and got.e == "X:case"


def test_unverified_field_stays_below_green(spark):
    rows = [("f", "extraction", 1.0, None), ("g", "extraction", 1.0, None), ("g", "source", 1.0, None), ("h", "source", 1.0, 0.49)]
    got = {r.k: r for r in scoring.field_scores(spark.createDataFrame(rows, "k string, stage string, score double, ceiling double"), ["k"]).collect()}
    assert (got["f"].composite, got["f"].flag) == (0.79, "yellow") and got["g"].flag == "green" and got["h"].flag == "red"


def test_claim_while_owned_is_dropped(spark):
    rows = [(1, "c"), (2, "c"), (3, "done"), (4, "c"), (5, "c")]
    e = spark.createDataFrame([("u", i, k) for i, k in rows], "u string, i int, k string")
    got = state.accepted_claims(e.orderBy(F.desc("i")), "u", ["i"], F.col("k") == "c", F.col("k") == "done")
    assert sorted(r.i for r in got.collect()) == [1, 4]


def test_runs_keep_gaps_apart(spark):
    e = spark.createDataFrame([("c", 1, "x"), ("c", 2, "x"), ("c", 3, None), ("c", 4, "x")], "k string, i int, v string")
    assert sorted((r.run, r.v, r.n) for r in classify.runs(e, "k", "i", "v").collect()) == [(1, "x", 2), (2, None, 1), (3, "x", 1)]


def test_totals_over_all_lines_by_brute_force(spark):
    rng = random.Random(4)
    rows = [[rng.randint(1, 10**6) for _ in range(13)] for _ in range(2)] + [[rng.randint(-300, 500) * 25 for _ in range(9)], [500], []]
    for q in rows[:2]:
        q.append(q[1] + q[12])  # a total of line 13
        q.append(sum(q[8:14]))
    slip = lambda a, b: len(a) == len(b) and a[0] == b[0] and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    shown = lambda c: f"{c / 100:.2f}"
    for q in rows:
        for i, v in enumerate(q):
            others = [x for j, x in enumerate(q) if j != i and x]
            want = bool(v) and any(abs(sum(c) - v) <= 1 or slip(shown(sum(c)), shown(v)) for k in range(2, 7) for c in combinations(others, k))
            assert linkage.reachable(v, others) == want, (q, v)


def test_degenerate_pages_by_token_and_phrase(spark, tmp_path):
    rng = random.Random(2)
    noise = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(n)]
    mixed = lambda a, b: " ".join(rng.sample([*a, *b], len(a) + len(b)))
    texts = {
        1: "all the same words " * 200,  # compresses
        2: mixed(["9"] * 70, noise(60)),  # one token
        3: mixed(["Payrolls by Inc."] * 20, noise(90)),  # three words: 40 %, two of them 27 %
        4: mixed(["pay slip"] * 30, noise(60)),  # two words
        5: mixed(["- - -"] * 25, noise(95)),  # no word in it
        6: " ".join(noise(120)),
        7: "no no",
        8: None,
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["degenerate_pages"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(got[d].ratio >= 0.10 for d in (2, 3, 4))
    assert got[2].token >= 0.5 and got[3].phrase == 0.4 and got[4].phrase >= 0.35
