"""Order-dependent reconciliation on literal cases; shuffled input gives the same result."""

from pyspark.sql import functions as F

from hearthledger.operators import reconcile

MENTIONS = [
    ("c", 0, "Alma Dorrance", 0, 1), ("c", 1, "Alba Dorrance", 1, 1), ("c", 2, "ALMA DORRANCE", None, 3), ("c", 3, "Alma Dorance", None, 2),
    ("c", 4, "Piet Quill", None, 2), ("d", 0, "Alma Dorrance", None, 5),
]


def test_household_rows_stay_apart(spark):
    rows = spark.createDataFrame(MENTIONS, "case_id string, ord long, name string, member long, trust int")
    for some in (rows, rows.orderBy(F.desc("ord"))):
        got = {(r.case_id, r.ord): (r.leader, r.canonical) for r in reconcile.name_clusters(some, "case_id", "ord", "name", "member", "trust").collect()}
        assert got[("c", 0)] == (0, "Alma Dorrance") and got[("c", 1)][0] == 1
        assert got[("c", 2)] == got[("c", 3)] == (0, "Alma Dorrance")
        assert got[("c", 4)] == (4, "Piet Quill") and got[("d", 0)][0] == 0


def test_stubs_of_one_job_share_a_name(spark):
    rows = [
        ("c", 0, "Alma Dorrance", "77", "Hill Staffing", "2024-01-05", 500.0, 500.0), ("c", 1, "Alma Dor", "77", "Hil Staffing", "2024-01-12", 500.0, 1000.0),
        ("c", 2, "Alma Dorrance", None, None, "2024-01-19", 510.0, 1510.0), ("c", 3, "Piet Quill", None, "Hill Staffing", "2024-01-05", 90.0, 90.0), ("c", 4, "Alma Dorrance", "9", "Zed Foods", "2024-01-05", 70.0, 9000.0),
    ]
    got = {r.ord: r.unified for r in reconcile.unify_stub_sources(spark.createDataFrame(rows, reconcile.STUB)).collect()}
    assert got == {0: "Hill Staffing", 1: "Hill Staffing", 2: "Hill Staffing", 3: "Hill Staffing", 4: "Zed Foods"}
