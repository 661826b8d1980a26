"""Order-dependent reconciliation within a case. A case is small (tens of records), so its records meet in one
array or one pandas group; cases are the parallel unit and every order is explicit."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthledger.functions.similarity import name_similarity

CLUSTER = 0.55
SAME_NAME, SAME_PERSON = 0.80, 0.85


def name_clusters(mentions: DataFrame, case: str, order: str, name: str, member: str, trust: str) -> DataFrame:
    """case, order, leader, canonical: leader clustering of name mentions in their order.

    A mention joins the first leader it resembles, unless both are rows of the household (they are different people)
    or the leader's cluster already holds that household row; else it leads. The canonical name is the most trusted
    of its cluster, the earliest on ties. One fold over the case's array, native."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(member).alias("h"), F.col(trust).alias("t"))))
    kind = "array<struct<o:bigint,n:string,h:bigint,rows:array<bigint>>>"
    out = "array<struct<o:bigint,lead:bigint>>"

    def fits(leader: Column, x: Column) -> Column:
        different = leader["h"].isNotNull() & x["h"].isNotNull() & (leader["h"] != x["h"])
        taken = leader["h"].isNull() & x["h"].isNotNull() & F.array_contains(leader["rows"], F.coalesce(x["h"], F.lit(-1)))
        return ~different & ~taken & (name_similarity(leader["n"], x["n"]) >= CLUSTER)

    def step(state: Column, x: Column) -> Column:
        hit = F.get(F.filter(state["leaders"], lambda leader: fits(leader, x)), F.lit(0))
        own = F.when(x["h"].isNotNull(), F.array(x["h"].cast("long"))).otherwise(F.array().cast("array<bigint>"))
        joined = F.transform(state["leaders"], lambda q: F.struct(q["o"].alias("o"), q["n"].alias("n"), q["h"].alias("h"), F.when(q["o"] == hit["o"], F.concat(q["rows"], own)).otherwise(q["rows"]).alias("rows")))
        fresh = F.concat(state["leaders"], F.array(F.struct(x["o"].cast("long").alias("o"), x["n"].alias("n"), x["h"].cast("long").alias("h"), own.alias("rows"))))
        leaders = F.when(hit.isNotNull(), joined).otherwise(fresh)
        return F.struct(leaders.cast(kind).alias("leaders"), F.concat(state["out"], F.array(F.struct(x["o"].cast("long").alias("o"), F.coalesce(hit["o"], x["o"].cast("long")).alias("lead")))).cast(out).alias("out"))

    start = F.struct(F.array().cast(kind).alias("leaders"), F.array().cast(out).alias("out"))
    placed = mentions.groupBy(case).agg(m.alias("m")).select(case, F.inline(F.aggregate("m", start, step)["out"])).withColumnsRenamed({"o": order, "lead": "leader"})
    rows = mentions.select(case, F.col(order).cast("long").alias(order), name, trust).join(placed, [case, order])
    best = rows.groupBy(case, "leader").agg(F.min_by(name, F.struct(F.col(trust), F.col(order))).alias("canonical"))
    return rows.join(best, [case, "leader"]).select(case, order, "leader", "canonical")


def _key(text: object) -> str:
    return "".join(c for c in str(text or "").lower() if c.isalnum())


def _alike(a: str, b: str, least: float) -> bool:
    return a == b or SequenceMatcher(None, a, b).ratio() >= least


def _one_job(a: dict, b: dict) -> bool:
    """Two stubs of one person at one employer: equal employee id, near-equal name, or running totals that follow."""
    ma, mb = _key(a["member"]), _key(b["member"])
    if ma and mb and not (ma.startswith(mb) or mb.startswith(ma) or _alike(ma, mb, SAME_PERSON)):
        return False
    if _key(a["employee_id"]) and _key(a["employee_id"]) == _key(b["employee_id"]):
        return True
    na, nb = _key(a["source"]), _key(b["source"])
    if na and nb and _alike(na, nb, SAME_NAME):
        return True
    first, second = sorted((a, b), key=lambda s: str(s["day"] or ""))
    known = all(pd.notna(x) for x in (first["ytd"], second["ytd"], second["gross"])) and first["day"] and second["day"]
    return bool(known and abs(second["ytd"] - first["ytd"] - second["gross"]) <= 0.02)


_TEXT, _NUMBER = T.StringType(), T.DoubleType()
STUB = T.StructType([T.StructField(n, k) for n, k in (("case_id", _TEXT), ("ord", T.LongType()), ("member", _TEXT), ("employee_id", _TEXT), ("source", _TEXT), ("day", _TEXT), ("gross", _NUMBER), ("ytd", _NUMBER))])


def unify_stub_sources(stubs: DataFrame) -> DataFrame:
    """case_id, ord, source, unified: stubs of one job take the name most of them carry (the longer on ties).

    The ratio of two names has no native form, so a case's stubs meet in one pandas group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("ord").to_dict("records")
        top = list(range(len(rows)))

        def root(i: int) -> int:
            while top[i] != i:
                i = top[i]
            return i

        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if _one_job(rows[i], rows[j]):
                    top[root(j)] = root(i)
        names: dict[int, dict[str, list]] = {}
        for i, r in enumerate(rows):
            if _key(r["source"]):
                names.setdefault(root(i), {}).setdefault(_key(r["source"]), []).append(r["source"])
        chosen = {k: max(v.items(), key=lambda kv: (len(kv[1]), len(kv[0])))[1][0] for k, v in names.items()}
        return pd.DataFrame({"case_id": [r["case_id"] for r in rows], "ord": [r["ord"] for r in rows], "source": [r["source"] for r in rows], "unified": [chosen.get(root(i), r["source"]) for i, r in enumerate(rows)]})

    return stubs.select(*STUB.fieldNames()).groupBy("case_id").applyInPandas(run, "case_id string, ord long, source string, unified string")
