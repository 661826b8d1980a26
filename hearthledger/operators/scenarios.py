"""Special scenarios, case sections and range rules; findings are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthledger.operators.review import OVERPAYMENT

#: What documents are worth as evidence of an identity, by category. Fixed values.
AUTHORITY = {"cert": 0, "identity": 1, "income": 2, "asset": 3}


def students_unverified(members: DataFrame, groups: DataFrame) -> DataFrame:
    """case, member: students of cases without a student document. members: case, member, student; groups: case, label, category."""
    proof = groups.filter(F.contains(F.lower("label"), F.lit("student")) & (F.col("category") != "ignore")).select("case").distinct()
    return members.filter("student = 'Y'").join(proof, "case", "left_anti").select("case", "member")


def overpayments(groups: DataFrame) -> DataFrame:
    """case, g_id: benefit letters whose text speaks of an overpayment or adjustment. groups: case, g_id, label, text."""
    benefit = F.lower("label").rlike("ssa|ssi|ssdi|social security")
    return groups.filter(benefit & F.lower("text").rlike(OVERPAYMENT)).select("case", "g_id")


def incomplete_forms(groups: DataFrame, sections: DataFrame) -> DataFrame:
    """case, g_id, missing: sections that a form's text lacks. groups: case, g_id, form, text; sections: form, section, pattern, any of which marks it."""
    need = groups.join(F.broadcast(sections) if sections.count() <= 10_000 else sections, "form")
    held = need.groupBy("case", "g_id", "section").agg(F.bool_or(F.expr("lower(text) rlike pattern")).alias("held"))
    return held.filter("not held").groupBy("case", "g_id").agg(F.array_sort(F.collect_set("section")).alias("missing"))


def crypto_assets(assets: DataFrame, *columns: str) -> DataFrame:
    """Assets of a kind that nothing verifies."""
    named = F.lit(False)
    for c in columns:
        named = named | F.coalesce(F.contains(F.lower(c), F.lit("crypto")), F.lit(False))
    return assets.filter(named)


def case_sections(pages: DataFrame, members: DataFrame, incomes: DataFrame) -> DataFrame:
    """case, code, n: pages of low confidence or unknown, members without a student answer, heads without income, ended work without a date.

    pages: case, label, confidence; members: case, member, head, student; incomes: case, member, status, ended."""
    low = pages.filter("confidence < 0.6 and label <> 'Unknown'").groupBy("case").agg(F.count("*").alias("n")).withColumn("code", F.lit("LOW_CONFIDENCE_PAGES"))
    unknown = pages.filter("label = 'Unknown'").groupBy("case").agg(F.count("*").alias("n")).withColumn("code", F.lit("UNKNOWN_PAGES"))
    silent = members.filter("student is null").groupBy("case").agg(F.count("*").alias("n")).withColumn("code", F.lit("STUDENT_STATUS_BLANK"))
    heads = members.filter("head").join(incomes.select("case", "member"), ["case", "member"], "left_anti").groupBy("case").agg(F.count("*").alias("n")).withColumn("code", F.lit("HEAD_WITHOUT_INCOME"))
    ended = incomes.filter("status = 'terminated' and ended is null").groupBy("case").agg(F.count("*").alias("n")).withColumn("code", F.lit("TERMINATION_WITHOUT_DATE"))
    out = low.select("case", "code", "n")
    for df in (unknown, silent, heads, ended):
        out = out.unionByName(df.select("case", "code", "n"))
    return out


def range_scores(records: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """key, field, score, reason: numeric fields against their range (rules: field, low, high, applies). Null is no verdict; a rule that does not apply is N/A."""
    fields = [c for c in records.columns if c != key]
    long = records.select(key, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(key, fields, "field", "value").filter("value is not null")
    both = long.join(F.broadcast(rules) if rules.count() <= 10_000 else rules, "field")
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return both.select(key, "field", F.when(~F.col("applies"), None).when(inside, 1.0).otherwise(0.2).alias("score"), F.when(~F.col("applies"), "not applicable").when(inside, "in range").otherwise("out of range").alias("reason"))


def household_sources(rows: DataFrame, household: list[str]) -> DataFrame:
    """r_id, kept: records of a household-level type of one case and member become the one with the most dated history; those without a member join the only owner.

    rows: case, member, type, r_id, dated."""
    level = rows.filter(F.lower("type").isin(*household))
    owners = level.filter("member is not null").groupBy("case", "type").agg(F.countDistinct("member").alias("_n"), F.min("member").alias("_owner"))
    placed = level.join(owners, ["case", "type"], "left").withColumn("_who", F.coalesce("member", F.when(F.col("_n") == 1, F.col("_owner"))))
    keep = placed.groupBy("case", "type", "_who").agg(F.max(F.struct("dated", (-F.col("r_id")).alias("k"), "r_id"))["r_id"].alias("kept"))
    same = (F.col("p.case") == F.col("k.case")) & (F.col("p.type") == F.col("k.type")) & F.col("p._who").eqNullSafe(F.col("k._who"))
    return placed.alias("p").join(keep.alias("k"), same).select("p.r_id", "k.kept")


def title_disagreements(groups: DataFrame, votes: DataFrame) -> DataFrame:
    """g_id, family, voted: groups whose printed words vote for another family than their label's. groups: g_id, family, text; votes: ord, pattern, voted."""
    listed = votes.agg(F.array_sort(F.collect_list(F.struct("ord", "voted", "pattern"))).alias("_v"))
    hit = F.filter("_v", lambda v: F.rlike(F.lower("text"), v["pattern"]))
    first = groups.crossJoin(F.broadcast(listed)).select("g_id", "family", F.get(hit, F.lit(0))["voted"].alias("voted"))
    return first.filter("voted <> family")


def authority(category: Column) -> Column:
    """Rank of a document as evidence, 0 first; 4 for the rest."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in AUTHORITY.items() for x in kv)), category), F.lit(4))


def page_note(text: Column, flags: Column, snippet: Column) -> Column:
    """What a classifier sees of a page: nothing of a blank one, a marker of one that could not be read, else its snippet."""
    blank = (F.trim(F.coalesce(text, F.lit(""))) == "") | F.array_contains(flags, "blank")
    unread = F.array_contains(flags, "unreadable") | (F.length(F.regexp_replace(text, r"\s", "")) < 20)
    return F.when(blank, F.lit(None).cast("string")).when(unread, "[unreadable page]").otherwise(snippet)
