"""More rules over cases: disclosures, gaps, provenance, splits, disputes. Findings are rows; an unread value says nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthledger.operators.linkage import alike
from hearthledger.operators.taxonomy import dimension

#: What a dispute of the whole case leaves of its records' score. Fixed value.
CASE_DISPUTE = 0.40


def unverified_disclosures(disclosed: DataFrame, documents: DataFrame, rules: DataFrame) -> DataFrame:
    """case, code: a topic answered yes that no document of the case proves. rules: topic, pattern (of labels), code."""
    yes = disclosed.filter("yes").select("case", "topic").distinct().join(dimension(rules), "topic")
    proofs = documents.select("case", F.lower("label").alias("label")).distinct().join(dimension(rules.select("topic", "pattern")), F.expr("label rlike pattern")).select("case", "topic")
    return yes.join(proofs, ["case", "topic"], "left_anti").select("case", "code")


def value_gaps(records: DataFrame, key: str, required: list[str]) -> DataFrame:
    """key, field: required fields that a record leaves empty."""
    long = records.select(key, *(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias(f) for f in required)).unpivot(key, required, "field", "value")
    return long.filter("value is null").select(key, "field")


def amount_forms(amount: Column) -> Column:
    """How a page may print an amount: with and without thousands commas, cents, or, of whole amounts, no cents."""
    plain = amount.cast("decimal(18,2)").cast("string")
    grouped = F.format_number(amount.cast("decimal(18,2)"), 2)
    whole = F.when(amount.cast("decimal(18,2)") == F.floor(amount), F.array(F.regexp_replace(plain, r"\.00$", ""), F.regexp_replace(grouped, r"\.00$", "")))
    return F.array_distinct(F.concat(F.array(plain, grouped), F.coalesce(whole, F.array().cast("array<string>"))))


def number_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)))


def provenance(records: DataFrame, pages: DataFrame, id_: str, amount: str) -> DataFrame:
    """id, amount, printed: an amount that no page of its case prints becomes null. records: case, id, amount; pages: case, text."""
    forms = records.select("case", id_, F.explode(amount_forms(F.col(amount))).alias("token"))
    tokens = pages.select("case", F.explode(number_tokens(F.col("text"))).alias("token")).distinct()
    hit = forms.join(tokens, ["case", "token"]).select(id_).distinct().withColumn("printed", F.lit(True))
    out = records.join(hit, id_, "left").withColumn("printed", F.coalesce("printed", F.lit(False)))
    return out.select(id_, F.when(F.col("printed"), F.col(amount)).alias(amount), "printed")


def resolved_names(asked: DataFrame, roster: DataFrame, least: float = 0.72) -> DataFrame:
    """ref, member: the most similar name of the case, first in order on ties, or null below ``least``. A name that many ask is compared once. asked: case, ref, name; roster: case, ord, member."""
    pairs = alike(asked, roster, ["case"], "name", "member", least).join(roster, ["case", "member"])
    best = pairs.groupBy("case", "name").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "member")).alias("b"))
    return asked.join(best, ["case", "name"], "left").select("ref", F.col("b.member").alias("member"))


def filled_members(members: DataFrame, found: DataFrame, fields: list[str]) -> DataFrame:
    """``members`` (case, m_id, name, fields) with empty fields filled: from the same name, else from the only name of the case with its first and last word."""
    loose = lambda c: F.concat_ws(" ", F.get(F.split(F.lower(c), " "), F.lit(0)), F.element_at(F.split(F.lower(c), " "), -1))
    first = lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f"_{f}")
    exact = found.groupBy("case", F.lower("name").alias("_n")).agg(*map(first, fields))
    near = found.groupBy("case", loose(F.col("name")).alias("_l")).agg(F.countDistinct(F.lower("name")).alias("_k"), *(first(f).alias(f"__{f}") for f in fields)).filter("_k = 1")
    both = members.withColumn("_n", F.lower("name")).withColumn("_l", loose(F.col("name"))).join(exact, ["case", "_n"], "left").join(near, ["case", "_l"], "left")
    return both.select("case", "m_id", *(F.coalesce(f, f"_{f}", f"__{f}").alias(f) for f in fields))


def printed_title(text: Column, labels: list[str], head: int = 300) -> Column:
    """The longest of a taxonomy's labels that stands in the first characters of a page; by code point order on ties."""
    top = F.lower(F.substring(text, 1, head))
    held = [F.when(F.contains(top, F.lit(x.lower())), F.struct(F.lit(-len(x)).alias("n"), F.lit(x).alias("label"))) for x in labels]
    return F.array_min(F.filter(F.array(*held), lambda x: x.isNotNull()))["label"]


def split_groups(pages: DataFrame) -> DataFrame:
    """case, part, first, last, n: a group's pages split where the effective date changes; pages without one stay with the page before. pages: case, page, day."""
    from pyspark.sql import Window as W

    by = W.partitionBy("case").orderBy("page")
    carried = pages.withColumn("_d", F.last("day", ignorenulls=True).over(by))
    before = F.lag("_d").over(by)
    new = F.when(F.row_number().over(by) == 1, 1).when(before.isNull() | (F.col("_d") == before), 0).otherwise(1)
    parts = carried.withColumn("_new", new).withColumn("part", F.sum("_new").over(by))
    return parts.groupBy("case", "part").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n"))


def rotation_winner(reads: DataFrame) -> DataFrame:
    """page, turn: a turned read wins with a score 0.1 above the upright one, or 0.05 below and clean where that is not. reads: page, turn (0 upright), score, clean."""
    up = reads.filter("turn = 0").select("page", F.col("score").alias("_s"), F.col("clean").alias("_c"))
    best = reads.filter("turn <> 0").groupBy("page").agg(F.max(F.struct("score", (-F.col("turn")).alias("k"), "clean", "turn")).alias("b"))
    wins = (F.col("b.score") >= F.col("_s") + 0.1) | (F.col("b.clean") & ~F.col("_c") & (F.col("b.score") >= F.col("_s") - 0.05))
    return up.join(best, "page", "left").select("page", F.when(wins, F.col("b.turn")).otherwise(0).alias("turn"))


def skipped_page(text: Column, flags: Column) -> Column:
    """A page that says nothing: empty, blank, or of low quality and not repaired."""
    low = F.array_contains(flags, "low_quality") & ~F.array_contains(flags, "repaired")
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | F.array_contains(flags, "blank") | low


def month_key(c: Column) -> Column:
    """YYYY-MM of a month printed as 2024-03(-..), 03/2024, 3/15/2024, Mar 2024 or March 2024; null otherwise."""
    part = lambda p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    names = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    named = r"(?i)^\s*([a-z]{3})[a-z]*\.?,?\s+([0-9]{4})\s*$"
    number = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(F.coalesce(part(named, 1), F.lit("")))), F.lit(0))
    shapes = [(part(r"^\s*([0-9]{4})-([0-9]{1,2})(?:-[0-9]{1,2})?\s*$", 1), part(r"^\s*([0-9]{4})-([0-9]{1,2})(?:-[0-9]{1,2})?\s*$", 2)), (part(r"^\s*([0-9]{1,2})/(?:[0-9]{1,2}/)?([0-9]{4})\s*$", 2), part(r"^\s*([0-9]{1,2})/(?:[0-9]{1,2}/)?([0-9]{4})\s*$", 1)), (part(named, 2), number.cast("string"))]
    keys = [F.when(m.try_cast("int").between(1, 12), F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))) for y, m in shapes]
    return F.coalesce(*keys)


def record_annual(rate: Column, hours: Column, multiplier: Column) -> Column:
    """A record's yearly figure: rate by hours by periods, or rate by periods; null without periods."""
    return F.round(F.when(hours.isNotNull(), rate * hours * multiplier).otherwise(rate * multiplier), 2)


def certification_kind(move_in: Column, effective: Column, stated: Column) -> Column:
    """A certification effective on the move-in day is a move-in one; another stated type contradicts the document."""
    kind = F.when(move_in == effective, "MI")
    return F.when(kind.isNotNull() & stated.isNotNull() & (stated != kind), "CERT_TYPE_CONTRADICTS_DOCUMENT")


def dispute_stages(findings: DataFrame, cards: DataFrame) -> DataFrame:
    """card, code, score: findings lower the records whose label holds all words of their subject; one without a subject is shared by the case's records.

    findings: case, code, strength, subject (array); cards: case, card, words (array).
    """
    both = findings.join(cards, "case")
    own = both.filter((F.size("subject") > 0) & (F.size(F.array_except("subject", "words")) == 0)).select("card", "code", F.col("strength").alias("score"))
    n = cards.groupBy("case").agg(F.count("*").alias("n"))
    shared = both.filter(F.size("subject") == 0).join(n, "case").select("card", "code", (1 - (1 - F.lit(CASE_DISPUTE)) / F.col("n")).alias("score"))
    return own.unionByName(shared)


def without_historical(cards: DataFrame, calcs: DataFrame, keys: list[str]) -> DataFrame:
    """Cards whose source has no calculation marked as history."""
    return cards.join(calcs.filter(F.col("details").startswith("[historical]")).select(*keys).distinct(), keys, "left_anti")


def deliverable_stubs(stubs: DataFrame, keys: list[str], days: int = 548) -> DataFrame:
    """keys, n, stubs: a record's stubs of the last ``days`` before its newest, by date, as JSON."""
    newest = stubs.groupBy(*keys).agg(F.max("day").alias("_newest"))
    recent = stubs.join(newest, keys).filter(F.datediff("_newest", "day") <= days)
    listed = F.array_sort(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "amount")))
    return recent.groupBy(*keys).agg(F.count("*").alias("n"), F.to_json(listed).alias("stubs"))


def forms_present(groups: DataFrame, required: list[str]) -> DataFrame:
    """case, forms, missing: the forms that a case holds, in order, and the required ones that it lacks."""
    need = F.array(*map(F.lit, required))
    held = groups.groupBy("case").agg(F.array_sort(F.collect_set("label")).alias("forms"))
    return held.select("case", "forms", F.array_except(need, "forms").alias("missing"))
