"""Rules over certified cases and confidence of their records; findings are rows, unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Which method speaks for a source where several computed it. Fixed values.
METHOD_ORDER = {"voi-based": 0, "history-based": 0, "self-declared": 1, "ytd-based": 2, "paystub-based": 3}
POPULATED, SUSPICIOUS, ABSENT = 0.85, 0.60, 0.0
PLACEHOLDERS = ("***-**-0000", "***-**-9999", "000-00-0000", "999-99-9999")
ASSISTANCE = "homebase|rental assistance verification|housing voucher|rent subsidy verification"
OVERPAYMENT = "overpayment|adjusted amount|withholding|offset"


def reachable_sums(amounts: Column, cap: int = 20_000) -> Column:
    """Distinct sums of any of the amounts, to the cent; null when there are more than ``cap``: then nothing is said about them."""
    cents = F.transform(amounts, lambda a: F.round(a * 100).cast("long"))

    def add(s: Column, v: Column) -> Column:
        return F.when(F.size(s) <= cap, F.array_distinct(F.concat(s, F.transform(s, lambda x: x + v)))).otherwise(s)

    sums = F.aggregate(cents, F.array(F.lit(0).cast("long")), add)
    return F.when(F.size(sums) <= cap, F.transform(F.array_sort(sums), lambda c: c / 100))


def verified_figures(stated: Column, monthly: Column) -> Column:
    """Distinct figures that a verification states, in order, then the mean of its monthly balances."""
    known = F.filter(stated, lambda x: x.isNotNull())
    months = F.filter(monthly, lambda x: x.isNotNull())
    mean = F.round(F.aggregate(months, F.lit(0.0), lambda a, x: a + x) / F.size(months), 2)
    return F.array_distinct(F.when(F.size(months) > 0, F.concat(known, F.array(mean))).otherwise(known))


def declared_off(declared: Column, figures: Column, tolerance: float = 0.10) -> Column:
    """A declared balance that none of the stated figures is near; null without either."""
    near = lambda v: F.abs(declared - v) <= tolerance * F.greatest(F.abs(declared), F.abs(v))
    return F.when(declared.isNotNull() & (F.size(figures) > 0), ~F.exists(figures, near))


def monthly_mean(balances: Column, last: int = 6) -> Column:
    """Mean of the last months of an array of (month, balance)."""
    some = F.slice(F.array_sort(balances), -F.least(F.size(balances), F.lit(last)), last)
    return F.when(F.size(balances) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x["balance"]) / F.size(some))


def asset_income(stated: Column, period_figures: Column) -> Column:
    """The stated annual income of an asset, unless it is one period's figure or the sum of them read as a year's."""
    same = lambda a, b: F.abs(a - b) < 0.005
    total = F.aggregate(period_figures, F.lit(0.0), lambda a, x: a + x)
    return F.when(~(F.exists(period_figures, lambda x: same(x, stated)) | (same(total, stated) & (F.size(period_figures) > 1))), stated)


def best_calculation(calcs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, annual: the figure of the method that speaks first; notes (audit, historical) don't."""
    order = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in METHOD_ORDER.items() for x in kv)), F.col("method")), F.lit(99))
    counted = calcs.filter(F.col("annual").isNotNull() & ~F.coalesce(F.col("details").rlike(r"^\[(audit|historical)\]"), F.lit(False)))
    return counted.groupBy(*keys).agg(F.min_by("annual", F.struct(order, "ord", "annual")).alias("annual"))


def summary_mismatch(records: DataFrame, calcs: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose certified figure is more than 10 % off the computed one. records: keys, declared, status."""
    both = records.filter("declared > 0 and coalesce(status, '') <> 'declared_only'").join(best_calculation(calcs, keys), keys)
    off = F.abs(F.col("annual") - F.col("declared")) / F.col("declared")
    return both.filter(off > 0.10).select(*keys, "declared", "annual", F.when(F.col("annual") > F.col("declared"), "higher").otherwise("lower").alias("direction"))


def assistance_missing(groups: DataFrame, certifications: DataFrame) -> DataFrame:
    """Cases with an assistance document whose certification shows zero assistance; unread figures say nothing."""
    held = groups.filter(F.lower("label").rlike(ASSISTANCE) & (F.col("category") != "ignore")).groupBy("case").agg(F.count("*").alias("documents"))
    read = F.col("federal").isNotNull() | F.col("other").isNotNull()
    zero = (F.coalesce("federal", F.lit(0.0)) == 0) & (F.coalesce("other", F.lit(0.0)) == 0)
    return certifications.filter(read & zero).join(held, "case").select("case", "documents")


def confirmations_without_report(groups: DataFrame) -> DataFrame:
    """case, report: what a countersigned confirmation restates and the case lacks. groups: case, canonical, category, confirms."""
    held = groups.filter("category <> 'ignore'")
    want = held.filter("confirms is not null").select("case", F.col("confirms").alias("report")).distinct()
    return want.join(held.select("case", F.col("canonical").alias("report")), ["case", "report"], "left_anti")


def social_security_finding(number: Column, age: Column) -> Column:
    """Members over six have a number, and a real one."""
    return F.when(age > 6, F.when(number.isNull() | (number == ""), "MEMBER_SSN_MISSING").when(number.isin(*PLACEHOLDERS), "MEMBER_SSN_PLACEHOLDER"))


def marked_yes(text: Column, words: str) -> Column:
    """A word followed, on its line and within 120 characters, by a marked yes, or standing in prose without a choice."""
    low = F.lower(text)
    mark = r"(\[\s*x\s*\]|☒|\(\s*x\s*\))"
    chosen = low.rlike(rf"(?:{words})[^\n]{{0,120}}?(?:{mark}\s*yes\b|\byes\s*{mark}(?!\s*no\b))")
    asked = low.rlike(rf"(?:{words})[^\n]{{0,120}}?\b(?:yes|no)\b")
    return chosen | (low.rlike(words) & ~asked)


def extraction_scores(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, score, reason: populated 0.85, suspicious 0.60, absent 0; an unpivot."""
    text = [F.col(f).cast("string").alias(f) for f in fields]
    long = records.select(key, *text).unpivot(key, fields, "field", "value")
    v = F.col("value")
    odd = (F.length(v) > 200) | F.lower(v).rlike("<td|<tr|</t|&amp;|colspan") | v.rlike("^[0-9]{5,}$")
    score = F.when(v.isNull(), ABSENT).when(odd, SUSPICIOUS).otherwise(POPULATED)
    return long.select(key, "field", score.alias("score"), F.when(v.isNull(), "absent").when(odd, "suspicious").otherwise("populated").alias("reason"))


def record_scores(fields: DataFrame, key: str) -> DataFrame:
    """key, score: the mean of a record's fields that apply; declared-only records reach 0.60, disputed ones 0.79 at most."""
    agg = fields.groupBy(key).agg(F.avg(F.when(~F.col("na"), F.col("score"))).alias("mean"), F.bool_or("declared_only").alias("_d"), F.bool_or("disputed").alias("_x"))
    return agg.select(key, F.least("mean", F.when(F.col("_d"), 0.60).otherwise(1.0), F.when(F.col("_x"), 0.79).otherwise(1.0)).alias("score"))


def case_score(fields: DataFrame, key: str, headline: Column, coverage: Column) -> DataFrame:
    """key, score: mean over fields, headline ones three times, times coverage, six places."""
    w = F.when(headline, 3.0).otherwise(1.0)
    return fields.groupBy(key).agg(F.round(F.sum(F.col("score") * w) / F.sum(w) * F.max(coverage), 6).alias("score"))


def evidence_tier(found_own: Column, found_any: Column, confidence: Column, populated: Column) -> Column:
    """Score and ceiling of a value by where it is printed: its own pages, other pages, nowhere."""
    tier = lambda s, c: F.struct(s.cast("double").alias("score"), F.lit(c).cast("double").alias("ceiling"))
    return F.when(~populated, F.lit(None)).when(found_own, tier(F.lit(1.0), 1.0)).when(found_any, tier(0.70 * confidence, 0.79)).otherwise(tier(0.30 * confidence, 0.49))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256, lower-case hex, of text under a text key of at most 64 bytes; longer keys are hashed first."""
    raw = F.when(F.octet_length(key) > 64, F.sha2(key, 256)).otherwise(F.lower(F.hex(F.encode(key, "UTF-8"))))
    padded = F.rpad(raw, 128, "0")
    nibble = lambda x: F.conv(x, 16, 10).cast("int")

    def masked(byte: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.lpad(F.lower(F.hex(nibble(F.substring(padded, i, F.lit(2))).bitwiseXOR(F.lit(int(byte, 16))).cast("long"))), 2, "0")), "")

    inner = F.sha2(F.concat(F.unhex(masked("36")), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(masked("5c")), F.unhex(inner)), 256)


def retryable(message: Column) -> Column:
    """Whether a failure is worth another try."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return m.rlike("timeout|timed out|429|rate limit|5[0-9]{2}|connection|temporar|unavailable") & ~m.rlike("invalid|unauthori|forbidden|40[0134]")


def resumable(jobs: DataFrame, owned: tuple[str, ...], limit: int) -> DataFrame:
    """Owned jobs by age with what happens to them: a request that can run again resumes, others fail."""
    held = jobs.filter(F.col("state").isin(*owned))
    can = F.col("request").isNotNull() & (F.col("retries") < limit)
    return held.select("case", "created", F.when(can, "resume").otherwise("fail").alias("action"))


def member_payload(members: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key, payload: members as a JSON list in order, each with a reference m01, m02, … over all rows."""
    ref = F.format_string("m%02d", F.row_number().over(W.partitionBy(key).orderBy(order)))
    rows = members.withColumn("ref", ref)
    listed = F.array_sort(F.collect_list(F.struct("ref", *fields)))
    return rows.groupBy(key).agg(F.to_json(listed).alias("payload"))


def gold_checks(rows: DataFrame, want: str, got: str, tolerance: float) -> DataFrame:
    """``rows`` with verdict: right, wrong, missing (nothing delivered) or extra (nothing expected)."""
    w, g = F.col(want), F.col(got)
    verdict = F.when(w.isNull() & g.isNull(), None).when(g.isNull(), "missing").when(w.isNull(), "extra").when(F.abs(w - g) <= tolerance * F.greatest(F.abs(w), F.lit(1.0)), "right").otherwise("wrong")
    return rows.select(*rows.columns, verdict.alias("verdict"))


def spread(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, runs, low, high, stable: how one figure differs between runs."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.min(value).alias("low"), F.max(value).alias("high"), (F.min(value) == F.max(value)).alias("stable"))


def folded(values: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """True over False over unknown, by key; unknown only where every document is silent."""
    return values.groupBy(*keys).agg(*(F.bool_or(f).alias(f) for f in flags))
