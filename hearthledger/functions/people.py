"""Facts about household members: race and ethnicity vocabulary, relationships, hours ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The consumer's categories. Fixed values.
WHITE, BLACK, ASIAN = "White", "Black/African American", "Asian"
AIAN, NHPI = "American Indian/Alaska Native", "Native Hawaiian/Other Pacific Islander"
OTHER, DECLINED, MULTI = "Other", "Decline to Answer", "Other Multi-Racial"
HISPANIC, NOT_HISPANIC = "Hispanic or Latino", "Not Hispanic or Latino"
ASIAN_DETAILS = ("Asian - Asian Indian", "Asian - Chinese", "Asian - Filipino", "Asian - Japanese", "Asian - Korean", "Asian - Vietnamese", "Asian - Other Asian")
NHPI_DETAILS = tuple(f"{NHPI} - {x}" for x in ("Native Hawaiian", "Guamanian or Chamorro", "Samoan", "Other Pacific Islander"))
RACES = (WHITE, BLACK, ASIAN, *ASIAN_DETAILS, AIAN, NHPI, *NHPI_DETAILS, OTHER, DECLINED, MULTI)
#: Pairs with a name of their own. Fixed values.
PAIRS = {(AIAN, WHITE): f"{AIAN} & {WHITE}", (ASIAN, WHITE): f"{ASIAN} & {WHITE}", (BLACK, WHITE): f"{BLACK} & {WHITE}", (AIAN, BLACK): f"{AIAN} & {BLACK}"}
#: Printed labels, tried in this order: a detail before its group. Fixed values.
PRINTED = (
    ("asian indian", ASIAN_DETAILS[0]), ("chinese", ASIAN_DETAILS[1]), ("filipino", ASIAN_DETAILS[2]), ("japanese", ASIAN_DETAILS[3]), ("korean", ASIAN_DETAILS[4]), ("vietnamese", ASIAN_DETAILS[5]), ("other asian", ASIAN_DETAILS[6]),
    ("native hawaiian or other pacific islander", NHPI), ("native hawaiian other pacific islander", NHPI), ("native hawaiian pacific islander", NHPI), ("other pacific islander", NHPI_DETAILS[3]),
    ("guamanian", NHPI_DETAILS[1]), ("chamorro", NHPI_DETAILS[1]), ("samoan", NHPI_DETAILS[2]), ("native hawaiian", NHPI_DETAILS[0]), ("pacific islander", NHPI), ("hawaiian", NHPI_DETAILS[0]),
    ("american indian", AIAN), ("alaska native", AIAN), ("alaskan native", AIAN), ("native american", AIAN), ("african american", BLACK), ("black", BLACK), ("white", WHITE), ("caucasian", WHITE), ("asian", ASIAN),
    ("choose not to respond", DECLINED), ("chose not to respond", DECLINED), ("decline", DECLINED), ("prefer not", DECLINED), ("did not respond", DECLINED), ("no response", DECLINED), ("multi", MULTI), ("two or more", MULTI), ("other", OTHER),
)
#: Codes of the printed form. Fixed values.
CODES = {"1": AIAN, "2": ASIAN, "3": BLACK, "4": NHPI, "5": WHITE, "W": WHITE, "B": BLACK, "A": ASIAN, "I": AIAN, "P": NHPI}
#: Roles that only adults have. Fixed values.
ADULT_ROLES = ("co-head", "cohead", "co head", "spouse", "wife", "husband", "other adult", "adult", "live-in aide", "live in aide", "aide", "partner", "co-tenant", "adult co-tenant")


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), r"\s+", " "))


def race(c: Column) -> Column:
    """One printed label or code as the consumer's category; anything else is null."""
    raw, text = F.trim(c), plain(c)
    case = F.when(raw.isin(*RACES), raw)
    for code, label in CODES.items():
        case = case.when(F.upper(raw) == code, label)
    for words, label in PRINTED:
        case = case.when(text.contains(words), label)
    return case


def races(c: Column) -> Column:
    """Distinct categories of a joined text or of digits run together, in order."""
    raw = F.trim(c)
    items = F.when(raw.rlike("^[1-5]{2,}$"), F.split(raw, "(?<=.)(?=.)")).otherwise(F.split(raw, r"\s*[;,|]\s*|\s*&\s*|\s+and\s+"))
    return F.array_distinct(F.array_compact(F.transform(items, race)))


def race_out(ticks: Column) -> Column:
    """The one category of several ticks: a detail over its group, a named pair, else multi."""
    group = lambda t: F.when(t.isin(*ASIAN_DETAILS), ASIAN).when(t.isin(*NHPI_DETAILS), NHPI).otherwise(t)
    stated = F.filter(ticks, lambda t: t != DECLINED)
    used = F.when((F.size(ticks) > 1) & (F.size(stated) > 0), stated).otherwise(ticks)
    groups = F.array_sort(F.array_distinct(F.transform(used, group)))
    details = F.filter(used, lambda t: ~F.array_contains(groups, t))
    pair = F.when(F.lit(False), "")
    for names, label in PAIRS.items():
        pair = pair.when(groups == F.array(*map(F.lit, sorted(names))), label)
    return (
        F.when(F.coalesce(F.size(ticks), F.lit(0)) <= 0, None).when(F.array_contains(ticks, MULTI), MULTI)
        .when(F.size(groups) == 1, F.when(F.size(details) == 1, F.get(details, F.lit(0))).otherwise(F.get(groups, F.lit(0))))
        .otherwise(F.coalesce(pair, F.lit(MULTI)))
    )


def ethnicity(c: Column) -> Column:
    raw, text = F.trim(c), plain(c)
    declined = text.rlike("decline|choose not|chose not|prefer not|no response|did not respond")
    negated = text.rlike(r"\b(?:not|non)\b.*(?:hispanic|latino)|(?:hispanic|latino).*\bnot\b")
    return F.when(raw == "1", HISPANIC).when(raw == "2", NOT_HISPANIC).when(declined, DECLINED).when(negated, NOT_HISPANIC).when(text.rlike("hispanic|latin[oa]"), HISPANIC)


def relationship(role: Column, born: Column, day: Column) -> Column:
    """A role only adults have, on a member the dates make a minor, is Child."""
    minor = F.datediff(day, born) / 365.25 < 18
    return F.when(minor & F.rtrim(F.lower(F.trim(role)), F.lit(".")).isin(*ADULT_ROLES), "Child").otherwise(role)


def hours(c: Column, rule: Column) -> Column:
    """Hours of a range by rule (highest, lowest, else the mean), or the one number stated."""
    rx = r"(\d+(?:\.\d+)?)\s*[-–—to]+\s*(\d+(?:\.\d+)?)"
    a, b = (F.regexp_extract(c, rx, k).try_cast("double") for k in (1, 2))
    one = F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    between = F.when(rule == "highest", F.greatest(a, b)).when(rule == "lowest", F.least(a, b)).otherwise((a + b) / 2)
    return F.when(c.rlike(rx), between).otherwise(one)
