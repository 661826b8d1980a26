"""Cross-record validation: queries that give finding rows, their keys and their deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthledger.functions.normalise import slug

#: Dispute strength by code: weak ones give reason to look, the others point to a misread. Fixed values.
WEAK_DISPUTES = ("INCOME_METHODS_DISAGREE", "INCOME_METHOD_OUTLIER", "TIC_TOTAL_MINOR_DIFF", "NEAR_DUPLICATE_INCOME", "DUPLICATE_EMPLOYER", "DUPLICATE_INCOME_RECORD", "ASSET_SELF_DECLARED_VS_VERIFIED", "CERT_AMOUNT_UNACCOUNTED")
STRONG, WEAK = 0.15, 0.50


def finding_key(code: Column, subject: Column) -> Column:
    """code and the slugs of the subject's values in the order of their keys; ``code:case`` without any."""
    values = F.transform(F.array_sort(F.map_keys(subject)), lambda k: slug(F.try_element_at(subject, k)))
    parts = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda p: p != "")
    return F.concat_ws(":", code, F.when(F.size(parts) > 0, F.array_join(parts, ":")).otherwise("case"))


def finding(rows: DataFrame, code: str, subject: dict[str, Column], text: Column, category: str = "file_review", result: str = "non_compliant") -> DataFrame:
    ref = F.create_map(*(x for k, v in subject.items() for x in (F.lit(k), v.cast("string"))))
    return rows.select(F.lit(code).alias("code"), text.alias("text"), F.lit(category).alias("category"), F.lit(result).alias("result"), ref.alias("subject_ref")).withColumn("finding_key", finding_key(F.col("code"), F.col("subject_ref")))


def gathered(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def first_seen(findings: DataFrame, identity: str, order: list[str]) -> DataFrame:
    """The first finding of each identity; an explicit order, not an arbitrary survivor."""
    row = F.struct(*findings.columns)
    return findings.groupBy(identity).agg(F.min_by(row, F.struct(*order)).alias("_first")).select("_first.*")  # partial; no window over a hot key


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows that nothing present satisfies."""
    return required.join(present, keys, "left_anti")


def total_band(declared: Column, computed: Column) -> Column:
    """How far a computed total is from the declared one: none, minor, or mismatch."""
    off, share = F.abs(computed - declared), F.abs(computed - declared) / declared
    return F.when(declared <= 0, None).when((share > 0.15) & (off > 100), "TIC_TOTAL_MISMATCH").when((share > 0.05) & (off > 100), "TIC_TOTAL_MINOR_DIFF").otherwise("OK")


def signature_finding(signed: Column, effective: Column) -> Column:
    """Signed long after the effective day, or implausibly early."""
    lag = F.datediff(signed, effective)
    return F.when(lag < -365, "CERT_SIGNATURE_DATE_IMPLAUSIBLE").when(lag > 14, "CERT_SIGNED_AFTER_EFFECTIVE_DATE")


def dispute_strength(code: Column) -> Column:
    return F.when(code.isin(*WEAK_DISPUTES), WEAK).otherwise(STRONG)
