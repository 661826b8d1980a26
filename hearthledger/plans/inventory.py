"""Document inventory over forms written from orders; the oracle knows what each form was filled with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthledger.functions import inventory as V
from hearthledger.plans.registry import Tables, query


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' ELSE 'N/A' END AS signed, CASE o_orderkey % 4 WHEN 0 THEN 'Ana Quill' WHEN 2 THEN 'Leo Moss' END AS signer,
  CASE WHEN o_orderkey % 4 IN (0, 2) THEN strftime(o_orderdate, '%Y-%m-%d') END AS signed_on, CASE WHEN o_orderkey % 4 = 1 THEN 'blank' END AS slot,
  CASE o_orderkey % 4 WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS effective, CASE o_orderkey % 4 WHEN 3 THEN 'Hill Court LLC' WHEN 2 THEN 'Moss Foods' END AS organisation
FROM orders
""")
def document_inventory(t: Tables) -> DataFrame:
    """Signature, signer, dates and origin read from the text of forms."""
    day = F.date_format("o_orderdate", "M/d/yyyy")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Signature of Household Head: Ana Quill   Date: "), day)).when(k == 1, F.lit("Tenant signature: ______  Date: ________"))
        .when(k == 2, F.concat(F.lit("Employer: MOSS FOODS\nSigned by: Leo Moss Date: "), day)).otherwise(F.concat(F.lit("Project Name: <b>HILL COURT LLC</b>\nEffective Date: "), day))
    )
    d = lambda c: F.date_format(c, "yyyy-MM-dd")
    x = F.col("x")
    read = t.orders.select("o_orderkey", text.alias("x"))
    signed_on = V.signature_date(x, 2026)
    return read.select(
        "o_orderkey", V.signature(x).alias("signed"), V.signer(x).alias("signer"), d(F.when(x.rlike("(?i)sign"), signed_on)).alias("signed_on"), F.when(signed_on.isNull() & x.rlike("(?i)sign"), V.date_slot(x)).alias("slot"),
        d(F.when(~x.rlike("(?i)sign"), V.document_date(x, 2026))).alias("effective"), V.organisation(x).alias("organisation"),
    )
