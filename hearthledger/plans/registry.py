"""Queries over the driver's tables and their DuckDB twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthledger.sources.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of one scale factor by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def expanded(sql: str) -> str:
    """``cents(x)`` and ``frac4(x)`` of the oracle texts written out: half-up rounding on the binary value."""
    for name, scale in (("cents", 100), ("frac4", 10_000)):
        while (at := sql.find(f"{name}(")) >= 0:
            depth, end = 1, at + len(name) + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = f"{sql[:at]}(floor(({sql[at + len(name) + 1 : end - 1]}) * {scale} + 0.5) / {scale}){sql[end:]}"
    return sql


def query(oracle: str | None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of the tables under its name, with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if oracle is not None:
            ORACLE[build.__name__] = expanded(oracle)
        return run

    return register


from hearthledger.plans import classify, income, inventory, linkage, manifest, normalise, packets, pages, people, reconciling, review, rules, scenarios, scoring, state  # noqa: E402, F401
from hearthledger.plans import case_rules  # noqa: E402, F401, I001  (reads the oracles of the others)
