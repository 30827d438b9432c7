"""Query catalog: each entry pairs a DataFrame plan with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodgemetrics.functions.exprs import rounded
from lodgemetrics.operators import prepare, revpar, star
from lodgemetrics.plans.bridge_sql import CTES
from lodgemetrics.sources.bridge import bookings_from_star, raw_bookings_from_star

Plan = Callable[["Inputs"], DataFrame]


@dataclass(frozen=True)
class Inputs:
    """Lazy inputs of one query run; each method only joins the tables it needs."""

    spark: SparkSession
    sf_dir: str

    def bookings(self, part: bool = False, nation: bool = False) -> DataFrame:
        return bookings_from_star(self.spark, self.sf_dir, part=part, nation=nation)

    def raw(self) -> DataFrame:
        return raw_bookings_from_star(self.spark, self.sf_dir)

    def monthly(self, variant: str = "warehouse") -> DataFrame:
        return star.build_fact_monthly(self.bookings(), variant)

    def daily(self, variant: str = "warehouse") -> DataFrame:
        return star.build_fact_daily(self.bookings(), variant)

    def panel(self) -> DataFrame:
        return revpar.measure_panel(self.monthly())

    def stays(self, part: bool = False) -> DataFrame:
        return prepare.filter_stays(self.bookings(part=part))


@dataclass
class Catalog:
    plans: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, plan: Plan, sql: str | None = None, r6: str = "", r4: str = "") -> None:
        """Register a plan; r6 / r4 list the double columns rounded to 6 / 4 digits."""
        if name in self.plans:
            raise ValueError(f"duplicate query name: {name}")
        digits = {**{c: 6 for c in r6.split()}, **{c: 4 for c in r4.split()}}

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(plan(Inputs(spark, sf_dir)), **digits)

        self.plans[name] = run
        if sql is not None:
            self.oracles[name] = oracle(sql, digits)


def oracle(body: str, digits: dict[str, int]) -> str:
    """Prepend the CTEs ``body`` mentions and round its double columns."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, sql in CTES.items():
            if name not in used and f" {name} " in f" {text} ".replace("\n", " ").replace(")", " ").replace("(", " ").replace(",", " "):
                need(sql)
                if name not in used:
                    used.append(name)

    need(body)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in used)
    fixes = ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-{d + 3}, {d}) + 0.0 AS {c}" for c, d in digits.items())
    replace = f" REPLACE ({fixes})" if fixes else ""
    inner = f"SELECT *{replace} FROM ({body}) AS answer"
    return f"WITH {head}\n{inner}" if head else inner
