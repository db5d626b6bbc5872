"""What a registered query is: a build function, its output columns, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load_tables

# Output kinds: s text, i whole number, n whole number or missing, b boolean,
# d date as ISO text, f<k> double rounded to k places.


def rounded(c: Column, places: int) -> Column:
    """Round after a shift far below the last place.

    Without the shift, a value exactly half-way between two roundings may go either way
    in two engines.
    """
    return F.round(c.cast("double") + 1.7 * 10 ** -(places + 3), places) + 0.0


def rounded_sql(c: str, places: int) -> str:
    return f"round(CAST({c} AS DOUBLE) + 1.7e-{places + 3}, {places}) + 0.0"


def _column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "s":
        c = c.cast("string")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "n":
        c = c.cast("double")
    elif kind == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("f"):
        c = rounded(c, int(kind[1:]))
    return c.alias(name)


def _sql(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "s":
        out = f"CAST({c} AS VARCHAR)"
    elif kind == "i":
        out = f"CAST({c} AS BIGINT)"
    elif kind == "n":
        out = f"CAST({c} AS DOUBLE)"
    elif kind == "d":
        out = f"strftime({c}, '%Y-%m-%d')"
    elif kind.startswith("f"):
        out = rounded_sql(c, int(kind[1:]))
    else:
        out = c
    return f"{out} AS {c}"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    out: dict[str, str]
    sql: str | None = None
    ctes: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, load_tables(spark, sf_dir))
        return df.select(*[_column(n, k) for n, k in self.out.items()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql(n, k) for n, k in self.out.items())
        head = f"WITH {self.ctes}\n" if self.ctes else ""
        return f"{head}SELECT {cols} FROM ({self.sql}) AS result"
