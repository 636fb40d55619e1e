"""Invariants that a SQL query gives certain rows: set-up rows become views of a session of their own, Spark runs the query."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Case:
    """tables: by name the declared columns (as DDL) and the rows; expected: rows, in any order unless `ordered`."""

    id: str
    query: str
    expected: list[tuple]
    tables: dict[str, tuple[str, list[tuple]]] = field(default_factory=dict)
    ordered: bool = False


def outcome(spark: SparkSession, case: Case) -> tuple[bool, str]:
    """Whether a case's rows are the expected ones, and what is said of it. Only what differs is brought to the driver, a few rows of it;
    an error fails with its class. Other cases' views are not seen, nor does a case leave any behind."""
    own = spark.newSession()
    try:
        for name, held in case.tables.items():
            own.createDataFrame(held[1], held[0]).createOrReplaceTempView(name)
        found = own.sql(case.query)
        wanted = own.createDataFrame(case.expected, found.schema)
        if case.ordered:
            rows = [tuple(r) for r in found.limit(len(case.expected) + 1).collect()]
            good = rows == [tuple(r) for r in wanted.collect()]
            return good, f"{len(rows)} rows" if good else f"gave {rows[:5]!r:.200}"
        more, less = found.exceptAll(wanted).limit(5).collect(), wanted.exceptAll(found).limit(5).collect()
    except Exception as e:  # noqa: BLE001, a query that can't be run fails and says why
        return False, f"raised {type(e).__name__}"
    return not (more or less), f"{len(case.expected)} rows" if not (more or less) else f"more: {[tuple(r) for r in more]!r:.100}; less: {[tuple(r) for r in less]!r:.100}"


def sql_holds(spark: SparkSession, cases: Iterable[Case]) -> DataFrame:
    """id, passed, message of cases, which a person wrote; each is a query of its own."""
    return spark.createDataFrame([(c.id, *outcome(spark, c)) for c in cases], "id string, passed boolean, message string")
