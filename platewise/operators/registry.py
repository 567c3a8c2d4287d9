"""Rule families by name, and one findings table of all that are selected."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the common findings table; a family without a page leaves it 0, for the document.
COLUMNS = {"job_id": "long", "page_num": "int", "inspection_id": "string", "severity": "string"}


@dataclass
class Families:
    """Rule families: a name, a category, the tables that it reads and a function of these to findings."""

    known: dict[str, tuple[str, tuple[str, ...], Callable[..., DataFrame]]] = field(default_factory=dict)
    #: Families whose findings come out dealt by job.
    by_job: set[str] = field(default_factory=set)

    def register(self, name: str, category: str, *tables: str, by_job: bool = False):
        """Decorator that adds a family; a name can be taken once. ``by_job``: its last shuffle deals its rows by job alone."""

        def keep(f: Callable[..., DataFrame]):
            if name in self.known:
                raise ValueError(f"family {name} is registered twice")
            self.known[name] = (category, tables, f)
            self.by_job |= {name} if by_job else set()
            return f

        return keep

    def _each(self, table: Callable[[str], DataFrame], categories: tuple[str, ...] | None, names: tuple[str, ...] | None) -> Iterator[tuple[str, DataFrame]]:
        """Each selected family's name and findings; selection comes before the plan."""
        for name, (category, tables, f) in self.known.items():
            if (categories and category not in categories) or (names and name not in names):
                continue
            out = f(*map(table, tables))
            out = out if "page_num" in out.columns else out.withColumn("page_num", F.lit(0))
            yield name, out.select(F.lit(name).alias("family"), *[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()])

    def findings(self, table: Callable[[str], DataFrame], categories: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
        """(family, job_id, page_num, inspection_id, severity) of all selected families."""
        return _union([out for _, out in self._each(table, categories, names)])

    def counts(self, table: Callable[[str], DataFrame], categories: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None) -> DataFrame:
        """(family, inspection_id, severity, n, jobs): the findings of all selected families and the distinct jobs that have them.

        No job is sent for each check. Where a family's rows are dealt by job they are counted where they are; of others 64 jobs of
        successive numbers are one row, a bit each, before they are shuffled.
        """
        check, n = ["family", "inspection_id", "severity"], F.count("*").alias("n")
        each = list(self._each(table, categories, names))
        counted = [out.groupBy(*check, "job_id").agg(n).select(*check, "n", F.col("job_id").isNotNull().cast("int").alias("jobs")) for name, out in each if name in self.by_job]
        if spread := [out for name, out in each if name not in self.by_job]:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("job_id").bitwiseAND(F.lit(63)).cast("int"))
            words = _union(spread).groupBy(*check, F.shiftright("job_id", 6).alias("word")).agg(n, F.bit_or(bit).alias("bits"))
            counted.append(words.select(*check, "n", F.coalesce(F.bit_count("bits"), F.lit(0)).alias("jobs")))
        return _union(counted).groupBy(*check).agg(F.sum("n").alias("n"), F.sum("jobs").alias("jobs"))


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no family is selected")
    return reduce(DataFrame.unionByName, parts)
