"""Operators whose result depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.tables import settled


def fill_down(rows: DataFrame, part: list[str], order: list[str], *columns: str) -> DataFrame:
    """Blank cells take what stands last above them."""
    above = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(above) for c in columns})


def first_values(rows: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Repeats of a group's first value go; a group that holds another is flagged."""
    group = Window.partitionBy(*part)
    first = F.first(value).over(group.orderBy(*order))
    held = rows.withColumns({"_first": first, "_place": F.row_number().over(group.orderBy(*order))})
    held = held.withColumn("conflict", F.max((F.col(value) != F.col("_first")).cast("int")).over(group) == 1)
    return held.where((F.col("_place") == 1) | (F.col(value) != F.col("_first"))).drop("_first", "_place")


#: Stretches that a part's rows are cut into where a few parts may hold most rows.
STRETCHES = 64


def in_stretches(rows: DataFrame, part: list[str], lead: Column) -> DataFrame:
    """rows with `_stretch`: 0 for the part's smallest values of a number, and so on, of about equal size, by approximate quantiles. Equal values are in one stretch. The quantiles depend on the order in which rows arrive, so they are estimated once for all who use the stretches."""
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    held = rows.withColumn("_lead", lead.cast("double"))
    edges = settled(held.groupBy(*part).agg(F.percentile_approx("_lead", shares, 10_000).alias("_edges")))
    return held.join(edges, part).withColumn("_stretch", F.size(F.filter("_edges", lambda e: e < F.col("_lead")))).drop("_lead", "_edges")


def numbered(rows: DataFrame, part: list[str], order: str, name: str = "place") -> DataFrame:
    """rows with their place in their part by an ascending number, from 1. No task sorts a part: stretches of it are numbered apart and moved on by the sizes of those before."""
    cut = in_stretches(rows, part, F.col(order))
    sizes = cut.groupBy(*part, "_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy(*part, "_stretch").orderBy(order))
    return cut.join(sizes.withColumn("_before", before).drop("_n"), [*part, "_stretch"]).withColumn(name, F.col("_before") + here).drop("_stretch", "_before")


def within_budget(rows: DataFrame, part: list[str], order: list[Column], size: str, budget: int, lead: Column | None = None) -> DataFrame:
    """Rows in order while those before take less than the budget; the first always. lead: a number that the order begins with, ascending; then stretches that lie wholly past the budget are left out before anything is sorted."""
    if lead is not None:
        cut = in_stretches(rows, part, lead)
        sizes = cut.groupBy(*part, "_stretch").agg(F.sum(size).alias("_n"))
        taken = F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = cut.join(sizes.withColumn("_taken", taken).where(F.col("_taken") < budget).select(*part, "_stretch"), [*part, "_stretch"], "left_semi").drop("_stretch")
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("_before") < budget).drop("_before")


def top(rows: DataFrame, part: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= k)
