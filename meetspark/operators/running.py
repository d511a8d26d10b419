"""Running values of jobs of any length: windows over slices of a job, with what earlier slices carry over.

A plain window over a job sorts the whole job in one task. Here rows are dealt out by job and slice; each slice is summed up in
one row, the slices' rows give each slice what it inherits, and a window over the slice does the rest. Only the slices' rows of a
job, one for each stretch of time, ever come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SEC = 600.0


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], at: str = "start", width: float = SLICE_SEC, key: str = "job_id") -> DataFrame:
    """``df`` with a column for each of ``values``: name to kind and expression, over the rows of a job in ``order``.

    Kinds: ``max_before`` (largest in the rows before, null for none), ``sum`` (with the row itself), ``last_before`` (of the row
    before), ``last_known`` (latest that is not null, with the row itself), ``next`` (of the row after). ``order`` must begin
    with ``at``, which is never null and is cut into slices of ``width``.
    """
    cut = df.withColumn("__slice", F.floor(F.col(at) / width)).repartition(key, "__slice")  # one exchange for both uses
    place = F.struct(*order)
    totals = {
        "max_before": lambda x: F.max(x),
        "sum": lambda x: F.sum(x),
        "last_before": lambda x: F.max_by(F.struct(x.alias("x")), place),
        "last_known": lambda x: F.max_by(F.struct(x.alias("x")), F.when(x.isNotNull(), place)),
        "next": lambda x: F.min_by(F.struct(x.alias("x")), place),
    }
    slices = cut.groupBy(key, "__slice").agg(*(totals[kind](x).alias(f"__{name}") for name, (kind, x) in values.items()))
    along = Window.partitionBy(key).orderBy("__slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        "max_before": lambda c: F.max(c).over(before),
        "sum": lambda c: F.sum(c).over(before),
        "last_before": lambda c: F.lag(c).over(along),
        "last_known": lambda c: F.last(c, ignorenulls=True).over(before),
        "next": lambda c: F.lead(c).over(along),
    }
    carry = slices.select(key, "__slice", *(carried[kind](F.col(f"__{name}")).alias(f"__{name}") for name, (kind, _) in values.items()))
    within = Window.partitionBy(key, "__slice").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def whole(kind: str, x: Column, c: Column) -> Column:
        if kind == "max_before":
            return F.greatest(F.max(x).over(earlier), c)
        if kind == "sum":
            return F.coalesce(F.sum(x).over(so_far), F.lit(0)) + F.coalesce(c, F.lit(0))
        if kind == "last_before":
            return F.coalesce(F.lag(F.struct(x.alias("x"))).over(within), c)["x"]
        if kind == "last_known":
            return F.coalesce(F.last(x, ignorenulls=True).over(so_far), c["x"])
        return F.coalesce(F.lead(F.struct(x.alias("x"))).over(within), c)["x"]

    met = cut.join(carry, [key, "__slice"], "left")
    return met.select(*df.columns, *(whole(kind, x, F.col(f"__{name}")).alias(name) for name, (kind, x) in values.items()))
