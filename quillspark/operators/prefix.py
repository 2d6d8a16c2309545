"""Running counts and sums that a hot group doesn't force into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """``df`` with, for each name of ``values``, the sum of its expression over the rows of the same keys that come before in
    ``order``, a whole number without nulls (of equal ones, the sums include neither).

    Rows fall into stretches of ``width`` numbers. Stretches are summed up (a row each), then rows within theirs, so
    that no task sees more than a stretch of a group."""
    stretch, part = "_stretch", [*keys, "_stretch"]
    rows = df.withColumn(stretch, F.floor(F.col(order) / width))
    sums = rows.groupBy(*part).agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in values.items()))
    before = Window.partitionBy(*keys).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(part)), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in values))
    same = F.lit(True)
    for i, k in enumerate(part):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = Window.partitionBy(*part).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_own_{n}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for n, v in values.items()}).join(sums, same)
    return out.select(*df.columns, *((F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in values))
