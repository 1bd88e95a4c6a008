"""Joins on a tolerance, as equi-joins on bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tolerance: float, mode: str = "abs", how: str = "inner", condition: Column | None = None, band: tuple[str, str, float] | None = None) -> DataFrame:
    """left join right where |l - r| <= tolerance (mode 'abs') or |l / r - 1| <= tolerance (mode 'ratio').

    The right side goes into three neighbouring bins and the left side into one, so a pair meets at most
    once and semi and anti joins hold. condition: a further predicate over both sides. Column names of the
    two sides must differ. Ratio keys must be positive; keys that are null meet nothing. band: a left and a
    right column that condition holds to within a width of each other; they join the bins, so that a frequent
    key is spread over its band.
    """
    if mode == "ratio":
        width = -math.log1p(-tolerance) * (1 + 1e-9) + 1e-15
        place = lambda c: F.floor(F.when(F.col(c) > 0, F.ln(F.when(F.col(c) > 0, F.col(c)))) / width)
        near = F.abs(F.col(left_key) / F.col(right_key) - 1) <= tolerance
    else:
        width = tolerance * (1 + 1e-9) or 1e-9
        place = lambda c: F.floor(F.col(c) / width)
        near = F.abs(F.col(left_key) - F.col(right_key)) <= tolerance
    bins = left.withColumn("_l_bin", place(left_key))
    copies = right.withColumn("_r_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: place(right_key) + d)))
    on = (F.col("_l_bin") == F.col("_r_bin")) & near
    if band is not None:
        at = lambda c: F.floor(F.col(c) / (band[2] * (1 + 1e-9) or 1e-9))
        bins = bins.withColumn("_l_band", at(band[0]))
        copies = copies.withColumn("_r_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: at(band[1]) + d)))
        on = on & (F.col("_l_band") == F.col("_r_band"))
    return bins.join(copies, on if condition is None else on & condition, how).drop("_l_bin", "_r_bin", "_l_band", "_r_band")
