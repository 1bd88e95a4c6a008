"""Spectra as arrays: Catalyst expressions over m/z and intensity lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value computed once a row. An expression that a higher-order function's lambda mentions is computed
    anew for every element; bound, it is a variable there."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rounded(x: Column, digits: int) -> Column:
    """x to `digits` decimals, the even one if two are equally near: the scaled double is rounded, not its decimal text."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def scaled_to_max(a: Column) -> Column:
    """Each value over the largest; null where that is 0."""
    return bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.try_divide(x, top)))


def nearest(mz: Column, target: Column) -> Column:
    """Index of the value nearest to target, the first on ties."""
    return F.array_min(F.transform(mz, lambda x, i: F.struct(F.abs(x - target).alias("d"), i.alias("i"))))["i"]


def second_largest(a: Column) -> Column:
    return F.get(F.sort_array(a, False), F.lit(1))


def arg_max(values: Column, of: Column) -> Column:
    """The element of `of` at the largest of values, the first on ties."""
    return F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"), F.get(of, i).alias("x"))))["x"]


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if a norm is 0."""
    dot = total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    norms = F.sqrt(total(F.transform(a, lambda x: (x * x).cast("double")))) * F.sqrt(total(F.transform(b, lambda x: (x * x).cast("double"))))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - F.try_divide(dot, norms))


def entropy(intensity: Column) -> Column:
    """Spectral entropy -sum p ln p of intensities; null for null, 0 for none."""
    part = lambda x, s: F.when((x > 0) & (s > 0), (x / s) * F.ln(x / s)).otherwise(0.0)
    return bound(total(F.transform(intensity, lambda x: x.cast("double"))), lambda s: F.aggregate(intensity, F.lit(0.0), lambda acc, x: acc - part(x, s)))


def entropy_weighted(intensity: Column) -> Column:
    """Intensities p**(0.25 + 0.25 S) for an entropy S under 3, summing to 1."""
    power = lambda x, v: F.when(v["s"] < 3, F.pow(x / v["t"], 0.25 + 0.25 * v["s"])).otherwise(x / v["t"])
    w = bound(F.struct(entropy(intensity).alias("s"), total(intensity).alias("t")), lambda v: F.transform(intensity, lambda x: power(x, v)))
    return bound(w, lambda w: bound(total(w), lambda t: F.transform(w, lambda x: x / t)))


def cleaned(mz: Column, intensity: Column, ppm: float, noise: float) -> Column:
    """array of (mz, i): peaks above zero and at least `noise` of the largest, those closer than ppm merged: from the most intense
    down a peak joins the first merged one it is near to, which moves to the weighted mean. Sorted by m/z, summing to 1."""
    pairs = F.filter(F.arrays_zip(mz.alias("mz"), intensity.alias("i")), lambda p: (p["mz"] > 0) & (p["i"] > 0))
    falling = F.reverse(F.array_sort(F.transform(pairs, lambda p: F.struct(p["i"].cast("double").alias("i"), (-p["mz"]).cast("double").alias("low")))))
    kind = "array<struct<at:double,moment:double,i:double>>"

    def near(c: Column, p: Column) -> Column:
        return F.abs(c["at"] + p["low"]) <= c["at"] * F.lit(ppm * 1e-6)

    def join(state: Column, p: Column) -> Column:
        hit = F.array_min(F.transform(state, lambda c, k: F.when(near(c, p), k)))
        grown = F.transform(state, lambda c, k: F.when(k == hit, F.struct(c["at"].alias("at"), (c["moment"] - p["low"] * p["i"]).alias("moment"), (c["i"] + p["i"]).alias("i"))).otherwise(c))
        fresh = F.concat(state, F.array(F.struct((-p["low"]).alias("at"), (-p["low"] * p["i"]).alias("moment"), p["i"].alias("i"))))
        return F.when(hit.isNull(), fresh).otherwise(grown).cast(kind)

    merged = F.aggregate(falling, F.array().cast(kind), join)
    least = lambda rows: F.array_max(F.transform(rows, lambda r: r["i"])) * F.lit(noise)
    rows = bound(merged, lambda rows: bound(least(rows), lambda low: F.filter(rows, lambda r: r["i"] >= low)))
    part = lambda rows: bound(total(F.transform(rows, lambda r: r["i"])), lambda t: F.array_sort(F.transform(rows, lambda r: F.struct((r["moment"] / r["i"]).alias("mz"), (r["i"] / t).alias("i")))))
    return F.when(mz.isNotNull() & intensity.isNotNull(), bound(rows, part))


def entropy_similarity(mz_a: Column, int_a: Column, mz_b: Column, int_b: Column, tolerance: float, ppm: bool = False) -> Column:
    """1 - (2 S_AB - S_A - S_B) / ln 4 of weighted spectra; peaks of b merge with those of a within tolerance, in ppm of a's m/z if ppm.

    -1 where a spectrum is null or empty. Peaks of one spectrum are taken to be further apart than the tolerance.
    """
    peaks = lambda mz, i: F.arrays_zip(mz.alias("mz"), entropy_weighted(i).alias("p"))
    score = bound(peaks(mz_a, int_a), lambda a: bound(peaks(mz_b, int_b), lambda b: _similarity(a, b, tolerance * 1e-6 if ppm else tolerance, ppm)))
    return F.when((F.size(int_a) > 0) & (F.size(int_b) > 0), score).otherwise(F.lit(-1.0))


def _similarity(a: Column, b: Column, tolerance: float, relative: bool) -> Column:
    near = lambda x, y: F.abs(y["mz"] - x["mz"]) <= (x["mz"] * tolerance if relative else F.lit(tolerance))
    h = lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    matched = lambda x, other: total(F.transform(F.filter(other, lambda y: near(x, y)), lambda y: y["p"]))
    s_a, s_b = (F.aggregate(v, F.lit(0.0), lambda s, x: s + h(x["p"])) for v in (a, b))
    with_a = F.aggregate(a, F.lit(0.0), lambda s, x: s + bound((x["p"] + matched(x, b)) / 2, h))
    only_b = F.aggregate(F.filter(b, lambda y: ~F.exists(a, lambda x: near(x, y))), F.lit(0.0), lambda s, y: s + h(y["p"] / 2))
    return 1 - (2 * (with_a + only_b) - s_a - s_b) / F.lit(1.3862943611198906)
