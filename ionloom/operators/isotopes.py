"""Element bounds and checks from isotope peaks: arithmetic over nearest-peak lookups."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions import arrays
from ionloom.functions.elements import DEFAULT_MAX, DEFAULT_MIN, ELEMENTS, INDEX, ISOTOPES, LEAST_TOLERANCE_MASS

#: Elements whose counts are deduced.
DEDUCED = ("C", "S", "Cl", "Br")


#: Fixed value: the resolution above which the heavy isotopes of C and N are two peaks.
NITROGEN_RESOLUTION = 1e5


@dataclass(frozen=True)
class BoundsConfig:
    """Tolerances of deduce_bounds."""

    ms1_mass_tolerance_ppm: float = 5.0
    isotopic_mass_tolerance_ppm: float = 3.0
    minimum_intensity: float = 5e4
    intensity_absolute_tolerance: float = 5e4
    intensity_relative_tolerance: float = 0.05


@dataclass(frozen=True)
class PatternConfig:
    """Tolerances of fits_pattern; mass_tolerance is a share."""

    mass_tolerance: float
    ms1_resolution: float
    minimum_intensity: float = 5e5
    max_intensity_ratio: float = 1.7

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> PatternConfig:
        """The tolerance and the resolution are needed; other values that are None keep their default; an unknown key is an error."""
        if unknown := values.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        for needed in ("mass_tolerance", "ms1_resolution"):
            if values.get(needed) is None:
                raise ValueError(f"{needed} is required")
        return cls(**{k: v for k, v in values.items() if v is not None})


def _strongest(mz: Column, intensity: Column, target: Column, tol: Column) -> Column:
    """struct(intensity, mz) of the most intense peak within tol of target; null if there is none."""
    near = F.filter(F.arrays_zip(intensity.alias("i"), mz.alias("m")), lambda x: F.abs(x["m"] - target) <= tol)
    return F.array_max(near)


def deduce_bounds(mz: Column, ms1_mz: Column, ms1_intensity: Column, low: tuple[int, ...] = DEFAULT_MIN, high: tuple[int, ...] = DEFAULT_MAX, config: BoundsConfig = BoundsConfig()) -> Column:
    """struct<min: array<int>, max: array<int>>: bounds with those of C, S, Cl and Br deduced from their isotope peaks.

    A precursor that is not in the MS1 spectrum gives -1 for those four, which excludes them from a search.
    A Cl count of two or more must also show in the M+4 peak, where that is expected to be visible.
    """
    scale = F.greatest(mz, F.lit(LEAST_TOLERANCE_MASS)) * 1e-6
    tol = scale * config.isotopic_mass_tolerance_ppm

    def heavies(peak: Column) -> Column:
        """The isotope peaks' intensities, a field for each element and Cl4 for two heavy Cl."""
        at = {**{e: ISOTOPES[e][0] for e in DEDUCED}, "Cl4": 2 * ISOTOPES["Cl"][0]}
        return F.struct(*[F.coalesce(_strongest(ms1_mz, ms1_intensity, peak["m"] + d, tol)["i"], F.lit(0.0)).alias(e) for e, d in at.items()])

    peak = _strongest(ms1_mz, ms1_intensity, mz, scale * config.ms1_mass_tolerance_ppm)
    return arrays.bound(peak, lambda p: arrays.bound(heavies(p), lambda h: _bounds(p, h, low, high, config)))


def _bounds(peak: Column, heavies: Column, low: tuple[int, ...], high: tuple[int, ...], c: BoundsConfig) -> Column:
    bounds: dict[str, tuple[Column, Column]] = {}
    for e in DEDUCED:
        _, p0, p1 = ISOTOPES[e]
        heavy = heavies[e]
        unit = F.lit(p0) / (F.lit(p1) * peak["i"])
        seen = heavy >= c.minimum_intensity
        lower = F.ceil(F.when(seen, (heavy * (1 - c.intensity_relative_tolerance) - c.intensity_absolute_tolerance) * unit).otherwise(0.0))
        upper = F.floor(F.when(seen, (heavy * (1 + c.intensity_relative_tolerance) + c.intensity_absolute_tolerance) * unit).otherwise(c.minimum_intensity * unit))
        if e == "Cl":
            expected = F.lit(p1 / (2 * p0)) * heavy
            off = (lower > 0) & (upper >= 2) & (expected >= c.minimum_intensity) & (F.abs(heavies["Cl4"] / F.greatest(heavy, F.lit(1e-300)) / (p1 / (2 * p0)) - 1) > c.intensity_relative_tolerance)
            lower, upper = F.when(off, 0).otherwise(lower), F.when(off, 1).otherwise(upper)
        lost = peak.isNull()
        bounds[e] = (F.when(lost, -1).otherwise(F.greatest(lower, F.lit(0))).cast("int"), F.when(lost, -1).otherwise(upper).cast("int"))
    low_ = F.array(*[bounds[e][0] if e in bounds else F.lit(low[i]) for i, e in enumerate(ELEMENTS)])
    high_ = F.array(*[bounds[e][1] if e in bounds else F.lit(high[i]) for i, e in enumerate(ELEMENTS)])
    return F.struct(low_.alias("min"), high_.alias("max"))


def fits_pattern(formula: Column, mz: Column, ms1_mz: Column, ms1_intensity: Column, config: PatternConfig) -> Column:
    """Whether each element's isotope peak has the intensity that its count lets expect, within a factor of max_intensity_ratio.

    n atoms let expect n p1 / p0**n of the peak nearest to the precursor. Counts of 0 and expectations below
    the minimum intensity fit; the peak nearest to the isotope's m/z must be within the mass tolerance. Where the
    resolution can't part the peaks of C and N, a formula with both is held to their sum, at the m/z of C.
    """
    c = config
    nearest = lambda t: F.get(F.arrays_zip(ms1_mz.alias("m"), ms1_intensity.alias("i")), arrays.nearest(ms1_mz, t))
    base = nearest(mz)["i"]
    count = lambda e: F.get(formula, F.lit(INDEX[e]))

    def fits(*elements: str) -> Column:
        light, heavy = F.lit(1.0), F.lit(0.0)
        for e in elements:
            _, p0, p1 = ISOTOPES[e]
            light, heavy = light * F.pow(F.lit(p0), count(e)), heavy + count(e) * F.lit(p1)
        expected = base * heavy / light
        target = mz + ISOTOPES[elements[0]][0]
        return arrays.bound(F.struct(expected.alias("e"), target.alias("t")), lambda x: (x["e"] < c.minimum_intensity) | arrays.bound(nearest(x["t"]), lambda p: (F.abs(p["m"] - x["t"]) <= F.abs(x["t"]) * c.mass_tolerance + 1e-8) & p["i"].between(x["e"] / c.max_intensity_ratio, x["e"] * c.max_intensity_ratio)))

    if c.ms1_resolution > NITROGEN_RESOLUTION:
        carbon = [fits("C"), fits("N")]
    else:
        carbon = [F.when(count("N") == 0, fits("C")).when(count("C") == 0, fits("N")).otherwise(fits("C", "N"))]
    out = F.lit(True)
    for fit in (*carbon, fits("S"), fits("Cl"), fits("Br")):
        out = out & fit
    return F.coalesce(out, F.lit(False))


def bounds_around(formula: Column) -> Column:
    """struct<min, max> of bounds that hold a known formula: C within one, Cl and Br exactly, B, N and S only and surely
    if it has them, the others from none to a fixed count."""
    n = lambda e: F.get(formula, F.lit(INDEX[e]))
    # fixed values: upper bounds
    top = {"H": 100, "C": 60, "N": 30, "O": 30, "F": 30, "Si": 1, "P": 2, "S": 5, "I": 3}
    some = lambda e, x: F.when(n(e) > 0, x).otherwise(0)
    low = {"C": F.greatest(n("C") - 1, F.lit(0)), "Cl": n("Cl"), "Br": n("Br"), **{e: some(e, F.lit(1)) for e in ("B", "N", "S")}}
    high = {"C": n("C") + 1, "Cl": n("Cl"), "Br": n("Br"), "B": n("B"), **{e: some(e, F.lit(top[e])) for e in ("N", "S")}}
    side = lambda by, rest: F.array(*[by.get(e, F.lit(rest.get(e, 0))).cast("int") for e in ELEMENTS])
    return F.struct(side(low, {}).alias("min"), side(high, top).alias("max"))
