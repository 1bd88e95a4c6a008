"""Formula arrays (array<int> of 15 counts) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionloom.functions.arrays import bound
from ionloom.functions.elements import ELEMENTS, INDEX, MASSES, VALENCE, WRITTEN


def literal(counts: dict[str, int]) -> Column:
    """A formula array from counts per symbol."""
    return F.array(*[F.lit(int(counts.get(e, 0))) for e in ELEMENTS])


#: A symbol and its number; a symbol without one counts if a capital letter or the end follows.
TOKEN = r"([A-Z][a-z]?)(\d+|(?=[A-Z])|\z)"


def parse(formula: Column) -> Column:
    """A plain formula string as an array. The first stay of a symbol counts; null gives zeros. The text is read once for the
    symbols and once for their numbers."""
    read = lambda g: F.coalesce(F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(g)), F.array().cast("array<string>"))

    def counts(t: Column) -> Column:
        def count(e: Column) -> Column:
            at = F.array_position(t["symbols"], e).cast("int")
            found = F.get(t["numbers"], at - 1)
            return F.when(at == 0, 0).when(found == "", 1).otherwise(F.coalesce(found.try_cast("int"), F.lit(0)))

        return F.transform(F.split(F.lit(",".join(ELEMENTS)), ","), count)

    return bound(F.struct(read(1).alias("symbols"), read(2).alias("numbers")), counts)


def add(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(sign))


def parse_signed(formula: Column, compat: bool = False) -> Column:
    """A formula with one added and one removed group, as in C6H12O6+2H-H2O, as an array.

    A number directly after the sign multiplies its group; with compat the first digits anywhere in it do.
    """
    def joined(total: Column, sign: str, s: int) -> Column:
        group = F.regexp_extract(formula, rf"\{sign}([A-Za-z0-9]+)", 1)
        times = F.coalesce(F.regexp_extract(group, r"(\d+)" if compat else r"^(\d+)", 1).try_cast("int"), F.lit(1))
        told = F.struct(times.alias("n"), parse(F.regexp_replace(group, r"^\d+", "")).alias("c"))
        added = lambda total: bound(told, lambda g: F.zip_with(total, g["c"], lambda x, y: (x + y * g["n"] * F.lit(s)).cast("int")))
        return bound(total, lambda total: F.when((group == "") | group.isNull(), total).otherwise(added(total)))

    return joined(joined(parse(F.regexp_extract(formula, r"^([A-Za-z0-9]+)", 1)), "+", 1), "-", -1)


def ion_formula(formula: Column, adduct: Column) -> Column:
    """Array of the ion that an adduct such as [M+H]+ makes of a formula: every M is the formula."""
    inner = F.regexp_extract(adduct, r"\[(.*)\]", 1)
    return parse_signed(F.replace(inner, F.lit("M"), formula))


def mass(f: Column) -> Column:
    """Monoisotopic mass, summed in element order."""
    total = F.lit(0.0)
    for i, m in enumerate(MASSES):
        total = total + F.get(f, F.lit(i)) * F.lit(m)
    return total


def unsaturation2(f: Column) -> Column:
    """Twice the degree of unsaturation, a whole number."""
    total = F.lit(2)
    for e, v in VALENCE.items():
        total = total + F.get(f, F.lit(INDEX[e])) * F.lit(v)
    return total


def unsaturation_fits(f: Column, low: float, high: float) -> Column:
    u = unsaturation2(f)
    return (u % 2 == 0) & (u >= 2 * low) & (u <= 2 * high)


def write(f: Column) -> Column:
    """The formula as text: symbols in writing order, 1 omitted, counts of 0 or less skipped."""
    def part(e: str) -> Column:
        n = F.get(f, F.lit(INDEX[e]))
        return F.when(n == 1, F.lit(e)).when(n > 1, F.concat(F.lit(e), n.cast("string")))

    return F.concat_ws("", *[part(e) for e in WRITTEN])


def is_valid(f: Column) -> Column:
    return F.coalesce((F.size(f) == len(ELEMENTS)) & F.forall(f, lambda x: x.isNotNull() & (x >= 0)), F.lit(False))


def fits_mass(f: Column, observed: Column, rel_tol: float = 3e-6) -> Column:
    """Whether a formula's mass is the observed one; null, empty or negative formulas don't fit."""
    m = mass(f)
    return F.coalesce(is_valid(f) & (m > 0) & (F.abs(m - observed) <= rel_tol * F.greatest(F.abs(m), F.abs(observed))), F.lit(False))


def is_subformula(part: Column, whole: Column) -> Column:
    """part is contained in whole and differs from it."""
    return F.forall(F.zip_with(part, whole, lambda p, w: p <= w), lambda x: x) & (part != whole)
