"""Columns that spectral libraries and compound lists gain after reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import arrays


# The patterns of adducts, and the instruments whose energies are related apart.
FRAGMENT = r"-\d*((H(\d+|[A-Z]|[a-z]))|([A-G]|[I-Z])[a-z]?\d*)(([A-Z][a-z]?\d*))*"
FLAGS = {"Isotope": "i", "Cation": "Cat", "Multimer": "[0-9]M", "MultiCharge": r"\][0-9]", "Fragment": FRAGMENT}
INSTRUMENTS = ("Elite", "Velos", "Fusion")


def precursor_type_flags(kind: Column) -> dict[str, Column]:
    """What an adduct says of its ion; clean_precursor: none of it, and the adduct names the molecule. Null for null."""
    flags = {name: F.regexp_like(kind, F.lit(pattern)) for name, pattern in FLAGS.items()}
    unclean = ~kind.contains("M")
    for flag in flags.values():
        unclean = unclean | flag
    return {**flags, "clean_precursor": ~unclean}


def molecular_ion_intensity(annotations: Column, intensity: Column) -> Column:
    """Intensity of the last peak if it is 'Mol'; -2 if 'Mol' stands elsewhere, -1 if nowhere."""
    return F.when(F.try_element_at(annotations, F.lit(-1)) == "Mol", F.try_element_at(intensity, F.lit(-1))).when(F.array_contains(annotations, "Mol"), F.lit(-2.0)).otherwise(F.lit(-1.0))


def base_peak(mz: Column, intensity: Column, precursor: Column) -> dict[str, Column]:
    """The most intense peak's m/z, its ratio to the precursor's and the difference, 3 decimals."""
    base = arrays.arg_max(intensity, mz)
    return {"base_peak_mz": base, "base_peak_div_precursor_mz": arrays.rounded(base / precursor, 3), "precursor_minus_base_peak_mz": arrays.rounded(precursor - base, 3)}


def energy_relation(df: DataFrame, x: Column, y: str, *keys: str) -> DataFrame:
    """slope, intercept and r of y over x per group."""
    d = df.withColumn("_x", x)
    return d.groupBy(*keys).agg(F.regr_slope(y, "_x").alias("slope"), F.regr_intercept(y, "_x").alias("intercept"), F.corr("_x", y).alias("r"))


def estimated_energy(df: DataFrame, nce: str, mz: str, ev: str, instrument: str) -> DataFrame:
    """df with estimated_ev from its instrument's line of eV over NCE * m/z; the lines are one row per instrument."""
    x = F.col(nce) * F.col(mz)
    known = df.filter(F.col(ev).isNotNull() & F.col(nce).isNotNull())
    lines = energy_relation(known, x, ev, instrument).select(instrument, "slope", "intercept")
    return df.join(lines, instrument, "left").withColumn("estimated_ev", x * F.col("slope") + F.col("intercept")).drop("slope", "intercept")


def add_estimated_ev(library: DataFrame) -> DataFrame:
    """library with Collision_energy_ev_estimated: for HCD spectra of the INSTRUMENTS, from the line of eV over NCE * m/z that the
    instrument's spectra with both energies make; null for others. Needs the columns of a parsed library."""
    kind = F.when(F.col("Instrument_type").contains("HCD"), F.coalesce(*[F.when(F.col("Instrument").contains(i), F.lit(i)) for i in INSTRUMENTS]))
    x = F.col("Collision_energy_NCE") * F.col("PrecursorMZ")
    known = library.withColumn("_kind", kind).filter("_kind is not null and Collision_energy_ev is not null and Collision_energy_NCE is not null")
    lines = energy_relation(known, x, "Collision_energy_ev", "_kind").select(F.col("_kind").alias("_k"), "slope", "intercept")
    out = library.join(F.broadcast(lines), kind == F.col("_k"), "left")  # a row for each of the INSTRUMENTS
    return out.withColumn("Collision_energy_ev_estimated", x * F.col("slope") + F.col("intercept")).drop("_k", "slope", "intercept")


def base_key(inchikey: Column) -> Column:
    """First block of an InChIKey."""
    return F.substring_index(inchikey, "-", 1)


def reduce_compounds(df: DataFrame, inchikey: str = "InChIKey", order: str | None = None) -> DataFrame:
    """One row per base key, in base_InChIKey: the one with the smallest value of order, else any."""
    d = df.withColumn("base_InChIKey", base_key(F.col(inchikey)))
    if order is None:
        return d.dropDuplicates(["base_InChIKey"])
    return d.groupBy("base_InChIKey").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*", "base_InChIKey")


def isomers_by_mass(df: DataFrame, mass: float, ppm: float = 3.0, num_isomers: int | None = None, but: str | None = None, column: str = "monoisotopic_mass") -> DataFrame:
    """Compounds in an inclusive mass window, one per base key, without the base key `but`."""
    found = df.filter(F.col(column).between(mass * (1 - ppm / 1e6), mass * (1 + ppm / 1e6)))
    return _isomers(found, num_isomers, but)


def isomers_by_formula(df: DataFrame, formula: str, num_isomers: int | None = None, but: str | None = None) -> DataFrame:
    """Compounds of a formula (a partition of the table, if it is written by formula), one per base key."""
    return _isomers(df.filter(F.col("Formula") == formula), num_isomers, but)


def _isomers(df: DataFrame, n: int | None, but: str | None) -> DataFrame:
    if "base_InChIKey" not in df.columns:
        df = df.withColumn("base_InChIKey", base_key(F.col("InChIKey")))
    if but is not None:
        df = df.filter(F.col("base_InChIKey") != but)
    df = df.dropDuplicates(["base_InChIKey"])
    return df if n is None else df.limit(n)


def add_structures(library: DataFrame, compounds: DataFrame, key: str = "InChIKey") -> DataFrame:
    """library with the compounds' InChI and SMILES, its own first; one compound per key."""
    c = compounds.dropDuplicates([key]).select(key, *[F.col(x).alias(f"_{x}") for x in ("InChI", "SMILES")])
    out = library.join(c, key, "left")
    for x in ("InChI", "SMILES"):
        out = out.withColumn(x, F.coalesce(x, f"_{x}") if x in library.columns else F.col(f"_{x}")).drop(f"_{x}")
    return out


def yes_no(c: Column) -> Column:
    return c.contains("Y")


def synonyms(c: Column) -> Column:
    return F.split(c, r"\|")
