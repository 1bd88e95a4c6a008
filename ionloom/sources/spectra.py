"""Readers of chromatogram exports and spectral libraries: text scans and regex columns, one narrow stage.

Columns keep the names that the formats and their users know. Lines are told apart once an entry: header
lines, which the keys are looked up in, and peak lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import arrays, formula
from ionloom.operators import libraries

# The columns that are read of a chromatogram export, by name, and their types.
CHROMATOGRAM = {
    "Peak ID": "long", "Scan": "long", "RT left(min)": "double", "RT (min)": "double", "RT right (min)": "double", "Precursor m/z": "double",
    "Height": "double", "Adduct": "string", "Isotope": "string", "MSMS spectrum": "string", "MS1 isotopes": "string",
}
# Keys of MGF blocks, their types where they are not text, and the values of the closed ones.
MGF_KEYS = (
    "NAME", "DESCRIPTION", "EXACTMASS", "FORMULA", "INCHI", "INCHIAUX", "SMILES", "FEATURE_ID", "MSLEVEL", "RTINSECONDS", "ADDUCT", "PEPMASS", "CHARGE",
    "FEATURE_MS1_HEIGHT", "SPECTYPE", "COLLISION_ENERGY", "FRAGMENTATION_METHOD", "ISOLATION_WINDOW", "ACQUISITION", "INSTRUMENT_TYPE", "SOURCE_INSTRUMENT",
    "IMS_TYPE", "ION_SOURCE", "IONMODE", "PI", "DATACOLLECTOR", "DATASET_ID", "USI", "SCANS", "PRECURSOR_PURITY", "QUALITY_CHIMERIC",
    "QUALITY_EXPLAINED_INTENSITY", "QUALITY_EXPLAINED_SIGNALS", "Num peaks",
)
MGF_TYPES = {
    "EXACTMASS": "double", "RTINSECONDS": "double", "PEPMASS": "double", "CHARGE": "long", "FEATURE_MS1_HEIGHT": "double", "MSLEVEL": "long", "ISOLATION_WINDOW": "double",
    "Num peaks": "long", "PRECURSOR_PURITY": "double", "QUALITY_EXPLAINED_INTENSITY": "double", "QUALITY_EXPLAINED_SIGNALS": "double",
}
MGF_VALUES = {"ION_SOURCE": ("ESI",), "SPECTYPE": ("SINGLE_SCAN", "SINGLE_BEST_SCAN", "SAME_ENERGY", "ALL_ENERGIES", "ALL_MSN_TO_PSEUDO_MS2"), "IONMODE": ("positive", "negative")}
MGF_MSN = ("MSn_collision_energies", "MSn_precursor_mzs", "MSn_fragmentation_methods", "MSn_isolation_windows")
MGF_DEFAULT_SPECTYPE = "SINGLE_BEST_SCAN"
# Fields of library entries as (column, pattern of the value after the key).
MSP_FIELDS = {
    "Name": "Name: (.+)", "NIST_ID": r"NIST#: (\d+)", "DB_ID": r"DB#: (\d+)", "Instrument_type": "Instrument_type: (.+)", "Instrument": "Instrument: (.+)", "Spectrum_type": "Spectrum_type: (.+)",
    "Collision_gas": "Collision_gas: (.+)", "Collision_energy_raw": "Collision_energy: (.+)", "Ionization": "Ionization: (.+)", "Ion_mode": "Ion_mode: ([P,N])", "Precursor_type": "Precursor_type: (.+)",
    "PrecursorMZ": r"PrecursorMZ: (\d+\.?\d*)", "MW": r"MW: (\d+)", "Formula": "Formula: (.+)", "Num_Peaks": r"Num Peaks: (\d+)", "CAS": "CAS#: ([0-9,-]+)", "Related_CAS": "Related_CAS#: ([0-9,-]+)",
    "InChIKey": "InChIKey: (.+)", "ExactMass": r"ExactMass: (\d+\.\d+)", "Peptide_sequence": "Peptide_sequence: (.+)", "Peptide_mods": "Peptide_mods: (.+)", "inchi": "InChI: (.+)", "smiles": "SMILES: (.+)",
}
#: Fields that count at the start of a line only; others may share one.
MSP_LINE_START = ("CAS", "Related_CAS", "InChIKey", "ExactMass")
MSP_TYPES = {"NIST_ID": "long", "DB_ID": "long", "MW": "long", "Num_Peaks": "long", "PrecursorMZ": "double"}
MSP_MZ_DIFF = r"[Mm]z_diff=(-?\d+\.\d+)"
# A peak line's formula, which an equals sign or a p with /, + or - follows, and the mark of the precursor.
PEAK_FORMULA = r'^"(.*?)((([A-Z][a-z]?\d*)|[+-]|\d)+)=?p[/+-]'
PEAK_PRECURSOR = r'^"p/'


def extracted(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where the pattern doesn't match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def peaks(text: Column) -> tuple[Column, Column]:
    """m/z and intensity lists of 'mz:int mz:int ...'; null where there are none."""
    some = lambda a: F.when(F.size(a) > 0, a)
    mz = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\.\d+)"), F.lit(1)), lambda x: x.cast("double"))
    intensity = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)(?:\s|\z)"), F.lit(1)), lambda x: x.cast("double"))
    return some(mz), some(intensity)


def read_chromatogram(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of a tab-separated export, spectra as lists scaled to 1, with widths and nominal masses.

    Columns are found by the names in the header, so surplus ones and their order don't matter; a value that is no number is an error.
    """
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="null", quote="", inferSchema=False)
    raw = raw.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in CHROMATOGRAM.items()])
    mz, intensity = peaks(F.col("MSMS spectrum"))
    ms1_mz, ms1_intensity = peaks(F.col("MS1 isotopes"))
    return raw.select(
        F.col("Peak ID").alias("peak_id"),
        F.col("RT (min)").alias("rt_min"),
        (F.col("RT right (min)") - F.col("RT left(min)")).alias("peak_width_min"),
        F.rint(F.col("RT (min)") * 60).cast("long").alias("rt_sec"),
        arrays.rounded(F.col("Precursor m/z"), 4).alias("precursor_mz"),
        F.rint("Precursor m/z").cast("long").alias("nominal_mass"),
        F.col("Height").alias("height"),
        F.col("Adduct").alias("adduct"),
        mz.alias("mz"),
        arrays.scaled_to_max(intensity).alias("intensity"),
        ms1_mz.alias("ms1_mz"),
        ms1_intensity.alias("ms1_intensity"),
    )


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _one_of(name: str, c: Column) -> Column:
    """c, an error where it is none of a closed key's values."""
    bad = F.raise_error(F.concat(F.lit(f"{name} has the value "), c)).cast("string")
    return F.when(c.isNull() | c.isin(*MGF_VALUES[name]), c).otherwise(bad)


def _list(c: Column) -> Column:
    """The items of '[a, b]' without blanks."""
    return F.transform(F.split(F.btrim(c, F.lit("[]")), ","), lambda x: F.btrim(x, F.lit(" ")))


def _numbers(c: Column) -> Column:
    return F.transform(_list(c), lambda x: x.cast("double"))


def _energies(c: Column) -> Column:
    """'[[30.0, 40.0], 60.0]' as a list of lists; an item that is no list is a list of one, what is no number null."""
    inner = F.regexp_replace(F.regexp_replace(c, r"^\[", ""), r"\]$", "")
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\[", ""), r"\]\s*$", "")
    return F.transform(F.split(inner, r"(?<=\]),"), lambda g: F.transform(F.split(bare(g), ","), lambda x: F.btrim(x, F.lit(" ")).try_cast("double")))


def parse_mgf(blocks: DataFrame, column: str = "value", msn: bool = False) -> DataFrame:
    """A row per 'BEGIN IONS' block: every key of MGF_KEYS as a column, with msn those of MGF_MSN as lists.

    INCHIAUX becomes inchikey and COLLISION_ENERGY collision_energy_list, with collision_energy_mean and
    multiple_collision_energies; USI is a list, with num_merged_spectra and is_single_spectra; FORMULA_array,
    spectrum_mz and spectrum_intensity are added. Numbers and closed values that are malformed are errors.
    """
    lines = _lines(F.col(column))
    peak = r"^(\d+\.\d+)\s+(\d+\.\d+(?:[eE][+-]?\d+)?)$"
    b = blocks.filter(F.col(column).contains("BEGIN IONS")).select(
        F.array_join(F.filter(lines, lambda x: x.contains("=")), "\n").alias("_head"),
        F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(peak))), lambda x: F.split(x, r"\s+")).alias("_peaks"),
    )
    keys = [*MGF_KEYS, *(MGF_MSN if msn else ())]
    out = b.select(*[extracted(F.col("_head"), rf"(?m)^{k}=(.+)$").alias(k) for k in keys], "_peaks")
    out = out.withColumn("SPECTYPE", F.coalesce("SPECTYPE", F.lit(MGF_DEFAULT_SPECTYPE))).withColumn("IONMODE", F.lower("IONMODE"))
    out = out.withColumn("PEPMASS", F.regexp_replace("PEPMASS", r"\s.*$", ""))  # an intensity may follow
    out = out.withColumns({k: F.col(f"`{k}`").cast(t) for k, t in MGF_TYPES.items()} | {k: _one_of(k, F.col(k)) for k in MGF_VALUES})
    energies = F.col("collision_energy_list")
    out = out.withColumns({
        "spectrum_mz": F.transform("_peaks", lambda x: x[0].cast("double")),
        "spectrum_intensity": F.transform("_peaks", lambda x: x[1].cast("double")),
        "USI": F.split(F.btrim("USI", F.lit("[]")), ","),
        "FORMULA_array": formula.parse(F.col("FORMULA")),
        "collision_energy_list": _numbers(F.col("COLLISION_ENERGY")),
    })
    out = out.withColumns({
        "num_merged_spectra": F.when(F.col("USI").isNotNull(), F.size("USI")),
        "is_single_spectra": F.when(F.col("USI").isNotNull(), F.size("USI") == 1),
        "multiple_collision_energies": F.coalesce(F.size(energies) > 1, F.lit(False)),
        "collision_energy_mean": F.try_divide(F.aggregate(energies, F.lit(0.0), lambda s, x: s + x), F.size(energies)),
    })
    if msn:
        out = out.withColumns({
            "MSn_precursor_mzs": _numbers(F.col("MSn_precursor_mzs")),
            "MSn_isolation_windows": _numbers(F.col("MSn_isolation_windows")),
            "MSn_fragmentation_methods": _list(F.col("MSn_fragmentation_methods")),
            "MSn_collision_energies": _energies(F.col("MSn_collision_energies")),
        })
    return out.withColumnRenamed("INCHIAUX", "inchikey").drop("_peaks", "COLLISION_ENERGY")


def read_mgf(spark: SparkSession, path: str, msn: bool = False) -> DataFrame:
    """A file, folder or glob of MGF files, split by block."""
    return parse_mgf(spark.read.text(path, lineSep="END IONS"), msn=msn)


def read_ms2_singles(spark: SparkSession, folder: str) -> DataFrame:
    """The MS2 spectra of a folder that come from a single scan."""
    return read_mgf(spark, f"{folder.rstrip('/')}/*.mgf").filter("is_single_spectra and MSLEVEL = 2")


def _peak_rows(lines: Column, scale: Column) -> Column:
    """array of (mz, intensity, normalized mz, formula, precursor) of peak lines; scale: what m/z values are divided by."""

    def one(line: Column) -> Column:
        t = F.split(line, r"\s", 3)
        note = F.coalesce(F.get(t, F.lit(2)), F.lit(""))
        f = extracted(note, PEAK_FORMULA, 2)
        mz = t[0].cast("double")
        return F.struct(mz.alias("mz"), F.regexp_extract(t[1], r"^\d+(\.\d+)?", 0).cast("double").alias("i"), arrays.rounded(mz / scale, 4).alias("n"), f.alias("f"), (f.isNull() & F.regexp_like(note, F.lit(PEAK_PRECURSOR))).alias("p"))

    return F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"^\d+\.\d+\s\d"))), one)


def parse_msp(entries: DataFrame, column: str = "value") -> DataFrame:
    """A row per entry of a blank-line separated library: the fields of MSP_FIELDS, Synonyms, and its spectrum three times.

    raw_spectrum_*: as it stands; normalized_spectrum_mz: m/z divided by 1 + the entry's mz_diff in ppm, to 4
    decimals; clean_spectrum_*: the peaks whose formula has their normalized mass, with raw intensities, and the
    precursor's, whose formula is 'Mol' and whose array is the ion's. With num_clean_peaks, the flags of the
    precursor type, the base peak's columns and molecular_ion_intensity. An entry without peaks has empty lists.
    """
    e = F.col(column)
    split = entries.filter(F.trim(e) != "").select(_lines(e).alias("_lines"), extracted(e, MSP_MZ_DIFF).cast("double").alias("mz_diff"))
    split = split.select("_lines", "mz_diff", F.array_join(F.filter("_lines", lambda x: x.contains(": ")), "\n").alias("_head"))
    head = F.col("_head")
    out = split.select("_lines", "mz_diff", *[extracted(head, f"(?m)^{p}" if n in MSP_LINE_START else p).cast(MSP_TYPES.get(n, "string")).alias(n) for n, p in MSP_FIELDS.items()], F.regexp_extract_all(head, F.lit("(?m)^Synon: (.+)$"), F.lit(1)).alias("Synonyms"))
    out = out.withColumns({
        "base_InChIKey": extracted(F.col("InChIKey"), "(.+?)-"),
        "Collision_energy_NCE": extracted(F.col("Collision_energy_raw"), r"NCE=(\d+)").cast("long"),
        "Collision_energy_ev": extracted(F.col("Collision_energy_raw"), r"(\d+)e*V*v*\z").cast("long"),
        "Formula_array": F.when(F.col("Formula").isNotNull(), formula.parse_signed(F.col("Formula"))),
        "_ion": F.when(F.col("Precursor_type").isNull(), formula.parse_signed(F.col("Formula"))).otherwise(formula.ion_formula(F.col("Formula"), F.col("Precursor_type"))),
        "_rows": _peak_rows(F.col("_lines"), 1 + F.coalesce("mz_diff", F.lit(0.0)) * 1e-6),
    })
    none = F.array(*[F.lit(0)] * 15)
    rows = F.transform("_rows", lambda x: F.struct(x["n"].alias("mz"), x["i"].alias("i"), F.when(x["p"], F.lit("Mol")).otherwise(x["f"]).alias("f"), F.when(x["p"], F.coalesce("_ion", none)).otherwise(formula.parse_signed(x["f"])).alias("a")))
    out = out.withColumn("_clean", F.filter(rows, lambda x: (x["f"] == "Mol") | formula.fits_mass(x["a"], x["mz"])))
    of = lambda rows, c: F.transform(rows, lambda x: x[c])
    out = out.withColumns({
        "raw_spectrum_mz": of("_rows", "mz"), "raw_spectrum_intensity": of("_rows", "i"), "normalized_spectrum_mz": of("_rows", "n"),
        "clean_spectrum_mz": of("_clean", "mz"), "clean_spectrum_intensity": of("_clean", "i"), "clean_spectrum_formula": of("_clean", "f"), "clean_spectrum_formula_array": of("_clean", "a"),
        "num_clean_peaks": F.size("_clean"),
    })
    base = libraries.base_peak(F.col("raw_spectrum_mz"), F.col("raw_spectrum_intensity"), F.col("PrecursorMZ"))
    mol = libraries.molecular_ion_intensity(F.col("clean_spectrum_formula"), F.col("clean_spectrum_intensity"))
    return out.withColumns({**libraries.precursor_type_flags(F.col("Precursor_type")), **base, "molecular_ion_intensity": mol}).drop("_lines", "_rows", "_clean", "_ion")


def read_msp(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """A library file or glob. large: entries are separated by exactly one empty line, so a file can be split."""
    if large:
        return parse_msp(spark.read.text(path, lineSep="\n\n"))
    return parse_msp(spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n\s*\n")).alias("value")))


def read_libraries(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(path, name) pairs as one table with DB_Name."""
    out = None
    for path, name in files:
        if not path.lower().endswith((".msp", ".mspec", ".txt")):
            raise ValueError(f"not a library file: {path}")
        part = read_msp(spark, path).withColumn("DB_Name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def entries_without(entries: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """The entries that lack a text, for a look at what a format leaves out."""
    return entries.filter((F.trim(column) != "") & ~F.col(column).contains(pattern))


def mock_library(spark: SparkSession, size: int) -> DataFrame:
    """A library of `size` entries of C24H52N4O8 with three fragments, for tests and timings."""
    at = {e: i for i, e in enumerate(("H", "B", "C", "N", "O"))}
    counts = {"H": 13, "C": 6, "N": 1, "O": 2}
    one = [0] * 15
    for e, n in counts.items():
        one[at[e]] = 4 * n
    part = lambda **n: formula.mass(formula.literal(n))
    parent = F.array(*[F.lit(n) for n in one])
    fragments = F.array(part(H=8, B=4), part(H=11, C=6, N=1, O=1), part(H=22, C=12, N=2, O=2))
    return spark.range(1, size + 1).select(F.col("id").alias("NIST_ID"), formula.mass(parent).alias("PrecursorMZ"), parent.alias("Formula_array"), fragments.alias("raw_spectrum_mz"))
