"""Readers and writers of compound lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import formula
from ionloom.operators.libraries import base_key, synonyms, yes_no

# Columns of the compound tables.
INCHI = "CID long, InChI string, InChIKey string"
SMILES = "CID long, SMILES string"
MASS = "CID long, Formula string, monoisotopic_mass double, exact_mass double"


def read_inchi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=INCHI).withColumn("base_InChIKey", base_key(F.col("InChIKey")))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SMILES)


def read_mass(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=MASS)


def write_compounds(df: DataFrame, path: str, by_formula: bool = False) -> None:
    """Parquet, in a folder per Formula if by_formula, so that a formula reads only its own rows."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("Formula") if by_formula else writer).parquet(path)


# The yes/no columns of the main sheet, its whole and broken numbers, and the sheets' names.
FLAGS = ("SAFETY_DATA", "EXPOCAST", "TOXVAL_DATA", "PPRTV_LINK", "WIKIPEDIA_ARTICLE", "IRIS_LINK", "NHANES")
WHOLE = ("QC_LEVEL", "DATA_SOURCES", "NUMBER_OF_PUBMED_ARTICLES", "PUBCHEM_DATA_SOURCES", "CPDAT_COUNT", "READY_BIO_DEG")
BROKEN = ("AVERAGE_MASS", "MONOISOTOPIC_MASS", "LOGD5.5", "LOGD7.4", "EXPOCAST_MEDIAN_EXPOSURE_PREDICTION_MG/KG-BW/DAY", "TOXCAST_PERCENT_ACTIVE")
PREDICTED = ("_TEST_PRED", "_OPERA_PRED")
MAIN, SYNONYMS = "Main Data", "Synonym Identifier"


def typed(df: DataFrame) -> DataFrame:
    """A sheet read as text with its number columns as numbers; empty cells are null."""
    kinds = {c: "long" if c in WHOLE else "double" for c in df.columns if c in WHOLE + BROKEN or c.endswith(PREDICTED)}
    return df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def _number(c: str) -> Column:
    return F.regexp_replace(c, "^DTXSID", "").cast("long")


def clean_main_sheet(df: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """Y/N flags as booleans, DTXSID as a number, the formula also as an array."""
    out = df.withColumns({c: yes_no(F.col(c)) for c in flags if c in df.columns}).withColumn("DTXSID", _number("DTXSID"))
    return out.withColumn("MOLECULAR_FORMULA_array", formula.parse(F.col("MOLECULAR_FORMULA"))) if "MOLECULAR_FORMULA" in df.columns else out


def clean_synonym_sheet(df: DataFrame) -> DataFrame:
    return df.withColumn("synonyms", synonyms(F.col("IDENTIFIER"))).drop("IDENTIFIER")


def join_sheets(main: DataFrame, other: DataFrame, main_key: str = "PREFERRED_NAME", other_key: str = "SEARCHED_CHEMICAL") -> DataFrame:
    """Each main row (by DTXSID) once, with its synonyms."""
    other = other.withColumnRenamed(other_key, "_k")
    return main.join(other, main[main_key] == other["_k"], "left").drop("_k").dropDuplicates(["DTXSID"])


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet as text, through pandas on the driver; needs openpyxl. Excel sheets have at most 1,048,576 rows."""
    import pandas as pd

    if not str(path).lower().endswith(".xlsx"):
        raise ValueError(f"not an .xlsx file: {path}")
    try:
        frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    except ValueError as e:
        raise KeyError(f"{path} has no sheet named {sheet!r}") from e
    return spark.createDataFrame(frame.where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """A list with one row of identifiers per compound."""
    df = typed(read_excel(spark, path)).withColumn("DTXSID", _number("DTXSID"))
    return clean_synonym_sheet(df).withColumn("MOLECULAR_FORMULA_array", formula.parse(F.col("MOLECULAR_FORMULA")))


def read_short_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of one sheet, without synonyms."""
    return typed(read_excel(spark, path)).withColumn("DTXSID", _number("DTXSID"))


def read_full_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of two sheets, the compounds and their synonyms."""
    return join_sheets(clean_main_sheet(typed(read_excel(spark, path, MAIN))), clean_synonym_sheet(read_excel(spark, path, SYNONYMS)))
