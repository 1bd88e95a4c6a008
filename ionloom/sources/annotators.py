"""Answers of external annotation services, what is sent to them, and tables of what they say."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import formula

# Fields of the service's answers.
FRAGMENTS = "array<struct<fragmentId:int,intensity:double,mz:double,formula:string,massDeviationPpm:double>>"
FEATURE = "alignedFeatureId string, externalFeatureId string, ionMass double, charge int, detectedAdducts array<string>, hasMsMs boolean, rtApexSeconds double"
FORMULA = "formulaId string, molecularFormula string, adduct string, rank int, siriusScoreNormalized double, siriusScore double, isotopeScore double, treeScore double"
TREE = "molecularFormula string, adduct string, fragments array<struct<fragmentId:int,molecularFormula:string,adduct:string,ionType:string,massDeviationDa:double,massDeviationPpm:double,score:double,intensity:double,mz:double>>"
SCORES = ("rank", "siriusScoreNormalized", "siriusScore", "isotopeScore", "treeScore")


def fragments(body: Column) -> dict[str, Column]:
    """Lists of the fields of a JSON list of fragments."""
    f = F.from_json(body, FRAGMENTS)
    return {"fragment_mz": F.transform(f, lambda x: x["mz"]), "fragment_intensity": F.transform(f, lambda x: x["intensity"]), "fragment_formula": F.transform(f, lambda x: x["formula"])}


def service_url(port_file: str | None = None) -> str:
    """The local service's address for projects, from the file that it leaves its port in."""
    file = Path(port_file) if port_file else Path.home() / ".sirius" / "sirius-6.port"
    if not file.exists():
        raise RuntimeError(f"no port in {file}: is the service running?")
    return f"http://127.0.0.1:{file.read_text().strip()}/api/projects"


def _get(url: str, timeout: float):
    """The JSON at url; None if the service says no."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError:
        return None


def fetch(ids: DataFrame, url: str, timeout: float = 60.0) -> DataFrame:
    """id and body of the answers of a REST service to url with {id} filled in; each task asks for its own ids.
    Ids that the service has nothing for are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = [_get(url.format(id=i), timeout) for i in pdf["id"]]
            yield pdf.assign(body=[None if b is None else json.dumps(b) for b in bodies]).dropna(subset=["body"])

    return ids.select(F.col("id").cast("string").alias("id")).mapInPandas(run, "id string, body string")


def get_all_compounds(spark: SparkSession, project: str, base_url: str | None = None) -> DataFrame:
    """The project's features, one request on the driver: a project has as many as a chromatogram has peaks."""
    rows = _get(f"{base_url or service_url()}/{project}/aligned-features", 60.0) or []
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "body string")
    return features_of(text)


def features_of(answers: DataFrame) -> DataFrame:
    """Features out of a body of JSON each."""
    return answers.select(F.from_json("body", FEATURE).alias("x")).select("x.*")


def get_all_formulas(spark: SparkSession, project: str, base_url: str | None = None) -> DataFrame:
    """The formulas of all features, with featureId and molecularFormula_array."""
    base = base_url or service_url()
    ids = get_all_compounds(spark, project, base).select(F.col("alignedFeatureId").alias("id"))
    return formulas_of(fetch(ids, f"{base}/{project}/aligned-features/{{id}}/formulas"))


def formulas_of(answers: DataFrame) -> DataFrame:
    """Formulas out of (id of the feature, body: a JSON list)."""
    rows = answers.select(F.col("id").alias("featureId"), F.explode(F.from_json("body", f"array<struct<{_struct(FORMULA)}>>")).alias("x")).select("featureId", "x.*")
    return rows.withColumn("molecularFormula_array", formula.parse_signed(F.col("molecularFormula")))


def get_clean_spectra(spark: SparkSession, project: str, base_url: str | None = None) -> DataFrame:
    """The fragmentation tree of each formula of each feature as lists; see trees_of."""
    base = base_url or service_url()
    found = get_all_formulas(spark, project, base)
    ids = found.select(F.concat("featureId", F.lit("/formulas/"), "formulaId").alias("id"))
    return trees_of(fetch(ids, f"{base}/{project}/aligned-features/{{id}}/fragtree"))


def trees_of(answers: DataFrame) -> DataFrame:
    """featureId, formulaId, molecularFormula, adduct, fragments_intensities and fragment_formulas_array out of (id:
    feature/formulas/formula, body). A fragment's formula is its adduct's inside with the first M replaced by it."""
    parts = F.split("id", "/")
    rows = answers.select(parts[0].alias("featureId"), F.element_at(parts, -1).alias("formulaId"), F.from_json("body", TREE).alias("x")).select("featureId", "formulaId", "x.*")
    ion = lambda f: F.regexp_extract(F.regexp_replace(f["adduct"], "^([^M]*)M", F.concat(F.lit("$1"), f["molecularFormula"])), r"\[(.+)\]", 1)
    arrays_ = F.transform("fragments", lambda f: formula.parse_signed(ion(f)))
    return rows.select("featureId", "formulaId", "molecularFormula", "adduct", F.transform("fragments", lambda f: f["intensity"]).alias("fragments_intensities"), arrays_.alias("fragment_formulas_array"))


def get_all_info(spark: SparkSession, project: str, only_with_msms: bool = True, max_formulas_per_feature: int = 1, discard_failed_annotations: bool = True, base_url: str | None = None) -> DataFrame:
    """Features with the scores and fragmentation trees of their best formulas."""
    base = base_url or service_url()
    return all_info(get_all_compounds(spark, project, base), get_clean_spectra(spark, project, base), get_all_formulas(spark, project, base), only_with_msms, max_formulas_per_feature, discard_failed_annotations)


def all_info(features: DataFrame, spectra: DataFrame, formulas: DataFrame, only_with_msms: bool = True, max_formulas_per_feature: int = 1, discard_failed_annotations: bool = True) -> DataFrame:
    if only_with_msms:
        features = features.filter("hasMsMs")
    formulas = formulas.select("formulaId", "molecularFormula", "molecularFormula_array", *SCORES)
    out = join_features(features, spectra.drop("molecularFormula"), formulas, max_formulas_per_feature)
    return out.filter("siriusScore is not null") if discard_failed_annotations else out


def join_features(features: DataFrame, spectra: DataFrame, formulas: DataFrame, max_rank: int | None = None) -> DataFrame:
    """features (alignedFeatureId) with their formulas' spectra (featureId, formulaId) and formulas (formulaId, rank)."""
    if max_rank is not None:
        formulas = formulas.filter(F.col("rank") <= max_rank)
    both = spectra.join(formulas, "formulaId", "left")
    return features.join(both, features["alignedFeatureId"] == both["featureId"], "left").drop("featureId")


def _struct(ddl: str) -> str:
    """The fields of a flat table definition as those of a struct."""
    return ",".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))


# annotation by formula engines: what is sent, and the table of candidates

#: Columns of a candidate table.
CANDIDATES = (
    "identifier long, rank int, neutral_formula string, neutral_formula_array array<int>, charged_formula string, charged_formula_array array<int>, estimated_fdr double, ms1_isotope_similarity double, "
    "estimated_prob double, normed_estimated_prob double, subformula_mz array<double>, subformula_int array<double>, subformula_str array<string>, subformula_arr array<array<int>>"
)


@dataclass(frozen=True)
class FeatureColumns:
    """Names of the columns that features are made of; those that are None or missing take defaults by polarity."""

    identifier_col: str
    precursor_mz_col: str
    ms2_mz_col: str
    ms2_int_col: str
    rt_col: str | None = None
    adduct_col: str | None = None
    charge_col: str | None = None
    ms1_isotope_mz_col: str | None = None
    ms1_isotope_int_col: str | None = None
    polarity_col: str | None = None
    default_polarity: str = "positive"

    def __post_init__(self) -> None:
        object.__setattr__(self, "default_polarity", self.default_polarity.lower())
        if self.default_polarity not in ("positive", "negative"):
            raise ValueError("default_polarity must be 'positive' or 'negative'")

    @classmethod
    def from_dict(cls, values: dict) -> FeatureColumns:
        if unknown := values.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**values)

    def to_dict(self) -> dict:
        return asdict(self)


def _fine(mz: Column, intensity: Column) -> Column:
    """Finite, non-empty lists of one length, intensities not negative."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(mz) > 0) & (F.size(mz) == F.size(intensity)) & F.forall(mz, finite) & F.forall(intensity, lambda x: finite(x) & (x >= 0)), F.lit(False))


def is_sendable(mz: Column, precursor: Column, intensity: Column) -> Column:
    """A spectrum that is _fine and a positive finite precursor."""
    return _fine(mz, intensity) & F.coalesce((precursor > 0) & (precursor < float("inf")) & ~F.isnan(precursor), F.lit(False))


def default_adduct(adduct: Column, positive: Column) -> Column:
    return F.coalesce(adduct, F.when(positive, F.lit("[M+H]+")).otherwise(F.lit("[M-H]-")))


def to_features(df: DataFrame, columns: FeatureColumns) -> DataFrame:
    """identifier, mz, charge, adduct, rt, ms1_mz, ms1_int, ms2_mz, ms2_int of the rows whose spectrum and precursor can be sent.

    A polarity that is neither positive nor negative is the default one. Without an adduct it is [M+H]+ or [M-H]-, without a
    charge 1 or -1 by polarity; a charge of 0 becomes 1 or -1 where the adduct says so. MS1 peaks that can't be sent are left out.
    """
    needed = [columns.identifier_col, columns.precursor_mz_col, columns.ms2_mz_col, columns.ms2_int_col]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    given = lambda c, kind: F.col(f"`{c}`").cast(kind) if c and c in df.columns else F.lit(None).cast(kind)
    said = F.lower(given(columns.polarity_col, "string"))
    positive = F.when(said.isin("positive", "negative"), said == "positive").otherwise(F.lit(columns.default_polarity == "positive"))
    adduct = default_adduct(given(columns.adduct_col, "string"), positive)
    charge = F.coalesce(given(columns.charge_col, "string").try_cast("int"), F.when(positive, 1).otherwise(-1))
    charge = F.when((charge == 0) & (adduct == "[M+H]+"), 1).when((charge == 0) & (adduct == "[M-H]-"), -1).otherwise(charge)
    ms2, ms1 = ([given(c, "array<double>") for c in pair] for pair in ((columns.ms2_mz_col, columns.ms2_int_col), (columns.ms1_isotope_mz_col, columns.ms1_isotope_int_col)))
    mz = given(columns.precursor_mz_col, "double")
    out = df.filter(_fine(*ms2) & mz.isNotNull())
    sent = lambda c: F.when(_fine(*ms1), c)
    return out.select(given(columns.identifier_col, "long").alias("identifier"), mz.alias("mz"), charge.alias("charge"), adduct.alias("adduct"), given(columns.rt_col, "double").alias("rt"), sent(ms1[0]).alias("ms1_mz"), sent(ms1[1]).alias("ms1_int"), ms2[0].alias("ms2_mz"), ms2[1].alias("ms2_int"))


def ranked(candidates: DataFrame, key: str, candidate: str) -> DataFrame:
    """A row per item of a list of candidates, with its rank from 1; rows without candidates go."""
    return candidates.select(key, F.posexplode(candidate).alias("_at", candidate)).withColumn("rank", F.col("_at") + 1).drop("_at")


def annotate_formulas(df: DataFrame, columns: FeatureColumns, engine: Callable[[list[dict]], list[dict]] | None = None, engine_config=None) -> DataFrame:
    """Candidates (CANDIDATES, with the identifier under its own name) that an engine gives for the rows of df.

    engine: takes a list of features (dicts by the names of to_features) and returns candidates (dicts of
    CANDIDATES without rank, in order, grouped by identifier). It runs on each task's features, so its tables load once a
    task. By default it is msbuddy with engine_config, which must then be installed on the driver and every executor.
    """
    run_engine = engine or _msbuddy(engine_config)
    names = [f.split(" ")[0] for f in CANDIDATES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict = {}
            rows = []
            for c in run_engine(pdf.to_dict("records")):
                seen[c["identifier"]] = seen.get(c["identifier"], 0) + 1
                rows.append({**dict.fromkeys(names), **c, "rank": seen[c["identifier"]]})
            yield pd.DataFrame(rows, columns=names)

    return to_features(df, columns).mapInPandas(run, CANDIDATES).withColumnRenamed("identifier", columns.identifier_col)


def _msbuddy(config) -> Callable[[list[dict]], list[dict]]:
    try:
        import msbuddy  # noqa: F401
    except ImportError as e:
        raise RuntimeError("msbuddy is not installed; give another engine or install it on the driver and every executor") from e

    def run(features: list[dict]) -> list[dict]:
        from msbuddy import Msbuddy
        from msbuddy.base import MetaFeature, Spectrum

        spectrum = lambda mz, i: None if mz is None else Spectrum(mz_array=mz, int_array=i)
        tool = Msbuddy(config)
        tool.add_data([MetaFeature(identifier=f["identifier"], mz=f["mz"], charge=f["charge"], adduct=f["adduct"], rt=f["rt"], ms1=spectrum(f["ms1_mz"], f["ms1_int"]), ms2=spectrum(f["ms2_mz"], f["ms2_int"])) for f in features])
        tool.annotate_formula()
        out = []
        text, counts = lambda x: str(x) if x else None, lambda x: x.array.tolist() if x else None
        for m in tool.data or []:
            for c in m.candidate_formula_list or []:
                told, raw = c.ms2_raw_explanation, m.ms2_raw
                subs = [(raw.mz_array[k], raw.int_array[k], f) for k, f in zip(told.idx_array, told.explanation_list) if f is not None and 0 <= k < len(raw.mz_array)] if told and raw else []
                of = lambda g: [g(s) for s in subs] or None  # noqa: B023, E731
                out.append({
                    "identifier": m.identifier, "neutral_formula": text(c.formula), "neutral_formula_array": counts(c.formula), "charged_formula": text(c.charged_formula), "charged_formula_array": counts(c.charged_formula),
                    "estimated_fdr": c.estimated_fdr, "ms1_isotope_similarity": c.ms1_isotope_similarity, "estimated_prob": c.estimated_prob, "normed_estimated_prob": c.normed_estimated_prob,
                    "subformula_mz": of(lambda s: float(s[0])), "subformula_int": of(lambda s: float(s[1])), "subformula_str": of(lambda s: str(s[2])), "subformula_arr": of(lambda s: s[2].array.tolist()),
                })
        return out

    return run
