"""Operators that the queries don't reach: kernel bounds, isotopes, readers, joins, gates."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import arrays, formula
from ionloom.functions.elements import ELEMENTS, INDEX, MASSES
from ionloom.operators import chem, chromatogram, decompose, isotopes, libraries
from ionloom.operators.rangejoin import range_join
from ionloom.sources import annotators, compounds, spectra
from ionloom.streaming.spectra import stream_mgf


def bounds(**n):
    return tuple(n.get(e, 0) for e in ELEMENTS)


def test_space_against_all_formulas():
    low, high = bounds(C=1), bounds(C=6, H=12, O=3, S=2, Cl=2)
    s = decompose.Space(low, high, 400.0)
    every = [np.array(bounds(C=c, H=h, O=o, S=x, Cl=y)) for c, h, o, x, y in itertools.product(range(1, 7), range(13), range(4), range(3), range(3))]
    for mass in (86.03678, 121.99, 150.03, 200.5):
        want = {tuple(f) for f in every if abs(f @ np.array(MASSES) - mass) <= 200 * 30 / 1e6 and (u := 2 + f @ decompose._VALENCE) % 2 == 0 and 0 <= u <= 80}
        assert {tuple(f) for f in s.find(np.array([mass]), 30.0, (0, 40))[1]} == want


def test_own_formula_is_found(spark):
    df = spark.createDataFrame([(180.063388,), (None,), (-1.0,)], "m double").withColumn("f", decompose.verbose(decompose.decompose_mass(F.col("m"))))
    rows = df.collect()
    assert "C6H12O6" in rows[0].f.formulas_str and all(not r.f.formulas for r in rows[1:])
    assert df.filter("false").select("f.formulas_str").schema[0].dataType.simpleString() == "array<string>"


def test_isotope_bounds(spark):
    f = {"C": 10, "S": 1, "Cl": 1}
    base, mz = 1e8, 300.0
    peaks = [(mz, base)] + [(mz + d, base * f[e] * p1 / p0) for e, (d, p0, p1) in isotopes.ISOTOPES.items() if e in f]
    df = spark.createDataFrame([(mz, [p[0] for p in peaks], [p[1] for p in peaks]), (mz, [100.0], [1.0])], "mz double, m array<double>, i array<double>")
    found, lost = df.select(isotopes.deduce_bounds(F.col("mz"), F.col("m"), F.col("i")).alias("b")).collect()
    for e, n in f.items():
        assert found.b["min"][INDEX[e]] <= n <= found.b["max"][INDEX[e]]
    assert [lost.b["max"][INDEX[e]] for e in ("C", "S", "Cl", "Br")] == [-1] * 4
    # a spectrum too weak to show any isotope rules nothing out
    config = isotopes.PatternConfig(3e-6, 1.2e5)
    fits = lambda n: [r[0] for r in df.select(isotopes.fits_pattern(formula.literal(n), F.col("mz"), F.col("m"), F.col("i"), config)).collect()]
    assert fits(f) == [True, True] and fits({**f, "Br": 1}) == [False, True] and fits({**f, "C": 40}) == [False, True]


def test_large_carbon_counts_need_the_light_isotopes_share(spark):
    """At 30 carbons n p1 / p0**n is 0.443, 38 % above n p1 / p0."""
    mz, base = 500.0, 1e8
    df = spark.createDataFrame([(mz, [mz, mz + 1.003355], [base, base * 0.443]), (mz, [mz, mz + 1.003355], [base, base * 0.25])], "mz double, m array<double>, i array<double>")
    fit = isotopes.fits_pattern(formula.literal({"C": 30}), F.col("mz"), F.col("m"), F.col("i"), isotopes.PatternConfig(3e-6, 1.2e5, max_intensity_ratio=1.1))
    assert [r[0] for r in df.select(fit).collect()] == [True, False]
    with pytest.raises(ValueError):
        isotopes.PatternConfig.from_dict({"mass_tolerance": 1e-6})
    with pytest.raises(ValueError):
        isotopes.PatternConfig.from_dict({"mass_tolerance": 1e-6, "ms1_resolution": 1e5, "resolution": 1})


@pytest.mark.parametrize("mode", ["abs", "ratio"])
@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_range_join(spark, mode, how):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(50, 60, 200), rng.uniform(50, 60, 150)
    tol = 0.01 if mode == "abs" else 2e-4
    near = lambda x, y: abs(x - y) <= tol if mode == "abs" else abs(x / y - 1) <= tol
    got = range_join(spark.createDataFrame([(float(x),) for x in a], "a double"), spark.createDataFrame([(float(x),) for x in b], "b double"), "a", "b", tol, mode, how).count()
    assert got == (sum(near(x, y) for x in a for y in b) if how == "inner" else sum(not any(near(x, y) for y in b) for x in a))


def test_entropy_similarity(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 3.0], [1.0, 2.0], [2.0, 6.0]), ([1.0], [1.0], [5.0], [1.0]), (None, None, [5.0], [1.0])], "a array<double>, i array<double>, b array<double>, j array<double>")
    got = [r[0] for r in df.select(arrays.entropy_similarity(F.col("a"), F.col("i"), F.col("b"), F.col("j"), 0.01)).collect()]
    assert got == pytest.approx([1.0, 0.0, -1.0])


COLUMNS = ["Peak ID", "Name", "Scan", "RT left(min)", "RT (min)", "RT right (min)", "Precursor m/z", "Height", "Area", "Estimated noise", "S/N", "Adduct", "Isotope", "MSMS spectrum", "MS1 isotopes"]


def test_chromatogram_reader_and_annotation(spark, tmp_path):
    """In the export's own layout, with surplus columns in between."""
    rows = [
        [1, "Unknown", 5, 1.0, 1.1, 1.3, 181.0712, 1e6, 5e6, 3, 10, "[M+H]+", "null", "163.0601:50 181.0712:100", "181.0712:100000000 182.0746:6400000"],
        [2, "w/o MS2", 6, 1.0, 1.1, 1.3, 90.5, 1e6, 5e6, 3, 10, "[M+H]+", "null", "null", "null"],
        [3, "Unknown", 7, 1.0, 1.15, 1.3, 181.2, 4e5, 5e6, 3, 10, "[M+H]+", "null", "163.0601:100", "181.2:1000"],
    ]
    (tmp_path / "c.txt").write_text("\n".join("\t".join(map(str, r)) for r in [COLUMNS, *rows]))
    df = spectra.read_chromatogram(spark, str(tmp_path / "c.txt"))
    one, two, _ = df.orderBy("peak_id").collect()
    assert (one.rt_min, one.precursor_mz, one.height, one.adduct) == (1.1, 181.0712, 1e6, "[M+H]+")
    assert one.mz == [163.0601, 181.0712] and one.intensity == [0.5, 1.0] and two.mz is None
    out = chromatogram.annotate_formulas(df, high=dict(H=30, C=12, N=2, O=8)).filter("peak_id = 1").select(formula.write(F.col("formula")).alias("f"), "cleaned.*").collect()
    assert "C6H12O6" in [r.f for r in out]
    assert all(len(r.masses_normalized) == len(r.intensities) == len(r.fragment_formulas) for r in out)
    whole = chromatogram.get_chromatogram(spark, str(tmp_path / "c.txt"))
    assert whole.columns == list(chromatogram.OUTPUT.values())
    rows = {r["Peak ID"]: r for r in whole.collect()}
    assert rows[1]["energy_is_too_high"] is False and rows[2]["spectral_entropy"] is None
    # peak 3 subtracts at height 0.4 from peak 1's first fragment
    assert rows[1]["isobars"] == [3] and rows[3]["isobars"] == [1] and rows[1]["msms_intensity_cleaned"] == pytest.approx([0.5 - 0.4 * np.exp(-10 * 0.05**2), 1.0])
    assert rows[3]["msms_m/z_cleaned"] is None and set(chromatogram.from_output(whole).columns) == set(chromatogram.OUTPUT)


def test_blank_with_spectra(spark):
    kind = "peak_id long, rt_min double, precursor_mz double, height double, mz array<double>, intensity array<double>"
    sample = spark.createDataFrame([(1, 1.0, 100.0, 10.0, [50.0, 70.0], [1.0, 0.001]), (2, 1.0, 200.0, 10.0, [50.0], [1.0]), (3, 1.0, 300.0, 10.0, None, None)], kind)
    blank = spark.createDataFrame([(1, 1.25, 100.0, 10.0, [50.0002], [1.0]), (2, 1.0, 200.0, 10.0, [50.002], [1.0]), (3, 1.05, 300.0, 10.0, None, None)], kind)
    config = chromatogram.BlankConfig.from_dict({"use_ms2": True, "ratio": 5, "noise_threshold": None})
    assert [r.peak_id for r in chromatogram.subtract_blank(sample, blank, config).collect()] == [2]
    assert sorted(r.peak_id for r in chromatogram.subtract_blank(sample, blank).collect()) == [1]
    assert chromatogram.BlankConfig(ms1_mass_tolerance=3.0).ms1_mass_tolerance == pytest.approx(3e-6)
    with pytest.raises(ValueError):
        chromatogram.BlankConfig.from_dict({"rt_tolerance": 1})


def test_cleaned_spectrum(spark):
    df = spark.createDataFrame([([100.0, 100.0002, 50.0, 60.0, 0.0], [6.0, 2.0, 8.0, 0.01, 3.0])], "m array<double>, i array<double>")
    got = df.select(arrays.cleaned(F.col("m"), F.col("i"), 10.0, 0.005).alias("c")).first().c
    assert [round(p.mz, 5) for p in got] == [50.0, 100.00005] and [p.i for p in got] == pytest.approx([0.5, 0.5])


MGF = """BEGIN IONS
NAME=x
DESCRIPTION=a=b
EXACTMASS=180.0634
FORMULA=C6H12O6
INCHIAUX=WQZGKKKJIJFFOK-GASJEMHNSA-N
SMILES=OCC
FEATURE_ID=7
MSLEVEL=2
RTINSECONDS=12.5
ADDUCT=[M+H]+
PEPMASS=181.0707 3000
CHARGE=1
FEATURE_MS1_HEIGHT=2.5E6
COLLISION_ENERGY=[20.0, 45.0]
ISOLATION_WINDOW=1.2
SOURCE_INSTRUMENT=Orbitrap ID-X
ION_SOURCE=ESI
IONMODE=Positive
PI=Someone
DATASET_ID=d
USI=[mzspec:a]
PRECURSOR_PURITY=0.98
QUALITY_CHIMERIC=PASSED
QUALITY_EXPLAINED_INTENSITY=0.5
QUALITY_EXPLAINED_SIGNALS=0.25
MSn_collision_energies=[[30.0, 40.0], [60.0]]
MSn_precursor_mzs=[181.07, 163.06]
MSn_fragmentation_methods=[HCD, CID]
MSn_isolation_windows=[1.2, 1.6]
Num peaks=2
50.1 2.5E6
60.2 3.0
END IONS
BEGIN IONS
NAME=y
MSLEVEL=1
END IONS
"""


def test_mgf(spark, tmp_path):
    (tmp_path / "a.mgf").write_text(MGF)
    rows = {r.NAME: r for r in spectra.read_mgf(spark, str(tmp_path / "a.mgf"), msn=True).collect()}
    x, y = rows["x"], rows["y"]
    assert x.spectrum_mz == [50.1, 60.2] and x.spectrum_intensity == [2.5e6, 3.0] and y.spectrum_mz == []
    assert (x.PEPMASS, x.CHARGE, x.EXACTMASS, x.RTINSECONDS, x.FEATURE_MS1_HEIGHT, x.ISOLATION_WINDOW, x["Num peaks"]) == (181.0707, 1, 180.0634, 12.5, 2.5e6, 1.2, 2)
    assert (x.IONMODE, x.SPECTYPE, x.ION_SOURCE, x.DESCRIPTION, x.SOURCE_INSTRUMENT, x.PI, x.inchikey) == ("positive", "SINGLE_BEST_SCAN", "ESI", "a=b", "Orbitrap ID-X", "Someone", "WQZGKKKJIJFFOK-GASJEMHNSA-N")
    assert (x.PRECURSOR_PURITY, x.QUALITY_CHIMERIC, x.QUALITY_EXPLAINED_INTENSITY, x.QUALITY_EXPLAINED_SIGNALS) == (0.98, "PASSED", 0.5, 0.25)
    assert x.MSn_precursor_mzs == [181.07, 163.06] and x.MSn_fragmentation_methods == ["HCD", "CID"] and x.MSn_isolation_windows == [1.2, 1.6] and x.MSn_collision_energies == [[30.0, 40.0], [60.0]]
    assert x.collision_energy_list == [20.0, 45.0] and x.collision_energy_mean == 32.5 and x.multiple_collision_energies and x.FORMULA_array[:5] == [12, 0, 6, 0, 6]
    assert x.num_merged_spectra == 1 and x.is_single_spectra and y.is_single_spectra is None and {*spectra.MGF_KEYS} - {"INCHIAUX", "COLLISION_ENERGY"} <= {*x.asDict()}
    assert [r.NAME for r in spectra.read_ms2_singles(spark, str(tmp_path)).collect()] == ["x"]
    stream = stream_mgf(spark, str(tmp_path)).select("NAME").writeStream.format("memory").queryName("mgf").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("mgf").count() == 2
    for line in ("CHARGE=x", "IONMODE=sideways"):
        (tmp_path / "bad.mgf").write_text(f"BEGIN IONS\n{line}\nEND IONS\n")
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|sideways"):
            spectra.read_mgf(spark, str(tmp_path / "bad.mgf")).collect()


MSP = """Name: glucose
Synon: a
Synon: b
Notes: Consensus spectrum; Mz_diff=2.0ppm
Precursor_type: [M+H]+
Spectrum_type: MS2
PrecursorMZ: 181.0707
Instrument_type: HCD
Instrument: Thermo Finnigan Elite Orbitrap
Collision_gas: N2
Collision_energy: NCE=20% 9eV
Ion_mode: P
Formula: C6H12O6
MW: 180
ExactMass: 180.063388
CAS#: 50-99-7;  NIST#: 1000001
Related_CAS#: 1-1-1
DB#: 12
InChIKey: WQZGKKKJIJFFOK-GASJEMHNSA-N
Num Peaks: 5
60.1000 1.5 "?"
85.0286 250.45 "C4H5O2=p-C2H8O4/0.5ppm"
97.0286 30 "C9H9=p-C/9ppm 4/5"
163.0604 999.00 "C6H11O5=p-H2O/-3.1ppm;C5H9=p/1ppm"
181.0711 100.00 "p/0.0ppm 5/5"

Name: h
PrecursorMZ: 100
"""


def test_msp(spark, tmp_path):
    (tmp_path / "b.msp").write_text(MSP)
    lib = {r.Name: r for r in spectra.read_libraries(spark, [(str(tmp_path / "b.msp"), "db")]).collect()}
    g, h = lib["glucose"], lib["h"]
    assert (g.NIST_ID, g.DB_ID, g.CAS, g.Related_CAS, g.Collision_gas, g.ExactMass, g.MW, g.Ion_mode, g.mz_diff, g.base_InChIKey) == (1000001, 12, "50-99-7", "1-1-1", "N2", "180.063388", 180, "P", 2.0, "WQZGKKKJIJFFOK")
    assert g.Synonyms == ["a", "b"] and (g.Collision_energy_NCE, g.Collision_energy_ev, g.Num_Peaks) == (20, 9, 5)
    assert g.raw_spectrum_mz == [60.1, 85.0286, 97.0286, 163.0604, 181.0711] and g.raw_spectrum_intensity == [1.5, 250.45, 30.0, 999.0, 100.0]
    assert g.normalized_spectrum_mz == [60.0999, 85.0284, 97.0284, 163.0601, 181.0707]
    # 85.0284 is C4H5O2's 85.0290 within 7 ppm only, 163.0601 C6H11O5's 163.06065 within 3.4
    assert g.clean_spectrum_formula == ["Mol"] and g.clean_spectrum_intensity == [100.0] and g.clean_spectrum_formula_array[0][:5] == [13, 0, 6, 0, 6]
    assert (g.num_clean_peaks, g.molecular_ion_intensity, g.base_peak_mz, g.base_peak_div_precursor_mz, g.precursor_minus_base_peak_mz) == (1, 100.0, 163.0604, 0.901, 18.01)
    assert g.clean_precursor and not g.Fragment and h.DB_Name == "db" and h.Precursor_type is None and h.clean_precursor is None and h.raw_spectrum_mz == [] and h.molecular_ion_intensity == -1
    assert spectra.entries_without(spark.createDataFrame([(x,) for x in MSP.split("\n\n")], "value string"), "Synon").count() == 1


def test_formula_engine(spark):
    kind = "id long, mz double, m array<double>, i array<double>, pol string"
    df = spark.createDataFrame([(1, 181.07, [50.0], [1.0], "positive"), (2, 90.0, [50.0], [-1.0], "positive"), (3, 100.0, [50.0, 60.0], [1.0, 2.0], "NEGATIVE")], kind)
    columns = annotators.FeatureColumns("id", "mz", "m", "i", polarity_col="pol")
    engine = lambda features: [{"identifier": f["identifier"], "neutral_formula": f"{f['adduct']}{k}", "estimated_prob": 0.5} for f in features for k in range(2)]
    got = sorted((r.id, r.rank, r.neutral_formula, r.subformula_mz) for r in annotators.annotate_formulas(df, columns, engine).collect())
    assert got == [(1, 1, "[M+H]+0", None), (1, 2, "[M+H]+1", None), (3, 1, "[M-H]-0", None), (3, 2, "[M-H]-1", None)]
    with pytest.raises(ValueError):
        annotators.FeatureColumns.from_dict({"identifier": "x"})
    try:
        import msbuddy  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="msbuddy"):
            annotators.annotate_formulas(df, columns)


def test_empty_inputs_keep_their_types(spark):
    kind = "mass double, lo array<int>, hi array<int>, f array<int>, m array<double>, i array<double>"
    df = spark.createDataFrame([], kind)
    out = df.select(
        decompose.verbose(decompose.decompose_mass(F.col("mass"))).alias("a"), decompose.verbose(decompose.decompose_mass_per_bounds(F.col("mass"), F.col("lo"), F.col("hi"))).alias("b"), decompose.decompose_fragments_verbose(F.col("f"), F.col("m")).alias("c"),
        decompose.clean_spectra_verbose(F.col("f"), F.col("m"), F.col("i")).alias("d"), decompose.clean_and_normalize_spectra(F.col("f"), F.col("mass"), F.col("m"), F.col("i")).alias("e"),
    )
    assert out.count() == 0
    types = out.select("a.formulas_str", "c.formulas", "d.fragment_formulas_str", "e.fragment_formulas_str", "e.masses_normalized").dtypes
    assert [t for _, t in types] == ["array<string>", "array<array<array<int>>>", "array<array<string>>", "array<string>", "array<double>"]
    odd = spark.createDataFrame([(None, None, None, None, None, None), (100.0, [0] * 15, [50] * 15, None, [10.0, None], [1.0, 1.0]), (44.026215, [0] * 15, [50] * 15, [4, 0, 2, 0, 1] + [0] * 10, [16.0313, None, float("nan")], [1.0, 2.0, 3.0])], kind)
    rows = odd.select(decompose.decompose_mass_per_bounds(F.col("mass"), F.col("lo"), F.col("hi")).alias("b"), decompose.decompose_fragments(F.col("f"), F.col("m")).alias("c"), decompose.clean_and_normalize_spectra(F.col("f"), F.col("mass"), F.col("m"), F.col("i")).alias("e")).collect()
    assert rows[0].b == [] and rows[0].c == [] and rows[1].c == [] and [4, 0, 2, 0, 1] + [0] * 10 in rows[2].b and [len(x) for x in rows[2].c] == [1, 0, 0] and rows[2].e.fragment_formulas_str == ["CH4"]


def test_recalibration_against_one_spectrum_at_a_time():
    rng = np.random.default_rng(3)
    size = rng.integers(0, 6, 40)
    mz = rng.uniform(40, 200, size.sum())
    which = np.sort(rng.integers(0, len(mz), 150))
    found = np.zeros((150, 15), np.int32)
    found[:, 0] = np.round(mz[which] + rng.normal(0, 0.4, 150))
    parent, seen = rng.uniform(200, 300, 40), np.where(rng.random(40) < 0.8, rng.uniform(200, 300, 40), 0.0)
    at, pick, norm, ppm = decompose.recalibrated(size, mz, which, found, parent, seen, 1e9)
    start = np.concatenate(([0], np.cumsum(size)))
    for r in range(40):
        frags = range(start[r], start[r + 1])
        mine = {k: [c for c in range(150) if which[c] == k] for k in frags}
        err = lambda c: found[c, 0] * MASSES[0] - mz[which[c]]

        def line(points):
            points = points + [(seen[r], parent[r] - seen[r])] * int(seen[r] > 0)
            if not points:
                return 0.0, 0.0
            x, e = map(np.array, zip(*points))
            if len(set(x)) == 1:
                return np.average(e, weights=x), 0.0
            b, a = np.polyfit(x, e, 1, w=np.sqrt(x))
            return a, b

        a, b = line([(mz[k], err(c[0])) for k, c in mine.items() if len(c) == 1])
        chosen = {k: min(c, key=lambda j: round(abs(err(j) - a - b * mz[k]), 12)) for k, c in mine.items() if c}
        a, b = line([(mz[k], err(c)) for k, c in chosen.items()])
        got = {k: (c, n) for k, c, n in zip(at, pick, norm) if k in mine}
        assert {k: c for k, (c, _) in got.items()} == chosen
        assert all(abs(n - (mz[k] + a + b * mz[k])) < 1e-6 for k, (_, n) in got.items())


def test_worker_tables_are_bounded():
    decompose._kept.clear()
    one = decompose.space(bounds(), bounds(C=10, H=20), 200.0)
    assert decompose.space(bounds(), bounds(C=10, H=20), 200.0) is one
    decompose._kept.clear()
    for k in range(3, 9):
        decompose.space(bounds(), bounds(C=30, H=60, N=10, O=10, S=k), 700.0)
    assert len(decompose._kept) == 1 or sum(s.nbytes for s in decompose._kept.values()) <= decompose.KEPT_BYTES


def test_sheets(spark):
    main = spark.createDataFrame([("DTXSID5", "a", "Y", "C2H6", "30.0", "3", ""), ("DTXSID5", "a", "Y", "C2H6", "30.0", "3", ""), ("DTXSID6", "b", "N", "CH4", None, "4", "1.5")], "DTXSID string, PREFERRED_NAME string, NHANES string, MOLECULAR_FORMULA string, MONOISOTOPIC_MASS string, QC_LEVEL string, `48HR_DAPHNIA_LC50_MOL/L_TEST_PRED` string")
    other = spark.createDataFrame([("a", "x|y")], "SEARCHED_CHEMICAL string, IDENTIFIER string")
    rows = {r.DTXSID: r for r in compounds.join_sheets(compounds.clean_main_sheet(compounds.typed(main)), compounds.clean_synonym_sheet(other)).collect()}
    assert rows[5].synonyms == ["x", "y"] and rows[5].NHANES and rows[5].MONOISOTOPIC_MASS == 30.0 and rows[5].QC_LEVEL == 3 and rows[6].synonyms is None and not rows[6].NHANES
    assert rows[5]["48HR_DAPHNIA_LC50_MOL/L_TEST_PRED"] is None and rows[6].MOLECULAR_FORMULA_array[0] == 4
    with pytest.raises(ValueError, match="xlsx"):
        compounds.read_short_list(spark, "list.csv")


def test_compounds(spark, tmp_path):
    df = spark.createDataFrame([(1, "A-B-C", "C2H6", 30.0), (2, "A-D-C", "C2H6", 30.0), (3, "E-B-C", "CH4", 16.0)], "CID long, InChIKey string, Formula string, monoisotopic_mass double")
    compounds.write_compounds(df, str(tmp_path / "p"), by_formula=True)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert libraries.isomers_by_formula(back, "C2H6").count() == 1
    assert libraries.isomers_by_mass(back, 30.0, but="A").count() == 0
    assert libraries.reduce_compounds(df, order="CID").count() == 2


def test_fingerprint_parameters():
    p = chem.FingerprintParams.from_dict({"fp_type": "atompair", "fp_method": "GetCountFingerprint", "maxDistance": None})
    assert p.generator_args() == {"minDistance": 1, "includeChirality": False, "use2D": True, "fpSize": 2048}
    assert chem.FingerprintParams(fp_type="maccs").fpSize == 167 and chem.FingerprintParams(radius=None).radius == 4 and len(p.to_dict()) == 16
    for bad in ({"fp_type": "x"}, {"fp_method": "x"}, {"size": 1}):
        with pytest.raises(ValueError):
            chem.FingerprintParams.from_dict(bad)


def test_rdkit_gate():
    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="RDKit"):
            chem.sanitize_smiles(F.col("x"))
