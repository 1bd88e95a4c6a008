"""Elements, their masses and bounds: the order of every formula array."""

from __future__ import annotations

# Symbols by increasing mass, monoisotopic masses, default upper bounds.
ELEMENTS = ("H", "B", "C", "N", "O", "F", "Na", "Si", "P", "S", "Cl", "K", "As", "Br", "I")
MASSES = (1.007825, 11.009305, 12.0, 14.003074, 15.994915, 18.998403, 22.989770, 27.9769265, 30.973762, 31.972071, 34.96885271, 38.963707, 74.921596, 78.918338, 126.904468)
DEFAULT_MAX = (100, 0, 50, 20, 20, 40, 0, 0, 5, 5, 10, 0, 0, 10, 5)
DEFAULT_MIN = (0,) * 15
#: Isotope mass differences and the abundances of the light and heavy isotope.
ISOTOPES = {"C": (1.003355, 0.9893, 0.0107), "N": (0.997035, 0.996, 0.004), "S": (1.995796, 0.9493, 0.0429), "Cl": (1.99705, 0.7578, 0.2422), "Br": (1.99795, 0.5069, 0.4931)}
#: The order in which a formula is written.
WRITTEN = ("C", "H", "B", "N", "O", "F", "Na", "Si", "P", "S", "Cl", "K", "As", "Br", "I")
NUM_ELEMENTS = len(ELEMENTS)
INDEX = {e: i for i, e in enumerate(ELEMENTS)}
#: Contribution of an atom to twice the degree of unsaturation, beside the constant 2.
VALENCE = {"C": 2, "Si": 2, "P": 3, "N": 1, "B": 1, "As": 1, "H": -1, "F": -1, "Cl": -1, "Br": -1, "I": -1}
#: The hydrogen atom's mass, which stands for a proton's in adduct arithmetic.
PROTON_MASS = MASSES[0]
#: Targets lighter than this share its absolute tolerance.
LEAST_TOLERANCE_MASS = 200.0


def element_info() -> list[dict]:
    """symbol, index, mass, default bounds and isotope (mass difference and abundances, or None) of every element."""
    return [{"symbol": e, "index": i, "mass": MASSES[i], "default_min": DEFAULT_MIN[i], "default_max": DEFAULT_MAX[i], "isotope": ISOTOPES.get(e)} for i, e in enumerate(ELEMENTS)]
