"""Structure conversions and fingerprints with RDKit, where it is installed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("morgan", "rdkit", "atompair", "torsion", "maccs")
MISSING = "RDKit is not installed; structure operators need it on the driver and every executor"


METHODS = ("GetFingerprint", "GetSparseFingerprint", "GetCountFingerprint", "GetSparseCountFingerprint")
MACCS_SIZE = 167


@dataclass(frozen=True)
class FingerprintParams:
    """Parameters of a fingerprint; each kind takes its own, those that are None are left to RDKit."""

    fp_type: str = "morgan"
    fp_method: str = "GetFingerprint"
    fpSize: int = 2048
    radius: int | None = 2
    useBondTypes: bool | None = True
    minPath: int | None = 1
    maxPath: int | None = 7
    numBitsPerFeature: int | None = 2
    use2D: bool | None = True
    minDistance: int | None = 1
    maxDistance: int | None = 30
    countSimulation_AP: bool | None = True
    includeChirality: bool | None = False
    targetSize: int | None = 4
    countSimulation_TT: bool | None = True
    atomInvariantsGenerator: object | None = None

    def __post_init__(self) -> None:
        if self.fp_type not in KINDS:
            raise ValueError(f"fp_type must be one of {KINDS}")
        if self.fp_method not in METHODS:
            raise ValueError(f"fp_method must be one of {METHODS}")
        if self.fp_type == "morgan" and self.radius is None:
            object.__setattr__(self, "radius", 4)
        if self.fp_type == "maccs":
            object.__setattr__(self, "fpSize", MACCS_SIZE)

    @classmethod
    def from_dict(cls, values: dict) -> FingerprintParams:
        if unknown := values.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**values)

    def to_dict(self) -> dict:
        return asdict(self)

    def generator_args(self) -> dict:
        """What RDKit's generator of the kind is called with."""
        own = {
            "morgan": {"radius": self.radius, "useBondTypes": self.useBondTypes, "atomInvariantsGenerator": self.atomInvariantsGenerator, "includeChirality": self.includeChirality},
            "rdkit": {"minPath": self.minPath, "maxPath": self.maxPath, "numBitsPerFeature": self.numBitsPerFeature},
            "atompair": {"minDistance": self.minDistance, "maxDistance": self.maxDistance, "includeChirality": self.includeChirality, "use2D": self.use2D, "countSimulation": self.countSimulation_AP if self.fp_method == "GetFingerprint" else None},
            "torsion": {"targetSize": self.targetSize, "includeChirality": self.includeChirality, "countSimulation": self.countSimulation_TT if self.fp_method == "GetFingerprint" else None},
            "maccs": {},
        }[self.fp_type]
        return {k: v for k, v in {**own, "fpSize": self.fpSize}.items() if v is not None}


def _chem():
    try:
        from rdkit import Chem
    except ImportError as e:
        raise RuntimeError(MISSING) from e
    return Chem


def _text_udf(convert: Callable, column: Column, invalid: str | None = "") -> Column:
    """A conversion per value; null and what can't be read give `invalid`."""
    _chem()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        chem = _chem()

        def one(x):
            try:
                return convert(chem, x) if x is not None else invalid
            except Exception:  # RDKit raises many kinds on malformed structures
                return invalid

        return s.map(one)

    return run(column)


def sanitize_smiles(c: Column) -> Column:
    return _text_udf(lambda chem, x: chem.MolToSmiles(chem.MolFromSmiles(x)), c)


def inchi_to_smiles(c: Column) -> Column:
    return _text_udf(lambda chem, x: chem.MolToSmiles(chem.MolFromInchi(x)), c)


def smiles_to_inchi(c: Column) -> Column:
    return _text_udf(lambda chem, x: chem.MolToInchi(chem.MolFromSmiles(x)), c)


def smiles_to_inchikey(c: Column) -> Column:
    return _text_udf(lambda chem, x: chem.MolToInchiKey(chem.MolFromSmiles(x)), c)


def eliminate(c: Column, pattern: str) -> Column:
    """The product of splitting off a neutral by a reaction pattern, without stereochemistry; null if it doesn't apply or
    the structure can't be read, 'multiple products' if it applies in more than one way."""

    def convert(chem, x):
        from rdkit.Chem import AllChem

        mol = chem.MolFromSmiles(x)
        chem.RemoveStereochemistry(mol)
        products = AllChem.ReactionFromSmarts(pattern).RunReactants((mol,))
        if len(products) != 1:
            return "multiple products" if products else None
        chem.SanitizeMol(products[0][0])
        return chem.MolToSmiles(products[0][0])

    return _text_udf(convert, c, None)


# A carbon with a hydrogen beside one with the leaving group.
WATER = "[C;h:1]-[C:2]-[OH]>>[C:1]=[C:2]"
AMMONIA = "[C;h:1]-[C:2]-[NH2]>>[C:1]=[C:2]"


def eliminate_water(c: Column) -> Column:
    return eliminate(c, WATER)


def eliminate_ammonia(c: Column) -> Column:
    return eliminate(c, AMMONIA)


def exact_mass(c: Column) -> Column:
    """Monoisotopic mass; -1 for null, null for what can't be read."""
    _chem()

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        from rdkit.Chem.Descriptors import ExactMolWt

        chem = _chem()
        return s.map(lambda x: -1.0 if x is None else ExactMolWt(m) if (m := chem.MolFromSmiles(x)) else None)

    return run(c)


def fingerprint(c: Column, params: FingerprintParams = FingerprintParams()) -> Column:
    """array<float> of fpSize values (maccs: 167), zeros for what can't be read. Sparse fingerprints are folded to fpSize."""
    _chem()

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        import numpy as np
        from rdkit.Chem import MACCSkeys
        from rdkit.Chem import rdFingerprintGenerator as g

        chem = _chem()
        makers = {"morgan": g.GetMorganGenerator, "rdkit": g.GetRDKitFPGenerator, "atompair": g.GetAtomPairGenerator, "torsion": g.GetTopologicalTorsionGenerator}
        make = None if params.fp_type == "maccs" else getattr(makers[params.fp_type](**params.generator_args()), params.fp_method)

        def one(x):
            out = np.zeros(params.fpSize, np.float32)
            m = chem.MolFromSmiles(x) if x else None
            if m is not None:
                made = MACCSkeys.GenMACCSKeys(m) if make is None else make(m)
                values = made.GetNonzeroElements() if hasattr(made, "GetNonzeroElements") else dict.fromkeys(made.GetOnBits(), 1)
                for bit, n in values.items():
                    out[bit % params.fpSize] += n
                if "Count" not in params.fp_method or make is None:
                    out = np.minimum(out, 1)
            return out.tolist()

        return s.map(one)

    return run(c)
