"""The three scoring dictionaries, as data.

Every table below is a FIXED VALUE that must equal the reference's for the
scores to match: the alias dictionary, the per-task advantage ranges and the
descriptor registry (after duplicate keys collapse; "function" entries name
themselves, "name" entries point at a canonical descriptor).  They are small
constants, so the DataFrames built from them are safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# FIXED VALUES: alias -> descriptor (54 entries, natural order)
# ---------------------------------------------------------------------------
ALIASES: tuple[tuple[str, str], ...] = (
    ("molweight", "MolWt"),
    ("molecularweight", "MolWt"),
    ("mol_weight", "MolWt"),
    ("molecular_weight", "MolWt"),
    ("mw", "MolWt"),
    ("exactmolweight", "ExactMolWt"),
    ("logp", "MolLogP"),
    ("xlogp", "MolLogP"),
    ("xlogp3", "MolLogP"),
    ("partitioncoefficient", "MolLogP"),
    ("octanolwater", "MolLogP"),
    ("tpsa", "TPSA"),
    ("psa", "TPSA"),
    ("polarsurfacearea", "TPSA"),
    ("topologicalpolarsurfacearea", "TPSA"),
    ("donors", "NumHDonors"),
    ("numhdonors", "NumHDonors"),
    ("hbd", "NumHDonors"),
    ("hydrogenbonddonors", "NumHDonors"),
    ("acceptors", "NumHAcceptors"),
    ("numhacceptors", "NumHAcceptors"),
    ("hba", "NumHAcceptors"),
    ("hydrogenbondacceptors", "NumHAcceptors"),
    ("rotatable", "NumRotatableBonds"),
    ("numrotatablebonds", "NumRotatableBonds"),
    ("rotatablebonds", "NumRotatableBonds"),
    ("nrb", "NumRotatableBonds"),
    ("fsp3", "FractionCSP3"),
    ("fractioncsp3", "FractionCSP3"),
    ("heavyatomcount", "HeavyAtomMolWt"),
    ("numheavyatoms", "HeavyAtomMolWt"),
    ("ringcount", "RingCount"),
    ("numrings", "RingCount"),
    ("molarrefractivity", "MolMR"),
    ("molmr", "MolMR"),
    ("polarizability", "MolMR"),
    ("balaban", "BalabanJ"),
    ("bertz", "BertzCT"),
    ("ipcindex", "Ipc"),
    ("chi0", "Chi0"),
    ("chi1", "Chi1"),
    ("chi2n", "Chi2n"),
    ("chi3n", "Chi3n"),
    ("chi4n", "Chi4n"),
    ("chi0v", "Chi0v"),
    ("chi1v", "Chi1v"),
    ("chi2v", "Chi2v"),
    ("chi3v", "Chi3v"),
    ("chi4v", "Chi4v"),
    ("kappa1", "Kappa1"),
    ("kappa2", "Kappa2"),
    ("kappa3", "Kappa3"),
    ("alpha", "HallKierAlpha"),
    ("hallkieralpha", "HallKierAlpha"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: advantage ranges, descriptor -> (BBBP, BACE, Clintox), inclusive
# ---------------------------------------------------------------------------
TASKS: tuple[str, ...] = ("BBBP", "BACE", "Clintox")
UNKNOWN_TASK = "UNKNOWN_TASK"

RANGES: tuple[tuple[str, tuple[float, float], tuple[float, float], tuple[float, float]], ...] = (
    ("MolWt", (100, 450), (200, 500), (50, 450)),
    ("ExactMolWt", (100, 450), (200, 520), (50, 470)),
    ("MolLogP", (1, 4), (1, 5), (-1, 3)),
    ("TPSA", (0, 70), (0, 60), (0, 80)),
    ("LabuteASA", (0, 100), (0, 140), (0, 110)),
    ("NumHDonors", (0, 2), (0, 3), (0, 3)),
    ("NumHAcceptors", (0, 4), (0, 6), (0, 6)),
    ("NumRotatableBonds", (0, 6), (0, 8), (0, 7)),
    ("FractionCSP3", (0.2, 0.6), (0.2, 0.6), (0.1, 0.7)),
    ("RingCount", (1, 4), (1, 5), (0, 4)),
    ("NumAromaticRings", (0, 3), (0, 3), (0, 2)),
    ("NumSaturatedRings", (0, 2), (0, 3), (0, 3)),
    ("NumAliphaticRings", (0, 2), (0, 2), (0, 2)),
    ("NumHeteroatoms", (0, 6), (0, 8), (0, 8)),
    ("HeavyAtomMolWt", (50, 430), (100, 480), (50, 440)),
    ("NumValenceElectrons", (40, 80), (50, 90), (30, 75)),
    ("BertzCT", (100, 500), (200, 600), (50, 450)),
    ("Ipc", (0, 600), (0, 800), (0, 650)),
    ("BalabanJ", (0.5, 3.5), (0.5, 4.0), (0.5, 3.8)),
    ("Kappa1", (0, 6), (0, 6), (0, 6)),
    ("Kappa2", (0, 3), (0, 4), (0, 4)),
    ("Kappa3", (0, 1.5), (0, 2), (0, 2)),
    ("Chi0", (0, 10), (0, 12), (0, 10)),
    ("Chi1", (0, 8), (0, 10), (0, 8)),
    ("Chi2n", (0, 10), (0, 12), (0, 10)),
    ("Chi3n", (0, 10), (0, 12), (0, 10)),
    ("Chi4n", (0, 10), (0, 12), (0, 10)),
    ("Chi0v", (0, 12), (0, 14), (0, 12)),
    ("Chi1v", (0, 10), (0, 12), (0, 10)),
    ("Chi2v", (0, 10), (0, 12), (0, 10)),
    ("Chi3v", (0, 10), (0, 12), (0, 10)),
    ("Chi4v", (0, 10), (0, 12), (0, 10)),
    ("NumRadicalElectrons", (0, 0), (0, 0), (0, 0)),
    ("HallKierAlpha", (-2.0, 1.5), (-2.0, 2.0), (-2.5, 2.0)),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: descriptor registry after duplicate keys collapse.
# Function-backed names (48, each names itself), in order of first appearance.
# ---------------------------------------------------------------------------
REGISTRY_FUNCTIONS: tuple[str, ...] = (
    "MolWt", "MinPartialCharge", "ExactMolWt", "NumValenceElectrons", "NumRadicalElectrons",
    "MaxPartialCharge", "MaxAbsPartialCharge", "MinAbsPartialCharge", "FpDensityMorgan1",
    "FpDensityMorgan2", "FpDensityMorgan3", "Chi0", "Chi0n", "Chi0v", "Chi1", "Chi1n", "Chi1v",
    "Chi2n", "Chi2v", "Chi3n", "Chi3v", "Chi4n", "Chi4v", "HallKierAlpha", "Kappa1", "Kappa2",
    "Kappa3", "LabuteASA", "HeavyAtomCount", "HeavyAtomMolWt", "NumHeteroatoms",
    "NumRotatableBonds", "NumAromaticRings", "NumAliphaticRings", "NumSaturatedRings",
    "NumAromaticCarbocycles", "NumAromaticHeterocycles", "NumAliphaticCarbocycles",
    "NumAliphaticHeterocycles", "NumSaturatedCarbocycles", "NumSaturatedHeterocycles",
    "MolLogP", "MolMR", "TPSA", "NumHAcceptors", "NumHDonors", "FractionCSP3", "RingCount",
)

# Name entries (34): registry key -> the descriptor it names, in order of first appearance.
REGISTRY_NAMES: tuple[tuple[str, str], ...] = (
    ("molecularweight", "MolWt"),
    ("polar_surface_area", "TPSA"),
    ("hydrogendonorcount", "NumHDonors"),
    ("molweight", "MolWt"),
    ("mol_weight", "MolWt"),
    ("molecular_weight", "MolWt"),
    ("exactmolecularweight", "ExactMolWt"),
    ("octanol-water", "MolLogP"),
    ("logp", "MolLogP"),
    ("log_p", "MolLogP"),
    ("xlogp", "MolLogP"),
    ("partitioncoefficient", "MolLogP"),
    ("tpsa", "TPSA"),
    ("topologicalpolarsurfacearea", "TPSA"),
    ("topological_polar_surface_area", "TPSA"),
    ("psa", "TPSA"),
    ("numhdonors", "NumHDonors"),
    ("hbd", "NumHDonors"),
    ("hbdonors", "NumHDonors"),
    ("numhacceptors", "NumHAcceptors"),
    ("hba", "NumHAcceptors"),
    ("hbacceptors", "NumHAcceptors"),
    ("hydrogenacceptorcount", "NumHAcceptors"),
    ("numrotatablebonds", "NumRotatableBonds"),
    ("rotatablebonds", "NumRotatableBonds"),
    ("nrb", "NumRotatableBonds"),
    ("fractioncsp3", "FractionCSP3"),
    ("fsp3", "FractionCSP3"),
    ("heavyatomcount", "HeavyAtomCount"),
    ("numheavyatoms", "HeavyAtomCount"),
    ("ringcount", "RingCount"),
    ("numrings", "RingCount"),
    ("molmr", "MolMR"),
    ("molarrefractivity", "MolMR"),
)
# ---------------------------------------------------------------------------


def alias_keys() -> tuple[str, ...]:
    return tuple(a for a, _ in ALIASES)


def registry_keys() -> tuple[str, ...]:
    return REGISTRY_FUNCTIONS + tuple(k for k, _ in REGISTRY_NAMES)


def range_rows() -> list[tuple[str, str, float, float]]:
    """Long form (task, descriptor, lo, hi): 3 x 34 = 102 rows."""
    out = []
    for name, *per_task in RANGES:
        for task, (lo, hi) in zip(TASKS, per_task):
            out.append((task, name, float(lo), float(hi)))
    return out


def range_keys(task: str) -> tuple[str, ...]:
    return tuple(d for t, d, _, _ in range_rows() if t == task)


def scorable_descriptors() -> tuple[str, ...]:
    """Descriptors a claim can be scored on: a range for some task and a registry entry."""
    reg = set(registry_keys())
    return tuple(sorted({d for _, d, _, _ in range_rows() if d in reg}))


def registry_rows() -> list[tuple[str, str, bool]]:
    """(key, descriptor, is_function): the registry with canonical targets (82 rows)."""
    return ([(k, k, True) for k in REGISTRY_FUNCTIONS]
            + [(k, d, False) for k, d in REGISTRY_NAMES])


# ----- DataFrames (constants: proven size bound, broadcast-safe) ----------
# Built from SQL VALUES, i.e. JVM-side local relations: broadcasting them
# needs no Python job.

def alias_df(spark: SparkSession) -> DataFrame:
    return spark.sql(sql_alias())


def ranges_df(spark: SparkSession) -> DataFrame:
    return spark.sql(sql_ranges())


def registry_df(spark: SparkSession) -> DataFrame:
    return spark.sql(sql_registry())


def scorable_df(spark: SparkSession) -> DataFrame:
    """Descriptors that can be computed: registry keys (membership test of the scorer)."""
    return spark.sql(f"SELECT * FROM {_sql_values([(k,) for k in registry_keys()], ['descriptor'])}")


def _sql_values(rows, cols) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return f"CAST({float(v)!r} AS DOUBLE)"
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


def sql_alias() -> str:
    return f"SELECT * FROM {_sql_values(ALIASES, ['alias', 'descriptor'])}"


def sql_ranges() -> str:
    return f"SELECT * FROM {_sql_values(range_rows(), ['task', 'descriptor', 'lo', 'hi'])}"


def sql_registry() -> str:
    return f"SELECT * FROM {_sql_values(registry_rows(), ['key', 'descriptor', 'is_function'])}"
