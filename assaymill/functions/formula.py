"""Molecular formulas and masses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mass of the proton; monoisotopic and average atomic masses.
PROTON = 1.007276
MONOISOTOPIC = {"H": 1.00782503207, "B": 11.0093054, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "F": 18.99840322, "Na": 22.9897692809, "Si": 27.9769265325, "P": 30.97376163, "S": 31.972071, "Cl": 34.96885268, "K": 38.96370668, "Br": 78.9183371, "I": 126.904473}
AVERAGE = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Br": 79.904, "I": 126.904}


def elements(formula: Column) -> Column:
    """``array<struct<element, n>>`` sorted by element, counts of repeats added:
    a comparable form of the element map."""
    names = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)(\\d*)"), F.lit(1))
    counts = F.transform(F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)(\\d*)"), F.lit(2)), lambda n: F.when(n == "", 1).otherwise(n.cast("int")))
    pairs = F.arrays_zip(names.alias("e"), counts.alias("n"))
    return F.transform(
        F.array_sort(F.array_distinct(names)),
        lambda e: F.struct(e.alias("element"), F.aggregate(pairs, F.lit(0), lambda a, p: a + F.when(p["e"] == e, p["n"]).otherwise(0)).alias("n")),
    )


def element_map(formula: Column) -> Column:
    return F.map_from_entries(elements(formula))


def mass(formula: Column, average: bool = False) -> Column:
    """Monoisotopic (or average) mass; null with an unknown element."""
    table = F.create_map(*[F.lit(x) for pair in (AVERAGE if average else MONOISOTOPIC).items() for x in pair])
    return F.aggregate(elements(formula), F.lit(0.0), lambda a, p: a + F.try_element_at(table, p["element"]) * p["n"])


def ppm(computed: Column, reference: Column) -> Column:
    """Signed error in parts per million, 0 against a reference of 0."""
    return F.when(reference == 0, F.lit(0.0)).otherwise(F.try_divide(computed - reference, reference) * 1e6)


def compare(formula: Column, exact_mass: Column, reference_formula: Column, reference_mass: Column) -> Column:
    """``struct<status, ppm>``: match by elements; else mass_only_match when
    [M+H]+ is within 0.5 of an integral reference or 10 ppm of another; else
    mismatch."""
    with_proton = exact_mass + PROTON
    error = ppm(with_proton, reference_mass)
    same = (F.coalesce(reference_formula, F.lit("")) != "") & (elements(formula) == elements(reference_formula))
    close = F.when(reference_mass == F.floor(reference_mass), F.abs(with_proton - reference_mass) <= 0.5).otherwise(F.abs(error) <= 10.0)
    status = F.when(F.coalesce(same, F.lit(False)), "match").when(F.coalesce(close, F.lit(False)), "mass_only_match").otherwise("mismatch")
    return F.struct(status.alias("status"), F.when(status != "mismatch", error).alias("ppm"))


def tanimoto(a: Column, b: Column) -> Column:
    """Of two fingerprints as arrays of longs; 0 when both are empty."""
    count = lambda op: F.aggregate(F.zip_with(a, b, op), F.lit(0), lambda s, x: s + F.bit_count(x))
    both, either = count(lambda x, y: x.bitwiseAND(y)), count(lambda x, y: x.bitwiseOR(y))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.try_divide(both, either))
