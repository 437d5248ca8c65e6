"""Export shapes: fixed columns and one per assay, reports, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The column order of the CSV contract.
FIXED = (
    "Source_File", "Compound_ID", "Compound_Type", "Page", "Structure", "SMILES", "Canonical_SMILES", "Valid", "MW_Da", "cLogP", "TPSA", "Rotatable_Bonds", "Stereocenters",
    "Molecular_Formula", "Formula_Validation", "Reference_Formula", "Reference_Mass", "Mass_Error_ppm", "Error",
)


def kept_rows(results: DataFrame, include_invalid: bool = True, example_only: bool = False) -> DataFrame:
    """Without ``other`` rows (a null type stays) and without invalid ones."""
    out = results.where(~F.col("compound_type").eqNullSafe(F.lit("other"))) if example_only else results
    return out if include_invalid else out.where(F.coalesce(F.col("is_valid"), F.lit(False)))


def assay_columns(assays: DataFrame) -> list[str]:
    """Distinct assay names in export order.  The names are a schema: collected
    once, one row per column of the file."""
    names = assays.select("assay").where("assay is not null").distinct()
    return [r.assay for r in names.orderBy(T.assay_rank(F.col("assay")), F.lower("assay"), "assay").collect()]


def _number(c: str, places: int, blank_zero: bool = False) -> Column:
    """A number to so many places, half to even as its text; null is blank."""
    text = F.format_string(f"%.{places}f", F.bround(F.col(c).cast("double"), places))
    empty = F.col(c).isNull() | (F.col(c) == 0) if blank_zero else F.col(c).isNull()
    return F.when(empty, "").otherwise(text)


def wide(results: DataFrame, assays: DataFrame, names: list[str] | None = None, custom: DataFrame | None = None) -> DataFrame:
    """One row per result with the fixed columns, then the assay columns, then
    custom ones, all text; ``result_id`` joins ``assays (result_id, assay,
    value)`` and ``custom (result_id, name, value)``."""
    names = assay_columns(assays) if names is None else names
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = [
        blank("source_file"), blank("compound_id"), blank("compound_type"), blank("page"), (F.col("structure_index") + 1).cast("string"), blank("smiles"), blank("canonical"),
        F.when(F.coalesce(F.col("is_valid"), F.lit(False)), "Yes").otherwise("No"), _number("mw", 2, True), _number("clogp", 2), _number("tpsa", 1), blank("rot_bonds"), blank("stereo"), blank("formula"),
        blank("formula_validation"), blank("reference_formula"), _number("reference_mass", 4), _number("mass_error_ppm", 1), blank("error"),
    ]
    out = results.select("result_id", *[v.alias(n) for v, n in zip(values, FIXED)])
    if names:
        per = assays.groupBy("result_id").pivot("assay", names).agg(F.first("value"))
        out = out.join(per, "result_id", "left").fillna("", names)
    if custom is not None:
        titles = [r.name for r in custom.select("name").distinct().orderBy("name").collect()]
        per = custom.where(T.stripped(F.col("value")) != "").groupBy("result_id").pivot("name", titles).agg(F.first("value"))
        out = out.join(per, "result_id", "left").fillna("", titles)
    return out


def report_lines(results: DataFrame) -> DataFrame:
    """``result_id, text``: the block of a plain report for each result; blanks
    leave their line out."""
    line = lambda title, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(title + ": "), F.col(c).cast("string")))
    status = T.validity(F.col("smiles"), F.col("is_valid"))
    head = F.format_string("Page %d, Structure %d", F.col("page"), F.col("structure_index") + 1)
    block = F.concat_ws("\n", head, line("Compound", "compound_id"), F.concat(F.lit("SMILES: "), T.display_smiles(F.col("smiles"), F.col("error"))), F.concat(F.lit("Status: "), status), line("Formula", "formula"), line("Check", "formula_validation"))
    return results.select("result_id", block.alias("text"))


def smiles_lines(results: DataFrame, canonical: bool = True, example_only: bool = False) -> DataFrame:
    rows = kept_rows(results, False, example_only)
    return rows.select((F.coalesce(T.blank_null(F.col("canonical")), F.col("smiles")) if canonical else F.col("smiles")).alias("value")).where("value is not null and value <> ''")


def sdf_records(results: DataFrame, molblock: str = "molblock") -> DataFrame:
    """``result_id, value``: SD records of the valid rows that have a mol block
    (from the ``chem_props`` slot), with an item per property."""
    key = lambda k: F.regexp_replace(F.regexp_replace(F.regexp_replace(k, " ", "_"), r"[()]", ""), "%", "pct")
    items = F.transform(F.map_entries("properties"), lambda e: F.concat(F.lit("> <"), key(e["key"]), F.lit(">\n"), e["value"], F.lit("\n")))
    rows = kept_rows(results, False).where(F.col(molblock).isNotNull())
    return rows.select("result_id", F.concat(F.col(molblock), F.lit("\n"), F.array_join(items, "\n"), F.lit("\n$$$$")).alias("value"))


def html_rows(results: DataFrame) -> DataFrame:
    """``result_id, value``: a table row of a standalone report."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), esc(c), F.lit("</td>")) for c in ("page", "compound_id", "smiles", "formula_validation")]
    return results.select("result_id", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def selection(results: DataFrame, chosen: DataFrame, order: str) -> DataFrame:
    """Chosen rows only, numbered anew from 1 in their old order."""
    from pyspark.sql.window import Window

    return results.join(chosen.select("result_id").distinct(), "result_id", "left_semi").withColumn("row_no", F.row_number().over(Window.orderBy(order)))
