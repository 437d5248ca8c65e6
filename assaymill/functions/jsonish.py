"""Tolerant reading of JSON in model answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_null, found, stripped

# Confidence of a formula by the kind of measurement.
CONFIDENCE = {"hrms": 0.95, "lcms": 0.9, "ms": 0.85, "formula_only": 0.7}
ENTRY_TYPES = ("example_compound", "other")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value evaluated once per row, however often
    ``then`` names it: as a lambda's variable.  Higher-order functions share no
    subexpressions."""
    return F.transform(F.array(value), then)[0]


def json_block(text: Column) -> Column:
    """The fenced block, else from the first to the last brace, else all."""
    fenced = found(text, r"(?s)```(?:json)?\s*\n?(.*?)```")
    return F.coalesce(stripped(fenced), found(text, r"(?s)(\{.*\})"), text)


def repaired(text: Column) -> Column:
    """Single quotes as double ones, no comma before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(text, "'", '"'), r",\s*([}\]])", "$1")


def json_map(text: Column) -> Column:
    """``map<string,string>`` of an answer's object, as written or repaired;
    null when neither parses."""
    ok = lambda t: F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, "map<string,string>"))
    return once(json_block(text), lambda block: F.coalesce(ok(block), once(repaired(block), ok)))


def entry(value: Column) -> Column:
    """``struct<type, id>`` of one entry: an object, or a bare type; null when
    it is neither."""
    is_object = F.startswith(stripped(value), F.lit("{"))
    kind = F.get_json_object(value, "$.type")
    name = blank_null(stripped(F.get_json_object(value, "$.id")))
    name = F.when(~F.lower(name).isin("null", "none"), name)
    return F.when(is_object, F.struct(F.when(kind.isin(*ENTRY_TYPES), kind).otherwise("other").alias("type"), name.alias("id"))).when(
        value.isin(*ENTRY_TYPES), F.struct(value.alias("type"), F.lit(None).cast("string").alias("id"))
    )


def entries(answer: Column, n: Column) -> Column:
    """One entry per box 1 .. n: by box number; if some are missing and there
    are n entries, in the order of their keys' digits; else type other."""
    digits = lambda k: F.coalesce(F.try_to_number(blank_null(F.regexp_replace(k, "[^0-9]", "")), F.lit("999999999999999")), F.lit(10**15))
    in_order = lambda m: F.transform(
        F.array_sort(F.transform(F.map_entries(m), lambda e, k: F.struct(digits(e["key"]).alias("d"), k.alias("k"), e["value"].alias("v")))), lambda e: once(e["v"], entry)
    )
    direct = lambda m: F.transform(F.sequence(F.lit(1), n), lambda k: once(F.try_element_at(m, k.cast("string")), entry))
    chosen = lambda m: once(direct(m), lambda d: F.when(F.exists(d, lambda e: e.isNull()) & (F.size(m) == n), in_order(m)).otherwise(d))
    other = F.struct(F.lit("other").alias("type"), F.lit(None).cast("string").alias("id"))
    picked = F.coalesce(once(json_map(answer), chosen), F.array_repeat(other, n))
    return F.when(n <= 0, F.array().cast("array<struct<type:string,id:string>>")).otherwise(F.transform(picked, lambda e: F.coalesce(e, other)))


def formula_refs(answer: Column) -> Column:
    """``array<struct<formula, mass, compound_id, source, confidence>>``: entries
    with a formula or a mass; a broken answer gives none."""
    bare = F.regexp_replace(F.regexp_replace(stripped(answer), r"^```[^\n]*\n", ""), r"\s*```\s*$", "")
    rows = F.from_json(bare, "array<struct<formula:string,mass:string,compound_id:string,source:string>>")
    mass = lambda r: F.when(r["mass"].rlike(r"^\s*[-+]?\d+(\.\d*)?([eE][-+]?\d+)?\s*$"), r["mass"].cast("double"))
    source = lambda r: F.when(r["source"].isin(*CONFIDENCE), r["source"]).otherwise("formula_only")
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    made = F.transform(
        F.filter(rows, lambda r: (blank_null(r["formula"]).isNotNull()) | mass(r).isNotNull()),
        lambda r: F.struct(
            F.coalesce(r["formula"], F.lit("")).alias("formula"), mass(r).alias("mass"), stripped(r["compound_id"]).alias("compound_id"), source(r).alias("source"), confidence[source(r)].alias("confidence")
        ),
    )
    return F.coalesce(made, F.array().cast("array<struct<formula:string,mass:double,compound_id:string,source:string,confidence:double>>"))
