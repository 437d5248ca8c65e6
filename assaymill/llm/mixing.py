"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight; within a
source the documents with the smallest keys are a weighted sample without
replacement.  A source's token budget is first spent on whole passes over the
source (epochs); the rest is spent on documents in key order until the prefix
sum of their sizes reaches it.

The prefix sum never sorts a source.  Keys are whole numbers; the totals of
ranges of them are summed along each source, and only the range in which the
budget runs out is looked at again in finer ranges, round after round, until it
holds few documents.  Those are ordered one by one, which gives the last
document taken.  That is one row per source, and every document, with its text
or without, compares its own key with its source's row: nothing is joined with
texts, and a source with a third of all rows is spread like any other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, carried, q, row_tie, stored, text_of, unit_hash

#: Documents of the range that are ordered one by one, about.
ROWS_ORDERED = 4_000
#: Keys are multiples of 2^-52; ranges of so many bits are summed in turn.
KEY_BITS, ROUNDS = 52, (46, 36, 26, 16, 6)
PATTERN_WEIGHTS = (5.0, 2.0, 1.0)
_MADE = ["size", "source_size", "target", "taken", "_am_key", "_am_tie", "_am_src", "_am_unit"]


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def quality_weight(text_col: str = "text") -> Column:
    """Share of letters and white space in the text, from 0.05 to 1: texts full
    of digits, symbols and markup are drawn later."""
    n = F.length(text_of(text_col))
    odd = F.length(F.regexp_replace(text_of(text_col), r"[\p{L}\s]+", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.coalesce(F.try_divide(odd, n), F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = PATTERN_WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``_am_src, source_size, target`` from ``_am_src, source_size``.

    Sources in code point order, null last, get ``weights`` in rotation and
    share ``share`` of all sizes; no target exceeds ``cap`` times its source and
    the excess is shared again by weight.  The fixed point is
    ``min(cap * size, level * weight)``; the level comes from prefix sums over
    the sources ordered by ``cap * size / weight``.  These windows run over one
    row per source."""
    n = len(weights)
    array = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_am_n", F.row_number().over(Window.orderBy(F.col("_am_src").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_am_w", F.element_at(array, (F.col("_am_n") % n + 1).cast("int"))).withColumn("_am_cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("_am_cap") / F.col("_am_w")).asc(), F.col("_am_n").asc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("_am_left", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_am_cap").over(order), F.lit(0.0)))
        .withColumn("_am_rest", F.sum("_am_w").over(everything) - F.coalesce(F.sum("_am_w").over(order), F.lit(0.0)))
        .withColumn("_am_level", F.col("_am_left") / F.col("_am_rest"))
        .withColumn("_am_level", F.min(F.when(F.col("_am_cap") >= F.col("_am_level") * F.col("_am_w"), F.struct(F.col("_am_cap") / F.col("_am_w"), F.col("_am_n"), F.col("_am_level").alias("v")))).over(everything)["v"])
    )
    target = F.when(F.col("_am_level").isNull(), F.col("_am_cap")).otherwise(F.least(F.col("_am_cap"), F.col("_am_level") * F.col("_am_w")))
    return levels.select("_am_src", "source_size", target.cast("double").alias("target"))


def _key(id_col: str, text_col: str, weight: Column, seed: int) -> Column:
    """The document's exponential key over its weight, as a whole number."""
    draw = unit_hash(q(id_col), row_tie(text_col), seed=seed)
    return F.least(F.lit(2.0**61), -F.log(draw) / weight * F.lit(2.0**KEY_BITS)).cast("long")


def _order(id_column: Column) -> Column:
    return F.struct(F.col("_am_key").alias("k"), id_column.alias("id"), F.col("_am_tie").alias("tie"))


def source_cuts(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float, rows_ordered: int) -> DataFrame:
    """One row per source: ``_am_of, source_size, target, _am_epochs``, and the
    keys below ``_am_lo`` and items up to ``_am_last`` that the fractional
    selection takes, from ``_am_id, _am_src, size, _am_tie, _am_key``."""
    sources = stored(rows.groupBy("_am_src").agg(F.sum("size").cast("long").alias("source_size")))
    plan = (
        source_targets(sources, weights, share, cap)
        .withColumn("_am_goal", F.bround("target").cast("long"))
        .withColumn("_am_epochs", F.coalesce(F.try_divide(F.col("_am_goal"), F.col("source_size")), F.lit(0.0)).cast("long"))
        .withColumn("_am_left", F.col("_am_goal") - F.col("_am_epochs") * F.col("source_size"))
        .withColumnRenamed("_am_src", "_am_of")
        .withColumns({"_am_bin": F.lit(0).cast("long"), "_am_before": F.lit(0).cast("long")})
    )
    plan = stored(plan)
    kept, shift = plan.columns, 62
    on_source = F.col("_am_src").eqNullSafe(F.col("_am_of"))
    along = Window.partitionBy("_am_of").orderBy("_am_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for finer in ROUNDS:
        inside = rows.join(plan.select("_am_of", "_am_bin"), on_source & (F.shiftright("_am_key", shift) == F.col("_am_bin")))
        totals = inside.groupBy("_am_of", F.shiftright("_am_key", finer).alias("_am_next")).agg(F.sum("size").alias("_am_sum"), F.count(F.lit(1)).alias("_am_n"))
        # a source's row repeats the null that groups its documents
        totals = totals.withColumnRenamed("_am_of", "_am_in").join(plan.select("_am_of", "_am_left", "_am_before"), F.col("_am_in").eqNullSafe(F.col("_am_of"))).drop("_am_in")
        upto = totals.withColumn("_am_upto", F.col("_am_before") + F.sum("_am_sum").over(along)).where(F.col("_am_upto") > F.col("_am_left"))
        first = F.min_by(F.struct(F.col("_am_next").alias("bin"), (F.col("_am_upto") - F.col("_am_sum")).alias("before"), F.col("_am_n").alias("n")), "_am_next")
        found = upto.groupBy(F.col("_am_of").alias("_am_in")).agg(first.alias("_am_cut"))
        plan = stored(
            plan.drop("_am_bin", "_am_before", "_am_n")
            .join(found, F.col("_am_in").eqNullSafe(F.col("_am_of")), "left")
            .select(*[c for c in kept if c not in ("_am_bin", "_am_before")], F.col("_am_cut.bin").alias("_am_bin"), F.col("_am_cut.before").alias("_am_before"), F.col("_am_cut.n").alias("_am_n"))
        )
        shift = finer
        if (plan.agg(F.max("_am_n")).first()[0] or 0) <= rows_ordered:
            break
    # rows equal in id and text are one item
    inside = rows.join(plan.select("_am_of", "_am_bin"), on_source & (F.shiftright("_am_key", shift) == F.col("_am_bin")))
    items = inside.groupBy(F.col("_am_of").alias("_am_in"), "_am_key", "_am_id", "_am_tie").agg(F.sum("size").alias("size"))
    items = items.join(plan.select("_am_of", "_am_left", "_am_before"), F.col("_am_in").eqNullSafe(F.col("_am_of")))
    order = Window.partitionBy("_am_of").orderBy("_am_key", "_am_id", "_am_tie").rowsBetween(Window.unboundedPreceding, -1)
    items = items.withColumn("_am_upto", F.col("_am_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = (F.col("_am_upto") < F.col("_am_left")) & (2 * (F.col("_am_left") - F.col("_am_upto")) >= F.col("size"))
    last = items.where(fits).groupBy(F.col("_am_of").alias("_am_in")).agg(F.max(_order(F.col("_am_id"))).alias("_am_last"))
    return stored(
        plan.join(last, F.col("_am_in").eqNullSafe(F.col("_am_of")), "left").select("_am_of", "source_size", "target", "_am_epochs", F.shiftleft("_am_bin", shift).alias("_am_lo"), "_am_last")
    )


def _passes(id_column: Column) -> Column:
    """How often a document is taken whole, given its source's row."""
    chosen = F.col("_am_lo").isNull() | (F.col("_am_key") < F.col("_am_lo")) | F.coalesce(_order(id_column) <= F.col("_am_last"), F.lit(False))
    return F.col("_am_epochs") + chosen.cast("long")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> DataFrame:
    weight = quality_weight(text_col) if weight is None else weight
    return stored(
        docs.select(
            q(id_col).alias("_am_id"), q(source_col).cast("string").alias("_am_src"), word_count(text_col).alias("size"), row_tie(text_col).alias("_am_tie"), _key(id_col, text_col, weight, seed).alias("_am_key")
        )
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights: tuple[float, ...] = PATTERN_WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 777,
    rows_ordered: int = ROWS_ORDERED,
) -> DataFrame:
    """``id_col, size, source_size, target, taken`` for every row of ``docs``.

    ``taken`` is ``size`` times the whole passes of its source plus ``size``
    again for documents in the fractional selection.  The document in which the
    budget runs out is taken when that brings the source nearer to its target;
    the other documents are whole too, so a source misses its target by at most
    half of one document (and half a word of rounding).

    Null texts have size 0; a null source is a source, last in order.  Ties of
    keys are broken by id and a hash of the text.  Rows equal in id and text are
    one item, taken or left together.  Sources of size 0 get target 0.  Empty
    input: empty output.  Other input columns play no part."""
    rows = _narrow(docs, id_col, text_col, source_col, weight, seed)
    cuts = source_cuts(rows, weights, share, cap, rows_ordered)
    out = rows.join(cuts, F.col("_am_src").eqNullSafe(F.col("_am_of")))
    return out.select(F.col("_am_id").alias(id_col), "size", "source_size", "target", (_passes(F.col("_am_id")) * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights: tuple[float, ...] = PATTERN_WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 777,
    rows_ordered: int = ROWS_ORDERED,
) -> DataFrame:
    """The documents of the mix with their own columns: each as often as
    :func:`mix` takes it, those it doesn't take left out, those without a word
    once.  Texts are read where they lie and never shuffled.

    Null texts have no word, a null source is a source, rows equal in id and
    text are taken alike, empty input gives empty output."""
    cuts = source_cuts(_narrow(docs, id_col, text_col, source_col, weight, seed), weights, share, cap, rows_ordered)
    names = carried(docs, ["_am_key", "_am_tie", "_am_from", "_am_of", "_am_epochs", "_am_lo", "_am_last", "_am_times", "_am_copy"])
    key = _key(id_col, text_col, quality_weight(text_col) if weight is None else weight, seed)
    rows = docs.select(*map(q, names), q(source_col).cast("string").alias("_am_from"), row_tie(text_col).alias("_am_tie"), key.alias("_am_key"))
    both = rows.join(cuts.drop("source_size", "target"), F.col("_am_from").eqNullSafe(F.col("_am_of")))
    times = F.when(text_of(text_col).rlike(WORD), _passes(q(id_col))).otherwise(1)
    both = both.withColumn("_am_times", times).where("_am_times > 0")
    return both.withColumn("_am_copy", F.explode(F.sequence(F.lit(1), F.col("_am_times").cast("int")))).select(*map(q, names))


def expected_error(sizes: list[int]) -> float:
    """Half of the largest document: what a source may miss its target by."""
    return math.ceil(max(sizes, default=0) / 2) + 0.5
