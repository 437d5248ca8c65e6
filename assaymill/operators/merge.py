"""Merging extractions by precedence, and joining assays to structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import parts


def first_filled(value: Column, *order: Column) -> Column:
    """Aggregate: the first value in order that is neither null nor empty."""
    filled = T.blank_null(value)
    return F.min_by(filled, F.when(filled.isNotNull(), F.struct(*order)))


def merge_records(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One record per key: the first filled ``value`` by ``order``."""
    return records.groupBy(*keys).agg(first_filled(F.col("value"), *map(F.col, order)).alias("value")).where("value is not null")


def fill_gaps(winner: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """A full outer join that fills the winner's missing records."""
    return winner.select(*keys, F.col("value").alias("_a")).join(other.select(*keys, F.col("value").alias("_b")), keys, "full").select(*keys, F.coalesce(T.blank_null(F.col("_a")), T.blank_null(F.col("_b"))).alias("value"))


def id_ladder(structures: DataFrame, assays: DataFrame) -> DataFrame:
    """``structure_id, file, compound_id, assay_id, rung``: each structure with
    the assay row its id reaches on the lowest rung.

    ``structures`` has ``structure_id, file, compound_id``, ``assays`` has
    ``file, assay_id``.  Rungs: equal, equal normalised, equal but for case,
    normalised but for case, the id's core against ids, against normalised ids,
    against cores, and leading numbers without dashes.  Each rung is an
    equi-join on (file, key), so none becomes a nested loop; of several assay
    rows on a rung the smallest id wins.

    The structures' keys are eight times their rows, which a planner doesn't
    see: they are dealt by their number and merged, never broadcast."""
    n = parts(structures, rows=31_250)
    s = structures.where("compound_id is not null and compound_id <> ''")
    raw, norm = T.stripped(F.col("compound_id")), T.merge_id(F.col("compound_id"))
    a_raw, a_norm = F.col("assay_id"), T.merge_id(F.col("assay_id"))
    rungs = [
        (raw, a_raw),
        (norm, a_norm),
        (F.lower(raw), F.lower(a_raw)),
        (F.lower(norm), F.lower(a_norm)),
        (T.simple_id(norm), a_raw),
        (T.simple_id(norm), a_norm),
        (T.simple_id(norm), T.simple_id(a_norm)),
        (T.number_base(norm), T.number_base(a_norm)),
    ]
    keys = lambda column: F.inline(F.array(*[F.struct(F.lit(k + 1).alias("rung"), F.concat(F.lit(f"{k + 1} "), r[column]).alias("key")) for k, r in enumerate(rungs)]))
    # one column, so that a file that is a constant can't drop out of the join's keys and have the rows dealt again
    at = F.concat("key", F.col("file").cast("string"), F.lit(":"), F.length(F.col("file").cast("string")).cast("string")).alias("at")
    left = s.select("structure_id", "file", "compound_id", keys(0)).select("structure_id", "file", "compound_id", "rung", at).where("at is not null")
    right = assays.select("file", "assay_id", keys(1)).select("assay_id", at).where("at is not null").repartition(n, "at").groupBy("at").agg(F.min("assay_id").alias("assay_id"))
    hits = left.repartition(n, "at").hint("merge").join(right, "at")
    return hits.groupBy("structure_id", "file", "compound_id").agg(F.min_by(F.struct("assay_id", "rung"), F.struct("rung", "assay_id")).alias("m")).select("structure_id", "file", "compound_id", "m.assay_id", "m.rung")


def display_merge(structures: DataFrame, assays: DataFrame) -> DataFrame:
    """The second, looser merge: exact id, number with letter, number with
    suffix; dashes are ignored."""
    core = lambda c: T.found(c, r"(\d+[a-zA-Z]?)")
    number = lambda c: F.concat(T.found(c, r"0*(\d+)"), F.lower(F.coalesce(T.found(c, r"\d+([a-zA-Z])"), F.lit(""))))
    rungs = lambda c: F.inline(F.array(*[F.struct(F.lit(k).alias("rung"), F.concat(F.lit(f"{k} "), x).alias("key")) for k, x in enumerate((c, core(c), number(c)), 1)]))
    left = structures.select("structure_id", "file", "compound_id", rungs(F.col("compound_id"))).where("key is not null")
    right = assays.select("file", "assay_id", rungs(F.col("assay_id"))).where("key is not null").groupBy("file", "key").agg(F.min("assay_id").alias("assay_id"))
    return left.join(right, ["file", "key"]).groupBy("structure_id", "file", "compound_id").agg(F.min_by(F.struct("assay_id", "rung"), "rung").alias("m")).select("structure_id", "file", "compound_id", "m.assay_id", "m.rung")


def unmatched(assays: DataFrame, matches: DataFrame) -> DataFrame:
    """Assay rows no structure took."""
    return assays.join(matches.select("file", "assay_id").distinct(), ["file", "assay_id"], "left_anti")


def with_overrides(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """Matches with manual assignments (``structure_id, assay_id``) before the
    ladder's."""
    o = overrides.select("structure_id", F.col("assay_id").alias("_o"))
    return matches.join(o, "structure_id", "full").withColumn("assay_id", F.coalesce("_o", "assay_id")).drop("_o")


def best_reference(structures: DataFrame, refs: DataFrame) -> DataFrame:
    """``structure_id, status, ppm, ref_seq``: formula check of each structure
    (``structure_id, file, page, compound_id, formula, exact_mass``) against its
    page's references: one with its id decides whatever it says, else a match,
    else a mass match, else the first reference; none: no_reference."""
    from ..functions import formula as M

    r = refs.select("file", "page", F.col("seq").alias("ref_seq"), F.col("compound_id").alias("ref_id"), F.col("formula").alias("ref_formula"), F.col("mh_mass").alias("ref_mass"))
    both = structures.join(r, ["file", "page"], "left").withColumn("c", M.compare(F.col("formula"), F.col("exact_mass"), F.col("ref_formula"), F.col("ref_mass")))
    by_id = F.coalesce(T.reference_id(F.col("ref_id")) == T.reference_id(F.col("compound_id")), F.lit(False))
    rank = F.when(by_id, 0).when(F.col("c.status") == "match", 1).when(F.col("c.status") == "mass_only_match", 2).otherwise(3)
    best = both.groupBy("structure_id").agg(F.min_by(F.struct("c", "ref_seq", F.col("formula").alias("f")), F.struct(rank, "ref_seq")).alias("b"))
    none = F.col("b.ref_seq").isNull() | F.col("b.f").isNull()
    return best.select("structure_id", F.when(none, "no_reference").otherwise(F.col("b.c.status")).alias("status"), F.when(~none, F.col("b.c.ppm")).alias("ppm"), "b.ref_seq")
