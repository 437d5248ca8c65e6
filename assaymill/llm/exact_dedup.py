"""Exact deduplication by progressive refinement.

One scan makes a narrow row of every document: its id, the length of its text
without white space and a hash of its first words.  Rows are grouped by length,
survivors of shared lengths by that hash, and only of survivors of shared
prefixes the whole text is normalised and hashed (SHA-256).

All joins and groups are on those narrow rows; groups are reduced by partial
aggregation, so one with a third of all rows costs one row per task.  Texts
meet decisions through a sieve of fixed size: rows of no group pass it without
a shuffle, the few others are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS, carried, one_of_each, q, row_tie, sieve, sifted, stored, text_of

PREFIX_WORDS = 16
_MADE = ["keep_id", "group_size", "kept", "full_hash"]
_HELP = ["_am_id", "_am_tie", "_am_len", "_am_prefix", "_am_of", "_am_with", "_am_keep", "_am_size", "_am_hash", "_am_maybe", "_am_bit", "_am_word", "_am_bits"]


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_of(text_col), WS, " ")


def _length(text_col: str) -> Column:
    """Characters other than ASCII white space."""
    left = text_of(text_col)
    for blank in " \t\n\r\x0b\x0c":
        left = F.replace(left, F.lit(blank), F.lit(""))
    return F.length(left)


def _prefix(text_col: str, words: int) -> Column:
    """Hash of the normalised first words: equal for equal texts."""
    some = F.regexp_extract(text_of(text_col), f"^(?:{WS.replace('+', '*')}{WORD}){{0,{words}}}", 0)
    return F.xxhash64(F.regexp_replace(some, WS, " "))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_words: int = PREFIX_WORDS) -> DataFrame:
    """``_am_id, _am_tie, _am_rows, _am_keep, _am_size, _am_hash`` of the
    documents that have an equal text, a row for each id and text."""
    names = q(id_col).alias("_am_id"), row_tie(text_col).alias("_am_tie")
    narrow = stored(docs.select(*names, _length(text_col).alias("_am_len"), _prefix(text_col, prefix_words).alias("_am_prefix")))
    shared = lambda rows, *by: stored(rows.groupBy(*by).count().where("count > 1").drop("count"))
    by_length = narrow.join(shared(narrow, "_am_len"), "_am_len", "left_semi")
    survivors = narrow.join(shared(by_length, "_am_len", "_am_prefix"), ["_am_len", "_am_prefix"], "left_semi")
    held = sieve(survivors, F.col("_am_id"), F.col("_am_tie"))
    rows = sifted(docs.select(*names, text_of(text_col).alias("_am_text")), held, F.col("_am_id"), F.col("_am_tie")).where("_am_maybe")
    hashed = rows.select("_am_id", "_am_tie", F.sha2(normalised("_am_text"), 256).alias("_am_hash"))
    hashed = stored(hashed.groupBy("_am_hash", "_am_id", "_am_tie").agg(F.count(F.lit(1)).alias("_am_rows")))
    groups = hashed.groupBy("_am_hash").agg(F.min("_am_id").alias("_am_keep"), F.sum("_am_rows").alias("_am_size")).where("_am_size > 1")
    return stored(hashed.join(stored(groups), "_am_hash").select("_am_id", "_am_tie", "_am_rows", "_am_keep", "_am_size", "_am_hash"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_words: int = PREFIX_WORDS) -> DataFrame:
    """All rows of ``docs`` with ``keep_id, group_size, kept, full_hash``.

    Texts are equal when identical after each run of ASCII white space becomes
    one space (their SHA-256 tells).  ``keep_id`` is the smallest id among equal
    texts, ``full_hash`` their SHA-256, null for texts without an equal.

    Nulls: a null text is empty; a null id is never smallest while another is
    there.  Empty texts equal each other.  Rows repeating an id with an equal
    text count in ``group_size`` and are all marked like that id.  Empty input:
    empty output.  Input columns named like the result's are replaced."""
    found = copies(docs, id_col, text_col, prefix_words).drop("_am_rows").withColumnsRenamed({"_am_id": "_am_of", "_am_tie": "_am_with"})
    names = carried(docs, [x for x in [*_MADE, *_HELP] if x.lower() not in (id_col.lower(), text_col.lower())])
    rows = docs.select(*map(q, names)).withColumn("_am_tie", row_tie(text_col))
    rows = sifted(rows, sieve(found, F.col("_am_of"), F.col("_am_with")), q(id_col), F.col("_am_tie"))
    alone = rows.where(~F.col("_am_maybe")).select(*map(q, names), q(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("full_hash"))
    same = q(id_col).eqNullSafe(F.col("_am_of")) & (F.col("_am_tie") == F.col("_am_with"))
    # where a group's ids are all null, so is the one it keeps
    keep = F.when(F.col("_am_size").isNull(), q(id_col)).otherwise(F.col("_am_keep"))
    both = rows.where("_am_maybe").join(found, same, "left")
    return alone.unionByName(
        both.select(*map(q, names), keep.alias("keep_id"), F.coalesce("_am_size", F.lit(1)).cast("long").alias("group_size"), q(id_col).eqNullSafe(keep).alias("kept"), F.col("_am_hash").alias("full_hash"))
    )


def kept_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_words: int = PREFIX_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of equal texts
    the smallest id's; of rows that repeat an id with an equal text one.  Null
    texts are empty, null ids come last, empty input gives empty output."""
    found = copies(docs, id_col, text_col, prefix_words)
    members = found.select("_am_id", "_am_tie", F.col("_am_hash").alias("_am_part"), F.explode(F.sequence(F.lit(1), F.least("_am_rows", F.lit(2)).cast("int"))).alias("_am_nth"))
    return one_of_each(docs, id_col, text_col, members.drop("_am_nth"))
