"""Wide tables of cells to long assay records.

``cells`` has one row per table row: ``file, page, table_no, row_no, cells``
(array of strings), row 0 the header.  Everything is higher-order functions
over the row and one join of rows with their table's header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .ordered import parts as parts_of

TABLE = ["file", "page", "table_no"]
# Words that make a table biological.
TABLE_WORDS = r"(?iu)ic50|ec50|ic 50|ec 50|\bki\b|\bkd\b|gi50|emax|inhibition|activity|assay|potency|binding|nm|μm|um\b|mm"


def with_header(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """``id_at`` and ``columns`` (``array<struct<at, name>>``) of header rows:
    the first cell naming compounds (else the first cell), and the other named
    columns; of equal names the last one counts.  Names are made once per cell,
    in a projection of their own."""
    is_id = F.transform(cells, lambda c: F.coalesce(c.rlike(r"(?i)compound|cpd|cmpd|no\.?|#|example|ex\.?|structure"), F.lit(False)))
    made = rows.withColumn("id_at", F.greatest(F.array_position(is_id, True) - 1, F.lit(0)).cast("int")).withColumn("_names", F.transform(cells, T.header_name))
    last = F.transform("_names", lambda n, k: F.struct(k.alias("at"), n.alias("name")))
    # the last of equal names: none like it in what follows
    last = F.filter(last, lambda x: x["name"].isNotNull() & (x["at"] != F.col("id_at")) & ~F.exists(F.slice("_names", x["at"] + 2, F.size("_names")), lambda n: F.coalesce(n == x["name"], F.lit(False))))
    return made.withColumn("columns", last).drop("_names")


def is_biological(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """The tables (``file, page, table_no``) with two rows or more whose first
    three hold an assay word, a value with a unit or an activity symbol.
    Dealt over ``parts`` partitions by table, as in :func:`long_assays`."""
    words = F.lower(F.array_join(F.filter("cells", lambda c: c.isNotNull()), " "))
    symbol = F.exists("cells", lambda c: F.coalesce(T.stripped(c).rlike(r"^[+＋]{1,5}$|^[-−–—]{1,5}$"), F.lit(False)))
    unit = words.rlike(r"(?iu)[<>≤≥]?\s*\d+\.?\d*\s*[nμump]?M")
    hit = ((F.col("row_no") < 3) & words.rlike(TABLE_WORDS)) | (F.col("row_no").isin(1, 2) & (unit | symbol))
    marked = rows.select(*TABLE, hit.alias("hit")).repartition(parts or parts_of(rows), *TABLE)
    return marked.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"), F.bool_or("hit").alias("hit")).where("n >= 2 and hit").select(*TABLE)


def long_assays(rows: DataFrame, only: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """``file, page, table_no, row_no, compound_id, assay, value``: one record
    per id, column and value.  Of rows with one id in a table the last wins.
    ``only`` restricts the tables: it meets the headers, and rows follow them.

    One shuffle by table serves the join with the header and the window over
    the ids; it deals the rows over ``parts`` partitions (by default one per
    250,000 rows, which are counted), so that a task's sorts don't grow with the
    input.  Cells are parsed after they have become rows, where a subexpression
    is evaluated once."""
    rows = rows.repartition(parts or parts_of(rows), *TABLE)
    heads = with_header(rows.where("row_no = 0")).select(*TABLE, "id_at", "columns")
    heads = heads if only is None else heads.join(only, TABLE, "left_semi")
    body = rows.where("row_no > 0").join(heads, TABLE)
    # an index past a short row is no cell
    body = body.withColumn("compound_id", F.explode(F.array(T.table_id(F.try_element_at("cells", F.col("id_at") + 1))))).where("compound_id is not null")
    newest = F.max("row_no").over(Window.partitionBy(*TABLE, "compound_id"))
    body = body.withColumn("_last", newest).where("row_no = _last")
    cells = body.select(*TABLE, "row_no", "compound_id", "cells", F.inline("columns")).withColumn("cell", F.try_element_at("cells", F.col("at") + 1))
    # a generator evaluates the parser once; a filter or a later use would repeat it
    return cells.select(*TABLE, "row_no", "compound_id", F.col("name").alias("assay"), F.explode(F.array(T.parse_value(F.col("cell")))).alias("value")).where("value is not null")


def text_lines(pages: DataFrame) -> DataFrame:
    """``file, page, line_no, compound_id, assay, value`` of text pages: the
    first line with an assay word names the assays; lines that start with an id
    give them values by position, the later line those it has.  Analytical and
    two-column pages are left out."""
    fit = pages.where(~T.is_analytical(F.col("text")) & ~T.looks_two_column(F.col("text")))
    lines = F.split("text", "\n")
    first = F.try_element_at(F.filter(F.transform(lines, F.lower), lambda x: x.rlike("ic50|ec50|ki|kd|inhibition|activity")), F.lit(1))
    assays = F.filter(F.array(*[F.lit(a) for a in ("ic50", "ec50", "ki", "kd")]), lambda a: F.coalesce(F.contains(first, a), F.lit(False)))
    assays = F.when(F.size(assays) > 0, assays).otherwise(F.array(F.lit("ic50")))
    out = fit.select("file", "page", assays.alias("assays"), F.posexplode(lines).alias("line_no", "line"))
    out = out.withColumn("compound_id", T.repair_digits(T.found(F.col("line"), T.COMPOUND_LINE, 1))).withColumn("rest", T.found(F.col("line"), T.COMPOUND_LINE, 2))
    out = out.where("compound_id is not null").where(~F.col("compound_id").rlike(r"^\d[HhDd]$"))
    values = F.regexp_extract_all("rest", F.lit(r"(?iu)([+＋]{1,5}|[-−–—]{1,5}|[\d.]+\s*[nμump]?M|ND|NA|NT)"), F.lit(1))
    zipped = F.filter(F.transform(F.arrays_zip(F.col("assays").alias("assay"), values.alias("value")), lambda z: z), lambda z: z["assay"].isNotNull() & z["value"].isNotNull())
    found = out.select("file", "page", "line_no", "compound_id", F.inline(zipped))
    return found.groupBy("file", "page", "compound_id", "assay").agg(F.max("line_no").alias("line_no"), F.max_by("value", "line_no").alias("value"))


def single_values(pages: DataFrame) -> DataFrame:
    """``file, page, compound_id, value`` of pages whose lines give one value
    per compound: up to five pluses, else a number with its unit, else a mark
    for inactive.  The later of equal ids wins; other lines are passed over."""
    lines = pages.select("file", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", T.stripped(F.col("line")))
    out = lines.select("file", "page", "line_no", T.found(F.col("line"), T.COMPOUND_LINE, 1).alias("compound_id"), F.explode(F.array(T.plus_signs(T.found(F.col("line"), T.COMPOUND_LINE, 2)))).alias("rest"))
    out = out.where(F.col("compound_id").isNotNull() & ~F.col("compound_id").rlike(r"^\d[HhDd]$"))
    pluses = F.regexp_count(F.regexp_extract("rest", T.PLUS_RUN, 1), F.lit("[+＋]"))
    value = F.coalesce(
        F.when(pluses > 0, F.repeat(F.lit("+"), F.least(pluses, F.lit(5)))), T.stripped(T.found(F.col("rest"), T.VALUE_WITH_UNIT, 1)), F.when(F.col("rest").rlike(T.INACTIVE), F.lit("-"))
    )
    found = out.withColumn("value", value).where("value is not null")
    return found.groupBy("file", "page", "compound_id").agg(F.max_by("value", "line_no").alias("value"))


def text_triples(pages: DataFrame) -> DataFrame:
    """``file, page, compound_id, assay, value`` of running text that says
    "compound N: assay = value"; the later of equal ids and assays wins."""
    pattern = r"(?iu)(?:compound|cpd|ex\.?|example)\s*(\d+[a-z]?)\s*[:\-]?\s*(ic50|ec50|ki|kd)\s*[=:\-]?\s*([<>≤≥±~]?\s*[\d.]+\s*(?:nM|μM|uM|mM|pM)?|\+{1,5})"
    part = lambda k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    hits = pages.select("file", "page", F.posexplode(F.arrays_zip(part(1).alias("i"), part(2).alias("a"), part(3).alias("v"))).alias("seq", "h"))
    keyed = hits.select("file", "page", "seq", T.repair_digits(F.col("h.i")).alias("compound_id"), F.lower("h.a").alias("assay"), T.stripped(F.col("h.v")).alias("value"))
    return keyed.groupBy("file", "page", "compound_id", "assay").agg(F.max_by("value", "seq").alias("value"))


def low_quality(records: DataFrame, by: list[str]) -> DataFrame:
    """Groups with fewer than two compounds, or values for fewer than half."""
    per = records.groupBy(*by, "compound_id").agg(F.count("value").alias("n"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("compounds"), F.count_if(F.col("n") > 0).alias("valued")).withColumn("low_quality", (F.col("compounds") < 2) | (F.col("valued") * 2 < F.col("compounds")))


def better_of(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Of two extractions the one with more filled fields wins each group, ties
    go to ``b``; the winner's gaps are filled from the loser."""
    both = a.withColumn("way", F.lit(1)).unionByName(b.withColumn("way", F.lit(0)))
    score = both.groupBy(*by, "way").agg(F.count("value").alias("score"))
    best = score.groupBy(*by).agg(F.max_by("way", F.struct("score", -F.col("way"))).alias("best"))
    ranked = both.join(best, by)
    return ranked.groupBy(*by, "compound_id", "assay").agg(F.min_by("value", (F.col("way") != F.col("best")).cast("int")).alias("value"))
