"""Tables from word boxes: columns by position, rows by clustering.

``words`` has ``file, page, seq, text, x, y, w, h, conf``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching, ordered

PAGE = ["file", "page"]
ASSAY_WORD = r"(?i)^(?:IC\s*50|EC\s*50|GI\s*50|CC\s*50|Ki|Kd|Emax|Assay.*|.*inhibition.*|Activity)$"


def from_text(docs: DataFrame, file: str, text: str, char_w: int = 8, line_h: int = 20) -> DataFrame:
    """Word boxes of plain text: lines as y, offsets as x; one page a file."""
    lines = docs.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("line", "s"))
    cells = lines.select("file", "line", F.posexplode(F.split("s", " ")).alias("k", "text"), "s")
    offset = F.length(F.array_join(F.slice(F.split("s", " "), 1, F.col("k")), " ")) + F.when(F.col("k") > 0, 1).otherwise(0)
    return cells.select("file", F.lit(1).alias("page"), F.col("line"), F.col("k"), "text", (offset * char_w).alias("x"), (F.col("line") * line_h).alias("y"), (F.length("text") * char_w).alias("w"), F.lit(line_h - 4).alias("h"), F.lit(96).alias("conf")).where("text <> ''")


def rows_of(words: DataFrame, tolerance: float = 15, least_conf: int = 30) -> DataFrame:
    """Words of enough confidence with ``row``: anchored clusters of their
    tops."""
    sure = words.where(F.col("conf") >= least_conf).where(T.stripped(F.col("text")) != "")
    return ordered.anchored(sure, PAGE, "y", tolerance, ["x", "seq"], "row")


def header_score(rows: DataFrame) -> DataFrame:
    """``file, page, row, score``: assay words of a row, half a point for an id
    word and for three cells, two off for long prose."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda s: s["text"]), " ")
    per = rows.groupBy(*PAGE, "row").agg(joined.alias("line"), F.count(F.lit(1)).alias("n"))
    patterns = (r"(?i)ic\s*50", r"(?i)ec\s*50", r"(?i)gi\s*50", r"(?i)\bki\b", r"(?i)\bkd\b", r"(?i)emax", r"(?i)inhibition", r"(?i)\(\s*[nμu]M\s*\)")
    score = sum((F.col("line").rlike(p).cast("double") for p in patterns), F.lit(0.0))
    score = score + F.when(F.col("line").rlike(r"(?i)\b(?:example|compound|cpd|no)\b"), 0.5).otherwise(0.0) + F.when(F.col("n") >= 3, 0.5).otherwise(0.0) - F.when((F.length("line") > 100) & (F.col("n") > 12), 2.0).otherwise(0.0)
    return per.select(*PAGE, "row", "line", score.alias("score"))


def header_row(rows: DataFrame) -> DataFrame:
    """The first row of the best score of at least 1 on each page."""
    s = header_score(rows).where("score >= 1")
    return s.groupBy(*PAGE).agg(F.max_by(F.struct("row", "line", "score"), F.struct("score", -F.col("row"))).alias("h")).select(*PAGE, "h.*")


def ids_of(words: DataFrame, left: float = 0.28, top: float = 0.12) -> DataFrame:
    """Words in the left band under the page's top that read as ids, each id's
    first occurrence, outliers dropped."""
    band = words.where((F.col("x") < left * F.col("page_w")) & (F.col("y") > top * F.col("page_h")) & (F.col("conf") >= 30))
    text = F.when(F.length("text") <= 6, T.repair_digits(F.col("text"))).otherwise(F.col("text"))
    ids = band.withColumn("compound_id", T.found(text, r"^(\d{1,4}(?:-\d{1,4})?[a-zA-Z]?)$")).where("compound_id is not null")
    first = ids.groupBy(*PAGE, "compound_id").agg(F.min_by(F.struct("seq", "x", "y", "h"), F.struct("y", "x", "seq")).alias("f")).select(*PAGE, "compound_id", "f.*")
    number = first.withColumn("_number", F.regexp_extract("compound_id", r"^(\d+)", 1).cast("int"))
    return ordered.inside_limits(number, PAGE, "_number").drop("_number").withColumn("yc", F.col("y") + F.col("h") / 2)


def values_by_column(words: DataFrame, columns: DataFrame, ids: DataFrame, limit: float = 100) -> DataFrame:
    """``file, page, assay, compound_id, value``: in each column band (x_low,
    x_high, assay) each id, from the top, takes the nearest unused value."""
    pct = 100 * F.col("x") / F.col("page_w")
    v = words.join(columns, PAGE).where(F.col("x").between(F.col("x_low"), F.col("x_high")))
    v = v.withColumn("value", T.ocr_value(T.plus_signs(F.col("text")), pct)).where("value is not null")
    v = v.select(*PAGE, "assay", F.col("seq").alias("word"), (F.col("y") + F.col("h") / 2).alias("at"), "value")
    asked = ids.join(columns.select(*PAGE, "assay"), PAGE).select(*PAGE, "assay", F.col("seq").alias("asked"), "compound_id", "yc")
    hits = matching.nearest(asked, v, [*PAGE, "assay"], "yc", "at", limit, "asked", "word", ["yc", "asked"])
    named = hits.join(asked.select(*PAGE, "assay", "asked", "compound_id"), [*PAGE, "assay", "asked"])
    return named.join(v.select(*PAGE, "assay", F.col("word").cast("long").alias("word"), "value"), [*PAGE, "assay", "word"]).select(*PAGE, "assay", "compound_id", "value")


def numeric_columns(words: DataFrame, ids: DataFrame, least: int = 3, share: float = 0.3, tolerance: float = 40) -> DataFrame:
    """Unnamed value columns: anchored clusters of numbers' x with at least
    three words and 30 % of the ids, named Assay_k from the left."""
    from pyspark.sql.window import Window

    pct = 100 * F.col("x") / F.col("page_w")
    numbers = words.where(T.ocr_value(F.col("text"), pct).isNotNull()).where(pct > 28)
    clusters = ordered.anchored(numbers.select(*PAGE, "x", "seq"), PAGE, "x", tolerance, ["seq"])
    n = ids.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_ids"))
    per = clusters.groupBy(*PAGE, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_low"), F.max("x").alias("x_high")).join(n, PAGE)
    good = per.where((F.col("n") >= least) & (F.col("n") >= share * F.col("_ids")))
    return good.select(*PAGE, F.concat(F.lit("Assay_"), F.row_number().over(Window.partitionBy(*PAGE).orderBy("x_low"))).alias("assay"), "x_low", "x_high")


def halves(words: DataFrame) -> DataFrame:
    """``side``: the half of the page a word's centre is in."""
    return words.withColumn("side", F.when(F.col("x") + F.col("w") / 2 < F.col("page_w") / 2, "left").otherwise("right"))


def two_columns(words: DataFrame) -> DataFrame:
    """Pages with a header word both left of 40 % and right of 50 %."""
    heads = words.where(F.col("text").rlike(r"(?i)^(?:example|compound|no\.?|cpd\.?)$"))
    per = heads.groupBy(*PAGE).agg(F.bool_or(F.col("x") < 0.4 * F.col("page_w")).alias("l"), F.bool_or(F.col("x") > 0.5 * F.col("page_w")).alias("r"))
    return per.where("l and r").select(*PAGE)
