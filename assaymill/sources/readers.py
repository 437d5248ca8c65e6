"""Readers: documents as binary files, fixtures, truths, predictions.

Everything goes through Spark's readers, so any store Spark knows will do;
parsing happens on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

WORDS = "file string, page int, seq int, text string, x int, y int, w int, h int, conf int"
CELLS = "file string, page int, table_no int, row_no int, cells array<string>"
CLUSTERS = "file string, page int, label string, conf double, l double, t double, r double, b double, origin string, page_w double, page_h double"
PREDICTIONS = "file string, page int, structure_index int, smiles string"


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, file_name, length, content``: the full path is the key, the base
    name for display; unreadable files fail by file, in a backend's error
    column, not here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", "content")


def page_numbers(documents_with_count: DataFrame) -> DataFrame:
    """One row per page of documents that have ``page_count``."""
    return documents_with_count.where("page_count > 0").withColumn("page", F.explode(F.sequence(F.lit(1), F.col("page_count"))))


def count_truth(spark: SparkSession, path: str) -> DataFrame:
    """``patent, filename, page, expected, examples, notes`` of a JSON truth of
    expected counts per page."""
    raw = spark.read.schema("patents array<struct<id:string,filename:string,notes:string,pages:array<struct<page:int,expected_count:int,examples:string,notes:string>>>>").json(path, multiLine=True)
    patents = raw.select(F.explode("patents").alias("p"))
    pages = patents.select(F.col("p.id").alias("patent"), F.col("p.filename").alias("filename"), F.explode("p.pages").alias("g"))
    return pages.select("patent", "filename", "g.page", F.col("g.expected_count").alias("expected"), X.blank_null(F.col("g.examples")).alias("examples"), X.blank_null(F.col("g.notes")).alias("notes"))


def box_labels(spark: SparkSession, path: str, file: str) -> DataFrame:
    """``file, page, box_no, type, id, x1 .. y2`` of a JSON object of pages of
    labelled boxes."""
    box = "struct<type:string,id:string,bbox:array<int>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<image_file:string,n_structures:int,structures:map<string,{box}>>>").alias("m"))
    pages = raw.select(F.explode("m").alias("page", "p")).select(F.col("page").cast("int"), F.explode("p.structures").alias("box_no", "b"))
    return pages.select(F.lit(file).alias("file"), "page", F.col("box_no").cast("int"), "b.type", "b.id", *[F.try_element_at("b.bbox", F.lit(k + 1)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def strings_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def image_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Image and SMILES pairs, with the document and compound id their file
    names encode."""
    rows = strings_csv(spark, path)
    name = F.regexp_extract("file_path", r"([^/\\]+?)(?:\.[^.]*)?$", 1)
    return rows.withColumn("patent", F.regexp_extract(name, r"^(.*)_[^_]*$", 1)).withColumn("compound_id", F.regexp_extract(name, r"_([^_]*)$", 1))


def truth_table(rows: DataFrame, required: bool = True) -> DataFrame:
    """``compound_id, smiles`` of a sheet read as text: columns found by their
    names, the first two where none fits; of equal ids the last row counts.
    ``required`` raises ValueError when there is no second column."""
    low = {c.lower(): c for c in rows.columns}
    pick = lambda *words: next((c for k, c in low.items() if any(w in k for w in words)), None)
    smiles, name = pick("smiles"), pick("compound", "example", "cpd", "id", "no")
    if required and smiles is None and len(rows.columns) < 2:
        raise ValueError("no SMILES column")
    name, smiles = name or rows.columns[0], smiles or rows.columns[1]
    numbered = rows.select(X.truth_id(F.col(f"`{name}`")).alias("compound_id"), F.col(f"`{smiles}`").alias("smiles"), F.monotonically_increasing_id().alias("_k"))
    return numbered.where("compound_id <> '' and smiles <> ''").groupBy("compound_id").agg(F.max_by("smiles", "_k").alias("smiles"))


def workbook(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet as text columns.  Needs a reader engine for pandas; a sheet is
    read on the driver, as workbooks are single small files."""
    import pandas as pd

    sheet_rows = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(sheet_rows.astype(object).where(sheet_rows.notna(), None), T.StructType([T.StructField(str(c), T.StringType()) for c in sheet_rows.columns]))


def resolved_images(refs: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")) -> DataFrame:
    """``ref, path``: the file of each reference by stem, whatever its case;
    the exact name first, then by extension in order."""
    base = lambda c: F.regexp_extract(c, r"([^/\\]+)$", 1)
    stem = lambda c: F.lower(F.regexp_replace(base(c), r"\.[^.]*$", ""))
    f = files.select("path", stem(F.col("path")).alias("_s"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("_e"), base(F.col("path")).alias("_b"))
    rank = F.coalesce(*[F.when(F.col("_e") == e, F.lit(k + 1)) for k, e in enumerate(extensions)])
    both = refs.select("ref", stem(F.col("ref")).alias("_s"), base(F.col("ref")).alias("_r")).join(f.where(rank.isNotNull() | F.lit(True)), "_s")
    order = F.when(F.col("_b") == F.col("_r"), 0).otherwise(rank)
    return both.where(order.isNotNull()).groupBy("ref").agg(F.min_by("path", F.struct(order, "path")).alias("path"))
