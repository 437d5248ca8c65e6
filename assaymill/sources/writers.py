"""Writers of the export shapes.  Each writes a folder of part files; one
ordered file comes from ``single=True``, which is for results of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import export, metrics


def _ordered(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1).sortWithinPartitions("result_id") if single else df


def csv(results: DataFrame, assays: DataFrame, path: str, single: bool = False, **options) -> None:
    """Fixed and assay columns with a header."""
    custom = options.pop("custom", None)
    table = export.wide(export.kept_rows(results, **options), assays, custom=custom)
    _ordered(table, single).drop("result_id").write.option("header", True).option("emptyValue", "").option("escape", '"').mode("overwrite").csv(path)


def report(results: DataFrame, path: str, single: bool = False, **options) -> None:
    """The plain report: a summary, then a block per result."""
    rows = export.kept_rows(results, **options)
    head = metrics.summary(rows).select(F.lit(-1).cast("long").alias("result_id"), F.format_string("Total: %d\nValid: %d\nInvalid: %d\n", "total", "valid", "invalid").alias("text"))
    blocks = export.report_lines(rows).select(F.col("result_id").cast("long"), "text")
    _ordered(head.unionByName(blocks), single).select("text").write.mode("overwrite").text(path)


def smiles(results: DataFrame, path: str, **options) -> None:
    export.smiles_lines(results, **options).write.mode("overwrite").text(path)


def sdf(results: DataFrame, path: str, single: bool = False, **options) -> int:
    """SD records; returns how many were written."""
    records = export.sdf_records(results, **options)
    _ordered(records, single).select("value").write.mode("overwrite").text(path)
    return records.count()


def html(results: DataFrame, path: str) -> None:
    """A standalone report: its rows between a head and a foot."""
    rows = export.html_rows(results).select(F.col("result_id").cast("long"), "value")
    frame = results.sparkSession.createDataFrame([(-1, "<html><body><table>"), (2**62, "</table></body></html>")], "result_id long, value string")
    _ordered(rows.unionByName(frame), True).select("value").write.mode("overwrite").text(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
