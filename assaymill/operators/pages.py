"""Page ranges, page sets and section bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_range(text: str, pages: int) -> set[int]:
    """Pages of ``1-5, 8``; blank is all.  ValueError names what is wrong: an
    empty part, no number, a page below 1, a page past the end, a range that
    runs backward."""
    if not text or not text.strip():
        return set(range(1, pages + 1))
    out: set[int] = set()
    for part in text.split(","):
        part = part.strip()
        if not part:
            raise ValueError("empty part in page range")
        ends = [e.strip() for e in part.split("-", 1)]
        if not all(e.isdigit() for e in ends):
            raise ValueError(f"not a page number: {part}")
        a, b = int(ends[0]), int(ends[-1])
        if min(a, b) < 1:
            raise ValueError(f"pages start at 1: {part}")
        if max(a, b) > pages:
            raise ValueError(f"past the last page {pages}: {part}")
        if a > b:
            raise ValueError(f"range runs backward: {part}")
        out.update(range(a, b + 1))
    return out


def page_list(spec: Column, pages: Column) -> Column:
    """The lenient form as an array: order and repeats stay, pages past either
    end and parts that aren't numbers go."""
    parts = F.transform(F.split(spec, ","), T.stripped)
    ends = lambda p: (F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"(\d+)$", 1).try_cast("int"))
    good = F.filter(parts, lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    ranges = F.transform(good, lambda p: F.when(ends(p)[0] <= ends(p)[1], F.sequence(*ends(p))).otherwise(F.array().cast("array<int>")))
    return F.filter(F.flatten(ranges), lambda k: k.between(1, pages))


def sorted_pages(spec: Column) -> Column:
    """Distinct pages in order, without bounds."""
    return F.array_sort(F.array_distinct(page_list(spec, F.lit(2**31 - 1))))


def pages_to_process(section: DataFrame, detected: DataFrame, pages: DataFrame) -> DataFrame:
    """``file, page``: per file the detected pages in the section; a file with
    no detected page is left out; one whose intersection is empty is processed
    whole."""
    both = section.join(detected, ["file", "page"], "left_semi")
    some = detected.select("file").distinct()
    whole = some.join(both.select("file").distinct(), "file", "left_anti")
    return both.select("file", "page").union(pages.join(whole, "file", "left_semi").select("file", "page")).distinct()


def section_bounds(pages: DataFrame) -> DataFrame:
    """``file, examples_start, claims_start, total_pages``: the first page that
    opens the examples, and the first from there on that opens the claims."""
    text = F.col("text")
    marked = pages.select("file", "page", T.near_section(text).alias("_e"), T.near_section(text, claims=True).alias("_c"))
    starts = marked.groupBy("file").agg(F.min(F.when(F.col("_e"), F.col("page"))).alias("examples_start"), F.max("page").alias("total_pages"))
    ends = marked.where("_c").join(starts, "file").where(F.col("examples_start").isNull() | (F.col("page") >= F.col("examples_start"))).groupBy("file").agg(F.min("page").alias("claims_start"))
    return starts.join(ends, "file", "left").select("file", "examples_start", "claims_start", "total_pages")


def section_pages(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pages from the examples' start to before the claims (or the end)."""
    return pages.join(bounds.where("examples_start is not null"), "file").where(F.col("page").between(F.col("examples_start"), F.coalesce(F.col("claims_start") - 1, F.col("total_pages")))).select("file", "page")


def sampled_pages(total: Column, fractions: list[float]) -> Column:
    """Distinct pages at fractions of a document."""
    return F.array_sort(F.array_distinct(F.array(*[F.greatest(F.lit(1), F.least(total, F.ceil(total * f).cast("int"))) for f in fractions])))


def backward_scan(hits: DataFrame, total: str = "total_pages") -> DataFrame:
    """Claims by the dense last fifth, else every third page back to three
    quarters: the last sampled hit, refined to the earliest hit within 4."""
    p, n = F.col("page"), F.col(total)
    sampled = (p > n * 0.8) | ((p > n * 0.75) & ((n - p) % 3 == 0))
    last = hits.where("hit").where(sampled).groupBy("file").agg(F.max("page").alias("_at"))
    return hits.where("hit").join(last, "file").where(F.abs(p - F.col("_at")) <= 4).groupBy("file").agg(F.min("page").alias("claims_start"))


def refined(hits: DataFrame, approximate: DataFrame, reach: int = 4, earliest: bool = True) -> DataFrame:
    """The earliest (or latest) hit within a few pages of an approximate one."""
    near = hits.where("hit").join(approximate.select("file", F.col("page").alias("_at")), "file").where(F.abs(F.col("page") - F.col("_at")) <= reach)
    return near.groupBy("file").agg((F.min if earliest else F.max)("page").alias("page"))


def top_heading(words: DataFrame, share: float = 0.3) -> DataFrame:
    """``file, page, heading``: the id of the first line in the page's top that
    reads as a heading; words are lines by their centre to 4 points."""
    mid = F.col("y") + F.col("h") / 2
    lines = words.where(mid <= share * F.col("page_h")).groupBy("file", "page", (F.bround(mid / 4) * 4).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda s: s["text"]), " ").alias("text"))
    return lines.withColumn("heading", T.heading_id(F.col("text"))).where("heading is not null").groupBy("file", "page").agg(F.min_by("heading", "line").alias("heading"))


def resolved_ids(structures: DataFrame) -> DataFrame:
    """The id of a structure by precedence: a heading for examples, the
    classifier's, the recogniser's, else the running number."""
    heading = F.when(F.col("type") == "example_compound", F.col("heading"))
    return structures.withColumn("compound_id", F.coalesce(T.blank_null(heading), T.blank_null(F.col("classifier_id")), T.blank_null(F.col("ocr_id")), F.col("running_no").cast("string")))
