"""Boxes on pages: merging, containment, gaps, filters, page classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .ordered import by_group


def merged(boxes: DataFrame, by: list[str], overlap: float = 0.3, gap: int = 50) -> DataFrame:
    """Bounding boxes of the connected components of each page's boxes under
    :func:`assaymill.functions.geometry.mergeable`; ``parts`` counts them."""
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", x1 long, y1 long, x2 long, y2 long, parts int"

    def make(key: tuple, columns: list) -> list[tuple]:
        b = list(zip(*(c.tolist() for c in columns)))
        parent = list(range(len(b)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, (ax1, ay1, ax2, ay2) in enumerate(b):
            for j in range(i + 1, len(b)):
                bx1, by1, bx2, by2 = b[j]
                if bx1 - ax2 > gap:
                    break  # sorted by x1: the rest is too far right
                if max(0, min(ay2, by2) - max(ay1, by1)) / max(min(ay2 - ay1, by2 - by1), 1) >= overlap:
                    parent[root(i)] = root(j)
        groups: dict[int, list] = {}
        for i, x in enumerate(b):
            groups.setdefault(root(i), []).append(x)
        return [(min(x[0] for x in g), min(x[1] for x in g), max(x[2] for x in g), max(x[3] for x in g), len(g)) for g in groups.values()]

    sides = ["x1", "y1", "x2", "y2"]
    return by_group(boxes, by, sides, sides, make, schema)


def inside(boxes: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """Boxes whose centre lies in a table (``tx1 .. ty2``), with that table's
    columns: an equi-join by page with a range predicate."""
    outer = G.box("t")
    return boxes.join(tables, by).where(G.holds_centre(outer, G.box()))


def close_row_gaps(boxes: DataFrame, tables: DataFrame, by: list[str], most: int = 80) -> DataFrame:
    """Boxes in a table with gaps of 1 to 79 to the box above closed upward,
    then what is left below closed downward against the new tops.  Boxes go by
    their top and number, those equal in both by their other sides, so that the
    order of the rows decides nothing."""
    key = [*by, "table_no"]
    order = Window.partitionBy(*key).orderBy("y1", "box_no", "x1", "x2", "y2")
    rows = inside(boxes, tables, by)
    up = F.col("y1") - F.lag("y2").over(order)
    rows = rows.withColumn("_y1", F.when(up.between(1, most - 1), F.lag("y2").over(order)).otherwise(F.col("y1")))
    down = F.lead("_y1").over(order) - F.col("y2")
    rows = rows.withColumn("_y2", F.when(down.between(1, most - 1), F.lead("_y1").over(order)).otherwise(F.col("y2")))
    return rows.select(*key, "box_no", "x1", F.col("_y1").alias("y1"), "x2", F.col("_y2").alias("y2"))


def without_spanning(boxes: DataFrame, tables: DataFrame, by: list[str], page_height: str = "page_h") -> DataFrame:
    """Boxes no taller than 70 % of the page, or in a table, or wider than 800."""
    held = inside(boxes, tables, by).select(*by, "box_no").distinct().withColumn("_in", F.lit(True))
    tall = (F.col("y2") - F.col("y1")) > 0.7 * F.col(page_height)
    return boxes.join(held, [*by, "box_no"], "left").where(~tall | F.col("_in").isNotNull() | ((F.col("x2") - F.col("x1")) > 800)).drop("_in")


def wide_columns(columns: DataFrame, by: list[str], least: float = 0.3) -> DataFrame:
    """Columns (x1, x2) of at least 30 % of the table's width; all of them where
    none is."""
    wide = (F.col("x2") - F.col("x1")) >= least * F.col("table_w")
    n = F.count_if(wide).over(Window.partitionBy(*by))
    return columns.withColumn("_n", n).where((F.col("_n") == 0) | wide).drop("_n")


def pitch_rows(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Row tops of a table by its mean pitch, walked from the first box up and
    down to the table's edges (ty1, ty2)."""
    order = Window.partitionBy(*by).orderBy("y1")
    step = F.col("y1") - F.lag("y1").over(order)
    pitch = boxes.withColumn("_d", step).groupBy(*by, "ty1", "ty2").agg(F.avg("_d").alias("pitch"), F.min("y1").alias("first"))
    pitch = pitch.where("pitch >= 1")
    k = F.sequence(F.ceil((F.col("ty1") - F.col("first")) / F.col("pitch")).cast("int"), F.floor((F.col("ty2") - F.col("first")) / F.col("pitch")).cast("int"))
    return pitch.select(*by, F.explode(k).alias("k"), "pitch", "first").select(*by, F.floor(F.col("first") + F.col("k") * F.col("pitch")).alias("y1"))


def page_classes(clusters: DataFrame, by: list[str], least: float = 0.25) -> DataFrame:
    """Per page the count and best confidence of each label above the cut, and
    whether it has structures or tables."""
    per = clusters.where(F.col("conf") >= least).groupBy(*by, "label").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("conf").alias("best"))
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", c))))
    out = per.groupBy(*by).agg(
        entry("n").alias("categories"), entry("best").alias("confidence"), F.max("best").alias("max_conf"),
        F.bool_or(F.col("label").isin("picture", "formula", "chart")).alias("has_structures"), F.bool_or(F.col("label") == "table").alias("has_tables"),
    )
    return out.withColumn("should_process", F.col("has_structures") | F.col("has_tables"))


def routed(primary: DataFrame, verifier: DataFrame, by: list[str], trust: float = 0.8) -> DataFrame:
    """The primary class where it is sure, else the verifier's where there is
    one; ``route`` says which decided."""
    v = verifier.select(*by, F.col("page_class").alias("_v"))
    sure = F.coalesce(F.col("max_conf") > trust, F.lit(False))
    return primary.join(v, by, "left").select(
        *by, F.when(sure, F.col("page_class")).otherwise(F.coalesce("_v", "page_class")).alias("page_class"), F.when(sure, "primary").when(F.col("_v").isNull(), "fallback").otherwise("verifier").alias("route")
    )


def rescued(pages: DataFrame, positive: DataFrame, rescue: DataFrame, by: list[str]) -> DataFrame:
    """Positive pages and those leftover pages a second model accepts."""
    left = pages.select(*by).join(positive.select(*by), by, "left_anti")
    return positive.select(*by).union(left.join(rescue.where("accepted").select(*by), by, "left_semi")).distinct()


def label_words(words: DataFrame, margin: float = 0.15) -> DataFrame:
    """Words in the left margin read as labels, with their centres."""
    from ..functions.text import label_id

    return words.where(F.col("x") < margin * F.col("page_w")).withColumn("label", label_id(F.col("text"))).where("label is not null").withColumn("yc", F.col("y") + F.col("h") / 2)


def strips(words: DataFrame, columns: DataFrame, by: list[str], width: int = 160, least: int = 30) -> DataFrame:
    """Words in the strip left of each column of drawings."""
    return words.join(columns.where(F.col("column_x") >= least), by).where((F.col("x") >= F.col("column_x") - width) & (F.col("x") < F.col("column_x")))


def filled_columns(boxes: DataFrame, by: list[str], least: int = 6) -> DataFrame:
    """Boxes inferred in gaps of half-page columns: on pages with six boxes or
    more, where the step to the next box of a half is at least 1.7 pitches (its
    median step), copies of the upper box one pitch further each."""
    side = F.when((F.col("x1") + F.col("x2")) / 2 < F.col("page_w") / 2, "left").otherwise("right")
    b = boxes.withColumn("side", side).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least)
    order = Window.partitionBy(*by, "side").orderBy("y1", "x1")
    b = b.withColumn("_step", F.lead("y1").over(order) - F.col("y1"))
    pitch = b.where("_step > 0").groupBy(*by, "side").agg(F.percentile("_step", 0.5).alias("_pitch"))
    gaps = b.join(pitch, [*by, "side"]).where(F.col("_step") >= 1.7 * F.col("_pitch"))
    k = F.sequence(F.lit(1), F.round(F.col("_step") / F.col("_pitch")).cast("int") - 1)
    down = F.floor(F.col("_k") * F.col("_pitch")).cast("long")
    return gaps.withColumn("_k", F.explode(k)).select(*by, "side", F.col("x1").cast("long").alias("x1"), (F.col("y1") + down).alias("y1"), F.col("x2").cast("long").alias("x2"), (F.col("y2") + down).alias("y2"))


def structure_columns(columns: DataFrame, boxes: DataFrame, remembered: DataFrame, by: list[str]) -> DataFrame:
    """Per table the columns (column_no, x1, x2) that hold a box's centre, else
    those remembered for it, else its second, else its first."""
    b = boxes.select(*by, ((F.col("x1") + F.col("x2")) / 2).alias("_c"))
    held = columns.join(b, by).where(F.col("_c").between(F.col("x1"), F.col("x2"))).select(*by, "column_no", "x1", "x2").distinct().withColumn("_rank", F.lit(0))
    kept = remembered.select(*by, "column_no", "x1", "x2").withColumn("_rank", F.lit(1))
    rest = columns.where("column_no <= 2").select(*by, "column_no", "x1", "x2", F.when(F.col("column_no") == 2, 2).otherwise(3).alias("_rank"))
    every = held.unionByName(kept).unionByName(rest)
    return every.withColumn("_best", F.min("_rank").over(Window.partitionBy(*by))).where("_rank = _best").drop("_rank", "_best")
