"""Queries against their SQL on odd inputs."""

import os

import duckdb

from assaymill.plans import catalogue

from .test_catalogue import rows


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over small tables."""
    c = duckdb.connect()
    for t, frame in tables.items():
        path = os.path.join(folder, f"{t}.parquet")
        frame.coalesce(1).write.mode("overwrite").parquet(path)
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    found = catalogue.QUERIES[name](spark, str(folder))
    out = c.sql(catalogue.SQL[name])
    return rows(tuple(r[n] for n in out.columns) for r in found.collect()), rows(out.fetchall())


def test_text_predicates(spark, tmp_path):
    texts = [
        "Example 1 Example 2", "TABLE 1 TABLE 2", "Assay 1 Assay 2 Assay 3 Assay 4", "Ki Ki Ki Ki", "Ki Ki Ki\nKi", "K\n;K,KiK;", "K;\rK,KiK;", "K\x0b;K,KiK;", "K ;K;K;K;", "K;K,KiK;",
        "K; K,KiK;", "K;\u0085K,KiK;", "K;K,KİK;", "k ,KIk\f;ki", "K;K,Ki\nx K; K; K; K", "Licensed\n", "", None,
    ]
    got, expected = both(spark, tmp_path, "q_text_predicates", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == expected


def test_row_gaps_ties(spark):
    """Boxes equal in top and number: the order of the rows decides nothing."""
    from assaymill.operators import layout

    boxes = [(1, 0, 20, 10, 40), (2, 5, 60, 25, 90), (2, 9, 60, 12, 90), (2, 9, 60, 30, 90), (3, 0, 120, 20, 150)]
    page = spark.createDataFrame([(1, 1, 0, 0, 500, 500)], "page int, table_no int, tx1 int, ty1 int, tx2 int, ty2 int")
    closed = [
        rows(layout.close_row_gaps(spark.createDataFrame([(1, *b) for b in x], "page int, box_no int, x1 int, y1 int, x2 int, y2 int").coalesce(1), page, ["page"]).collect())
        for x in (boxes, boxes[::-1], boxes[2:] + boxes[:2])
    ]
    assert closed[0] == closed[1] == closed[2]
    # y2 of the box above and y1 of the box below
    assert closed[0][1] == repr((1.0, 1.0, 2.0, 5.0, 40.0, 25.0, 90.0))
