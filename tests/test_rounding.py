"""Registered queries against their SQL on values whose seventh decimal is a half."""

import duckdb

from corvane.plans import catalog


def differing(spark, folder, name, rows):
    """(Spark's rows that SQL has not, SQL's rows that Spark has not) of a query over documents (doc_id, text)."""
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = c.sql(catalog.SQL[name])
    got, rows = {tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*want.columns).collect()}, set(want.fetchall())
    return got - rows, rows - got


def test_chunk_text_richness_rounds_as_its_sql(spark, tmp_path):
    # 640 words of which so many are distinct, in three paragraphs: a / 3200 added to thousandths.
    gap = lambda i: "\n\n" if i in (200, 400) else " "
    rows = [(a, "".join(f"{gap(i)}word{i % a:03}" for i in range(640))) for a in (11, 61, 111, 161, 211)]
    assert differing(spark, tmp_path, "chunk_text_richness", rows) == (set(), set())

def test_text_quality_rounds_as_its_sql(spark, tmp_path):
    # So many of 640 lines are alike.
    rows = [(n, "\n".join(["the same line"] * n + [f"line {i} stands alone" for i in range(640 - n)])) for n in (41, 323, 333)]
    assert differing(spark, tmp_path, "text_quality", rows) == (set(), set())
