from pyspark.sql import functions as F

from reportloom.functions import drafts as D


def test_replaced_takes_other_columns_and_null(spark):
    df = spark.createDataFrame([("a1b22", "x"), ("none", "y"), ("7", "z"), (None, "x"), ("", "x")], "t string, o string")
    got = [r[0] for r in df.select(D.replaced(F.col("t"), r"\d+", lambda hit: F.concat(F.col("o"), hit))).collect()]
    assert got == ["ax1bx22", "none", "z7", "", ""]


def test_levels_of_an_empty_document_and_many_marks(spark):
    df = spark.createDataFrame([([],), (["□", "-"] * 300,)], "kinds array<string>")
    empty, many = (r[0] for r in df.select(D.levels_by_order(F.col("kinds"))).collect())
    assert empty == [] and many == [1, 2] * 300


def test_tables_of_odd_shapes_stay(spark):
    df = spark.createDataFrame([([],), ([["구분"]],), ([["구분", "1안", "2안"]],), ([["구분", "1안", "2안"], ["내용", "가"]],)], "rows array<array<string>>")
    got = df.select("rows", D.table_oriented(F.col("rows")).alias("turned"), D.table_as_ordinals(F.col("rows")).alias("lines")).collect()
    assert all(r["turned"] == r["rows"] for r in got)
    assert [r["lines"] for r in got[:2]] == [None, None] and got[3]["lines"] is None
