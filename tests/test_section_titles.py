"""Titles are read whole, however long."""

from pyspark.sql import functions as F

from tiersift.functions.sections import hierarchy_parts, is_method, is_noise, leaf_title, listed_parts, section_key, with_headings


def test_keywords_beyond_sixty_characters(spark):
    long = "a title that goes on and on for a good many more than sixty characters "
    rows = spark.createDataFrame([(long + "references",), (long + "methodology",), (long,)], "t string").select(is_noise(F.col("t")).alias("n"), is_method(F.col("t")).alias("m")).collect()
    assert [(r.n, r.m) for r in rows] == [(True, False), (False, True), (False, False)]


def test_hierarchies(spark):
    rows = spark.createDataFrame([("A >  > B ", "x", None), (None, " x ", [" A", "", "B"]), ("", None, [])], "h string, t string, l array<string>")
    parts = hierarchy_parts(F.col("h"))
    got = rows.select(section_key(parts, F.col("t")).alias("k"), leaf_title(section_key(parts, F.col("t"))).alias("leaf"), listed_parts(F.col("l")).alias("l"), with_headings(parts, F.lit("body")).alias("w")).collect()
    assert [(r.k, r.leaf, r.l, r.w) for r in got] == [("A > B", "B", [], "[A > B]\nbody"), ("x", "x", ["A", "B"], "body"), ("Document", "Document", [], "body")]
