"""Proofs of repairs and sections of headings on small cases."""

from pyspark.sql import functions as F

from scholia_spark.operators import repair as P


def proven(spark, cells, rebuilt, page, rotated=()):
    df = spark.createDataFrame([(list(cells), list(rebuilt), page, list(rotated))], "c array<string>, r array<string>, p string, t array<string>")
    return df.select(P.rebuild_proven(*map(F.col, "crpt"))).first()[0]


def test_proof(spark):
    assert proven(spark, ["1 2 3"], ["1", "2", "3"], "1 2 3")
    assert not proven(spark, ["1 2 3"], ["1", "2"], "1 2 3")  # reads less
    assert not proven(spark, ["1"], ["1", "4"], "1 2 3")  # not printed
    assert not proven(spark, ["1"], [], "1") and not proven(spark, ["1"], ["1"], " ")
    assert proven(spark, ["1"], ["1", "1"], "1")  # a spanning cell repeats
    assert proven(spark, [], ["Word"], "droW", ["drow"]) and not proven(spark, [], ["12.5"], "5.21", ["5.21"])


def test_agreement(spark):
    long = "a" * 20 + "b" * 20
    rows = [(long, "x" + long + "y"), (long + "tail", "x" + long), (long, long[:35] + "zzz"), ("", "abc"), ("abc", "zabcz")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(P.agreement(F.col("a"), F.col("b"))).collect()] == [40, 40, 0, 0, 3]


def test_heading_sections(spark):
    rows = [("lead, gone.\nIntro\nsome.\n\nmore.\nEnd\nlast.",), ("plain.",), (None,), ("Intro",)]
    df = spark.createDataFrame(rows, "t string").select(P.heading_sections(F.col("t")).alias("s"))
    got = [[(x.section, x.body) for x in r.s] for r in df.collect()]
    assert got == [[("intro", "some.\n\nmore."), ("end", "last.")], [("body", "plain.")], [("body", "")], [("intro", "")]]
