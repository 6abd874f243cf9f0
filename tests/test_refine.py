"""Refinement, masks and captions on small fixtures."""

from pyspark.sql import functions as F

from scholia_spark.operators import refine as R

PAPER = "1 Introduction\nWe show $x^2$.\nCopyright 2020\n12\nFigure 1: A plot\nMETHODS USED\ntext\x07 here. Appendix A holds more\nReferences\n[1] gone"


def test_refine_text():
    r = R.refine_text(PAPER)
    assert "gone" not in r["body"] and "Copyright" not in r["body"] and "\n12\n" not in r["body"] and "\x07" not in r["body"]
    assert r["captions"] == ["Figure 1: A plot"] and r["formulas"] == ["$x^2$"] and r["preserved"] == ["Appendix A holds more"]
    assert [s["label"] for s in r["sections"]] == ["1 Introduction", "METHODS USED"]
    assert [r["body"][s["start"] : s["end"]].strip() for s in r["sections"]] == ["1 Introduction", "METHODS USED"]
    assert R.refine_text(None) == R.refine_text("") and R.refine_text("")["token_count"] == 1


def test_windows_cover_the_body_in_order():
    body = "".join(chr(97 + i % 26) for i in range(1000))
    plain = R.windows(body, [300, 310, 900], 50, 0)
    assert "".join(plain) == body and all(len(w) <= 204 for w in plain)
    lapped = R.windows(body, [300, 310, 900], 50, 20)
    for a, b in zip(lapped, lapped[1:]):
        assert b.startswith(a[-20:])
    assert R.windows("", [], 50, 20) == [] and R.windows("  ", [], 50, 20) == []


def test_segment_batches(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate([40, 40, 400, 4, 0])] + [(2, 0, None)]
    got = {(r.doc_id, r.ord): r.batch for r in R.segment_batches(spark.createDataFrame(rows, "doc_id long, ord long, text string"), 20).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 2, (2, 0): 0}
    assert R.segment_batches(spark.createDataFrame([], "doc_id long, ord long, text string")).count() == 0


def test_rendered_particles(spark):
    df = spark.createDataFrame([("⟦G0⟧은 ⟦G1⟧으로 ⟦ G 1 ⟧가 ⟦G9⟧ ⟦⟧끝",), (None,)], "t string")
    rows = df.select(R.render_terms(["주의", "BERT"])("t").alias("r")).collect()
    assert rows[0].r.text == "주의는 BERT로 BERT가  끝" and rows[0].r.seen == [0, 1]
    assert rows[1].r.text == "" and rows[1].r.seen == []


def test_numbers_of_captions(spark):
    df = spark.createDataFrame([("IIII",), ("XIV",), ("xl",), ("Q",), (None,)], "t string")
    assert [r[0] for r in df.select(R.roman_number(F.col("t"))).collect()] == [4, 14, 40, None, None]
    lines = spark.createDataFrame([("Figure12:Seven plots",), ("Table I shows that",), ("Fig. 3 The set",), (None,)], "t string")
    assert [tuple(r[0]) if r[0] else None for r in lines.select(R.caption_number(F.col("t"))).collect()] == [("figure", 12), None, ("figure", 3), None]
