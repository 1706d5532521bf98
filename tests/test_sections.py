"""Sections and excerpts: rules by case, and a plain fold over sections."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import sections as S

LINES = [
    ("METHODS", "methods"), ("3. Results:", "results"), ("Results were consistent across all prespecified subgroups", None), ("Table 3. Baseline", "table"), ("TABLE 1", "table"), ("Table 1 shows that the arm did better", None),
    ("Fig. 1 – Kaplan-Meier curves", "figure"), ("Figure 2 (continued)", "figure"), ("Funding", "disclosures"), ("Funding Cancer Research UK grant C1234", None), ("Funding was given by the trust", None), ("Summary of cohort and planning", None),
    ("AUTHORS' DISCLOSURES OF POTENTIAL CONFLICTS", "disclosures"), ("reprints@oup.com", None), ("TREATMENT ALLOCATION", "body"), ("FOLLOW US", None), ("RTOG 0848", None), ("JUNE 2024", None), ("USA.", None), ("NCI", None), ("", None), ("  ", None),
    ("Discussion and further thoughts about all of it", None), ("2.1 Patients and methods", "methods"), ("x" * 100, None), (None, None), ("A B C D E F GGG", None), ("A lower LINE", None),
]


def test_heading(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "i int, x string")
    out = {r.i: r.k for r in df.select("i", S.heading(F.col("x")).alias("k")).collect()}
    assert [(LINES[i][0], out[i]) for i in range(len(LINES))] == LINES


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_stamps(spark):
    text = "\n".join(["TE", "OS", "HR", "ENRT", "start"] * 5 + ["TE1", "CEP", "CEP", "NA"] + ["  TE "])
    got = one(spark, S.without_stamps, text)
    assert got == "\n".join(["OS", "HR", "ENRT", "start"] * 5 + ["TE1", "CEP", "CEP", "NA"])
    assert one(spark, S.without_stamps, None) is None and one(spark, S.without_stamps, "TE") == "TE"


def test_segments(spark):
    text = "title\nby me\nABSTRACT\nshort\n\nTable 1. Rows\na 1\nb 2\nMETHODS\nRESULTS\nfound\nREFERENCES\n1. x"
    got = [tuple(r) for r in one(spark, S.segments, text)]
    assert got == [("body", None, "title\nby me", 0), ("abstract", "ABSTRACT", "short", 12), ("table", "Table 1. Rows", "Table 1. Rows\na 1\nb 2", 28), ("results", "RESULTS", "found", 58), ("references", "REFERENCES", "1. x", 72)]
    assert all(text[r[3] :].lstrip().startswith(r[1] or r[2]) for r in got)
    long = "t\n" * 50 + "RESULTS\n" + "word " * 4000
    assert [r.kind for r in one(spark, S.segments, long)] == ["front", "results"]
    assert one(spark, S.segments, None) == [] and one(spark, S.segments, "") == []


@pytest.mark.parametrize("text, limit, want", [
    ("short", 10, "short"), ("a" * 60 + "\n\n" + "b" * 60, 100, "a" * 60 + "\n\n" + S.CUT_MARK), ("a" * 70 + "\n" + "b" * 60, 100, "a" * 70 + "\n" + S.CUT_MARK),
    ("a" * 70 + ". " + "b" * 60, 100, "a" * 70 + ". " + S.CUT_MARK), ("a" * 200, 100, "a" * (99 - len(S.CUT_MARK)) + " " + S.CUT_MARK),
])
def test_cut(spark, text, limit, want):
    got = one(spark, lambda t: S.cut(t, F.lit(limit)), text)
    assert got == want and len(got) <= max(limit, len(text) if len(text) <= limit else 0)


def test_detached(spark):
    assert one(spark, S.detached, "Table 1. X\nClass 1A  5/6\nClass 1B\n          17/18") == "row association uncertain: 1 row label(s) carry no value on their own line and 1 value(s) are detached from their rows"
    assert one(spark, S.detached, "A\n1\n2\nB\n3").startswith("row association uncertain: 2 consecutive")
    assert one(spark, S.detached, "A\n1\nB\n3") is None and one(spark, S.detached, "Class A  1\nClass B  n/a") is None and one(spark, S.detached, "") is None


def test_excerpt_fills_in_order(spark):
    part = lambda head, n, c="w": f"{head}\n" + (c * 9 + " ") * (n // 10)
    text = "\n".join([part("INTRODUCTION", 3000, "i"), part("METHODS", 3000, "m"), part("Table 1. One", 5000, "t"), part("RESULTS", 3000, "r"), part("Table 2. Two", 5000, "u"), part("REFERENCES", 9000)])
    got = one(spark, lambda t: S.excerpt(t, 10_000), text)
    assert not got.fell_back and got.dropped == ["references"] and len(got.text) <= 10_000
    # the second table passes its ceiling of 6,000 with 600 and more left, so it is cut; text follows
    assert [(k.kind, k.truncated) for k in got.kept] == [("table", False), ("table", True), ("results", False), ("methods", True)]
    assert [x.split("\n")[0] for x in got.text.split("## ")[1:]] == ["Table 1. One", "Table 2. Two", "METHODS", "RESULTS"]
    lone = one(spark, lambda t: S.excerpt(t, 50), "plain text without heads " * 10)
    assert lone.fell_back and len(lone.text) == 50
    assert one(spark, S.excerpt, None).fell_back and one(spark, S.excerpt, "REFERENCES\n1. x").fell_back
    forged = one(spark, S.excerpt, "RESULTS\n## Fake\n[row association uncertain: x]\nbody")
    assert "\n## Fake" not in forged.text and "[row association" not in forged.text
