"""Effect estimates: cases of the rules, and where they abstain."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import measures as M

RATIOS = [
    ("HR 0.54", "95% CI 0.41-0.72", ("HR", 0.54, 0.41, 0.72, 95)),
    ("HR 0·54", "95% CI 0·41–0·72", ("HR", 0.54, 0.41, 0.72, 95)),
    ("mDFS 52.7 vs 24.4 mo", "HR 0.750 (95% CI 0.607-0.928)", ("HR", 0.75, 0.607, 0.928, 95)),
    ("adjusted HR 1.40 (0.91-2.13), P=.12", None, ("HR", 1.4, 0.91, 2.13, None)),
    ("HR 1.40 for RT (60-70 Gy)", "", ("HR", 1.4, None, None, None)),
    ("HR 1.40 (60-70)", "", ("HR", 1.4, None, None, None)),
    ("HR 0.70 (95% CI 0.80-0.90)", "", None),
    ("HR 0.70 (95% CI 0.90-0.60)", "", None),
    ("sub-HR 1.2", "90% CI 0.84 to 2.04", ("SHR", 1.2, 0.84, 2.04, 90)),
    ("aHR: 0.8", None, ("HR", 0.8, None, None, None)),
    ("OR=2.5", "95% CI 1.1-3; 95% CI 2-3", ("OR", 2.5, None, None, None)),
    ("HR 0.70; 12-mo PFS rate is 0.70 (95% CI 0.60-0.80); then 95% CI 0.50-0.95", "", ("HR", 0.7, None, None, None)),
    ("RR 0", "x", None), ("28% vs 21%", "p=0.1", None), (None, None, None), ("", "", None), ("THR 2", "", None),
]
PAIRS = [
    ("28% vs 21%", (28.0, 21.0, "%", None, None)), ("15.8 vs 12.3 mo", (15.8, 12.3, "mo", None, None)), ("7% vs 7.4% (AHRT vs EHRT)", (7.0, 7.4, "%", "AHRT", "EHRT")),
    ("8.0% vs 9.4% (40 vs 50Gy)", (8.0, 9.4, "%", None, None)), ("3.5% vs 3.7% vs 5.5%", None), ("NR vs 17 mo", None), ("0% vs 0%", None), ("28% vs 21 mo", None), ("none", None), (None, None), ("Δ4.8 pts (79.2 vs 74.3)", None),
]
HEADS = [
    (["Endpoint", "Arm A", "Arm B", "p"], (1, 2)), (["Endpoint (20yr)", "RT (n=500)", "Control"], (1, 2)), (["Endpoint", "POP-RT (n=500)", "PEACE-2 (n=600)"], None), (["Endpoint (smokers)", "Arm A", "Arm B"], None),
    (["Cohort", "Arm A", "Arm B"], None), (["Endpoint", "Arm A", "Arm B", "Arm C"], None), (["Endpoint", "Stage control", "Arm B"], None), (["Endpoint", "Drug", "HR (95% CI), p", "placebo"], (1, 3)), (["Endpoint", "A"], None), (None, None),
]


def test_ratio(spark):
    df = spark.createDataFrame([(i, v, d) for i, (v, d, _) in enumerate(RATIOS)], "i int, v string, d string")
    out = {r.i: r.x and tuple(r.x) for r in df.select("i", M.ratio(F.col("v"), F.col("d")).alias("x")).collect()}
    assert [(RATIOS[i][:2], out[i]) for i in range(len(RATIOS))] == [((v, d), w) for v, d, w in RATIOS]


def test_pair(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(PAIRS)], "i int, v string")
    out = {r.i: r.x and tuple(r.x) for r in df.select("i", M.pair(F.col("v")).alias("x")).collect()}
    assert [(PAIRS[i][0], out[i]) for i in range(len(PAIRS))] == PAIRS


def test_arm_columns(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(HEADS)], "i int, v array<string>")
    out = {r.i: r.x and (r.x.a, r.x.b) for r in df.select("i", M.arm_columns(F.col("v")).alias("x")).collect()}
    assert [(HEADS[i][0], out[i]) for i in range(len(HEADS))] == HEADS


@pytest.mark.parametrize("label, endpoint, want", [("Dose", "OS", False), ("os", "OS ", True), ("3-yr overall  survival", "Overall survival", True), ("Overall survivals", "overall survival", False), ("Local control", "Freedom, local control.", True), ("", "x", False), (None, "x", False), ("a(b+c", "at (a(b+c) end", True)])
def test_names_endpoint(spark, label, endpoint, want):
    df = spark.createDataFrame([(label, endpoint)], "a string, b string")
    assert df.select(M.names_endpoint(F.col("a"), F.col("b"))).first()[0] == want


def test_effect_takes_ratio_then_pair_then_table(spark):
    tables = [(["Cohort", "A", "B"], [["OS", "1", "2"]]), (["Endpoint", "Arm A", "Arm B"], [["Dose", "50 Gy", "60 Gy"], ["Overall survival", "HR 2", "3"], ["Overall survival", "61%", "55%"]])]
    rows = [("HR 2", "", tables), ("5% vs 6%", "", tables), ("none", "", tables), ("none", "", []), ("none", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, d string, t array<struct<columns:array<string>,rows:array<array<string>>>>")
    out = [r.x for r in df.select("i", M.effect(F.col("v"), F.col("d"), F.lit("overall survival"), F.col("t")).alias("x")).orderBy("i").collect()]
    assert [x and x.form for x in out] == ["ratio", "paired", "table", None, None]
    assert tuple(out[2].pair) == (61.0, 55.0, "%", "Arm A", "Arm B")
