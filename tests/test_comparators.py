"""Named trials and claims about them, by case."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import comparators as C

CASES = [
    ("In DESTINY-Breast04, HR 0.51 held.", "destiny breast 06 had 0.51", ["DESTINY-Breast04"], ["DESTINY-Breast04"], []),
    ("In DESTINY-Breast04, HR 0.52 held.", "destiny breast 06 had 0.51", ["DESTINY-Breast04"], ["DESTINY-Breast04"], ["DESTINY-Breast04"]),
    ("NRG GU005 and NRG-GU005: 40%", "NRG-GU005", ["NRG", "GU005", "NRG-GU005"], [], []),
    ("**STAMPEDE** is context. Nothing more; ORIOLE n = 54.", "", ["STAMPEDE", "ORIOLE"], ["STAMPEDE", "ORIOLE"], ["ORIOLE"]),
    ("T2N0 III FIGO3 ASCO VEGF PHASE3 HR 0.9", "", [], [], []), ("ABLE-1 p<.05 22; ABLE1 median 33 mo in ABLE1: 44", "44", ["ABLE-1"], ["ABLE-1"], ["ABLE1"]), (None, None, [], [], []), ("", "x", [], [], []),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(spark, i):
    text, source, *want = CASES[i]
    t, s = F.col("t"), F.col("s")
    r = spark.createDataFrame([(text, source)], "t string, s string").select(C.named_trials(t).alias("a"), C.unsourced(t, s).alias("b"), C.unsourced_claims(t, s).alias("c")).first()
    assert [r.a, r.b, r.c] == want
