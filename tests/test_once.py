"""Readers name what they computed instead of computing it again: how often a step stands in their plan."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import effects as E
from tessera.functions import measures as M
from tessera.functions import untrusted as U

a, b = (lambda: F.col("a")), (lambda: F.col("b"))
TABLES = lambda: F.array(F.struct(F.array(a(), b()).alias("columns"), F.array(F.array(a(), b())).alias("rows")))
CASES = {
    "effect": (lambda: M.effect(a(), b(), a(), TABLES()), "regexp_extract(", 60),
    "ratio": (lambda: M.ratio(a(), b()), "regexp_extract(", 25),
    "pinned": (lambda: U.fault_of_pinned_trial(a()), "parse_json(", 2),
    "grounded": (lambda: E.grounded(F.array(a()), b()), "regexp_extract_all(", 2),
}


@pytest.mark.parametrize("name", CASES)
def test_steps_stand_once(spark, name):
    made, step, most = CASES[name]
    plan = spark.createDataFrame([("x", "y")], "a string, b string").select(made().alias("r"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count(step) <= most
