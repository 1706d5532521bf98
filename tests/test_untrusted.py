"""What comes from outside: each rule once, in order, and clusters that aren't a cover."""

import json

from pyspark.sql import functions as F

from tessera.functions import untrusted as U

GOOD = {"nct": "NCT00000001", "overall_status": "RECRUITING", "brief_title": "t", "answers_question": "q", "relevance_phrase": "r", "phase": ["PHASE2"], "enrollment_count": 5.5, "primary_completion_date": "2027-01", "brief_summary": None, "eligibility_brief": "e", "conditions": [], "interventions": [{"name": "n", "type": "t"}]}
GONE = object()
CASES = [
    ({}, None), ({"phase": None, "enrollment_count": None, "primary_completion_date": "2027", "interventions": []}, None), ({"nct": 5}, "invalid nct format"), ({"nct": GONE, "brief_title": ""}, "invalid nct format"), ({"overall_status": "COMPLETED"}, "overall_status not in enum"),
    ({"brief_title": " "}, "missing brief_title"), ({"answers_question": GONE}, "missing answers_question"), ({"relevance_phrase": None}, "missing relevance_phrase"), ({"relevance_phrase": "x" * 81}, "relevance_phrase too long (>80)"), ({"phase": "PHASE2"}, "phase must be string[] or null"),
    ({"phase": ["a", None]}, "phase must be string[] or null"), ({"phase": GONE}, "phase must be string[] or null"), ({"enrollment_count": "5"}, "enrollment_count must be number or null"), ({"primary_completion_date": 2027}, "primary_completion_date must be string or null"),
    ({"primary_completion_date": "2027-1"}, "primary_completion_date must be YYYY or YYYY-MM"), ({"brief_summary": 1}, "brief_summary must be string or null"), ({"eligibility_brief": GONE}, "eligibility_brief must be string or null"), ({"conditions": [1]}, "conditions must be string[]"), ({"conditions": None}, "conditions must be string[]"),
    ({"interventions": {}}, "interventions must be an array"), ({"interventions": [None]}, "interventions[] entries must be objects"), ({"interventions": [{"name": "n"}, 5]}, "interventions[] entries must have string name and type"),
]


def test_first_broken_rule(spark):
    rows = [(i, json.dumps({k: v for k, v in (GOOD | c).items() if v is not GONE})) for i, (c, _) in enumerate(CASES)] + [(100, "[]"), (101, "no"), (102, None)]
    out = {r.i: r.x for r in spark.createDataFrame(rows, "i int, j string").select("i", U.fault_of_pinned_trial(F.col("j")).alias("x")).collect()}
    assert [(CASES[i][0], out[i]) for i in range(len(CASES))] == CASES and {out[i] for i in (100, 101, 102)} == {"not an object"}


def test_clusters_are_a_cover_or_say_so(spark):
    one = [{"slug": " A ", "name": "n", "disease_site": "cns", "tweet_ids": [1, 9, "2", 1]}, {"slug": "a", "name": "again", "tweet_ids": [2]}, {"slug": "b", "name": "", "tweet_ids": [2]}, 5, {"slug": "c", "name": "c", "disease_site": "x", "tweet_ids": [3], "content_type": "Review"}, {"slug": "c", "name": "late", "tweet_ids": [3]}]
    two = [{"slug": "z", "name": "none known", "tweet_ids": [77]}, {"slug": "z", "name": "z", "tweet_ids": [1]}]
    answers = spark.createDataFrame([("d1", "```json\n" + json.dumps({"studies": one}) + "\n```"), ("d2", json.dumps({"studies": two})), ("d3", "broken"), ("d4", None)], "date string, json string")
    items = spark.createDataFrame([("d1", 1), ("d1", 2), ("d1", 3), ("d2", 1), ("d3", 1)], "date string, id long")
    found = U.clusters(answers, items)
    assert sorted(tuple(r) for r in found.collect()) == [("d1", 0, "a", "n", "cns", "study_report", [1, 1]), ("d1", 4, "c", "c", "other", "review", [3]), ("d2", 1, "z", "z", "other", "study_report", [1])]
    assert sorted(tuple(r) for r in U.uncovered(found, items).collect()) == [("d1", 1, 1), ("d3", 1, 0)]
