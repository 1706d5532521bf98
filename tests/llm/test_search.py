"""Ranked search against plain scoring and SQL."""

import numpy as np
import pytest

from tessera.llm import search
from tests.compare import differences, duck
from tests.llm import brute

pytest.importorskip("public_tokenizers")

DOCS = [
    (1, None), (2, ""), (3, " ,.; "), (4, "alpha"), (5, "Alpha beta ALPHA gamma"), (6, "alpha beta"), (7, "alpha beta"), (7, "beta É1x"), (None, "alpha beta"), (None, "gamma é1x É1x"),
    (8, " ".join(["beta", "filler"] * 4000)), (9, "zeta alpha-beta_gamma 42 42"), (9, "alpha"),
]
ITEMS = [(1, "alpha beta beta"), (1, "gamma É1x"), (1, "gamma É1x"), (2, None), (3, "  "), (None, "42 zeta"), (4, "unknown"), (5, "Alpha")]


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k, share, items", [(20, 0.2, 512), (3, 1.0, 1), (1, 0.5, 2)])
def test_edge_cases(spark, monkeypatch, k, share, items):
    monkeypatch.setattr(search, "SHARE", share)
    monkeypatch.setattr(search, "ITEMS", items)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS term", "'x' AS row", "2 AS n")
    wanted = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS q")
    assert found(search.search(docs, wanted, k)) == brute.ranked(DOCS, ITEMS, k)
    assert search.search(docs.limit(0), wanted).count() == 0
    assert search.search(docs, wanted.limit(0)).count() == 0


def test_random_texts_and_ties(spark):
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    odds = 1 / np.arange(1, 301)
    texts = [" ".join(r.choice(words, r.integers(1, 80), p=odds / odds.sum())) for _ in range(500)]
    docs = [(i, t) for i, t in enumerate(texts + texts[:100] + [texts[0]] * 60)]
    items = [(i, " ".join(r.choice(words, r.integers(1, 40)))) for i in range(25)] + [(30, texts[0]), (31, "w0 w1")]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert found(got) == brute.ranked(docs, items, 5)


def test_equals_sql(spark, sf):
    from tessera.llm.queries import ORACLES, queries

    assert not differences(spark, duck(sf), sf, queries()["op12_ranked_search"], ORACLES["op12_ranked_search"])


def test_threshold_is_the_largest(spark):
    most = [5, 7, 7, 20, 40]
    for tau in (1, 6, 17, 30, 55, 78):
        t, rest = search.thresholds(spark.createDataFrame([(1, m) for m in most], "q long, most long"), spark.createDataFrame([(1, tau)], "q long, tau long"), 1.0).select("t", "rest").first()
        reach = lambda t: sum(min(t, m) for m in most)
        assert rest == reach(t) < max(tau, 1) and (reach(t + 1) >= tau or t >= max(most))
