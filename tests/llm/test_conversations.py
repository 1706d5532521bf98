"""Conversation repair against a version that carries whole strings, and against all ways to edit."""

import itertools
import re

import numpy as np
import pytest

from tessera.llm import conversations
from tessera.llm.common import table
from tests.llm import brute

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df, key="conv_id"):
    return {r[key]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def random_rows(n, seed):
    r = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Hello.", "Why?", "cut off", "", "  \n", None, " ", "Done!\t ", "x", "No. 2"]
    rows = []
    for c in range(n):
        for t in range(int(r.integers(1, 9))):
            turn = None if r.random() < 0.05 else int(t * r.integers(1, 3))
            rows.append((c if c else None, turn, roles[int(r.choice(7, p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05]))], texts[int(r.integers(0, 10))] if r.random() < 0.5 else f"text {r.integers(0, 5)}."))
    return rows


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(conversations.digest(conversations.damaged(table(spark, sf, "conversations")), dropped="dropped")) == brute.conversations(rows)


def test_edge_cases(spark):
    rows = random_rows(300, 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "'x' AS numbers", "2 AS fault").repartition(5)
    want = brute.conversations(rows)
    assert {w[5] for w in want.values()} >= {0, 3, 4, 7} and any(w[6] == "" for w in want.values())
    assert found(conversations.digest(conversations.damaged(df), dropped="dropped")) == want
    assert conversations.digest(df.limit(0)).count() == 0 and conversations.repaired(df.limit(0)).count() == 0


def test_strings_as_keys_and_one_long_conversation(spark):
    rows = [("a", t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(20000)] + [("b", 0, "assistant", "x.")]
    df = spark.createDataFrame(rows, "c string, turn int, role string, text string")
    out = found(conversations.digest(df, conv="c"), "c")
    assert out["a"][:7] == (0, 0, 0, 0, 0, 0, "K" * 20000) and out["b"][5:7] == (3, "IK")
    turns = conversations.repaired(df, conv="c").where("c = 'b'").orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in turns] == [("I", "user", ""), ("K", "assistant", "x.")]


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_of_all_edits(seed):
    """Every sequence of edits with at most two inserts before each row and at the end."""
    r = np.random.default_rng(seed)
    for _ in range(6):
        rows = [("suat"[int(r.integers(0, 4))], int(r.choice([0, 0, 1, 3]))) for _ in range(int(r.integers(0, 5)))]
        fold = conversations._Fold()
        for i, (initial, fault) in enumerate(rows):
            fold.row(i, initial, fault)
        numbers, audit = fold.result()
        best = None
        edits = [[("D", "", 4)] + ([] if f == 1 else [("K", c, 3 * (f == 3))] + [("R", w, 3 + 3 * (f == 3)) for w in "ua"]) for c, f in rows]
        gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
        for chosen in itertools.product(*edits):
            # inserts are placed by the grammar: only those that can stand are tried
            todo = [("", 0, "")]
            for letter, role, price in [*chosen, ("", "", 0)]:
                todo = [(s + "".join(g) + role, cost + 3 * len(g) + price, a + "I" * len(g) + letter) for s, cost, a in todo for g in gaps if re.fullmatch("s?(ua)*u?", s + "".join(g) + role)]
            for s, cost, a in todo:
                if re.fullmatch("(s?(ua)+)?", s) and (best is None or (cost, a) < best):
                    best = (cost, a)
        assert (numbers[5], audit) == best
