"""Operators whose later decisions see earlier ones, against plain versions, with ties, nulls and empty tables."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.functions.effects import grounded
from tessera.functions.identifiers import canonical_url
from tessera.operators import folds, identity, lineage, store


def test_slugs_pass_what_is_out(spark):
    rows = [("d", 1, "a"), ("d", 2, "a"), ("d", 3, "a-2"), ("e", 1, "x-2"), ("e", 2, "x"), ("e", 3, "x"), ("e", 4, "x"), (None, 1, "a"), ("f", 1, "y" * 64), ("f", 2, "y" * 64)]
    df = spark.createDataFrame(rows, "date string, id int, base string")
    out = {(r.date, r.id): r.slug for r in folds.resolved(df, "date", "id", "base").collect()}
    assert out == {("d", 1): "a", ("d", 2): "a-2", ("d", 3): "a-2-2", ("e", 1): "x-2", ("e", 2): "x", ("e", 3): "x-3", ("e", 4): "x-4", (None, 1): "a", ("f", 1): "y" * 64, ("f", 2): "y" * 62 + "-2"}
    assert folds.resolved(df.limit(0), "date", "id", "base").count() == 0


def score(a, b):
    if a[2] and b[2] and a[2] != b[2]:
        return 0
    x, y = set(a[3]), set(b[3])
    share = len(x & y) / len(x | y) if x | y else 0
    return 1000 + share if a[1] and a[1] == b[1] else 100 + share if a[2] and a[2] == b[2] else share


def persist(previous, following):
    pairs = sorted((-score(n, p), n[0], p[0], p[1]) for n, p in itertools.product(following, previous) if p[1] and score(n, p) > 0)
    taken, out = {}, set()
    for _, ni, _, slug in pairs:
        if ni not in taken and slug not in out:
            taken[ni] = slug
            out.add(slug)
    for ni, slug, *_ in following:
        if ni not in taken:
            name, n = slug or "study", 2
            while name in out:
                name, n = f"{slug or 'study'}-{n}", n + 1
            taken[ni] = name
            out.add(name)
    return taken, {p[1] for p in previous if p[1]} - set(taken.values())


def test_published_slugs_go_to_the_best_match(spark):
    r = random.Random(2)
    made = lambda n: [(i, r.choice(["a", "b", "c", "d", "", "e"]), r.choice([None, None, "N1", "N2"]), r.sample(range(6), r.randint(0, 3))) for i in range(n)]
    days = {d: (made(r.randint(0, 6)), made(r.randint(0, 6))) for d in range(40)}
    frame = lambda k: spark.createDataFrame([(d, *x) for d, both in days.items() for x in both[k]], "date int, pos int, slug string, nct string, sources array<int>")
    kept = folds.persisted(frame(0), frame(1))
    out, gone = {}, {}
    for x in kept.collect():
        out.setdefault(x.date, {})[x.pos] = x.slug
    for x in folds.retired(frame(0), kept).collect():
        gone.setdefault(x.date, set()).add(x.slug)
    for d, (previous, following) in days.items():
        assert (out.get(d, {}), gone.get(d, set())) == persist(previous, following)


def test_rows_alike_meet_as_classes(spark):
    r = random.Random(7)
    made = lambda n: [(i, r.choice(["a", "b", "c", ""]), r.choice([None, "N1", "N2"]), r.choice([[], [1], [1, 2], [2, 1], [3]])) for i in r.sample(range(99), n)]
    days = {d: (sorted(made(r.randint(5, 30))), sorted(made(r.randint(5, 30)))) for d in range(12)}
    # a hundred rows of one class on both sides have one pair, not ten thousand
    days[99] = ([(i, "a", "N1", [1, 2]) for i in range(100)], [(i, "a", "N1", [2, 1]) for i in range(100)])
    frame = lambda k: spark.createDataFrame([(d, *x) for d, both in days.items() for x in both[k]], "date int, pos int, slug string, nct string, sources array<int>")
    assert folds.scored_pairs(frame(0), frame(1)).where("date = 99").count() == 1
    out = {}
    for x in folds.persisted(frame(0), frame(1)).collect():
        out.setdefault(x.date, {})[x.pos] = x.slug
    for d, both in days.items():
        assert out[d] == persist(*both)[0]


def fold(old, new):
    have = [list(x) for x in old]
    for row in new:
        hit = next((h for i in (0, 1) for h in have if row[i] is not None and h[i] == row[i]), None)
        if hit is None:
            if row[0] is not None or row[1] is not None:
                have.append(list(row))
            continue
        for i in range(3):
            if hit[i] is None and row[i] is not None and (i == 2 or not any(h[i] == row[i] for h in have)):
                hit[i] = row[i]
    return sorted(map(tuple, have), key=repr)


def merge(spark, old, new):
    a = spark.createDataFrame(old, "k1 int, k2 string, v string")
    b = spark.createDataFrame([(*x, i) for i, x in enumerate(new)], "k1 int, k2 string, v string, o int")
    return sorted((tuple(r) for r in store.merged(a, b, ["k1", "k2"], ["v"], ["o"]).collect()), key=repr)


def test_arrivals_that_collide(spark):
    old, new = [(1, None, "A"), (None, "x", "B")], [(1, "x", "n"), (5, "z", "p"), (None, "z", "q")]
    assert merge(spark, old, new) == fold(old, new) == sorted([(1, None, "A"), (None, "x", "B"), (5, "z", "p")], key=repr)
    r = random.Random(5)
    pick = lambda: (r.choice([None, *range(25)]), r.choice([None, *"abcdefghijklmnopqrst"]), r.choice([None, "v", "w"]))
    keys1, keys2, old = set(), set(), []
    for x in (pick() for _ in range(15)):
        if x[0] not in keys1 and x[1] not in keys2:
            old.append(x)
            keys1.add(x[0]), keys2.add(x[1])
    new = [pick() for _ in range(60)]
    assert merge(spark, old, new) == fold(old, new)
    assert merge(spark, [], [(None, None, "v")]) == []


def test_groups_within_groups_are_left_out(spark):
    rows = [(1, "NCT00000001 TRIAL-9"), (2, "NCT00000001 TRIAL-9"), (3, "BIG-1 SUB-2 SAME-3"), (4, "BIG-1 SUB-2 SAME-3"), (5, "BIG-1 LATE-7"), (6, "LATE-7 SAME-3x"), (7, None), (8, "PHASE3"), (9, "PHASE3")]
    got = lineage.association(spark.createDataFrame(rows, "id int, text string"))
    assert {(r.group_id, r.reason, r.strength, r["items"], r["first"], r["last"]) for r in got.collect()} == {("nct00000001", "shared NCT00000001", 10, 2, 1, 2), ("big-1", "shared acronym BIG-1", 3, 3, 3, 5), ("late-7", "shared acronym LATE-7", 3, 2, 5, 6)}
    assert lineage.association(spark.createDataFrame([], "id int, text string")).count() == 0


def test_no_date_loses_its_last_card(spark):
    verdict = "date string, slug string, kind string, prior_date string, prior_slug string, certain boolean, corroborated boolean, blocker string"
    rows = [("9", "a", "update", "1", "x", None, True, None), ("9", "b", "duplicate", "1", "x", True, None, None), ("9", "c", "update", "1", "y", None, True, None), ("9", "d", "update", "1", "z", None, True, None), ("9", "e", "update", "2", "x", None, False, "maturity"), ("9", "f", "duplicate", "2", "x", False, None, None), ("9", "g", "update", "2", "w", None, True, None), ("9", "h", "update", "7", "w", None, True, None), ("9", "i", "unrelated", None, None, None, None, None), ("9", "j", "update", "1", "h", None, True, None)]
    cards = [("1", s) for s in "xyzh"] + [("2", s) for s in "xw"] + [("9", s) for s in "abcdefghij"]
    args = (spark.createDataFrame(rows, verdict), spark.createDataFrame([("2", "w", 2), ("9", "a", 1)], "date string, slug string, n int"), spark.createDataFrame(cards, "date string, slug string"), spark.createDataFrame([("1", "h")], "date string, slug string"))
    plan = folds.suppressions(*args, True)
    out = {r.slug: (r.hide_slug, r.declined) for r in plan.collect()}
    assert out == {"a": ("x", None), "b": ("x", None), "c": ("y", None), "d": (None, "would empty 1"), "e": (None, "maturity"), "f": (None, "duplicate not certain"), "g": (None, "prior card (2 sources) merges multiple sources"), "h": (None, "prior artifact 7 not readable"), "j": ("h", None)}
    docs, dates = folds.applied(plan, args[3])
    assert [tuple(r) for r in docs.collect()] == [("1", ["h", "x", "y"])] and [r.date for r in dates.collect()] == ["1"]
    assert {r.declined for r in folds.suppressions(*args, False).where("slug in ('a', 'c')").collect()} == {"auto-suppress disabled"}


def test_grounding_and_addresses_beside_their_literals(spark):
    one = spark.createDataFrame([([".5", "5.", "0.50", "7"], "rate 0.5 of 5", "http://www.X.org/a/?q=a%20b&utm_source=m&B=1+2&%62=x#f")], "c array<string>, s string, u string")
    r = one.select(grounded(F.col("c"), F.col("s")).alias("g"), canonical_url(F.col("u")).alias("u")).first()
    assert (r.g.grounded, r.g.ungrounded, r.u) == ([".5", "5.", "0.50"], ["7"], "https://x.org/a?B=1 2&b=x&q=a b")


def test_prior_readings_abstain_where_trials_differ(spark):
    schema = "date string, slug string, nct string, key string, site string, kind string, endpoint string, point double, lo double, hi double"
    at = lambda day, slug, nct, key, point, site="x", kind="HR", endpoint="os": (f"2024-01-{day:02d}", slug, nct, key, site, kind, endpoint, point, None, None)
    rows = [
        at(1, "a", "N1", "K1", 0.5), at(2, "b", "N1", "K1", 0.5), at(3, "c", "N1", "K1", 0.6), at(4, "d", "N1", None, 0.6),  # d: newest that differs is b
        at(5, "e", "N2", None, 1.0), at(6, "f", None, "K2", 1.1), at(7, "g", "N2", "K2", 1.2),  # g: e and f share nothing
        at(8, "h", None, "K3", 1.0, None), at(9, "i", None, "K3", 2.0, None),  # a key alone needs a site
        at(10, "j", "N4", "K4", 1.0, kind="OR"), at(11, "k", "N4", "K4", 2.0), at(11, "l", "N4", "K4", 3.0), at(12, "m", "N4", "K5", 4.0), at(12, "n", "N4", "K4", 4.0, endpoint=""), at(12, "o", "N4", "K4", 4.0),
        at(13, "p", "N4", None, 9.0),  # N4 has two keys
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.slug: (r.prior_slug, r.point) for r in identity.prior_reading(df).collect()}
    assert got == {"c": ("b", 0.5), "d": ("b", 0.5), "o": ("k", 2.0)}
    assert identity.prior_reading(df.limit(0)).count() == 0


def test_an_item_of_several_rows_counts_once(spark):
    rows = [(1, "BIG-1 SUB-2"), (1, "BIG-1 SUB-2"), (2, "SUB-2"), (2, "BIG-1"), (3, "BIG-1"), (None, "SUB-2")]
    got = lineage.association(spark.createDataFrame(rows, "id int, text string"))
    assert {(r.group_id, r["items"], r["first"], r["last"]) for r in got.collect()} == {("big-1", 3, 1, 3)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # an item's names are in one place: groups aren't joined with their items
    assert plan.count("Join") <= 4
