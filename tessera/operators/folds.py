"""Folds in order: what an earlier row decides, a later one of its group sees.

A group's rows go through a task one after the other, sorted by Spark; a task holds what the fold itself keeps, never the group.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import payloads
from tessera.streaming.paths import shared_path

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
SLUG_CHARS = 64


def folded(rows: DataFrame, by: list[str], order: list[Column], schema: str, fold: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """fold(a group's rows in order, as tuples of rows' columns) gives tuples of schema. NULL is a group like others."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))
    at = [rows.columns.index(c) for c in by]

    def run(batches):
        import itertools

        import pyarrow as pa

        def flat():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def made(held):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

        held = []
        for _, group in itertools.groupby(flat(), key=lambda r: [r[i] for i in at]):
            for row in fold(group):
                held.append(row)
                if len(held) == 1000:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def free_slug(base: str, n: int, taken) -> tuple[str, int]:
    """The first of base-n, base-(n + 1), ... that isn't taken, with its number; the base is cut where the whole would be too long."""
    while True:
        end = f"-{n}"
        slug = (base[: SLUG_CHARS - len(end)].rstrip("-") if len(base) + len(end) > SLUG_CHARS else base) + end
        if slug not in taken:
            return slug, n
        n += 1


def resolved(rows: DataFrame, by: str, key: str, base: str) -> DataFrame:
    """By, key, slug: in order of key the first of a base keeps it, later ones get -2, -3, ... past every slug that is already out."""
    def fold(group):
        seen: dict = {}
        for of, k, b in group:
            n = seen.get(b, 0)
            slug = free_slug(b, n + 1, seen)[0] if n else b
            seen[b] = n + 1
            if n:
                seen[slug] = 1
            yield of, k, slug

    kind = {c: rows.schema[c].dataType.simpleString() for c in (by, key)}
    return folded(rows.select(by, key, base), [by], [F.col(key)], f"`{by}` {kind[by]}, `{key}` {kind[key]}, slug string", fold)


def scored_pairs(previous: DataFrame, following: DataFrame) -> DataFrame:
    """date, ni, pi, slug, score of rows (date, pos, slug, nct, sources) that share a slug, a registration or a source on a date, and score above 0: those that can win.

    Rows alike in slug, registration and set of sources score alike, so they meet as classes. A slug goes to a row by its best and first pair only, and the rows of
    a class get slugs in order of pos: its nth can get one only if the class has n slugs that score as much. Pairs left out would find row or slug taken.
    """
    alike = ["date", "slug", "nct", "sources"]
    plain = lambda rows: rows.select("date", "pos", "slug", "nct", F.array_sort(F.array_distinct("sources")).alias("sources"))

    def side(rows: DataFrame, x: str) -> DataFrame:
        tokens = F.concat(F.array(F.concat(F.lit("s:"), "slug"), F.concat(F.lit("n:"), F.upper("nct"))), F.transform("sources", lambda r: F.concat(F.lit("r:"), r.cast("string"))))
        classes = plain(rows).groupBy(*alike).agg(F.min("pos").alias(f"{x}i"))
        return classes.select("date", f"{x}i", *(F.col(c).alias(f"{x}_{c}") for c in alike[1:]), F.explode(F.array_distinct(F.array_compact(tokens))).alias("token"))

    score = payloads.match_score(*(F.col(f"{x}_{c}") for x in "np" for c in alike[1:]))
    met = side(following, "n").join(side(previous.where("slug != ''"), "p"), ["date", "token"]).select("date", F.col("ni").alias("first"), F.col("p_slug").alias("slug"), "pi", score.alias("score")).where("score > 0")
    # counted by score before the best is taken: that adds up where rows meet, before anything is sent
    met = met.groupBy("date", "first", "slug", "score").agg(F.min("pi").alias("pi"))
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("date", "first", "slug").orderBy(F.desc("score")))).where("n = 1").drop("n")
    best = best.withColumn("most", F.count(F.lit(1)).over(Window.partitionBy("date", "first").orderBy(F.desc("score"))))
    same = Window.partitionBy(*alike)
    rows = plain(following).select("date", F.col("pos").alias("ni"), F.min("pos").over(same).alias("first"), F.row_number().over(same.orderBy("pos")).alias("nth"))
    return best.join(rows, ["date", "first"]).where("nth <= most").select("date", "ni", "pi", "slug", "score")


def persisted(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Date, pos, slug, reused of following's rows: published slugs go to the rows that match best, one to one; ties by both positions. Others keep theirs, numbered past what is out."""
    none = F.lit(None)
    pairs = scored_pairs(previous, following).select("date", F.lit(0).alias("kind"), (-F.col("score")).alias("o"), "ni", "pi", "slug")
    rows = following.select("date", F.lit(1).alias("kind"), none.cast("double").alias("o"), F.col("pos").alias("ni"), none.cast(previous.schema["pos"].dataType).alias("pi"), "slug")

    def fold(group):
        taken, out, free = {}, set(), {}
        for date, kind, _, ni, _, slug in group:
            if kind == 0:
                if ni not in taken and slug not in out:
                    taken[ni] = slug
                    out.add(slug)
            elif ni in taken:
                yield date, ni, taken[ni], True
            else:
                name = base = slug or "study"
                if name in out:
                    # what is out stays out, so a base's numbers are looked at once
                    n = free.get(base, 2)
                    while (name := f"{base}-{n}") in out:
                        n += 1
                    free[base] = n + 1
                out.add(name)
                yield date, ni, name, False

    date, pos = (following.schema[c].dataType.simpleString() for c in ("date", "pos"))
    return folded(pairs.union(rows), ["date"], [F.col("kind"), F.col("o"), F.col("ni"), F.col("pi")], f"date {date}, pos {pos}, slug string, reused boolean", fold)


def retired(previous: DataFrame, kept: DataFrame) -> DataFrame:
    """Date, slug of published slugs that no row carries any more."""
    return previous.where("slug != ''").select("date", "slug").distinct().join(kept.select("date", "slug").distinct(), ["date", "slug"], "left_anti")


def suppressions(verdicts: DataFrame, sources: DataFrame, cards: DataFrame, hidden: DataFrame, auto: bool) -> DataFrame:
    """Date, slug, hide_date, hide_slug, declined for each verdict that isn't unrelated.

    verdicts as of lineage.classified; sources(date, slug, n) counts substantive sources; cards and hidden (date, slug). A later decision of a date sees the earlier ones:
    an earlier date never loses its last card. Whether it would is a matter of how many different cards were asked for before, so windows decide it.
    """
    count = lambda d, s, n: sources.select(F.col("date").alias(d), F.col("slug").alias(s), F.col("n").alias(n))
    rows = verdicts.where("kind != 'unrelated'").join(count("date", "slug", "own"), ["date", "slug"], "left").join(count("prior_date", "prior_slug", "prior"), ["prior_date", "prior_slug"], "left")
    side = F.when(F.col("prior") > 1, F.concat(F.lit("prior card ("), "prior", F.lit(" sources)"))).when(F.col("own") > 1, F.concat(F.lit("new card ("), "own", F.lit(" sources)")))
    sure = F.coalesce(((F.col("kind") == "update") & F.col("corroborated")) | ((F.col("kind") == "duplicate") & F.col("certain")), F.lit(False))
    rows = rows.withColumn("side", side).withColumn("gate", sure & F.col("side").isNull())
    left = cards.join(hidden, ["date", "slug"], "left_anti").groupBy("date").agg(F.count(F.lit(1)).alias("left"))
    known = cards.select("date").distinct().join(left, "date", "left").select(F.col("date").alias("prior_date"), F.coalesce("left", F.lit(0)).alias("left"))
    gone = hidden.select(F.col("date").alias("prior_date"), F.col("slug").alias("prior_slug"), F.lit(True).alias("gone")).distinct()
    rows = rows.join(known, "prior_date", "left").join(gone, ["prior_date", "prior_slug"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    # the first that asks for a card counts, others find it asked for
    asked = F.col("gate") & ~F.col("gone")
    first = F.row_number().over(Window.partitionBy("date", "prior_date", "prior_slug", asked).orderBy("slug"))
    rows = rows.withColumn("fresh", asked & (first == 1))
    nth = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("date", "prior_date").orderBy("slug"))
    # the number under which a card was first asked for
    own = F.min(F.when(F.col("fresh"), F.col("nth"))).over(Window.partitionBy("date", "prior_date", "prior_slug"))
    rows = rows.withColumn("nth", nth).withColumn("number", F.when(F.col("gone"), 0).otherwise(own))
    empties = F.col("left") - F.col("number") < 1
    declined = (
        F.when((F.col("kind") == "update") & ~F.coalesce("corroborated", F.lit(False)), F.coalesce("blocker", F.lit("not authorized")))
        .when((F.col("kind") == "duplicate") & ~F.coalesce("certain", F.lit(False)), F.coalesce("blocker", F.lit("duplicate not certain")))
        .when(F.col("side").isNotNull(), F.concat("side", F.lit(" merges multiple sources")))
        .when(F.col("gate") & F.lit(not auto), F.lit("auto-suppress disabled"))
        .when(F.col("gate") & F.col("left").isNull(), F.concat(F.lit("prior artifact "), "prior_date", F.lit(" not readable")))
        .when(F.col("gate") & empties, F.concat(F.lit("would empty "), "prior_date"))
    )
    hide = F.col("gate") & F.lit(auto) & declined.isNull()
    return rows.select("date", "slug", F.when(hide, F.col("prior_date")).alias("hide_date"), F.when(hide, F.col("prior_slug")).alias("hide_slug"), declined.alias("declined"))


def applied(plan: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dates' hidden slugs with the plan's added (date, slugs in order), and the dates to build anew."""
    new = plan.where("hide_date is not null").select(F.col("hide_date").alias("date"), F.col("hide_slug").alias("slug"))
    docs = hidden.select("date", "slug").union(new).groupBy("date").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))
    return docs, new.join(hidden, ["date", "slug"], "left_anti").select("date").distinct()


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_path(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_groups(rows: DataFrame, tokens: str) -> DataFrame:
    """token, label: tokens that rows (an array of tokens each) tie together, directly or through others, have one label, the least of them."""
    edges = rows.where(F.size(tokens) > 1).select(F.col(tokens)[0].alias("a"), F.explode(F.slice(tokens, 2, 10**6)).alias("b"))
    edges = _kept(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = _kept(rows.select(F.explode(tokens).alias("token")).distinct().withColumn("label", F.col("token")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("token")).groupBy("a").agg(F.min("label").alias("least"))
        stepped = labels.join(near, F.col("token") == F.col("a"), "left").select("token", F.least("label", "least").alias("label"))
        # labels are tokens: what a label has found in the meantime is taken over, so chains halve
        jump = stepped.select(F.col("token").alias("t"), F.col("label").alias("far"))
        new = _kept(stepped.join(jump, F.col("label") == F.col("t"), "left").select("token", F.least("label", "far").alias("label")), "labels")
        if new.join(labels, ["token", "label"], "left_anti").isEmpty():
            return new
        labels = new
