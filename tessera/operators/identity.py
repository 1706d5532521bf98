"""Identity over time: histories, duplicates, as-of lookups, lineage verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import dealt


def history(card: DataFrame, most: int = 4) -> DataFrame:
    """Other dates of the same strong key (any site), or of the same weak key in the same site if the key isn't ambiguous.

    One row for each (key, date) and the newest most + 1 dates of a key are kept before the join.
    """
    def few(rows: DataFrame, keys: list[str], late: bool) -> DataFrame:
        one = rows.groupBy(*keys, "date").agg((F.max if late else F.min)("card_id").alias("other"))
        return one.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))).where(F.col("r") <= most + 1).select(*(F.col(k).alias(f"h_{k}") for k in keys), F.col("date").alias("h_date"), "other")

    clear = card.where("acronym is not null").groupBy("acronym").agg(F.countDistinct("nct").alias("n")).where("n < 2").select("acronym")
    strong = few(card.where("nct is not null"), ["nct"], True)
    weak = few(card.join(clear, "acronym", "left_semi"), ["acronym", "site"], False)
    a = card.join(strong, card.nct == strong.h_nct).select("card_id", "date", "h_date", "other", F.lit(1).alias("how"))
    b = card.join(weak, (card.acronym == weak.h_acronym) & (card.site == weak.h_site)).select("card_id", "date", "h_date", "other", F.lit(2).alias("how"))
    both = a.union(b).where("h_date <> date")
    best = both.groupBy("card_id", "h_date").agg(F.min(F.struct("how", "other")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("card_id").orderBy(F.desc("h_date")))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("card_id", "h_date", F.col("m.other").alias("other"), F.col("m.how").alias("how"), "rank")


def cross_date_duplicates(card: DataFrame) -> DataFrame:
    """Strong keys on several dates; weak keys on several dates unless all their cards are in the first set or they have several strong keys."""
    def counted(key: str, *more) -> DataFrame:
        # nearly all pairs of key and date are different: they are dealt before they are counted, not counted where they are read
        days = dealt(card.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, "date", *(["nct"] if more else [])])), key, "date").groupBy(key, "date").agg(F.count(F.lit(1)).alias("cards"), *more)
        whole = [F.bool_or("open").alias("open"), F.min("lo").alias("lo"), F.max("hi").alias("hi")] if more else []
        return days.groupBy(key).agg(F.count("date").alias("dates"), F.sum("cards").alias("cards"), F.max("date").alias("latest"), *whole).where("dates >= 2")

    strong = counted("nct")
    weak = counted("acronym", F.bool_or(F.col("nct").isNull()).alias("open"), F.min("nct").alias("lo"), F.max("nct").alias("hi"))
    # of one strong key at most, so the whole group's cards are in the first set if none lacks it and it is there
    weak = weak.where("lo is null or lo = hi").join(strong.select(F.col("nct").alias("e_nct")), F.col("lo") == F.col("e_nct"), "left").where("open or e_nct is null")
    return strong.select(F.lit("nct").alias("kind"), F.col("nct").alias("key"), "dates", "cards", "latest").union(weak.select(F.lit("acronym"), "acronym", "dates", "cards", "latest"))


def prior_as_of(card: DataFrame, key: str) -> DataFrame:
    """For each key and date the newest earlier date's last card; one row for each (key, date) before the window."""
    one = card.where(F.col(key).isNotNull()).groupBy(key, "date").agg(F.max("card_id").alias("card_id"))
    w = Window.partitionBy(key).orderBy("date")
    return one.select(F.col(key).alias("key"), "date", "card_id", F.lag("date").over(w).alias("prior_date"), F.lag("card_id").over(w).alias("prior_card")).where("prior_date is not null")


def prior_estimate(card: DataFrame) -> DataFrame:
    """J12 for keys that aren't ambiguous: the newest earlier card of the same strong key and facet whose point differs."""
    one = card.where("nct is not null and modality is not null").groupBy("nct", "modality", "date").agg(F.min_by("point", "card_id").alias("point"), F.min("card_id").alias("card_id"))
    w = Window.partitionBy("nct", "modality").orderBy("date")
    return one.withColumn("prior", F.lag("point").over(w)).withColumn("changed", F.col("prior") != F.col("point")).where("changed").select("nct", "modality", "date", "card_id", "point", "prior")


def lineage(card: DataFrame) -> DataFrame:
    """Each card against the newest earlier one of its strong key: an ordered list of cases."""
    w = Window.partitionBy("nct").orderBy("date", "card_id")
    p = card.where("nct is not null").select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("card_id", "modality", "verdict", "point")))
    verdict = F.when(F.col("p_card_id").isNull(), "unrelated").when(F.col("modality").isNull() | F.col("p_modality").isNull(), "unrelated").when(F.col("modality") != F.col("p_modality"), "new-card").when(F.coalesce("verdict", F.lit("")) != F.coalesce("p_verdict", F.lit("")), "new-card").when(F.col("point") > F.col("p_point"), "update").otherwise("duplicate")
    return p.select("card_id", "nct", F.col("p_card_id").alias("prior"), verdict.alias("verdict"))


def collisions(rows: DataFrame, key: str, cluster: str) -> DataFrame:
    """Keys in more than one cluster."""
    return rows.groupBy(key).agg(F.countDistinct(cluster).alias("clusters")).where("clusters > 1")


def prior_reading(readings: DataFrame) -> DataFrame:
    """Date, slug, prior_date, prior_slug, point, lo, hi: the newest earlier reading of the same trial, kind of ratio and endpoint whose estimate differs.

    readings(date, slug, nct, key, site, kind, endpoint, point, lo, hi); an endpoint is named. Identity as in lineage.same_trial: it isn't transitive, so if two of the
    earlier readings that match aren't one trial, there is none. No pairs are listed: what a reading matches falls into classes (both registration and key,
    registration alone, key alone), each is a partition in order of time, and what can disagree shows in the classes' least and greatest values. Rows per reading: seven at most.
    """
    est = F.struct("point", "lo", "hi")
    rows = readings.where("endpoint != '' and kind is not null").withColumn("e", F.struct("date", "slug", est.alias("v")))
    n, k, s = F.col("nct").isNotNull(), F.col("key").isNotNull(), F.col("site").isNotNull()
    token = lambda name, *cols: F.struct(F.lit(name).alias("c"), F.concat_ws("\u0001", "kind", "endpoint", *cols).alias("t"))
    both, nct_only, key_only, any_key, any_nct = token("both", "nct", "key"), token("nct", "nct"), token("key", "key", "site"), token("any_key", "nct"), token("any_nct", "key", "site")
    own = F.array_compact(F.array(F.when(n & k, both), F.when(n & ~k, nct_only), F.when(k & s & ~n, key_only), F.when(n, any_key), F.when(k & s, any_nct)))
    asked = F.array_compact(F.array(F.when(n & k, both), F.when(n & k, nct_only), F.when(n & k & s, key_only), F.when(n & ~k, any_key), F.when(k & s & ~n, any_nct)))
    events = rows.select(F.explode(own).alias("p"), "date", "slug", "e", "nct", "key", "site")
    order = [F.col("date"), F.col("slug").desc()]
    line = Window.partitionBy("p").orderBy(*order)
    # the last one before that has another estimate
    events = events.withColumn("l", F.lag("e").over(line))
    events = events.withColumn("other", F.last(F.when(~F.col("l.v").eqNullSafe(F.col("e.v")), F.col("l")), True).over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("l")
    none = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    probes = rows.select(F.explode(asked).alias("p"), "date", "slug", none("e"), none("nct"), none("key"), none("site"), none("other"), est.alias("v"), F.col("site").alias("own"), F.lit(0).alias("late"))
    every = probes.unionByName(events.withColumn("late", F.lit(1)), allowMissingColumns=True)
    # probes of a date come before its events, so they see earlier dates only
    seen = Window.partitionBy("p").orderBy("date", "late", F.col("slug").desc()).rowsBetween(Window.unboundedPreceding, -1)
    got = every.withColumn("last", F.last(F.when(F.col("late") == 1, F.struct("e", "other")), True).over(seen))
    for c in ("nct", "key", "site"):
        got = got.withColumn(f"{c}_a", F.min(c).over(seen)).withColumn(f"{c}_b", F.max(c).over(seen))
    lone = F.count(F.when((F.col("late") == 1) & F.col("site").isNull(), 1)).over(seen)
    got = got.withColumn("unplaced", lone).where("late = 0 and last is not null")
    best = F.when(~F.col("last.e.v").eqNullSafe(F.col("v")), F.col("last.e")).otherwise(F.col("last.other"))
    # the site of what matches by both; a key alone needs the same one
    elsewhere = (F.col("p.c") == "both") & ((F.col("unplaced") > 0) | F.coalesce((F.col("site_a") != F.col("own")) | (F.col("site_b") != F.col("own")), F.lit(False)))
    apart = F.when(F.col("p.c") == "any_key", F.col("key_a") != F.col("key_b")).when(F.col("p.c") == "any_nct", F.col("nct_a") != F.col("nct_b")).otherwise(F.lit(False))
    has = lambda c: F.bool_or(F.col("p.c") == c)
    out = got.groupBy("date", "slug").agg(
        F.bool_or(F.coalesce(apart, F.lit(False))).alias("apart"), (has("key") & (has("nct") | F.bool_or(elsewhere))).alias("split"),
        # of one date the least slug: classes are few, so they are compared at once
        F.get(F.array_sort(F.collect_list(F.when(best.isNotNull(), F.struct((-F.datediff(best["date"].cast("date"), F.lit("1970-01-01"))).alias("d"), best["slug"].alias("s"), best.alias("b"))))), F.lit(0))["b"].alias("b"),
    )
    return out.where("not apart and not split and b is not null").select("date", "slug", F.col("b.date").alias("prior_date"), F.col("b.slug").alias("prior_slug"), "b.v.point", "b.v.lo", "b.v.hi")
