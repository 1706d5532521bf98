"""Tag algebra over cards: facets, reverse index, frequent combinations, filters, activity, siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import slugify

NAMESPACES = ("modality", "intent", "methodology", "verdict", "meeting")


def tagged(card: DataFrame) -> DataFrame:
    """One row for each card and tag, by unpivoting the facet columns; NULL facets give none."""
    keep = [c for c in ("card_id", "date", "site") if c in card.columns]
    return card.unpivot(keep, list(NAMESPACES), "ns", "value").where("value is not null").withColumn("slug", slugify(F.col("value"))).drop("value").withColumn("tag", F.concat_ws(":", "ns", "slug"))


def facet_counts(card: DataFrame) -> DataFrame:
    """Count of cards for each facet value, and its rank in the facet by count, then slug."""
    n = tagged(card).groupBy("ns", "slug").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("ns").orderBy(F.desc("n"), "slug")))


def grouping_sets(card: DataFrame) -> DataFrame:
    """Three histograms and the total in one pass."""
    names = ["modality", "intent", "methodology"]
    return card.groupingSets([[F.col(n)] for n in names] + [[]], *names).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def reverse_index(card: DataFrame) -> DataFrame:
    """The number of distinct cards and of dates of each tag."""
    return tagged(card).groupBy("tag").agg(F.countDistinct("card_id").alias("cards"), F.countDistinct("date").alias("dates"))


def pairs(card: DataFrame, threshold: int = 3) -> DataFrame:
    """W06, arity 2: pairs of tags on at least so many cards. A card has at most one tag of each namespace, so ten pairs."""
    t = card.select("card_id", *(F.when(F.col(n).isNotNull(), F.concat(F.lit(n + ":"), slugify(F.col(n)))).alias(n) for n in NAMESPACES))
    tags = F.array_sort(F.array_compact(F.array(*NAMESPACES)))
    two = t.select("card_id", tags.alias("t")).select(F.explode(F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, len(NAMESPACES)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return two.groupBy(F.col("p.a").alias("tag_a"), F.col("p.b").alias("tag_b")).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= threshold)


def triples(card: DataFrame, threshold: int = 3, cap: int = 1000) -> DataFrame:
    """W06, W07, arity 3: Apriori: only triples whose three pairs are frequent are counted; the cap is by support, then tags."""
    t = tagged(card).select("card_id", "tag")
    good = pairs(card, threshold).select("tag_a", "tag_b")
    a, b, c = (t.select("card_id", F.col("tag").alias(f"tag_{x}")) for x in "abc")
    two = a.join(b, "card_id").where("tag_a < tag_b").join(good, ["tag_a", "tag_b"], "left_semi")
    three = two.join(c, "card_id").where("tag_b < tag_c")
    for x, y in (("a", "c"), ("b", "c")):
        three = three.join(good.toDF(f"tag_{x}", f"tag_{y}"), [f"tag_{x}", f"tag_{y}"], "left_semi")
    n = three.groupBy("tag_a", "tag_b", "tag_c").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= threshold)
    return n.orderBy(F.desc("support"), "tag_a", "tag_b", "tag_c").limit(cap)


def having_all(card: DataFrame, tags: list[str]) -> DataFrame:
    """Cards that have all tags; an empty list gives none."""
    got = tagged(card).where(F.col("tag").isin(tags) if tags else F.lit(False)).groupBy("card_id", "date").agg(F.countDistinct("tag").alias("n"))
    return got.where(F.col("n") == len(set(tags))).select("card_id", "date")


def relaxation(card: DataFrame, tags: list[str], locked: tuple[str, ...] = ()) -> DataFrame:
    """if no card has all tags, for each unlocked one the cards that have all others; best two."""
    got = tagged(card).where(F.col("tag").isin(tags)).groupBy("card_id").agg(F.collect_set("tag").alias("own"))
    missing = F.array_except(F.array(*map(F.lit, tags)), F.col("own"))
    some = got.select(missing.alias("m"))
    full = some.agg(F.count_if(F.size("m") == 0).alias("full"))
    one = some.where(F.size("m") == 1).groupBy(F.get("m", F.lit(0)).alias("dropped")).agg(F.count(F.lit(1)).alias("n"))
    # full has one row
    return one.where(~F.col("dropped").isin(list(locked)) if locked else F.lit(True)).join(F.broadcast(full.where("full = 0").select(F.lit(1).alias("empty"))), F.col("empty") == 1).select("dropped", "n").orderBy(F.desc("n"), "dropped").limit(2)


def siblings(card: DataFrame, most: int = 3) -> DataFrame:
    """For each card the newest others of its site and verdict (NULL is a verdict), and of its modality if it has one.

    Each group is ranked once and cut to most + 1 candidates before the join, so nothing is squared.
    """
    order = [F.desc("date"), F.col("card_id")]
    few = lambda keys: card.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= most + 1).select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("card_id").alias("sibling"), F.col("date").alias("s_date"))
    base = card.select("card_id", "site", "verdict", "modality")
    same = base.where("modality is not null").join(few(["site", "verdict", "modality"]), (F.col("site") == F.col("s_site")) & F.col("verdict").eqNullSafe(F.col("s_verdict")) & (F.col("modality") == F.col("s_modality"))).select("card_id", "sibling", "s_date")
    wide = base.where("modality is null").join(few(["site", "verdict"]), (F.col("site") == F.col("s_site")) & F.col("verdict").eqNullSafe(F.col("s_verdict"))).select("card_id", "sibling", "s_date")
    rank = F.row_number().over(Window.partitionBy("card_id").orderBy(F.desc("s_date"), "sibling"))
    return same.union(wide).where("card_id <> sibling").withColumn("rank", rank).where(F.col("rank") <= most).select("card_id", "sibling", "rank")


def activity(rows: DataFrame, last: int = 14, top: int = 20) -> DataFrame:
    """rows(date, tag) over the last so many dates that occur: counts by recency, trend of later against earlier half."""
    dates = rows.select("date").distinct().orderBy(F.desc("date")).limit(last)
    w = Window.orderBy("date")
    numbered = dates.withColumn("i", F.row_number().over(w)).withColumn("n_days", F.count(F.lit(1)).over(Window.partitionBy()))  # at most `last` rows
    n = rows.join(F.broadcast(numbered), "date").groupBy("tag", "i", "n_days").agg(F.count(F.lit(1)).alias("c"))
    half = F.floor(F.col("n_days") / 2)
    got = n.groupBy("tag").agg(F.sum("c").alias("total"), F.round(F.sum(F.col("c") * F.col("i") / F.col("n_days")), 6).alias("weight"), F.sum(F.when(F.col("i") <= half, F.col("c")).otherwise(0)).alias("early"), F.sum(F.when(F.col("i") > F.col("n_days") - half, F.col("c")).otherwise(0)).alias("late"))
    trend = F.when(F.col("late") - F.col("early") > 1, "up").when(F.col("late") - F.col("early") < -1, "down").otherwise("flat")
    return got.withColumn("trend", trend).orderBy(F.desc("weight"), F.expr("case trend when 'up' then 0 when 'flat' then 1 else 2 end"), "tag").limit(top)
