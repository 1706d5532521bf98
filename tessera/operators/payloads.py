"""What is published from cards: occurrences, feeds, indexes, badges. A feed's or index's text is made row by row; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.display import rfc822
from tessera.functions.identifiers import escaped_xml
from tessera.operators.tags import NAMESPACES, tagged

RECENT, FEED, CHANNEL_LINES = 30, 50, 20


def occurrences(card: DataFrame) -> DataFrame:
    """Tag, date, card_id, place (1 is the newest) of each card of a tag."""
    w = Window.partitionBy("tag").orderBy(F.desc("date"), "card_id")
    return tagged(card).select("tag", "date", "card_id", F.row_number().over(w).alias("place"))


def tag_payload(card: DataFrame, name: str = "site") -> DataFrame:
    """Tag, n, the name of its newest card, newest and oldest date."""
    t = tagged(card)
    newest = F.max_by(name, F.struct("date", -F.col("card_id")))
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), newest.alias("name"), F.max("date").alias("newest"), F.min("date").alias("oldest"))


def tag_list(card: DataFrame) -> DataFrame:
    """card_id, tags in the order of the namespaces, distinct, as one text."""
    tag = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}:"), F.lower(F.col(n))))
    return card.select("card_id", F.array_join(F.array_distinct(F.array_compact(F.array(*(tag(n) for n in NAMESPACES)))), " ").alias("tags"))


def tag_dimension(card: DataFrame) -> DataFrame:
    """Slug, namespace, label: of a slug in several namespaces the first namespace counts."""
    t = tagged(card).groupBy("slug", "ns").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, NAMESPACES)), F.col("ns"))
    return t.groupBy("slug").agg(F.min_by("ns", rank).alias("namespace"), F.sum("n").alias("cards"))


def search_index(card: DataFrame) -> DataFrame:
    """One entry a card: id, site, date and a line of at most 60 characters."""
    line = F.concat_ws(" ", "site", "meeting", "intent", "verdict")
    return card.select(F.concat_ws("#", F.col("date").cast("string"), F.col("card_id").cast("string")).alias("id"), F.lower("site").alias("site"), F.substring(line, 1, 60).alias("line"))


def feed_items(card: DataFrame, most: int = RECENT) -> DataFrame:
    """The latest cards as XML items, escaped."""
    last = card.orderBy(F.desc("date"), "card_id").limit(most)
    part = lambda name, c: F.concat(F.lit(f"<{name}>"), escaped_xml(c), F.lit(f"</{name}>"))
    link = F.concat(F.lit("/d/"), F.col("date").cast("string"), F.lit("#"), F.col("card_id").cast("string"))
    item = F.concat(F.lit("<item>"), part("title", F.concat_ws(" & ", "site", "meeting")), part("link", link), part("pubDate", rfc822(F.col("date").cast("string"))), F.lit("</item>"))
    return last.select("card_id", item.alias("item"))


def tag_feeds(card: DataFrame, most: int = FEED) -> DataFrame:
    """The latest cards of each tag, with their place in the tag's feed."""
    return occurrences(card).where(F.col("place") <= most)


def channel_post(card: DataFrame, most: int = CHANNEL_LINES) -> DataFrame:
    """A day's post: a line a card, then how many more there are; days have a bounded number of lines."""
    w = Window.partitionBy("date")
    rows = card.withColumn("place", F.row_number().over(w.orderBy("site", "card_id"))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("place") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" · ", "site", "meeting").alias("line")))), lambda x: x["line"])
    return rows.groupBy("date").agg(lines.alias("lines"), F.max("n").alias("n")).select("date", F.concat(F.array_join("lines", "\n"), F.when(F.col("n") > most, F.concat(F.lit("\n…and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")).alias("post"))


def whitelisted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Known columns only, in order."""
    return rows.select(*(c for c in columns if c in rows.columns))


def meetings(card: DataFrame) -> DataFrame:
    """Distinct meetings with their dates, newest first, as one text."""
    return card.where("meeting is not null").groupBy("meeting").agg(F.array_join(F.reverse(F.array_sort(F.collect_set(F.col("date").cast("string")))), ",").alias("dates"))


def by_site(card: DataFrame, sites: DataFrame) -> DataFrame:
    """All sites with their cards, 0 included, and whether there are any."""
    n = card.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return sites.join(n, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("populated"))


def new_by_site(card: DataFrame, baseline: DataFrame, sites: DataFrame) -> DataFrame:
    """New cards of each known site."""
    return card.join(baseline.select("card_id").distinct(), "card_id", "left_anti").join(sites, "site", "left_semi").groupBy("site").agg(F.count(F.lit(1)).alias("fresh"))


def top_tags(card: DataFrame, most: int = 20) -> DataFrame:
    """G28."""
    return tagged(card).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def renamed_paths(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths that were and are no more, each with its first date."""
    return before.groupBy("path").agg(F.min("date").alias("date")).join(now.select("path").distinct(), "path", "left_anti")


def combined(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Two lists as one: no blanks, distinct, in order."""
    one = lambda df: df.select(F.trim(F.col(column)).alias(column))
    return one(a).union(one(b)).where(F.col(column) != "").distinct().orderBy(column)


def source_rows(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows of several kinds as one table: kind, ref, text; blank texts are left out."""
    out = None
    for kind, (rows, key, text) in sources.items():
        one = rows.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("ref"), F.col(text).alias("text")).where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
        out = one if out is None else out.union(one)
    return out


def references(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """A study's references, and those that aren't slides."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col(kind) != "slide").alias("papers"))


def earliest_first(rows: DataFrame, group: str, question: str, completion: str, key: str, most: int = 3) -> DataFrame:
    """Of each question the earliest completion, NULLs last; the first questions of a group."""
    order = [F.col(completion).asc_nulls_last(), F.col(key)]
    one = rows.withColumn("r", F.row_number().over(Window.partitionBy(group, question).orderBy(*order))).where("r = 1")
    return one.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("r") <= most)


def match_score(slug_a: Column, nct_a: Column, refs_a: Column, slug_b: Column, nct_b: Column, refs_b: Column) -> Column:
    """0 for different registrations; equal slugs 1000, equal registrations 100, and the share of common references."""
    union = F.size(F.array_union(refs_a, refs_b))
    shared = F.when(union > 0, F.size(F.array_intersect(refs_a, refs_b)) / union).otherwise(0.0)
    same = F.coalesce(nct_a == nct_b, F.lit(False))
    return F.when(nct_a.isNotNull() & nct_b.isNotNull() & ~same, 0.0).when(F.coalesce((slug_a == slug_b) & (slug_a != ""), F.lit(False)), shared + 1000).when(same, shared + 100).otherwise(shared)


def budgeted(rows: DataFrame, group: str, order: list[str], n: str, most: int) -> DataFrame:
    """How many of each row's items fit into the group's budget, in order."""
    before = F.coalesce(F.sum(n).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("kept", F.greatest(F.lit(0), F.least(F.col(n), F.lit(most) - before)))
