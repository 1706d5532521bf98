"""JSON from outside, told apart by the types that it has, not by what it could be cast to. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import validate as V
from tessera.functions.sections import let, trimmed
from tessera.sources.tables import dealt

# States of a trial that is still running, and the longest phrase of a pinned one.
RUNNING = ["RECRUITING", "NOT_YET_RECRUITING", "ACTIVE_NOT_RECRUITING", "ENROLLING_BY_INVITATION"]
PHRASE_CHARS = 80


def kind(v: Column) -> Column:
    """string, number, boolean, null, array or object of a variant; NULL for none."""
    named = lambda s: F.when(s == "STRING", "string").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s.isNotNull(), "number")
    return let(F.schema_of_variant(v), named)


def part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column) -> Column:
    return let(v, lambda x: F.when(kind(x) == "string", F.try_variant_get(x, "$", "string")))


def items(v: Column) -> Column:
    """An array's items as variants; no array: none."""
    return let(v, lambda x: F.when(kind(x) == "array", F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))


def fault_of_pinned_trial(json: Column) -> Column:
    """the first rule that a pinned trial breaks; NULL if it breaks none. What is absent is of no type, so it is not null either."""
    return let(F.try_parse_json(json), _fault)


def _fault(v: Column) -> Column:
    text = {n: _text(part(v, n)) for n in ("nct", "overall_status", "brief_title", "answers_question", "relevance_phrase", "primary_completion_date")}
    is_kind = lambda n, *kinds: F.coalesce(kind(part(v, n)).isin(*kinds), F.lit(False))
    strings = lambda n: is_kind(n, "array") & F.coalesce(F.forall(items(part(v, n)), lambda x: F.coalesce(kind(x), F.lit("")) == "string"), F.lit(False))
    objects = items(part(v, "interventions"))
    named = lambda x: (kind(part(x, "name")) == "string") & (kind(part(x, "type")) == "string")
    # entries are looked at one after the other, each for both rules
    first = F.get(F.filter(F.transform(objects, lambda x: F.when(F.coalesce(kind(x), F.lit("")) != "object", "interventions[] entries must be objects").when(~F.coalesce(named(x), F.lit(False)), "interventions[] entries must have string name and type")), lambda m: m.isNotNull()), F.lit(0))
    lacks = lambda n: F.coalesce(trimmed(text[n]), F.lit("")) == ""
    return (
        F.when(F.coalesce(kind(v), F.lit("")) != "object", "not an object")
        .when(~F.coalesce(text["nct"].rlike("^NCT[0-9]{8}$"), F.lit(False)), "invalid nct format")
        .when(~F.coalesce(text["overall_status"].isin(RUNNING), F.lit(False)), "overall_status not in enum")
        .when(lacks("brief_title"), "missing brief_title").when(lacks("answers_question"), "missing answers_question").when(lacks("relevance_phrase"), "missing relevance_phrase")
        .when(F.length(text["relevance_phrase"]) > PHRASE_CHARS, f"relevance_phrase too long (>{PHRASE_CHARS})")
        .when(~(is_kind("phase", "null") | strings("phase")), "phase must be string[] or null")
        .when(~is_kind("enrollment_count", "null", "number"), "enrollment_count must be number or null")
        .when(~is_kind("primary_completion_date", "null", "string"), "primary_completion_date must be string or null")
        .when(~text["primary_completion_date"].rlike("^[0-9]{4}(-[0-9]{2})?$"), "primary_completion_date must be YYYY or YYYY-MM")
        .when(~is_kind("brief_summary", "null", "string"), "brief_summary must be string or null").when(~is_kind("eligibility_brief", "null", "string"), "eligibility_brief must be string or null")
        .when(~strings("conditions"), "conditions must be string[]").when(~is_kind("interventions", "array"), "interventions must be an array").otherwise(first)
    )


def clusters(answers: DataFrame, items_: DataFrame) -> DataFrame:
    """Date, pos, slug, name, site, content_type, ids of the clusters that answers(date, json) give of items(date, id): those with a safe slug that is new, a name, and a known id."""
    root = F.try_parse_json(V.unfenced(F.col("json")))
    rows = answers.select("date", F.posexplode(items(part(root, "studies"))).alias("pos", "c"))
    low = lambda n: F.coalesce(trimmed(_text(part(F.col("c"), n))), F.lit(""))
    number = F.transform(F.filter(items(part(F.col("c"), "tweet_ids")), lambda x: kind(x) == "number"), lambda x: F.try_variant_get(x, "$", "bigint"))
    rows = rows.select("date", "pos", F.lower(low("slug")).alias("slug"), low("name").alias("name"), F.when(low("disease_site").isin(*V.SITES), low("disease_site")).otherwise("other").alias("site"), V.content_type(_text(part(F.col("c"), "content_type"))).alias("content_type"), number.alias("ids"))
    known = dealt(rows.select("date", "pos", F.posexplode("ids").alias("at", "id")), "date", "id").join(dealt(items_.select("date", "id"), "date", "id"), ["date", "id"], "left_semi")
    known = known.groupBy("date", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
    good = rows.drop("ids").where(V.safe_slug(F.col("slug")) & (F.col("name") != "")).join(known, ["date", "pos"])
    return good.withColumn("n", F.row_number().over(Window.partitionBy("date", "slug").orderBy("pos"))).where("n = 1").drop("n")


def uncovered(found: DataFrame, items_: DataFrame) -> DataFrame:
    """Date, missing, duplicated of dates whose clusters aren't an exact cover: ids in none, ids in several (or twice in one). Dates without fault give no row."""
    used, each = found.select("date", F.explode("ids").alias("id"), F.lit(1).alias("u")).where("date is not null and id is not null"), items_.select("date", "id", F.lit(0).alias("u"))
    # ids meet as rows, item or use, and are dealt before they are counted: nearly all are different, so counting them where they are read only takes memory
    met = dealt(each.unionByName(used), "date", "id").groupBy("date", "id").agg(F.sum("u").alias("n"), F.min("u").alias("item")).where("item = 0")
    got = met.groupBy("date").agg(F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("n") > 1).alias("duplicated"))
    return got.where("missing > 0 or duplicated > 0")
