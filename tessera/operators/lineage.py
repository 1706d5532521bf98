"""Whether two readings report one trial, and what a new reading does to an earlier one.

A reading is a row: date, slug, ncts (array), keys (array), site, facet, maturity, followup_months, endpoint, stat_value,
stat_detail. Candidates are found by equi-joins on registrations and on keys, never by pairing all readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.identifiers import trial_key, trial_names

# Strengths of the two kinds of evidence, and the order of maturities.
BY_NCT, BY_NAME = 10, 3
RANK = {"conference-abstract": 0, "full-publication": 1}
READING = "date slug ncts keys site facet maturity followup_months endpoint stat_value stat_detail".split()


def keys_of(name: Column, acronyms: Column) -> Column:
    """The key of the name, else the keys of the declared acronyms."""
    own = trial_key(name)
    declared = F.array_distinct(F.filter(F.transform(F.coalesce(acronyms, F.array().cast("array<string>")), trial_key), lambda k: k.isNotNull()))
    return F.when(own.isNotNull(), F.array(own)).otherwise(declared)


def upper_set(ncts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(ncts, F.upper), lambda n: n.isNotNull() & (n != "")))


def share_registration(a: Column, b: Column) -> Column:
    """I08."""
    return F.coalesce(F.arrays_overlap(upper_set(a), upper_set(b)), F.lit(False))


def same_trial(ncts_a: Column, keys_a: Column, site_a: Column, ncts_b: Column, keys_b: Column, site_b: Column) -> Column:
    """No conflict of registrations or of keys; then a common registration, or a common key at one known site."""
    a, b = upper_set(ncts_a), upper_set(ncts_b)
    both_n, both_k = F.arrays_overlap(a, b), F.arrays_overlap(keys_a, keys_b)
    conflict = ((F.size(a) > 0) & (F.size(b) > 0) & ~both_n) | ((F.size(keys_a) > 0) & (F.size(keys_b) > 0) & ~both_k)
    return F.coalesce(~conflict & (both_n | (both_k & (site_a == site_b))), F.lit(False))


def plain_endpoint(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def _stat(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def moved(value_a: Column, detail_a: Column, value_b: Column, detail_b: Column) -> Column:
    """A statistic that both have differs, blanks aside."""
    differ = lambda x, y: F.coalesce(_stat(x) != _stat(y), F.lit(False))
    return differ(value_a, value_b) | differ(detail_a, detail_b)


def ratio_moved(a: list[Column], b: list[Column]) -> Column:
    """Point or an end of the interval differs, NULL being a value of its own."""
    out = F.lit(False)
    for x, y in zip(a, b, strict=True):
        out = out | ~x.eqNullSafe(y)
    return out


def rank(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), c)


def blockers(shared: Column, named: Column, followup: Column, prior_followup: Column, maturity: Column, prior_maturity: Column) -> Column:
    """Codes of the preconditions that refuse, in order: identity, endpoint, followup, maturity."""
    low = F.coalesce(followup < prior_followup, F.lit(True))
    young = F.coalesce(rank(maturity) < rank(prior_maturity), F.lit(True))
    codes = F.array(F.when(~shared, "identity"), F.when(~named, "endpoint"), F.when(low, "followup"), F.when(young, "maturity"))
    return F.filter(codes, lambda c: c.isNotNull())


def primary_blocker(codes: Column) -> Column:
    """The first that isn't identity, else the first."""
    return F.coalesce(F.get(F.filter(codes, lambda c: c != "identity"), F.lit(0)), F.get(codes, F.lit(0)))


def identity_only(codes: Column) -> Column:
    """I06."""
    return (F.size(codes) > 0) & F.forall(codes, lambda c: c == "identity")


def candidates(readings: DataFrame) -> DataFrame:
    """Pairs (c_*, p_*) of a reading and earlier ones of the same trial."""
    def side(x: str) -> DataFrame:
        return readings.select(*(F.col(n).alias(f"{x}_{n}") for n in READING))

    def met(by: str) -> DataFrame:
        tokens = upper_set(F.col("ncts")) if by == "ncts" else F.col("keys")
        rows = readings.select("date", "slug", "site", F.explode(tokens).alias("t"))
        one = rows.select("t", F.col("site").alias("cs"), F.col("date").alias("c_date"), F.col("slug").alias("c_slug"))
        two = rows.select("t", F.col("site").alias("ps"), F.col("date").alias("p_date"), F.col("slug").alias("p_slug"))
        # a key alone counts only at one site, so the site is part of the join
        on = ["t"] if by == "ncts" else (one["t"] == two["t"]) & (one["cs"] == two["ps"])
        return one.join(two, on).where("p_date < c_date").select("c_date", "c_slug", "p_date", "p_slug")

    pairs = met("ncts").union(met("keys")).distinct()
    got = pairs.join(side("c"), ["c_date", "c_slug"]).join(side("p"), ["p_date", "p_slug"])
    return got.where(same_trial(*(F.col(f"{x}_{n}") for x in "cp" for n in ("ncts", "keys", "site"))))


def classified(readings: DataFrame) -> DataFrame:
    """Date, slug, kind (unrelated, new-card, update, duplicate), prior_date, prior_slug, blocker, identity_only, certain, corroborated.

    Earlier readings that aren't one trial among themselves make the match ambiguous: unrelated. Among the rest those of a
    compatible objective come first, then the newest.
    """
    pairs = candidates(readings)
    same_facet = F.col("p_facet").eqNullSafe(F.col("c_facet")) | ((F.col("c_facet") == "long-term-followup") & (F.col("p_facet") == "primary-efficacy"))
    pairs = pairs.withColumn("fits", F.coalesce(same_facet, F.lit(False)))
    who = Window.partitionBy("c_date", "c_slug")
    # all pairs of priors agree if no two differ in a registration or a key, and any two share one of them
    identity = F.struct(upper_set(F.col("p_ncts")).alias("n"), F.col("p_keys").alias("k"), F.col("p_site").alias("s"))
    priors = F.collect_set(identity).over(who)
    agree = F.forall(priors, lambda a: F.forall(priors, lambda b: (a.eqNullSafe(b)) | same_trial(a["n"], a["k"], a["s"], b["n"], b["k"], b["s"])))
    pairs = pairs.withColumn("agree", agree)
    best = pairs.withColumn("r", F.row_number().over(who.orderBy(F.col("fits").desc(), F.col("p_date").desc(), "p_slug"))).where("r = 1")
    c, p = (lambda n: F.col(f"c_{n}")), (lambda n: F.col(f"p_{n}"))
    ce, pe = plain_endpoint(c("endpoint")), plain_endpoint(p("endpoint"))
    named = (ce != "") & (pe != "")
    codes = blockers(share_registration(c("ncts"), p("ncts")), named, c("followup_months"), p("followup_months"), c("maturity"), p("maturity"))
    matures = F.coalesce(rank(c("maturity")) > rank(p("maturity")), F.lit(False))
    longer = F.coalesce(c("followup_months") > p("followup_months"), F.lit(False))
    kind = (
        F.when(~F.col("agree") | c("facet").isNull() | p("facet").isNull(), "unrelated")
        .when(~F.col("fits") | (named & (ce != pe)), "new-card")
        .when(matures | longer | (named & moved(c("stat_value"), c("stat_detail"), p("stat_value"), p("stat_detail"))), "update")
        .otherwise("duplicate")
    )
    has = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    symmetric = has(c("stat_value")) & has(p("stat_value")) & (has(c("stat_detail")) == has(p("stat_detail")))
    free, of = F.size(codes) == 0, F.col("kind")
    got = best.withColumn("kind", kind).select(
        F.col("c_date").alias("date"), F.col("c_slug").alias("slug"), "kind",
        F.when(of != "unrelated", F.col("p_date")).alias("prior_date"), F.when(of != "unrelated", F.col("p_slug")).alias("prior_slug"),
        F.when((of == "duplicate") & free & ~symmetric, "symmetry").when(of.isin("update", "duplicate"), primary_blocker(codes)).alias("blocker"),
        F.when(of == "update", identity_only(codes)).when(of == "duplicate", identity_only(codes) & symmetric).otherwise(F.lit(False)).alias("identity_only"),
        ((of == "duplicate") & free & symmetric).alias("certain"), ((of == "update") & free).alias("corroborated"),
    )
    return readings.select("date", "slug").join(got, ["date", "slug"], "left").withColumn("kind", F.coalesce("kind", F.lit("unrelated")))


def coverage(readings: DataFrame, by: str) -> DataFrame:
    """Token (registration or key), n readings, newest, oldest date."""
    return readings.select("date", F.explode(upper_set(F.col("ncts")) if by == "ncts" else F.col("keys")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("newest"), F.min("date").alias("oldest"))


def association(items: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """group_id, reason, strength, items (number), first, last: items that name one registration, or one acronym with a digit or hyphen.

    An acronym's group whose items all lie in a registration's, or in that of an acronym seen earlier (by item, then place in the text), is left out. Whether one
    lies in another is told by how many items name both: as many as name the one. Those are counted where an item's names are together.
    """
    named = lambda c, strength: F.transform(c, lambda x, i: F.struct(x.alias("token"), F.lit(strength).alias("strength"), i.alias("pos")))
    ncts = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(\bNCT[0-9]{8}\b)"), F.lit(1)))
    names = items.select(F.col(key).alias("item"), F.concat(named(ncts, BY_NCT), named(trial_names(F.col(text)), BY_NAME)).alias("names")).where("size(names) > 0")
    names = names.groupBy("item").agg(F.flatten(F.collect_list("names")).alias("names"))
    both = names.select("item", F.inline("names")).groupBy("item", "token", "strength").agg(F.min("pos").alias("pos"))
    got = both.groupBy("token", "strength").agg(F.count("item").alias("items"), F.min("item").alias("first"), F.max("item").alias("last"), F.min_by("pos", "item").alias("pos")).where("items >= 2")
    alone = F.array_distinct(F.transform("names", lambda x: F.struct(x["token"].alias("token"), x["strength"].alias("strength"))))
    pairs = names.where("item is not null").select(alone.alias("names")).select("names", F.explode(F.filter("names", lambda x: x["strength"] == BY_NAME)).alias("g"))
    pairs = pairs.select(F.col("g.token").alias("token"), F.explode(F.filter("names", lambda x: x != F.col("g"))).alias("h")).select("token", F.col("h.token").alias("h"), F.col("h.strength").alias("h_strength"))
    common = pairs.groupBy("token", "h", "h_strength").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    seen = F.struct("first", "pos")
    inner = got.where(F.col("strength") == BY_NAME).select("token", F.col("items").alias("c"), seen.alias("g_seen"))
    outer = got.select(F.col("token").alias("h"), F.col("strength").alias("h_strength"), seen.alias("h_seen"))
    within = common.join(inner, ["token", "c"]).join(outer, ["h", "h_strength"]).where((F.col("h_strength") == BY_NCT) | (F.col("h_seen") < F.col("g_seen")))
    kept = got.join(within.select("token", F.lit(BY_NAME).alias("strength")).distinct(), ["token", "strength"], "left_anti")
    reason = F.concat(F.when(F.col("strength") == BY_NCT, "shared ").otherwise("shared acronym "), "token")
    return kept.select(F.lower("token").alias("group_id"), reason.alias("reason"), F.col("strength").cast("int").alias("strength"), "items", "first", "last")
