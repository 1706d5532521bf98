"""Queries over tables of readings, cards, queues and states, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from tessera.functions import effects as E
from tessera.functions import text as T
from tessera.operators import lineage, payloads, store
from tessera.sources.tables import cards, table
from tessera.streaming import ingest

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

CARD = """card AS (SELECT o_orderkey AS card_id, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS site,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS verdict, CASE WHEN o_orderstatus IN ('F','O') THEN o_orderstatus END AS modality,
 n_name AS meeting, r_name AS intent, 'm' || CAST(o_orderkey % 7 AS VARCHAR) AS methodology
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SLUG = "regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
TAGGED = f"""{CARD}, raw AS (SELECT card_id, date, site, unnest(['modality','intent','methodology','verdict','meeting']) AS ns, unnest([modality,intent,methodology,verdict,meeting]) AS value FROM card),
 tagged AS (SELECT card_id, date, site, ns, {SLUG} AS slug, ns || ':' || {SLUG} AS tag FROM raw WHERE value IS NOT NULL)"""
# Readings: an order's customer is its registration (or none), a third of it the key; facets and figures follow from the numbers.
READING = """r AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 's' || o_orderkey AS slug, CASE WHEN o_custkey % 4 <> 0 THEN 'NCT' || o_custkey END AS nct, CASE WHEN o_custkey % 5 <> 0 THEN 'K' || (o_custkey // 3) END AS key, 's' || (o_custkey % 2) AS site,
 ['primary-efficacy', 'long-term-followup', NULL, 'quality-of-life'][o_orderkey % 4 + 1] AS facet, ['conference-abstract', 'full-publication', NULL][o_orderkey % 3 + 1] AS maturity, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 5 * 12 AS DOUBLE) END AS followup_months,
 ['OS', 'o.s.', 'PFS', NULL][(o_orderkey // 4) % 3 + 1 + o_orderkey % 2] AS endpoint, 'HR ' || (o_orderkey % 3) AS stat_value, CASE WHEN o_orderkey % 2 = 0 THEN 'p' END AS stat_detail FROM orders WHERE o_custkey % 3 = 0)"""
SAME = "(NOT (a.nct IS NOT NULL AND b.nct IS NOT NULL AND a.nct <> b.nct) AND NOT (a.key IS NOT NULL AND b.key IS NOT NULL AND a.key <> b.key) AND (coalesce(a.nct = b.nct, false) OR coalesce(a.key = b.key AND a.site = b.site, false)))"


def readings(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 3 = 0")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    named = lambda prefix, v: F.concat(F.lit(prefix), v.cast("string"))
    return o.select(
        F.to_date("o_orderdate").cast("string").alias("date"), named("s", k).alias("slug"),
        F.array_compact(F.array(F.when(c % 4 != 0, named("NCT", c)))).alias("ncts"), F.array_compact(F.array(F.when(c % 5 != 0, named("K", F.floor(c / 3))))).alias("keys"), named("s", c % 2).alias("site"),
        pick(["primary-efficacy", "long-term-followup", None, "quality-of-life"], k % 4).alias("facet"), pick(["conference-abstract", "full-publication", None], k % 3).alias("maturity"),
        F.when(k % 7 != 0, (k % 5 * 12).cast("double")).alias("followup_months"), pick(["OS", "o.s.", "PFS", None], F.floor(k / 4) % 3 + k % 2).alias("endpoint"),
        named("HR ", k % 3).alias("stat_value"), F.when(k % 2 == 0, "p").alias("stat_detail"),
    )


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {READING} SELECT a.date, a.slug, b.date AS prior_date, b.slug AS prior_slug FROM r a JOIN r b ON b.date < a.date AND (a.nct = b.nct OR a.key = b.key) WHERE {SAME}")
def lineage_candidates(spark, d):
    """J09, J14, I01, I03."""
    return lineage.candidates(readings(spark, d)).select(F.col("c_date").alias("date"), F.col("c_slug").alias("slug"), F.col("p_date").alias("prior_date"), F.col("p_slug").alias("prior_slug"))


_EP = "regexp_replace(lower(coalesce({x}.endpoint, '')), '[^a-z0-9]', '', 'g')"
_RANK = "CASE {x}.maturity WHEN 'conference-abstract' THEN 0 WHEN 'full-publication' THEN 1 END"


@query(f"""WITH {READING}, m AS (SELECT a.date AS cd, a.slug AS cs, b.date AS pd, b.slug AS ps, coalesce(a.facet IS NOT DISTINCT FROM b.facet OR (a.facet = 'long-term-followup' AND b.facet = 'primary-efficacy'), false) AS fits FROM r a JOIN r b ON b.date < a.date AND (a.nct = b.nct OR a.key = b.key) WHERE {SAME}),
 bad AS (SELECT DISTINCT x.cd, x.cs FROM m x JOIN m y ON x.cd = y.cd AND x.cs = y.cs JOIN r a ON a.date = x.pd AND a.slug = x.ps JOIN r b ON b.date = y.pd AND b.slug = y.ps WHERE NOT {SAME} AND NOT (a.nct IS NOT DISTINCT FROM b.nct AND a.key IS NOT DISTINCT FROM b.key AND a.site IS NOT DISTINCT FROM b.site)),
 best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cd, cs ORDER BY fits DESC, pd DESC, ps) = 1),
 j AS (SELECT best.*, bad.cd IS NULL AS agree, a.facet AS af, b.facet AS bf, {_EP.format(x='a')} AS ae, {_EP.format(x='b')} AS be, coalesce({_RANK.format(x='a')} > {_RANK.format(x='b')}, false) AS matures, coalesce({_RANK.format(x='a')} < {_RANK.format(x='b')}, true) AS young,
  coalesce(a.followup_months > b.followup_months, false) AS longer, coalesce(a.followup_months < b.followup_months, true) AS short, coalesce(a.stat_value <> b.stat_value, false) OR coalesce(a.stat_detail <> b.stat_detail, false) AS moved, coalesce(a.nct = b.nct, false) AS shared, (a.stat_detail IS NULL) = (b.stat_detail IS NULL) AS sym
  FROM best JOIN r a ON a.date = cd AND a.slug = cs JOIN r b ON b.date = pd AND b.slug = ps LEFT JOIN bad USING (cd, cs)),
 k AS (SELECT *, ae <> '' AND be <> '' AS named, CASE WHEN NOT agree OR af IS NULL OR bf IS NULL THEN 'unrelated' WHEN NOT fits OR (ae <> '' AND be <> '' AND ae <> be) THEN 'new-card' WHEN matures OR longer OR (ae <> '' AND be <> '' AND moved) THEN 'update' ELSE 'duplicate' END AS kind FROM j),
 q AS (SELECT *, shared AND named AND NOT short AND NOT young AS free, CASE WHEN NOT named THEN 'endpoint' WHEN short THEN 'followup' WHEN young THEN 'maturity' WHEN NOT shared THEN 'identity' END AS first, NOT shared AND named AND NOT short AND NOT young AS sole FROM k)
 SELECT r.date, r.slug, coalesce(kind, 'unrelated') AS kind, CASE WHEN kind <> 'unrelated' THEN pd END AS prior_date, CASE WHEN kind <> 'unrelated' THEN ps END AS prior_slug, CASE WHEN kind = 'duplicate' AND free AND NOT sym THEN 'symmetry' WHEN kind IN ('update', 'duplicate') THEN first END AS blocker,
 CASE WHEN kind = 'update' THEN sole WHEN kind = 'duplicate' THEN sole AND sym WHEN kind IS NOT NULL THEN false END AS identity_only, CASE WHEN kind IS NOT NULL THEN kind = 'duplicate' AND free AND sym END AS certain, CASE WHEN kind IS NOT NULL THEN kind = 'update' AND free END AS corroborated FROM r LEFT JOIN q ON r.date = cd AND r.slug = cs""")
def lineage_classified(spark, d):
    """J13, I04-I07, F15."""
    return lineage.classified(readings(spark, d))


@query(f"WITH {READING} SELECT nct AS token, count(*) AS n, max(date) AS newest, min(date) AS oldest FROM r WHERE nct IS NOT NULL GROUP BY 1")
def coverage_by_registration(spark, d):
    """G07."""
    return lineage.coverage(readings(spark, d), "ncts")


@query(f"WITH {READING} SELECT key AS token, count(*) AS n, max(date) AS newest, min(date) AS oldest FROM r WHERE key IS NOT NULL GROUP BY 1")
def coverage_by_key(spark, d):
    """G08."""
    return lineage.coverage(readings(spark, d), "keys")


@query("""WITH i AS (SELECT o_orderkey AS id, 'NCT' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS nct, ['TRIAL-' || (o_custkey // 4), 'TWIN-' || (o_custkey // 4), 'DUO-' || (o_custkey // 8)] AS names FROM orders),
 t AS (SELECT id, nct AS token, 10 AS strength, 0 AS pos FROM i UNION ALL SELECT id, unnest(names), 3, generate_subscripts(names, 1) FROM i),
 g AS (SELECT token, strength, list(id ORDER BY id) AS ids, min(id) AS first, max(id) AS last, min(id * 10 + pos) AS seen FROM t GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT lower(token) AS group_id, CASE strength WHEN 10 THEN 'shared ' ELSE 'shared acronym ' END || token AS reason, strength, len(ids) AS items, first, last FROM g
 WHERE strength = 10 OR NOT EXISTS (SELECT 1 FROM g h WHERE (h.strength = 10 OR h.seen < g.seen) AND h.first <= g.first AND h.last >= g.last AND len(h.ids) >= len(g.ids) AND list_has_all(h.ids, g.ids))""")
def association_groups(spark, d):
    """Trials lie in a wider one, a twin of each has the same items, some trials have one registration only."""
    c = lambda n: F.floor(F.col("o_custkey") / n).cast("string")
    text = F.concat(F.lit("OS in NCT"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit(" and TRIAL-"), c(4), F.lit(", TWIN-"), c(4), F.lit(" or DUO-"), c(8), F.lit(" of NSCLC, PHASE3"))
    return lineage.association(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")))


@query("SELECT ['os', 'pfs', 'local'][p_partkey % 3 + 1] || '::' || p_brand AS bucket, round(CAST(CASE " + " ".join(f"WHEN e <= {r} THEN {r}" for r in E.RUNGS) + " ELSE pow(10, ceil(log10(e))) END AS DOUBLE), 6) AS domain FROM (SELECT min(p_partkey) AS p_partkey, p_brand, exp(greatest(max(abs(ln(p_retailprice / 1000))), ln(2.0)) * 1.15) AS e FROM part WHERE p_partkey % 4 <> 3 GROUP BY p_partkey % 4, p_brand) x(p_key, p_brand, e), LATERAL (SELECT p_key % 4 AS p_partkey)")
def corpus_axes(spark, d):
    """One axis for each family and kind; endpoints of no family have none."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Overall survival").when(k == 1, "PFS").when(k == 2, "Local control").otherwise("Cost")
    rows = table(spark, d, "part").withColumn("family", E.family(name)).where("family <> 'other'")
    got = rows.groupBy(E.bucket(name, F.col("p_brand")).alias("bucket")).agg(F.max(E.half_width(F.col("p_retailprice") / 1000)).alias("m"))
    return got.select("bucket", F.round(E.axis_end(F.col("m")), 6).alias("domain"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND user_id >= 10 AND user_id <= 60")
def scan_predicates(spark, d):
    """S04, S05, S06, S09, S10."""
    return store.scan(table(spark, d, "events"), [F.desc("ts"), F.col("event_id")], {"event_type": "purchase", "props": None}, {"user_id": (10, 60)}).select("event_id", "user_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 5 < 3")
def work_queue_scan(spark, d):
    """S08."""
    o = table(spark, d, "orders")
    rows = o.withColumn("status", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "failed").otherwise("enriched")).withColumn("attempts", F.col("o_orderkey") % 5)
    return store.workable(rows, "status", "attempts").select("o_orderkey", "o_orderstatus")


@query("""WITH g AS (SELECT user_id, event_type, ts, event_id, event_id % 7 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT user_id, arg_max(event_type, (ts, event_id)) AS reason, max(tm - i) + max(i) AS generation, count(*) AS requests, 0 AS attempts FROM g GROUP BY 1""")
def queue_generations(spark, d):
    """M06."""
    e = table(spark, d, "events").withColumn("at", F.col("event_id") % 7)
    return store.enqueued(e, "user_id", "event_type", ["ts", "event_id"], "at")


@query("SELECT user_id, max(event_id) AS generation FROM events GROUP BY 1 HAVING NOT bool_or(event_id % 4 = 0 AND event_id = (SELECT max(x.event_id) FROM events x WHERE x.user_id = events.user_id))")
def queue_done(spark, d):
    """Only the present generation is taken off."""
    e = table(spark, d, "events")
    queue = e.groupBy("user_id").agg(F.max("event_id").alias("generation"))
    return store.done(queue, e.where("event_id % 4 = 0").select("user_id", F.col("event_id").alias("generation")), "user_id")


@query("WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1) SELECT user_id, 1 AS generation, n AS attempts, n >= 3 AS dead FROM f")
def queue_failures(spark, d):
    """M08, M32."""
    e = table(spark, d, "events")
    queue = e.select("user_id").distinct().withColumn("generation", F.lit(1)).withColumn("attempts", F.lit(0).cast("long"))
    return store.failed(queue, e.where("event_type = 'error'").select("user_id", F.lit(1).alias("generation")), "user_id")


_STATE = "CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'enriched' WHEN 3 THEN 'failed' ELSE 'permanent_failure' END"
_TRANSITIONS = f"""WITH s AS (SELECT user_id, {_STATE} AS s, repeat('x', 600) || event_id AS error, ts, event_id FROM events), l AS (SELECT user_id, arg_max(s, (ts, event_id)) AS status, count(*) FILTER (WHERE s = 'failed') AS attempts FROM s GROUP BY 1)
 SELECT user_id, status, attempts, CASE WHEN status IN ('failed', 'permanent_failure') THEN repeat('x', 500) END AS error, status IN ('enriched', 'permanent_failure') OR attempts >= 3 AS final FROM l"""


def _states(e):
    m = F.col("event_id") % 5
    s = F.when(m == 0, "pending").when(m == 1, "failed").when(m == 2, "enriched").when(m == 3, "failed").otherwise("permanent_failure")
    return e.withColumn("s", s).withColumn("error", F.concat(F.repeat(F.lit("x"), 600), F.col("event_id").cast("string")))


@query(_TRANSITIONS)
def state_transitions(spark, d):
    """M09, M10, M11."""
    return store.transitions(_states(table(spark, d, "events")), "user_id", "s", "error", ["ts", "event_id"])


@query(_TRANSITIONS)
def stream_state_machine(spark, d):
    """The same as a stream; its state after the last micro-batch equals the batch fold."""
    from tessera.streaming.paths import shared_path

    path = f"{shared_path(spark)}/states-{uuid.uuid4().hex}"
    stream = _states(ingest.event_stream(spark, d))
    return ingest.run_states(store.transitions(stream, "user_id", "s", "error", ["ts", "event_id"]), f"{path}/out", f"{path}/checkpoint")


@query("SELECT s AS status, count(event_id) AS n FROM (VALUES ('pending'), ('enriched'), ('failed'), ('permanent_failure'), ('skipped')) v(s) LEFT JOIN (SELECT event_id, " + _STATE + " AS st FROM events) ON st = s GROUP BY 1")
def status_counts(spark, d):
    """G03."""
    return store.status_counts(_states(table(spark, d, "events")), "s")


@query("""WITH old AS (SELECT c_custkey AS k1, 'd' || c_custkey AS k2, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 3 <> 0),
 n AS (SELECT c_custkey AS k1, NULL AS k2, 'a' AS v, 0 AS o FROM customer UNION ALL SELECT NULL, 'd' || c_custkey, 'b', 1 FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'd' || c_custkey, 'c', 2 FROM customer WHERE c_custkey % 3 = 0)
 SELECT k1, k2, coalesce(v, 'a') AS v FROM old UNION ALL SELECT k1, arg_min(k2, o) FILTER (WHERE k2 IS NOT NULL), arg_min(v, o) FROM n WHERE k1 % 3 = 0 GROUP BY k1""")
def upsert_multikey(spark, d):
    """Several arrivals hit one row, by either key; those that hit none fold among themselves."""
    c = table(spark, d, "customer").withColumn("k1", F.col("c_custkey")).withColumn("k2", F.concat(F.lit("d"), F.col("c_custkey").cast("string")))
    old = c.where("k1 % 3 <> 0").select("k1", "k2", F.when(F.col("k1") % 2 == 0, F.col("c_mktsegment")).alias("v"))
    one = c.select("k1", F.lit(None).cast("string").alias("k2"), F.lit("a").alias("v"), F.lit(0).alias("o"))
    two = c.where("k1 % 3 <> 0").select(F.lit(None).cast("long").alias("k1"), "k2", F.lit("b").alias("v"), F.lit(1).alias("o"))
    three = c.where("k1 % 3 = 0").select("k1", "k2", F.lit("c").alias("v"), F.lit(2).alias("o"))
    return store.merged(old, one.union(two).union(three), ["k1", "k2"], ["v"], ["o"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_replace(spark, d):
    """M04."""
    from tessera.operators import upserts

    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return upserts.upsert(c, c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name FROM customer")
def set_where(spark, d):
    """M14, M15, M18, M21, M30."""
    return store.set_where(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), F.col("c_custkey") % 3 == 0, {"c_mktsegment": F.lit("X"), "c_name": F.lit(None)})


@query("SELECT user_id, arg_min(event_type, (event_id % 2 = 0, event_id)) AS event_type FROM events GROUP BY 1")
def frozen_first(spark, d):
    """The first write wins over later ones and over the old table's later rows never."""
    e = table(spark, d, "events")
    old = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("event_type"))
    new = e.where("event_id % 2 = 0").select("user_id", "event_type", "event_id")
    got = store.frozen(old.withColumn("event_id", F.lit(0).cast("long")), new, ["user_id"], ["event_id"])
    return got.select("user_id", "event_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_keys(spark, d):
    """M20."""
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return store.without_keys(table(spark, d, "customer").select("c_custkey"), gone, ["c_custkey"])


@query("SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT user_id, max(event_id) FROM events GROUP BY 1 HAVING NOT bool_or(event_id % 2 = 0)")
def offset_store(spark, d):
    """M05, L03."""
    e = table(spark, d, "events").select("user_id", "event_id")
    return store.offsets(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), "user_id", "event_id")


@query("SELECT coalesce(min(event_id) FILTER (WHERE event_type = 'error'), max(event_id) + 1) AS next FROM events")
def offset_next_failed(spark, d):
    """R02."""
    return store.next_offset(table(spark, d, "events").withColumn("ok", F.col("event_type") != "error"), "event_id", "ok")


@query("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS n FROM region")
def migrated_table(spark, d):
    """D02-D09."""
    return store.migrated(table(spark, d, "region"), {"r_regionkey": "bigint", "r_name": "string", "note": "string", "n": "bigint"}, ("r_name",))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'no key' ELSE 'repeated key' END AS fault FROM orders o WHERE (o_custkey % 3 = 0 AND o_orderkey % 2 = 0) OR (o_custkey % 3 <> 0 AND (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey) > 1)")
def broken_keys(spark, d):
    """At least one key, and none twice."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return store.broken_keys(o, [F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderkey"))]).select("o_orderkey", "fault")


@query(f"WITH {TAGGED}, x AS (SELECT DISTINCT ns, slug FROM tagged UNION SELECT 'series', slug FROM tagged WHERE ns = 'meeting' UNION SELECT 'series', 'Bad Slug') SELECT slug, string_agg(ns, ',' ORDER BY ns) AS namespaces, CASE WHEN slug = 'Bad Slug' THEN 'malformed' ELSE 'collision' END AS fault FROM x GROUP BY slug HAVING count(*) > 1 OR slug = 'Bad Slug'")
def slug_faults(spark, d):
    """D11, D12."""
    from tessera.operators.tags import tagged

    t = tagged(cards(spark, d)).select(F.col("ns").alias("namespace"), "slug").distinct()
    more = t.where("namespace = 'meeting'").select(F.lit("series"), "slug").union(spark.createDataFrame([("series", "Bad Slug")], "namespace string, slug string"))
    return store.colliding_slugs(t.union(more))


@query(f"WITH {TAGGED} SELECT slug, CASE WHEN bool_or(ns = 'meeting') THEN 'meeting' ELSE max(ns) END AS namespace FROM tagged GROUP BY slug")
def slug_namespaces(spark, d):
    """D13."""
    from tessera.operators.tags import tagged

    t = tagged(cards(spark, d)).select("slug", F.col("ns").alias("namespace")).distinct()
    return store.namespace_of(t.where("namespace <> 'meeting'"), t.where("namespace = 'meeting'"))


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS changed_at FROM orders GROUP BY 1) SELECT date FROM a WHERE date < DATE '1995-01-01' AND (changed_at % 2 = 0 OR changed_at % 3 = 0) UNION SELECT DATE '1998-08-02' UNION SELECT DATE '1998-08-01'")
def rebuild_dates(spark, d):
    """Without a build, or changed after it; yesterday and today."""
    a = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_orderkey").alias("changed_at")).where("date < '1995-01-01'")
    built = a.where("changed_at % 2 <> 0").select("date", F.when(F.col("changed_at") % 3 == 0, F.col("changed_at") - 1).otherwise(F.col("changed_at")).alias("built_at"))
    return store.rebuild_dates(a, built, F.lit("1998-08-02"))


@query("SELECT event_id FROM events WHERE false")
def new_without_baseline(spark, d):
    """Without a baseline nothing is new."""
    return store.new_ids(table(spark, d, "events").select("event_id"), None, "event_id")


@query(f"WITH {TAGGED} SELECT tag, date, card_id, row_number() OVER (PARTITION BY tag ORDER BY date DESC, card_id) AS place FROM tagged")
def tag_occurrences(spark, d):
    """K05, J02."""
    return payloads.occurrences(cards(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {TAGGED} SELECT tag, count(*) AS n, arg_max(site, (date, -card_id)) AS name, max(date) AS newest, min(date) AS oldest FROM tagged GROUP BY tag")
def tag_payload(spark, d):
    """K06, K12."""
    return payloads.tag_payload(cards(spark, d))


@query(f"WITH {CARD} SELECT card_id, list_aggregate(list_filter(['modality:' || lower(modality), 'intent:' || lower(intent), 'methodology:' || methodology, 'verdict:' || lower(verdict), 'meeting:' || lower(meeting)], lambda x: x IS NOT NULL), 'string_agg', ' ') AS tags FROM card")
def tag_lists(spark, d):
    """P04, P05."""
    return payloads.tag_list(cards(spark, d))


@query(f"WITH {TAGGED} SELECT slug, arg_min(ns, list_position(['modality','intent','methodology','verdict','meeting'], ns)) AS namespace, count(*) AS cards FROM tagged GROUP BY slug")
def tag_dimension(spark, d):
    """P06."""
    return payloads.tag_dimension(cards(spark, d))


@query(f"WITH {CARD} SELECT CAST(date AS VARCHAR) || '#' || card_id AS id, lower(site) AS site, substring(concat_ws(' ', site, meeting, intent, verdict), 1, 60) AS line FROM card")
def search_index(spark, d):
    """K11."""
    return payloads.search_index(cards(spark, d))


@query(f"WITH {CARD} SELECT card_id, '<item><title>' || site || ' &amp; ' || meeting || '</title><link>/d/' || date || '#' || card_id || '</link><pubDate>' || strftime(date, '%a, %d %b %Y') || ' 00:00:00 GMT</pubDate></item>' AS item FROM card ORDER BY date DESC, card_id LIMIT 30")
def feed_items(spark, d):
    """K07, K14, C31, Z06."""
    return payloads.feed_items(cards(spark, d))


@query(f"WITH {TAGGED}, o AS (SELECT tag, date, card_id, row_number() OVER (PARTITION BY tag ORDER BY date DESC, card_id) AS place FROM tagged) SELECT * FROM o WHERE place <= 50")
def tag_feeds(spark, d):
    """A feed's length is its feature."""
    return payloads.tag_feeds(cards(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {CARD}, p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY site, card_id) AS place, count(*) OVER (PARTITION BY date) AS n FROM card) SELECT date, string_agg(site || ' · ' || meeting, chr(10) ORDER BY place) || CASE WHEN max(n) > 20 THEN chr(10) || '…and ' || (max(n) - 20) || ' more' ELSE '' END AS post FROM p WHERE place <= 20 GROUP BY date")
def channel_posts(spark, d):
    """Lines of a post are capped, as its feature is."""
    return payloads.channel_post(cards(spark, d))


@query(f"WITH {CARD} SELECT meeting, (SELECT string_agg(x, ',' ORDER BY x DESC) FROM (SELECT DISTINCT CAST(date AS VARCHAR) AS x FROM card b WHERE b.meeting = a.meeting)) AS dates FROM (SELECT DISTINCT meeting FROM card) a")
def meeting_dates(spark, d):
    """G04, G21."""
    return payloads.meetings(cards(spark, d))


@query(f"WITH {CARD}, s AS (SELECT DISTINCT site FROM card UNION SELECT 'NOWHERE') SELECT s.site, count(card_id) AS n, count(card_id) > 0 AS populated FROM s LEFT JOIN card c ON c.site = s.site AND c.card_id % 2 = 0 GROUP BY 1")
def site_counts(spark, d):
    """G26, Y13."""
    c = cards(spark, d)
    sites = c.select("site").distinct().union(spark.createDataFrame([("NOWHERE",)], "site string"))
    return payloads.by_site(c.where("card_id % 2 = 0"), sites)


@query(f"WITH {CARD} SELECT site, count(*) AS fresh FROM card WHERE card_id % 3 <> 0 AND site <> 'BUILDING' GROUP BY 1")
def new_by_site(spark, d):
    """G14."""
    c = cards(spark, d)
    return payloads.new_by_site(c, c.where("card_id % 3 = 0"), c.select("site").distinct().where("site <> 'BUILDING'"))


@query(f"WITH {TAGGED} SELECT tag, count(*) AS n FROM tagged GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def top_tags(spark, d):
    """A report of the first twenty."""
    return payloads.top_tags(cards(spark, d))


@query(f"WITH {CARD} SELECT site || '/' || card_id AS path, date FROM card WHERE card_id % 4 = 0")
def renamed_paths(spark, d):
    """U03."""
    c = cards(spark, d).select(F.concat_ws("/", "site", F.col("card_id").cast("string")).alias("path"), "date", "card_id")
    return payloads.renamed_paths(c.select("path", "date"), c.where("card_id % 4 <> 0"))


@query("SELECT DISTINCT trim(v) AS v FROM (SELECT r_name AS v FROM region UNION ALL SELECT ' ' || n_name || ' ' FROM nation UNION ALL SELECT ' ') WHERE trim(v) <> ''")
def lists_combined(spark, d):
    """U06."""
    n = table(spark, d, "nation").select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("v")).union(spark.createDataFrame([(" ",)], "v string"))
    return payloads.combined(table(spark, d, "region").select(F.col("r_name").alias("v")), n, "v")


@query("SELECT 'paper' AS kind, 'paper:' || p_partkey AS ref, p_name AS text FROM part UNION ALL SELECT 'slide', 'slide:' || doc_id, text FROM documents WHERE trim(coalesce(text, '')) <> ''")
def source_rows(spark, d):
    """P13-P16."""
    return payloads.source_rows({"paper": (table(spark, d, "part"), "p_partkey", "p_name"), "slide": (table(spark, d, "documents"), "doc_id", "text")})


@query("SELECT l_orderkey, count(*) AS refs, count(*) FILTER (WHERE l_returnflag <> 'R') AS papers FROM lineitem GROUP BY 1")
def reference_counts(spark, d):
    """G11, G19."""
    li = table(spark, d, "lineitem").withColumn("kind", F.when(F.col("l_returnflag") == "R", "slide").otherwise("paper"))
    return payloads.references(li, "l_orderkey", "kind")


@query("""WITH l AS (SELECT l_orderkey, l_partkey % 4 AS q, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) END AS completion, l_partkey * 10 + l_linenumber AS k FROM lineitem), a AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, q ORDER BY completion NULLS LAST, k) = 1)
 SELECT l_orderkey, q, k, row_number() OVER (PARTITION BY l_orderkey ORDER BY completion NULLS LAST, k) AS r FROM a QUALIFY r <= 3""")
def earliest_questions(spark, d):
    """W12, L05."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).alias("q"), F.when(F.col("l_linenumber") % 3 != 0, F.to_date("l_shipdate")).alias("completion"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k"))
    return payloads.earliest_first(li, "l_orderkey", "q", "completion", "k").select("l_orderkey", "q", "k", F.col("r").cast("long").alias("r"))


@query("""WITH p AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_custkey % 3 <> 0 AS na, a.o_orderkey // 8 = b.o_orderkey // 8 AS ss FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) SELECT ka, kb, round(CAST(CASE WHEN ss THEN 1000.2 WHEN na THEN 100.2 ELSE 0.2 END AS DOUBLE), 6) AS score FROM p""")
def slug_match_score(spark, d):
    """Readings of one customer, of which one reference of five is common."""
    o = table(spark, d, "orders")
    side = lambda x: o.select("o_custkey", *(c.alias(f"{n}{x}") for n, c in (("k", F.col("o_orderkey")), ("s", F.floor(F.col("o_orderkey") / 8).cast("string")), ("n", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))), ("r", F.array(F.lit(-1).cast("long"), F.col("o_orderkey"), F.col("o_orderkey") + 1_000_000_000)))))
    p = side("a").join(side("b"), "o_custkey").where("ka < kb")
    score = payloads.match_score(*(F.col(f"{n}{x}") for x in "ab" for n in "snr"))
    return p.select("ka", "kb", F.round(score, 6).alias("score"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS n, coalesce(sum(l_linenumber % 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(n, 5 - b)) AS BIGINT) AS kept FROM l")
def image_budget(spark, d):
    """W11."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4).alias("n"))
    return payloads.budgeted(li, "l_orderkey", ["l_linenumber"], "n", 5).select("l_orderkey", "l_linenumber", F.col("kept").cast("long").alias("kept"))


@query("WITH a AS (SELECT quality, round(avg(doc_id % 10) * 10 + 1e-9) / 10 AS x, round(avg(doc_id % 7) * 10 + 1e-9) / 10 AS y FROM labels GROUP BY 1) SELECT quality, x AS axis_a, y AS axis_b, round((x + y) / 2 * 10 + 1e-9) / 10 AS overall FROM a")
def axis_means(spark, d):
    """The mean of the rounded axis means."""
    from tessera.functions.display import axis_mean

    n = F.count(F.lit(1))
    one = table(spark, d, "labels").groupBy("quality").agg(axis_mean(F.sum(F.col("doc_id") % 10), n).alias("axis_a"), axis_mean(F.sum(F.col("doc_id") % 7), n).alias("axis_b"))
    return one.withColumn("overall", axis_mean(F.col("axis_a") + F.col("axis_b"), F.lit(2)))


@query("SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS words FROM documents")
def word_counts(spark, d):
    """T19."""
    return table(spark, d, "documents").select("doc_id", T.word_count(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("words"))


@query("SELECT event_id, [json_extract(props, '$.k')::VARCHAR, 'x'] [1] AS first, 2 AS n FROM events")
def json_array_parse(spark, d):
    """An array of strings in JSON."""
    from tessera.functions.validate import strings

    made = F.concat(F.lit("["), F.from_json("props", "k bigint")["k"].cast("string"), F.lit(', " x ", ""]'))
    return table(spark, d, "events").select("event_id", F.get(strings(made), F.lit(0)).alias("first"), F.size(strings(made)).alias("n"))
