"""Registered queries of the library and the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import effects as E
from tessera.functions import identifiers as I
from tessera.functions import text as T
from tessera.operators import folds, identity, tags, upserts
from tessera.sources.tables import cards, table
from tessera.streaming import ingest

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

CARD = """card AS (SELECT o_orderkey AS card_id, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS site,
 CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS verdict, CASE WHEN o_orderstatus IN ('F','O') THEN o_orderstatus END AS modality,
 n_name AS meeting, r_name AS intent, 'm' || CAST(o_orderkey % 7 AS VARCHAR) AS methodology, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS nct,
 o_custkey // 2 AS acronym, o_totalprice AS point FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


TAGGED = f"""{CARD}, raw AS (SELECT card_id, date, site, unnest(['modality','intent','methodology','verdict','meeting']) AS ns, unnest([modality,intent,methodology,verdict,meeting]) AS value FROM card),
 tagged AS (SELECT card_id, date, site, ns, {slug_sql('value')} AS slug, ns || ':' || {slug_sql('value')} AS tag FROM raw WHERE value IS NOT NULL)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"WITH {TAGGED} SELECT ns, slug, count(*) AS n, row_number() OVER (PARTITION BY ns ORDER BY count(*) DESC, slug) AS rank FROM tagged GROUP BY ns, slug")
def facet_counts(spark, d):
    return tags.facet_counts(cards(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {CARD} SELECT modality, intent, methodology, count(*) AS n, CAST(grouping(modality, intent, methodology) AS BIGINT) AS level FROM card GROUP BY GROUPING SETS ((modality), (intent), (methodology), ())")
def facet_grouping_sets(spark, d):
    return tags.grouping_sets(cards(spark, d))


@query(f"WITH {TAGGED} SELECT tag, count(DISTINCT card_id) AS cards, count(DISTINCT date) AS dates FROM tagged GROUP BY tag")
def reverse_index_sizes(spark, d):
    return tags.reverse_index(cards(spark, d))


@query(f"WITH {TAGGED} SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS support FROM tagged a JOIN tagged b ON a.card_id = b.card_id AND a.tag < b.tag GROUP BY 1, 2 HAVING count(*) >= 3")
def tag_intersections_2(spark, d):
    return tags.pairs(cards(spark, d))


@query(f"WITH {TAGGED} SELECT a.tag AS tag_a, b.tag AS tag_b, c.tag AS tag_c, count(*) AS support FROM tagged a JOIN tagged b ON a.card_id = b.card_id AND a.tag < b.tag JOIN tagged c ON b.card_id = c.card_id AND b.tag < c.tag GROUP BY 1, 2, 3 HAVING count(*) >= 3 ORDER BY support DESC, tag_a, tag_b, tag_c LIMIT 1000")
def tag_intersections_3(spark, d):
    return tags.triples(cards(spark, d))


@query(f"WITH {TAGGED} SELECT card_id, date FROM tagged WHERE tag IN ('modality:f', 'intent:asia', 'methodology:m3') GROUP BY card_id, date HAVING count(DISTINCT tag) = 3")
def intersect_occurrences(spark, d):
    return tags.having_all(cards(spark, d), ["modality:f", "intent:asia", "methodology:m3"])


@query(f"WITH {CARD} SELECT card_id FROM card WHERE modality = 'O' AND intent = 'EUROPE' AND verdict IS NOT NULL")
def facet_filter(spark, d):
    return cards(spark, d).where((F.col("modality") == "O") & (F.col("intent") == "EUROPE") & F.col("verdict").isNotNull()).select("card_id")


@query(f"WITH {TAGGED}, m AS (SELECT card_id, list_filter(['modality:f','modality:o','intent:asia'], lambda x: NOT list_contains(list(tag), x)) AS miss FROM tagged GROUP BY card_id) SELECT miss[1] AS dropped, count(*) AS n FROM m WHERE len(miss) = 1 AND NOT EXISTS (SELECT 1 FROM m WHERE len(miss) = 0) GROUP BY 1 ORDER BY n DESC, dropped LIMIT 2")
def facet_relaxation(spark, d):
    return tags.relaxation(cards(spark, d), ["modality:f", "modality:o", "intent:asia"])


@query(f"WITH {CARD} SELECT card_id, date, CASE WHEN k = 1 THEN base ELSE base || '-' || CAST(k AS VARCHAR) END AS slug FROM (SELECT card_id, date, lower(site) AS base, row_number() OVER (PARTITION BY date, lower(site) ORDER BY card_id) AS k FROM card)")
def slug_collision(spark, d):
    return folds.resolved(cards(spark, d).withColumn("base", F.lower("site")), "date", "card_id", "base")


@query(f"WITH {CARD}, g AS (SELECT *, row_number() OVER (PARTITION BY site, verdict, modality ORDER BY date DESC, card_id) AS r3, row_number() OVER (PARTITION BY site, verdict ORDER BY date DESC, card_id) AS r2 FROM card), p AS (SELECT t.card_id, s.card_id AS sibling, s.date AS sd FROM card t JOIN g s ON t.site = s.site AND t.verdict IS NOT DISTINCT FROM s.verdict AND t.modality = s.modality AND s.r3 <= 4 UNION ALL SELECT t.card_id, s.card_id, s.date FROM card t JOIN g s ON t.modality IS NULL AND t.site = s.site AND t.verdict IS NOT DISTINCT FROM s.verdict AND s.r2 <= 4), q AS (SELECT card_id, sibling, row_number() OVER (PARTITION BY card_id ORDER BY sd DESC, sibling) AS rank FROM p WHERE card_id <> sibling) SELECT card_id, sibling, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= 3")
def siblings_top3(spark, d):
    return tags.siblings(cards(spark, d))


@query(f"WITH {CARD}, clear AS (SELECT acronym FROM card GROUP BY acronym HAVING count(DISTINCT nct) < 2), s AS (SELECT nct, date, max(card_id) AS other FROM card WHERE nct IS NOT NULL GROUP BY 1, 2), w AS (SELECT acronym, site, date, min(card_id) AS other FROM card WHERE acronym IN (SELECT acronym FROM clear) GROUP BY 1, 2, 3), b AS (SELECT c.card_id, s.date AS h_date, s.other, 1 AS how FROM card c JOIN s ON c.nct = s.nct AND c.date <> s.date UNION ALL SELECT c.card_id, w.date, w.other, 2 FROM card c JOIN w ON c.acronym = w.acronym AND c.site = w.site AND c.date <> w.date), m AS (SELECT card_id, h_date, min(how) AS how, arg_min(other, how * 1000000000 + other) AS other FROM b GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY h_date DESC) AS rank FROM m) SELECT card_id, h_date, other, how, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= 4")
def trial_history_top4(spark, d):
    return identity.history(cards(spark, d))


@query(f"WITH {CARD}, s AS (SELECT nct, count(DISTINCT date) AS dates, count(*) AS cards, max(date) AS latest FROM card WHERE nct IS NOT NULL GROUP BY nct HAVING count(DISTINCT date) >= 2), w AS (SELECT acronym, count(DISTINCT date) AS dates, count(*) AS cards, max(date) AS latest, bool_and(coalesce(nct IN (SELECT nct FROM s), FALSE)) AS e, count(DISTINCT nct) AS n FROM card GROUP BY acronym) SELECT 'nct' AS kind, nct AS key, dates, cards, latest FROM s UNION ALL SELECT 'acronym', acronym, dates, cards, latest FROM w WHERE dates >= 2 AND NOT e AND n < 2")
def cross_date_duplicates(spark, d):
    return identity.cross_date_duplicates(cards(spark, d))


@query(f"WITH {CARD}, o AS (SELECT nct AS key, date, max(card_id) AS card_id FROM card WHERE nct IS NOT NULL GROUP BY 1, 2) SELECT a.key, a.date, a.card_id, b.date AS prior_date, b.card_id AS prior_card FROM o a ASOF JOIN o b ON a.key = b.key AND a.date > b.date")
def prior_coverage_asof(spark, d):
    return identity.prior_as_of(cards(spark, d), "nct")


@query(f"WITH {CARD}, o AS (SELECT nct, modality, date, arg_min(point, card_id) AS point, min(card_id) AS card_id FROM card WHERE nct IS NOT NULL AND modality IS NOT NULL GROUP BY 1, 2, 3), q AS (SELECT *, lag(point) OVER (PARTITION BY nct, modality ORDER BY date) AS prior FROM o) SELECT nct, modality, date, card_id, point, prior FROM q WHERE prior <> point")
def prior_estimate_changed(spark, d):
    return identity.prior_estimate(cards(spark, d))


@query(f"WITH {CARD}, q AS (SELECT *, lag(card_id) OVER w AS pc, lag(modality) OVER w AS pm, lag(verdict) OVER w AS pv, lag(point) OVER w AS pp FROM card WHERE nct IS NOT NULL WINDOW w AS (PARTITION BY nct ORDER BY date, card_id)) SELECT card_id, nct, pc AS prior, CASE WHEN pc IS NULL OR modality IS NULL OR pm IS NULL THEN 'unrelated' WHEN modality <> pm THEN 'new-card' WHEN coalesce(verdict,'') <> coalesce(pv,'') THEN 'new-card' WHEN point > pp THEN 'update' ELSE 'duplicate' END AS verdict FROM q")
def lineage_verdict(spark, d):
    return identity.lineage(cards(spark, d))


@query(f"WITH {CARD} SELECT card_id, date FROM card ORDER BY date DESC, card_id LIMIT 30")
def recent_limit(spark, d):
    return cards(spark, d).select("card_id", "date").orderBy(F.desc("date"), "card_id").limit(30)


@query("WITH e AS (SELECT CAST(ts AS DATE) AS date, event_type AS tag FROM events), ds AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM e ORDER BY date DESC LIMIT 14)), c AS (SELECT tag, i, n, count(*) AS c FROM e JOIN ds USING (date) GROUP BY 1, 2, 3), g AS (SELECT tag, CAST(sum(c) AS BIGINT) AS total, round(sum(c * i / n), 6) AS weight, CAST(sum(CASE WHEN i <= n // 2 THEN c ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN i > n - n // 2 THEN c ELSE 0 END) AS BIGINT) AS late FROM c GROUP BY tag) SELECT *, CASE WHEN late - early > 1 THEN 'up' WHEN late - early < -1 THEN 'down' ELSE 'flat' END AS trend FROM g")
def tag_activity(spark, d):
    return tags.activity(table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("tag")))


@query("SELECT s.status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('click'),('error'),('purchase'),('signup'),('view'),('never')) s(status) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON event_type = s.status")
def status_zero_filled(spark, d):
    dim = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "never")], "status string")
    return dim.join(table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT CAST(ts AS DATE) AS date, CASE WHEN count(DISTINCT user_id % 3) = 1 THEN min(user_id % 3) END AS only_value FROM events GROUP BY 1")
def dominant_or_null(spark, d):
    v = F.col("user_id") % 3
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.when(F.countDistinct(v) == 1, F.min(v)).alias("only_value"))


@query("SELECT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION SELECT CAST(ts AS DATE) FROM events")
def all_dates_union(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.to_date(c).alias("date")).distinct()
    return one("orders", "o_orderdate").union(one("lineitem", "l_shipdate")).union(one("events", "ts")).distinct()


@query("SELECT date, max(v) AS latest FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS v FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), l_orderkey FROM lineitem UNION ALL SELECT CAST(ts AS DATE), event_id FROM events) GROUP BY date")
def max_ts_by_date(spark, d):
    one = lambda t, c, v: table(spark, d, t).groupBy(F.to_date(c).alias("date")).agg(F.max(v).alias("v"))
    return one("orders", "o_orderdate", "o_orderkey").union(one("lineitem", "l_shipdate", "l_orderkey")).union(one("events", "ts", "event_id")).groupBy("date").agg(F.max("v").alias("latest"))


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS built FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_orderkey) AS changed FROM lineitem GROUP BY 1) SELECT coalesce(a.date, b.date) AS date, CASE WHEN built IS NULL THEN 'missing' WHEN changed IS NULL THEN 'fresh' WHEN changed > built THEN 'stale' ELSE 'fresh' END AS state FROM a FULL JOIN b ON a.date = b.date")
def build_date_classify(spark, d):
    a = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_orderkey").alias("built"))
    b = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.max("l_orderkey").alias("changed"))
    state = F.when(F.col("built").isNull(), "missing").when(F.col("changed").isNull(), "fresh").when(F.col("changed") > F.col("built"), "stale").otherwise("fresh")
    return a.join(b, "date", "full").select("date", state.alias("state"))


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def new_since_baseline(spark, d):
    e = table(spark, d, "events")
    return ingest.new_since(e.select("event_id", "user_id"), e.where("event_type = 'purchase'"), "event_id").select("event_id", "user_id")


@query("SELECT event_id FROM events ORDER BY CAST(event_id AS VARCHAR) DESC LIMIT 500")
def cap_seen(spark, d):
    return table(spark, d, "events").select("event_id").orderBy(F.desc(F.col("event_id").cast("string"))).limit(500)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN s_name ELSE p_name END AS source, CASE WHEN l_returnflag = 'R' THEN 'supplier' ELSE 'part' END AS kind FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def ref_join_sources(spark, d):
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    back = F.col("l_returnflag") == "R"
    return li.join(p, li.l_partkey == p.p_partkey, "left").join(s, li.l_suppkey == s.s_suppkey, "left").select("l_orderkey", "l_linenumber", F.when(back, F.col("s_name")).otherwise(F.col("p_name")).alias("source"), F.when(back, "supplier").otherwise("part").alias("kind"))


@query("SELECT DISTINCT p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49")
def two_hop_link_map(spark, d):
    li, p, s = table(spark, d, "lineitem").where("l_quantity >= 49"), table(spark, d, "part"), table(spark, d, "supplier")
    return li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select("p_brand", "s_name").distinct()


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'P') GROUP BY 1")
def cross_date_antijoin(spark, d):
    o = table(spark, d, "orders")
    return o.join(o.where("o_orderstatus = 'P'").select("o_custkey").distinct(), "o_custkey", "left_anti").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 AND count(*) = count(l_returnflag) THEN min(l_returnflag) END AS facet, max(l_quantity) AS maturity, count(*) AS sources FROM lineitem GROUP BY 1")
def consensus_fold(spark, d):
    f = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when((F.countDistinct(f) == 1) & (F.count(F.lit(1)) == F.count(f)), F.min(f)).alias("facet"), F.max("l_quantity").alias("maturity"), F.count(F.lit(1)).alias("sources"))


@query("WITH p AS (SELECT l_orderkey, l_partkey, p_brand, min(l_linenumber) AS ord FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1, 2, 3), q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord, l_partkey) AS rank FROM p) SELECT l_orderkey, l_partkey, p_brand, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= 5")
def related_pick_join(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 10")
    one = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey", "l_partkey", "p_brand").agg(F.min("l_linenumber").alias("ord"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ord", "l_partkey"))).where("rank <= 5").drop("ord")


@query("SELECT md5(text) AS key, count(DISTINCT source) AS clusters FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cluster_collision(spark, d):
    return identity.collisions(table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "source"), "key", "source")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts, event_id) AS r FROM events) SELECT event_id, user_id, event_type FROM f WHERE r = 1")
def insert_if_absent(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    order = [F.col("ts"), F.col("event_id")]
    old = e.where("event_id % 2 = 1").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where("r = 1").drop("r")
    return upserts.insert_if_absent(old, e.where("event_id % 2 = 0"), ["user_id"], order).drop("ts")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS reason, max(ts) AS queued_at, count(*) AS requests FROM events GROUP BY 1")
def queue_coalesce(spark, d):
    return upserts.coalesced_queue(table(spark, d, "events"), "user_id", "event_type", "ts")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS changes FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def reopen_delete(spark, d):
    return upserts.last_state(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).where("state <> 'error'")


@query(f"WITH {CARD} SELECT card_id, CASE WHEN card_id % 17 = 0 THEN 'EDITED' ELSE site END AS site, modality FROM card WHERE card_id % 13 <> 0")
def patch_overrides(spark, d):
    c = cards(spark, d).select("card_id", "site", "modality")
    e = c.where("card_id % 13 = 0 or card_id % 17 = 0").select("card_id", (F.col("card_id") % 13 == 0).alias("suppress"), F.when(F.col("card_id") % 17 == 0, "EDITED").alias("site"))
    return upserts.patched(c, e, "card_id", ["site"])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def search_substring(spark, d):
    q = F.lit("license")
    return table(spark, d, "documents").where(F.lower("text").contains(q) | F.lower("source").contains(q)).select("doc_id")


@query("SELECT p_partkey, '10.' || CAST(1000 + p_partkey % 9000 AS VARCHAR) || '/' || lower(p_brand) AS doi FROM part")
def doi_normalize(spark, d):
    made = F.concat(F.lit("see https://doi.org/10."), (1000 + F.col("p_partkey") % 9000).cast("string"), F.lit("%2F"), F.upper("p_brand"), F.lit("/full and more"))
    return table(spark, d, "part").select("p_partkey", I.doi(F.regexp_replace(made, "#", "-")).alias("doi")).withColumn("doi", F.regexp_replace("doi", "-(?=[0-9])", "#"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^([^?#]*)', 1) AS public_url FROM pages")
def url_public(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.host(u).alias("host"), T.public_url(u).alias("public_url"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style|nav[^>]*>.*?</nav|aside[^>]*>.*?</aside|footer[^>]*>.*?</footer)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages) SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS article FROM b")
def article_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.article_text(F.col("html")).alias("article"))


@query(f"SELECT p_partkey, {slug_sql('p_name')} AS slug, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS endpoint, upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS acronym FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"), T.endpoint_norm(F.col("p_type")).alias("endpoint"), T.acronym_norm(F.col("p_name")).alias("acronym"))


@query("WITH r AS (SELECT p_brand AS family, p_type AS kind, max(abs(ln(p_retailprice / 1000))) AS m FROM part WHERE p_retailprice > 0 GROUP BY 1, 2), x AS (SELECT family, kind, exp(greatest(m, ln(2.0)) * 1.15) AS edge FROM r) SELECT family, kind, round(CAST(CASE WHEN edge <= 1.5 THEN 1.5 WHEN edge <= 2 THEN 2 WHEN edge <= 3 THEN 3 WHEN edge <= 4 THEN 4 WHEN edge <= 5 THEN 5 WHEN edge <= 7 THEN 7 WHEN edge <= 10 THEN 10 WHEN edge <= 15 THEN 15 WHEN edge <= 20 THEN 20 WHEN edge <= 30 THEN 30 WHEN edge <= 50 THEN 50 WHEN edge <= 100 THEN 100 ELSE pow(10, ceil(log10(edge))) END AS DOUBLE), 6) AS domain FROM x")
def log_domain(spark, d):
    """G09, N15."""
    r = table(spark, d, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_type").alias("kind")).agg(F.max(E.half_width(F.col("p_retailprice") / 1000)).alias("m"))
    return r.select("family", "kind", F.round(E.axis_end(F.col("m")), 6).alias("domain"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'os' WHEN p_partkey % 4 = 1 THEN 'pfs' WHEN p_partkey % 4 = 2 THEN 'other' ELSE 'unknown' END AS family FROM part")
def endpoint_family(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Median Overall Survival").when(k == 1, "PFS at 2 years").when(k == 2, F.col("p_brand")).otherwise("  ")
    return table(spark, d, "part").select("p_partkey", E.family(name).alias("family"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[0-9]+\\.[0-9]+|[0-9]{2,}'))) AS n_values FROM documents")
def stat_atoms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.numbers(F.col("text"))).cast("long").alias("n_values"))


@query("WITH v AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+\\.[0-9]+|[0-9]{2,}'))) AS v FROM documents), s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+\\.[0-9]+|[0-9]{2,}')) AS v FROM benchmark) SELECT doc_id, count(*) AS untraceable FROM v WHERE v NOT IN (SELECT v FROM s) GROUP BY 1")
def untraceable_values(spark, d):
    v = table(spark, d, "documents").select("doc_id", F.explode(T.numbers(F.col("text"))).alias("v"))
    s = table(spark, d, "benchmark").select(F.explode(T.numbers(F.col("text"))).alias("v")).distinct()
    return v.join(s, "v", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("untraceable"))


@query("SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(regexp_replace(lower(x), '[ \\t]+', ' ', 'g')), '[0-9]+', '#', 'g')), lambda x: x <> ''))) AS lines FROM documents")
def distinct_line_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.line_keys(F.col("text"))).cast("long").alias("lines"))


@query("WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations), i AS (SELECT conv_id, turn, word, list(pos) AS ps FROM w GROUP BY 1, 2, 3), b AS (SELECT conv_id, turn, word, unnest(ps) AS pos FROM i) SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS text FROM b GROUP BY 1, 2")
def inverted_index_roundtrip(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = w.groupBy("conv_id", "turn", "word").agg(F.collect_list("pos").alias("ps"))
    back = index.select("conv_id", "turn", "word", F.explode("ps").alias("pos")).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return back.select("conv_id", "turn", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


@query("SELECT count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS fn, round(count(*) FILTER (WHERE toxic = 0 AND quality = 1) / count(*) FILTER (WHERE toxic = 0), 6) AS precision, round(count(*) FILTER (WHERE toxic = 0 AND quality = 1) / count(*) FILTER (WHERE quality = 1), 6) AS recall, count(*) FILTER (WHERE toxic = 0 AND quality = 0) = 0 AS passed FROM labels")
def precision_recall(spark, d):
    picked, good = F.col("toxic") == 0, F.col("quality") == 1
    c = table(spark, d, "labels").agg(F.count_if(picked & good).alias("tp"), F.count_if(picked & ~good).alias("fp"), F.count_if(~picked & good).alias("fn"))
    part = lambda b: F.when(F.col("tp") + F.col(b) > 0, F.round(F.col("tp") / (F.col("tp") + F.col(b)), 6)).otherwise(1.0)
    return c.select("tp", "fp", "fn", part("fp").alias("precision"), part("fn").alias("recall"), (F.col("fp") == 0).alias("passed"))


@query("SELECT quality, round(avg(doc_id % 10), 1) AS mean_score, round(avg(doc_id % 10), 1) >= 4.5 AS passed FROM labels GROUP BY 1")
def mean_score(spark, d):
    m = F.round(F.avg(F.col("doc_id") % 10), 1)
    return table(spark, d, "labels").groupBy("quality").agg(m.alias("mean_score")).withColumn("passed", F.col("mean_score") >= 4.5)


@query(f"WITH {CARD} SELECT date, count(*) AS studies, count(DISTINCT site) AS sites, min(card_id) AS first_card FROM card GROUP BY date")
def digests_index(spark, d):
    return cards(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("studies"), F.countDistinct("site").alias("sites"), F.min("card_id").alias("first_card"))


@query(f"WITH {CARD} SELECT card_id, site || ' · ' || meeting AS title, '/d/' || CAST(date AS VARCHAR) || '#' || CAST(card_id AS VARCHAR) AS link, strftime(date, '%a, %d %b %Y') || ' 00:00:00 +0000' AS pub_date FROM card ORDER BY date DESC, card_id LIMIT 100")
def rss_items(spark, d):
    c = cards(spark, d).orderBy(F.desc("date"), "card_id").limit(100)
    return c.select("card_id", F.concat_ws(" · ", "site", "meeting").alias("title"), F.concat(F.lit("/d/"), F.col("date").cast("string"), F.lit("#"), F.col("card_id").cast("string")).alias("link"), F.concat(F.date_format("date", "EEE, dd MMM yyyy"), F.lit(" 00:00:00 +0000")).alias("pub_date"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup_ingest(spark, d):
    import uuid

    from tessera.streaming.paths import shared_path

    path = f"{shared_path(spark)}/stream-{uuid.uuid4().hex}"
    stream = ingest.dedup_ingest(ingest.event_stream(spark, d), ["event_id"]).select("event_id", "user_id", "event_type", "value")
    return ingest.run_to_table(stream, f"{path}/out", f"{path}/checkpoint")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS changes FROM events GROUP BY 1")
def stream_state_batch(spark, d):
    return upserts.last_state(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT coalesce(max(event_id), -1) + 1 AS next_offset FROM events")
def offset_next(spark, d):
    return ingest.next_offset(table(spark, d, "events"), "event_id")


from tessera.plans import cases, columns, ordered, outside, readings, relations, sectioned  # noqa: E402, F401

QUERIES |= cases.QUERIES | relations.QUERIES | readings.QUERIES
SQL |= cases.SQL | relations.SQL | readings.SQL
