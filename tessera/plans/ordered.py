"""Queries whose later rows depend on what earlier ones did. Their SQL is a recursion, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import folds, identity, lineage, store
from tessera.plans.readings import query
from tessera.plans.relations import SQL as _FIRST
from tessera.plans.relations import SAME, readings
from tessera.sources.tables import table


@query("""WITH RECURSIVE r AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderkey AS id, lower(c_mktsegment) || CASE o_orderkey % 5 WHEN 1 THEN '-2' WHEN 3 THEN '-3' ELSE '' END AS base, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey),
 f AS (SELECT m, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS slug, CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS seen FROM (SELECT DISTINCT m FROM r)
  UNION ALL SELECT m, k, id, slug, map_concat(seen, MAP {base: n + 1}, CASE WHEN n > 0 THEN MAP {slug: CAST(1 AS BIGINT)} ELSE CAST(MAP {} AS MAP(VARCHAR, BIGINT)) END)
  FROM (SELECT *, CASE WHEN n = 0 THEN base ELSE base || '-' || list_filter(range(n + 1, n + 2 + CAST(cardinality(seen) AS BIGINT)), lambda x: NOT map_contains(seen, base || '-' || x))[1] END AS slug FROM
   (SELECT f.m, r.k, r.id, r.base, f.seen, coalesce(map_extract(f.seen, r.base)[1], 0) AS n FROM f JOIN r ON r.m = f.m AND r.k = f.k + 1)))
 SELECT m AS month, id, slug FROM f WHERE id IS NOT NULL""")
def slug_resolution(spark, d):
    """A month's studies, some of whose own slugs are what a repeated one would get."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey") % 5
    base = F.concat(F.lower("c_mktsegment"), F.when(k == 1, "-2").when(k == 3, "-3").otherwise(""))
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("id"), base.alias("base"))
    return folds.resolved(rows, "month", "id", "base")


# A day's published studies and those of its next build: orders by customer as registration, two sources each.
_STUDIES = """s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS pos, 's' || (o_custkey % 4) AS slug, CASE WHEN o_custkey % 3 <> 0 THEN 'N' || (o_custkey % 5) END AS nct, [o_custkey % 5, 100 + o_orderkey % 4] AS sources FROM orders),
 p AS (SELECT * FROM s WHERE pos % 5 < 2), x AS (SELECT * REPLACE (CASE WHEN pos % 7 = 0 THEN '' ELSE slug END AS slug) FROM s WHERE pos % 5 > 2)"""


def _studies(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), k.alias("pos"), F.concat(F.lit("s"), c % 4).alias("slug"), F.when(c % 3 != 0, F.concat(F.lit("N"), c % 5)).alias("nct"), F.array(c % 5, 100 + k % 4).alias("sources"))
    return s.where("pos % 5 < 2"), s.where("pos % 5 > 2").withColumn("slug", F.when(F.col("pos") % 7 == 0, "").otherwise(F.col("slug")))


_PERSISTED = f"""{_STUDIES}, m AS (SELECT x.date, x.pos AS ni, p.pos AS pi, p.slug, CASE WHEN x.nct <> p.nct THEN 0 ELSE len(list_intersect(x.sources, p.sources)) / len(list_distinct(list_concat(x.sources, p.sources))) + CASE WHEN x.slug = p.slug THEN 1000 WHEN x.nct = p.nct THEN 100 ELSE 0 END END AS score FROM x JOIN p ON x.date = p.date),
 o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, ni, pi) AS k FROM m WHERE score > 0),
 g AS (SELECT date, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS ni, CAST(NULL AS VARCHAR) AS slug, CAST([] AS BIGINT[]) AS rows, CAST([] AS VARCHAR[]) AS slugs FROM (SELECT DISTINCT date FROM x)
  UNION ALL SELECT date, k, CASE WHEN ok THEN ni END, CASE WHEN ok THEN slug END, CASE WHEN ok THEN list_append(rows, ni) ELSE rows END, CASE WHEN ok THEN list_append(slugs, slug) ELSE slugs END
  FROM (SELECT o.date, o.k, o.ni, o.slug, g.rows, g.slugs, NOT list_contains(g.rows, o.ni) AND NOT list_contains(g.slugs, o.slug) AS ok FROM g JOIN o ON o.date = g.date AND o.k = g.k + 1)),
 e AS (SELECT date, slugs FROM g QUALIFY row_number() OVER (PARTITION BY date ORDER BY k DESC) = 1),
 u AS (SELECT x.*, row_number() OVER (PARTITION BY x.date ORDER BY x.pos) AS k FROM x LEFT JOIN g ON g.date = x.date AND g.ni = x.pos WHERE g.ni IS NULL),
 h AS (SELECT date, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS slug, slugs AS seen FROM e
  UNION ALL SELECT date, k, pos, name, list_append(seen, name) FROM (SELECT *, CASE WHEN NOT list_contains(seen, base) THEN base ELSE base || '-' || list_filter(range(2, 3 + len(seen)), lambda n: NOT list_contains(seen, base || '-' || n))[1] END AS name FROM
   (SELECT u.date, u.k, u.pos, h.seen, CASE WHEN u.slug = '' THEN 'study' ELSE u.slug END AS base FROM h JOIN u ON u.date = h.date AND u.k = h.k + 1))),
 kept AS (SELECT date, ni AS pos, slug, true AS reused FROM g WHERE ni IS NOT NULL UNION ALL SELECT date, pos, slug, false FROM h WHERE pos IS NOT NULL)"""


@query(f"WITH RECURSIVE {_PERSISTED} SELECT * FROM kept")
def slug_persistence(spark, d):
    """W09."""
    return folds.persisted(*_studies(spark, d))


@query(f"WITH RECURSIVE {_PERSISTED} SELECT DISTINCT date, slug FROM p WHERE (date, slug) NOT IN (SELECT date, slug FROM kept)")
def slugs_retired(spark, d):
    """W09."""
    previous, following = _studies(spark, d)
    return folds.retired(previous, folds.persisted(previous, following))


# Sources of a card and cards hidden before, from the number in its slug.
_PLAN = f"""v AS ({_FIRST["lineage_classified"]}), c AS (SELECT date, slug, CAST(substr(slug, 2) AS BIGINT) AS k FROM v),
 w AS (SELECT v.*, a.k % 9 = 0 AS a2, b.k % 9 = 0 AS b2, b.k % 4 = 1 AS gone, (kind = 'update' AND corroborated) OR (kind = 'duplicate' AND certain) AS sure FROM v JOIN c a USING (date, slug) LEFT JOIN c b ON b.date = prior_date AND b.slug = prior_slug WHERE kind <> 'unrelated'),
 n AS (SELECT date, count(*) FILTER (WHERE k % 4 <> 1) AS n FROM c GROUP BY 1),
 y AS (SELECT w.*, n, sure AND NOT b2 AND NOT a2 AS gate, count(DISTINCT CASE WHEN sure AND NOT b2 AND NOT a2 AND NOT gone THEN prior_slug END) OVER (PARTITION BY w.date, prior_date ORDER BY slug ROWS UNBOUNDED PRECEDING) AS asked FROM w JOIN n ON n.date = prior_date),
 z AS (SELECT *, CASE WHEN gone THEN 0 ELSE min(CASE WHEN gate THEN asked END) OVER (PARTITION BY date, prior_date, prior_slug) END AS number FROM y),
 plan AS (SELECT date, slug, prior_date, prior_slug, gate, gate AND n - number >= 1 AS hide, CASE WHEN kind = 'update' AND NOT corroborated THEN coalesce(blocker, 'not authorized') WHEN kind = 'duplicate' AND NOT certain THEN coalesce(blocker, 'duplicate not certain')
  WHEN b2 THEN 'prior card (2 sources) merges multiple sources' WHEN a2 THEN 'new card (2 sources) merges multiple sources' WHEN gate AND n - number < 1 THEN 'would empty ' || prior_date END AS declined FROM z)"""


def _plan(spark, d):
    rows = readings(spark, d)
    k = F.substring("slug", 2, 20).cast("long")
    cards = rows.select("date", "slug")
    hidden = cards.where(k % 4 == 1)
    return folds.suppressions(lineage.classified(rows), cards.select("date", "slug", F.when(k % 9 == 0, 2).otherwise(1).alias("n")), cards, hidden, True), hidden


@query(f"WITH {_PLAN} SELECT date, slug, CASE WHEN hide THEN prior_date END AS hide_date, CASE WHEN hide THEN prior_slug END AS hide_slug, declined FROM plan")
def suppression_plan(spark, d):
    """M26."""
    return _plan(spark, d)[0]


@query(f"WITH {_PLAN}, a AS (SELECT date, slug FROM c WHERE k % 4 = 1 UNION SELECT prior_date, prior_slug FROM plan WHERE hide) SELECT date, array_to_string(list_sort(list(slug)), ',') AS slugs FROM a GROUP BY 1")
def suppression_overrides(spark, d):
    """M28."""
    return folds.applied(*_plan(spark, d))[0].select("date", F.array_join("slugs", ",").alias("slugs"))


@query("""WITH RECURSIVE o AS (SELECT c_custkey AS id, c_custkey // 12 AS grp, 'p' || (c_custkey // 2) AS k1, CASE WHEN c_custkey % 4 = 0 THEN 'd' || c_custkey END AS k2, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 6 = 0),
 n AS (SELECT c_custkey AS id, c_custkey // 12 AS grp, CASE WHEN c_custkey % 5 <> 0 THEN 'p' || (c_custkey // 12 * 6 + c_custkey % 4) END AS k1, CASE WHEN c_custkey % 7 <> 0 THEN 'd' || (c_custkey // 12 * 12 + c_custkey % 5) END AS k2, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS v, row_number() OVER (PARTITION BY c_custkey // 12 ORDER BY c_custkey) AS k FROM customer),
 f AS (SELECT grp, CAST(0 AS BIGINT) AS k, coalesce(list({'k1': k1, 'k2': k2, 'v': v} ORDER BY o.id) FILTER (WHERE o.id IS NOT NULL), []) AS have FROM (SELECT DISTINCT c_custkey // 12 AS grp FROM customer) LEFT JOIN o USING (grp) GROUP BY grp
  UNION ALL SELECT grp, k, CASE WHEN hit IS NULL THEN CASE WHEN k1 IS NULL AND k2 IS NULL THEN have ELSE list_append(have, {'k1': k1, 'k2': k2, 'v': v}) END
   ELSE list_transform(have, lambda h, i: CASE WHEN i <> hit THEN h ELSE {'k1': CASE WHEN h.k1 IS NULL AND NOT list_contains(list_transform(have, lambda y: y.k1), k1) THEN k1 ELSE h.k1 END, 'k2': CASE WHEN h.k2 IS NULL AND NOT list_contains(list_transform(have, lambda y: y.k2), k2) THEN k2 ELSE h.k2 END, 'v': coalesce(h.v, v)} END) END
  FROM (SELECT f.grp, n.k, f.have, n.k1, n.k2, n.v, coalesce(list_position(list_transform(f.have, lambda y: coalesce(y.k1 = n.k1, false)), true), list_position(list_transform(f.have, lambda y: coalesce(y.k2 = n.k2, false)), true)) AS hit FROM f JOIN n ON n.grp = f.grp AND n.k = f.k + 1)),
 e AS (SELECT have FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k DESC) = 1) SELECT h.k1 AS k1, h.k2 AS k2, h.v AS v FROM (SELECT unnest(have) AS h FROM e)""")
def upsert_collisions(spark, d):
    """Arrivals that match different rows by either key, rows that an arrival ties together, keys that another row has."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    named = lambda prefix, x: F.concat(F.lit(prefix), x.cast("long").cast("string"))
    old = c.where(k % 6 == 0).select(named("p", F.floor(k / 2)).alias("k1"), F.when(k % 4 == 0, named("d", k)).alias("k2"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("v"))
    new = c.select(F.when(k % 5 != 0, named("p", F.floor(k / 12) * 6 + k % 4)).alias("k1"), F.when(k % 7 != 0, named("d", F.floor(k / 12) * 12 + k % 5)).alias("k2"), F.when(k % 2 == 0, F.col("c_name")).alias("v"), k.alias("o"))
    return store.merged(old, new, ["k1", "k2"], ["v"], ["o"])


def _late(spark, d):
    """Events as they come: four parts by their numbers, corrections of a third of them, and a part again. Each is drained as it came: a micro-batch."""
    import uuid

    from tessera.streaming import late
    from tessera.streaming.paths import shared_path

    base = f"{shared_path(spark)}/late-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), "user_id", F.col("value"), F.lit(0).alias("version"))
    fixed = e.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1).withColumn("version", F.lit(1))
    for part in [*(e.where(F.col("event_id") % 4 == i) for i in range(4)), fixed, e.where("event_id % 4 = 1")]:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        rows = late.run(stream, base, f"{base}/checkpoint", "event_id", ["version"], "date", ["value"])
    return rows, base


_LATE = "e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, user_id, value + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS value, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS version FROM events)"


@query(f"WITH {_LATE} SELECT * FROM e")
def late_upsert(spark, d):
    """Six micro-batches, one of them a replay."""
    return _late(spark, d)[0]


@query(f"WITH {_LATE} SELECT date, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total, sum(version) AS fixed FROM e GROUP BY 1")
def late_rebuild(spark, d):
    """The queued dates, built from the table."""
    from tessera.streaming import late

    daily = lambda rows: rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.sum("version").alias("fixed"))
    rows, base = _late(spark, d)
    return late.drain(rows, base, "date", daily)


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(max(CASE WHEN event_id % 3 = 0 THEN 4 ELSE event_id % 4 END) AS BIGINT) AS queued_at FROM events GROUP BY 1")
def late_queue(spark, d):
    """The last micro-batch that changed each date; the replay changes none."""
    from tessera.streaming import late

    return late.queued(spark, _late(spark, d)[1])


@query(f"""WITH r AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 's' || o_orderkey AS slug, CASE WHEN o_custkey % 4 <> 0 THEN 'NCT' || (o_custkey // 6) END AS nct, CASE WHEN o_custkey % 5 <> 0 THEN 'K' || (o_custkey // 9) END AS key, CASE WHEN o_custkey % 11 <> 0 THEN 's' || (o_custkey % 2) END AS site,
 'HR' AS kind, 'os' AS endpoint, o_orderkey % 3 / 2 AS point, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 END AS lo FROM orders WHERE o_custkey % 3 > 0),
 m AS (SELECT a.date AS cd, a.slug AS cs, b.date AS pd, b.slug AS ps FROM r a JOIN r b ON b.date < a.date AND (a.nct = b.nct OR a.key = b.key) WHERE {{same}}),
 bad AS (SELECT DISTINCT x.cd, x.cs FROM m x JOIN m y ON x.cd = y.cd AND x.cs = y.cs AND x.ps < y.ps JOIN r a ON a.slug = x.ps JOIN r b ON b.slug = y.ps WHERE NOT {{same}})
 SELECT c.date, c.slug, p.date AS prior_date, p.slug AS prior_slug, CAST(p.point AS DOUBLE) AS point, CAST(p.lo AS DOUBLE) AS lo FROM m JOIN r c ON c.slug = cs JOIN r p ON p.slug = ps LEFT JOIN bad ON bad.cs = m.cs WHERE bad.cs IS NULL AND (c.point IS DISTINCT FROM p.point OR c.lo IS DISTINCT FROM p.lo)
 QUALIFY row_number() OVER (PARTITION BY c.slug ORDER BY p.date DESC, p.slug) = 1""".replace("{{same}}", SAME).replace("{same}", SAME))
def prior_readings(spark, d):
    """J12, with identity and ambiguity."""
    o = table(spark, d, "orders").where("o_custkey % 3 > 0")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    named = lambda x, v: F.concat(F.lit(x), v.cast("long").cast("string"))
    rows = o.select(F.to_date("o_orderdate").cast("string").alias("date"), named("s", k).alias("slug"), F.when(c % 4 != 0, named("NCT", F.floor(c / 6))).alias("nct"), F.when(c % 5 != 0, named("K", F.floor(c / 9))).alias("key"), F.when(c % 11 != 0, named("s", c % 2)).alias("site"), F.lit("HR").alias("kind"), F.lit("os").alias("endpoint"), ((k % 3) / 2).alias("point"), F.when(k % 2 == 0, 0.5).alias("lo"), F.lit(None).cast("double").alias("hi"))
    return identity.prior_reading(rows).drop("hi")
