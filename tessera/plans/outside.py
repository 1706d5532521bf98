"""Queries that read JSON from outside, written from columns in the same way in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import untrusted as U
from tessera.plans.readings import query
from tessera.sources.tables import table

_K = "p_partkey % 17"
PINNED = f"""SELECT p_partkey, concat('{{"nct":"NCT', lpad(CAST(p_partkey AS {{text}}), CASE WHEN {_K} = 1 THEN 7 ELSE 8 END, '0'), '","overall_status":"', CASE WHEN {_K} = 2 THEN p_type ELSE 'RECRUITING' END, '","brief_title":', CASE WHEN {_K} = 3 THEN '" "' ELSE concat('"', p_name, '"') END,
 CASE WHEN {_K} = 4 THEN '' ELSE concat(',"answers_question":"', p_brand, '"') END, ',"relevance_phrase":"', CASE WHEN {_K} = 5 THEN repeat(p_name, 20) ELSE p_name END, '","phase":', CASE WHEN {_K} = 6 THEN '"PHASE2"' WHEN {_K} = 7 THEN '["PHASE1",2]' WHEN p_size % 2 = 0 THEN 'null' ELSE '["PHASE2","PHASE3"]' END,
 ',"enrollment_count":', CASE WHEN {_K} = 8 THEN concat('"', p_size, '"') WHEN p_size % 3 = 0 THEN 'null' ELSE concat(p_size, '') END, ',"primary_completion_date":', CASE WHEN {_K} = 9 THEN concat(2000 + p_size, '') WHEN {_K} = 10 THEN concat('"', 2000 + p_size, '-1"') ELSE concat('"', 2000 + p_size, '"') END,
 ',"brief_summary":', CASE WHEN {_K} = 11 THEN 'true' ELSE 'null' END, CASE WHEN {_K} = 12 THEN '' ELSE concat(',"eligibility_brief":"', p_type, '"') END, ',"conditions":', CASE WHEN {_K} = 13 THEN concat('["', p_type, '",', p_size, ']') ELSE concat('["', p_type, '"]') END,
 ',"interventions":', CASE WHEN {_K} = 14 THEN '"none"' WHEN {_K} = 15 THEN concat('[{{"name":"a","type":"b"}},', p_size, ']') WHEN {_K} = 16 THEN '[{{"name":"a"}}]' ELSE '[{{"name":"a","type":"b"}}]' END, '}}') AS j FROM part"""


@query(f"""WITH t AS ({PINNED.replace("{text}", "VARCHAR")}), x AS (SELECT p_partkey, CAST(j AS JSON) AS j FROM t),
 y AS (SELECT *, json_type(j, '$.phase') AS ph, json_type(j, '$.primary_completion_date') AS pc, CAST(json_extract(j, '$.interventions[*]') AS JSON[]) AS iv FROM x)
 SELECT p_partkey, CASE WHEN NOT regexp_full_match(j ->> '$.nct', 'NCT[0-9]{{8}}') THEN 'invalid nct format' WHEN j ->> '$.overall_status' <> 'RECRUITING' THEN 'overall_status not in enum' WHEN trim(j ->> '$.brief_title') = '' THEN 'missing brief_title' WHEN j ->> '$.answers_question' IS NULL THEN 'missing answers_question'
 WHEN length(j ->> '$.relevance_phrase') > 80 THEN 'relevance_phrase too long (>80)' WHEN ph NOT IN ('NULL', 'ARRAY') OR len(list_filter(CAST(json_extract(j, '$.phase[*]') AS JSON[]), lambda i: json_type(i) <> 'VARCHAR')) > 0 THEN 'phase must be string[] or null'
 WHEN json_type(j, '$.enrollment_count') = 'VARCHAR' THEN 'enrollment_count must be number or null' WHEN pc NOT IN ('VARCHAR', 'NULL') THEN 'primary_completion_date must be string or null' WHEN NOT regexp_full_match(j ->> '$.primary_completion_date', '[0-9]{{4}}(-[0-9]{{2}})?') THEN 'primary_completion_date must be YYYY or YYYY-MM'
 WHEN json_type(j, '$.brief_summary') NOT IN ('VARCHAR', 'NULL') THEN 'brief_summary must be string or null' WHEN json_type(j, '$.eligibility_brief') IS NULL THEN 'eligibility_brief must be string or null' WHEN len(list_filter(CAST(json_extract(j, '$.conditions[*]') AS JSON[]), lambda i: json_type(i) <> 'VARCHAR')) > 0 THEN 'conditions must be string[]'
 WHEN json_type(j, '$.interventions') <> 'ARRAY' THEN 'interventions must be an array' WHEN len(list_filter(iv, lambda i: json_type(i) <> 'OBJECT')) > 0 THEN 'interventions[] entries must be objects' WHEN len(list_filter(iv, lambda i: json_type(i, '$.type') IS NULL)) > 0 THEN 'interventions[] entries must have string name and type' END AS fault FROM y""")
def pinned_trials(spark, d):
    """F34."""
    table(spark, d, "part").createOrReplaceTempView("tessera_part")
    rows = spark.sql(PINNED.replace("{text}", "STRING").replace("FROM part", "FROM tessera_part"))
    return rows.select("p_partkey", U.fault_of_pinned_trial(F.col("j")).alias("fault"))


# A day's answer: a cluster for each customer segment of the day's orders; some ids are left out, named twice or unknown, some clusters are no good.
_ANSWER = """o AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderkey AS id, o_custkey % 4 AS g, o_custkey FROM orders),
 c AS (SELECT date, g, list(id ORDER BY id) FILTER (WHERE id % 9 <> 0) AS ids, min(id) AS first FROM o GROUP BY 1, 2), s AS (SELECT date, g, CASE WHEN first % 7 = 0 THEN 'Bad Slug' ELSE 'S-' || (g // (1 + first % 2)) END AS slug, CASE WHEN first % 11 = 0 THEN ' ' ELSE 'n' || g END AS name, CASE WHEN g = 1 THEN 'cns' ELSE 'x' || g END AS site, coalesce(ids, []) || CASE WHEN first % 5 = 0 THEN [first, -1] ELSE [] END AS ids FROM c)"""


@query(f"""WITH {_ANSWER}, k AS (SELECT date, g, lower(slug) AS slug, name, CASE site WHEN 'cns' THEN 'cns' ELSE 'other' END AS site, list_filter(ids, lambda i: i >= 0) AS ids FROM s WHERE slug <> 'Bad Slug' AND name <> ' ' AND len(list_filter(ids, lambda i: i >= 0)) > 0 QUALIFY row_number() OVER (PARTITION BY date, slug ORDER BY g) = 1)
 SELECT date, slug, name, site, array_to_string(ids, ',') AS ids FROM k""")
def cluster_answers(spark, d):
    """A13."""
    answers, items = _answers(spark, d)
    return U.clusters(answers, items).select("date", "slug", "name", "site", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {_ANSWER}, k AS (SELECT date, unnest(list_filter(ids, lambda i: i >= 0)) AS id FROM (SELECT * FROM s WHERE slug <> 'Bad Slug' AND name <> ' ' AND len(list_filter(ids, lambda i: i >= 0)) > 0 QUALIFY row_number() OVER (PARTITION BY date, slug ORDER BY g) = 1)),
 n AS (SELECT o.date, o.id, count(k.id) AS n FROM o LEFT JOIN k ON k.date = o.date AND k.id = o.id GROUP BY 1, 2) SELECT date, count(*) FILTER (WHERE n = 0) AS missing, count(*) FILTER (WHERE n > 1) AS duplicated FROM n GROUP BY 1 HAVING missing > 0 OR duplicated > 0""")
def cluster_cover(spark, d):
    """Days whose clusters are no exact cover."""
    answers, items = _answers(spark, d)
    return U.uncovered(U.clusters(answers, items), items)


def _answers(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("g"))
    c = o.groupBy("date", "g").agg(F.array_sort(F.collect_list(F.when(F.col("id") % 9 != 0, F.col("id")))).alias("ids"), F.min("id").alias("first"))
    first = F.col("first")
    ids = F.concat(F.col("ids"), F.when(first % 5 == 0, F.array(first, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    slug = F.when(first % 7 == 0, "Bad Slug").otherwise(F.concat(F.lit("S-"), F.floor(F.col("g") / (1 + first % 2)).cast("string")))
    one = F.struct("g", slug.alias("slug"), F.when(first % 11 == 0, " ").otherwise(F.concat(F.lit("n"), "g")).alias("name"), F.when(F.col("g") == 1, "cns").otherwise(F.concat(F.lit("x"), "g")).alias("disease_site"), ids.alias("tweet_ids"))
    studies = F.array_sort(F.collect_list(one))
    return c.groupBy("date").agg(F.concat(F.lit("```json\n"), F.to_json(F.struct(studies.alias("studies"))), F.lit("\n```")).alias("json")), o.select("date", "id")
