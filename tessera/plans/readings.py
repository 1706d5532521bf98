"""Queries that read texts: effect estimates. Their SQL restates the rules on the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tessera.functions import measures as M
from tessera.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Statistics written from the numbers of an order's line, in eight forms. The same text in both engines.
STAT = """
 SELECT l_orderkey, l_linenumber, f, CASE f WHEN 0 THEN concat('HR ', p) WHEN 1 THEN concat('OS adjusted HR ', p, ' (', lo, '-', hi, ')') WHEN 2 THEN concat(p, '% vs ', hi, '% (', l_returnflag, ' vs ', l_linestatus, l_linestatus, ')')
  WHEN 3 THEN concat('sub-HR=', replace(p, '.', '·')) WHEN 4 THEN 'not yet' WHEN 5 THEN concat('RR ', p, ' in ', CASE WHEN l_suppkey % 2 = 0 THEN 'all' ELSE concat('part ', l_partkey, l_returnflag, ' only') END, ', 95% CI ', lo, '–', hi) WHEN 6 THEN concat(l_returnflag, l_suppkey) ELSE concat(lo, ' vs ', hi, CASE WHEN l_orderkey % 2 = 0 THEN ' mo' ELSE ' mo vs 3 mo' END) END AS v,
  CASE f WHEN 0 THEN concat('95% CI ', lo, '-', hi) WHEN 2 THEN 'n' WHEN 3 THEN concat('90 % CI: ', lo, ' to ', hi) WHEN 4 THEN concat('OR ', p, '; later 95% CI ', lo, '-', hi, CASE WHEN l_orderkey % 3 = 0 THEN ' and 95% CI 1-2' ELSE '' END) WHEN 6 THEN concat('THR 9; HR: ', p, ', ', l_linestatus) END AS d
 FROM (SELECT *, concat(l_orderkey % 4, '.', lpad(CAST(l_partkey % 100 AS {text}), 2, '0')) AS p, concat(l_suppkey % 2, '.', lpad(CAST(l_partkey % 97 AS {text}), 2, '0')) AS lo, concat(l_orderkey % 5, '.', lpad(CAST(l_suppkey % 10 AS {text}), 2, '0')) AS hi, (l_orderkey + l_linenumber) % 8 AS f FROM lineitem) x"""
_NUM = r"[0-9]+(?:\.[0-9]+)?"
_RX = rf"(?i)(?:^|[^A-Za-z])((?:adjusted\s+|sub-?|s|a)?(?:HR|OR|RR)\s*[=:]?\s*{_NUM})"
_CI = rf"([0-9]{{2}})\s*%\s*CI[\s:]*\(?\s*({_NUM})\s*(?:-|to)\s*({_NUM})"
_PAIR = rf"(?i)({_NUM})\s*(%|mo)?\s+vs\.?\s+({_NUM})\s*(%|mo)?"


def _ci(text: str, before: str = "") -> str:
    x = lambda i: f"CAST(nullif(regexp_extract({text}, '(?is){before}{_CI}', {i}), '') AS DOUBLE)"
    return f"CASE WHEN {x(2)} > 0 AND {x(3)} > 0 THEN [{x(1)}, {x(2)}, {x(3)}] END"


_NEAR = "(?is)^.{0,12}?" + _CI
_BARE = rf"(?i)^[\s,;:]*\(\s*({_NUM})\s*(?:-|to)\s*({_NUM})\s*\)"
_b = lambda i: f"CAST(nullif(regexp_extract(tail, '{_BARE}', {i}), '') AS DOUBLE)"
_sole = lambda c: f"CASE WHEN len(regexp_extract_all({c}, '(?i){_CI}')) = 1 THEN {_ci(c)} END"


@query(f"""WITH t AS ({STAT.format(text="VARCHAR")}), n AS (SELECT l_orderkey, l_linenumber, replace(replace(coalesce(v, ''), '·', '.'), '–', '-') AS v, replace(replace(coalesce(d, ''), '·', '.'), '–', '-') AS d FROM t),
 m AS (SELECT *, regexp_extract(v, '{_RX}', 1) AS vm, regexp_extract(d, '{_RX}', 1) AS dm FROM n),
 u AS (SELECT *, CASE WHEN vm <> '' THEN v ELSE d END AS own, CASE WHEN vm <> '' THEN d ELSE v END AS other, CASE WHEN vm <> '' THEN vm ELSE dm END AS hit FROM m),
 k AS (SELECT *, upper(regexp_extract(hit, '(?i)(HR|OR|RR)', 1)) AS name, CAST(nullif(regexp_extract(hit, '({_NUM})$', 1), '') AS DOUBLE) AS pt, substr(own, strpos(own, hit) + length(hit), 52) AS tail FROM u),
 c AS (SELECT *, coalesce(CASE WHEN regexp_matches(tail, '{_NEAR}') THEN {_ci("tail", "^.{0,12}?")} WHEN {_b(1)} > 0 AND {_b(2)} > 0 THEN [NULL, {_b(1)}, {_b(2)}] END, {_sole("other")}, {_sole("own")}) AS ci FROM k),
 o AS (SELECT *, coalesce(ci[3] >= ci[2] AND pt >= ci[2] AND pt <= ci[3], false) AS fits FROM c),
 r AS (SELECT *, hit <> '' AND pt > 0 AND NOT (ci[1] IS NOT NULL AND NOT fits) AS ok FROM o),
 q AS (SELECT *, v NOT LIKE '%NR%' AND len(regexp_extract_all(regexp_replace(v, '\\([^()]*\\)', ' ', 'g'), '(?i)\\bvs\\.?')) = 1 AND regexp_matches(v, '{_PAIR}') AS two, CAST(nullif(regexp_extract(v, '{_PAIR}', 1), '') AS DOUBLE) AS x, CAST(nullif(regexp_extract(v, '{_PAIR}', 3), '') AS DOUBLE) AS y,
  lower(nullif(regexp_extract(v, '{_PAIR}', 2), '')) AS ux, lower(nullif(regexp_extract(v, '{_PAIR}', 4), '')) AS uy, nullif(regexp_extract(v, '\\(([^()]+?) vs ([^()]+?)\\)', 1), '') AS la, nullif(regexp_extract(v, '\\(([^()]+?) vs ([^()]+?)\\)', 2), '') AS lb FROM r),
 z AS (SELECT *, two AND NOT (x = 0 AND y = 0) AND coalesce(ux = uy, true) AS good FROM q)
 SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN CASE WHEN name IN ('OR', 'RR') THEN name WHEN regexp_matches(hit, '(?i)^s') THEN 'SHR' ELSE 'HR' END END AS kind, CASE WHEN ok THEN pt END AS point, CASE WHEN ok AND fits THEN ci[2] END AS lo, CASE WHEN ok AND fits THEN ci[3] END AS hi, CASE WHEN ok AND fits THEN CAST(ci[1] AS INTEGER) END AS level,
 CASE WHEN good THEN x END AS a, CASE WHEN good THEN y END AS b, CASE WHEN good THEN coalesce(ux, uy) END AS unit, CASE WHEN good THEN la END AS label_a, CASE WHEN good THEN lb END AS label_b FROM z""")
def effect_parse(spark, d):
    """N01, N02."""
    table(spark, d, "lineitem").createOrReplaceTempView("tessera_lineitem")
    rows = spark.sql(STAT.format(text="STRING").replace("FROM lineitem", "FROM tessera_lineitem"))
    got = rows.select("l_orderkey", "l_linenumber", M.ratio(F.col("v"), F.col("d")).alias("r"), M.pair(F.col("v")).alias("p"))
    return got.select("l_orderkey", "l_linenumber", *(F.col(f"r.{c}") for c in ("kind", "point", "lo", "hi", "level")), *(F.col(f"p.{c}") for c in ("a", "b", "unit", "label_a", "label_b")))


# Tables written from a part: heads by its brand and size, rows by its type and container.
PART_TABLE = """
 SELECT p_partkey, lower(p_type) AS want, {array}(CASE p_partkey % 5 WHEN 0 THEN 'Endpoint (5 yr)' WHEN 1 THEN 'Endpoint (smokers)' WHEN 2 THEN 'Cohort' ELSE 'Endpoint' END,
  CASE p_size % 4 WHEN 0 THEN 'Arm A' WHEN 1 THEN concat(p_brand, ' (n=', p_size, ')') WHEN 2 THEN 'POP-RT (n=5)' ELSE 'Stage II' END, CASE p_partkey % 3 WHEN 0 THEN 'HR (95% CI)' WHEN 1 THEN 'PEACE-2 (n=6)' ELSE p_brand END,
  CASE p_partkey % 2 WHEN 0 THEN 'placebo' ELSE 'p-value' END) AS heads,
 {array}({array}('Dose', '50 Gy', '60 Gy', '70 Gy'), {array}(p_brand, '1', '2', '3'), {array}(CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE concat('Late ', p_type, '.') END, concat(p_size, '%'), concat(p_partkey % 50, CASE WHEN p_partkey % 4 = 0 THEN ' Gy' ELSE '' END), concat(p_partkey % 9, ' mo')),
  {array}(p_type, '4', '0.5%', concat(p_size, '.5'))) AS cells FROM part"""
_CELL = rf"^\s*({_NUM})\s*(%|mo)?\s*$"


@query(f"""WITH t AS ({PART_TABLE.replace("{array}", "list_value")}), g AS (SELECT *, list_filter(heads[2:], lambda h: NOT regexp_matches(h, '(?i)^\\s*(p-value|hr \\(95% ci\\))\\s*$')) AS arms FROM t),
 h AS (SELECT *, heads[1] IN ('Endpoint', 'Endpoint (5 yr)') AND len(arms) = 2 AND len(list_filter(arms, lambda h: h LIKE 'Stage%')) = 0
  AND (len(list_filter(arms, lambda h: h = 'Arm A' OR h = 'placebo')) > 0 OR (len(list_filter(arms, lambda h: h LIKE '%(n=%')) > 0 AND len(list_filter(arms, lambda h: NOT regexp_matches(h, '^[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*\\s*(?:\\(n=[^)]*\\))?$'))) > 0)) AS ok, list_position(heads, arms[1]) AS ca, list_position(heads, arms[2]) AS cb FROM g),
 r AS (SELECT *, list_filter(cells, lambda c: (lower(c[1]) = want OR (length(want) >= 5 AND regexp_matches(lower(c[1]), '(^|\\W)' || want || '(\\W|$)'))) AND regexp_matches(c[ca], '{_CELL}') AND regexp_matches(c[cb], '{_CELL}')
   AND (TRY_CAST(regexp_extract(c[ca], '{_CELL}', 1) AS DOUBLE) > 0 OR TRY_CAST(regexp_extract(c[cb], '{_CELL}', 1) AS DOUBLE) > 0))[1] AS c FROM h WHERE ok)
 SELECT p_partkey, arms[1] AS label_a, TRY_CAST(regexp_extract(c[ca], '{_CELL}', 1) AS DOUBLE) AS a, arms[2] AS label_b, TRY_CAST(regexp_extract(c[cb], '{_CELL}', 1) AS DOUBLE) AS b, coalesce(nullif(regexp_extract(c[ca], '{_CELL}', 2), ''), nullif(regexp_extract(c[cb], '{_CELL}', 2), '')) AS unit FROM r WHERE c IS NOT NULL""")
def effect_table(spark, d):
    """The table is asked since the text holds no estimate."""
    table(spark, d, "part").createOrReplaceTempView("tessera_part")
    rows = spark.sql(PART_TABLE.replace("{array}", "array").replace("FROM part", "FROM tessera_part"))
    tables = F.array(F.struct(F.col("heads").alias("columns"), F.col("cells").alias("rows")))
    found = F.array(M.effect(F.lit("not yet"), F.lit(None).cast("string"), F.col("want"), tables))
    # a filter behind a column would compute the column again
    got = rows.select("p_partkey", F.explode(F.filter(found, lambda e: e["form"] == "table")).alias("e"))
    return got.select("p_partkey", *(F.col(f"e.pair.{c}") for c in ("label_a", "a", "label_b", "b", "unit")))


# A text that names three trials with numbers, and a source that holds some of both.
_CLAIMS = """SELECT l_orderkey, l_linenumber, concat('**DESTINY-Breast0', l_linenumber, '** had HR 0.', l_partkey % 90 + 10, ' (95% CI 0.1-0.9); POP-RT', l_suppkey % 9, ' did not. PHASE3, NSCLC and stage III: KEYNOTE-', l_orderkey % 400 + 100, ' reached ', l_partkey % 60 + 20, '% of ', l_returnflag, '.') AS t,
 concat('Destiny breast 0', l_linenumber % 3 + 1, ': 0.', l_partkey % 45 + 10, ', 0.1 to 0.9 (95); pop rt ', l_suppkey % 4, '; keynote ', l_orderkey % 200 + 100, ' and ', l_partkey % 30 + 20) AS s FROM lineitem"""


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_linenumber <> l_linenumber % 3 + 1 THEN 'DESTINY-Breast0' || l_linenumber END, CASE WHEN l_suppkey % 9 <> l_suppkey % 4 THEN 'POP-RT' || (l_suppkey % 9) END, CASE WHEN l_orderkey % 400 <> l_orderkey % 200 THEN 'KEYNOTE-' || (l_orderkey % 400 + 100) END], lambda x: x IS NOT NULL), ' ') AS unsourced,
 array_to_string(list_filter([CASE WHEN l_linenumber <> l_linenumber % 3 + 1 AND l_partkey % 90 <> l_partkey % 45 THEN 'DESTINY-Breast0' || l_linenumber END, CASE WHEN l_orderkey % 400 <> l_orderkey % 200 AND CAST(l_partkey % 60 + 20 AS VARCHAR) NOT IN (CAST(l_partkey % 30 + 20 AS VARCHAR), '95', CAST(l_orderkey % 200 + 100 AS VARCHAR)) THEN 'KEYNOTE-' || (l_orderkey % 400 + 100) END], lambda x: x IS NOT NULL), ' ') AS claims FROM lineitem""")
def comparator_claims(spark, d):
    """F09, C11, V01, V02."""
    from tessera.functions import comparators as C

    table(spark, d, "lineitem").createOrReplaceTempView("tessera_lineitem")
    rows = spark.sql(_CLAIMS.replace("FROM lineitem", "FROM tessera_lineitem"))
    t, s = F.col("t"), F.col("s")
    return rows.select("l_orderkey", "l_linenumber", F.array_join(C.unsourced(t, s), " ").alias("unsourced"), F.array_join(C.unsourced_claims(t, s), " ").alias("claims"))
