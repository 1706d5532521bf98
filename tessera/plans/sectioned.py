"""Queries over sections of documents. Their SQL explodes lines and uses windows and a recursion where the operators work in arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sections as S
from tessera.plans.readings import query
from tessera.sources.tables import table

# Documents with heads between their lines, the same in both engines: line i of a document (from 0) gets one if i + doc_id is a multiple of 3.
HEADINGS = ["METHODS", "3. Results:", "Table 2. Rows", "REFERENCES", "TREATMENT ALLOCATION", "Fig. 2 – Curves", "Funding", "Results were consistent across all of it", "ABSTRACT", "Discussion", "CEP", "  table 9", "Funding was given by others", "RTOG 0848", "mail@x.org"]
MOST = 4000
_L = "[" + ", ".join("'" + h + "'" for h in HEADINGS) + "]"
TEXT = f"SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1 + doc_id) % 3 = 0 THEN {_L}[(((i - 1 + doc_id) // 3) * 7 + doc_id) % {len(HEADINGS)} + 1] || chr(10) ELSE '' END || l), chr(10)) AS text FROM documents WHERE text IS NOT NULL"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_T = "regexp_replace(regexp_replace(l, '^\\s+', ''), '\\s+$', '')"
_LABEL = "(regexp_matches(b, '[:.]\\s*$') OR len(string_split_regex(b, '\\s+')) <= 2 OR NOT regexp_matches(b, '[a-z]') OR len(list_filter(string_split_regex(b, '\\s+'), lambda w: length(w) >= 4 AND regexp_matches(w, '^[a-z]'))) = 0)"
_KIND = (
    "CASE WHEN s = '' OR s LIKE '%@%' OR s LIKE '%://%' THEN NULL "
    + " ".join(f"WHEN length(s) <= 300 AND regexp_extract(s, {_q(p)}) <> '' AND (length(s) <= 24 OR regexp_matches(regexp_extract(s, {_q(p)}), '[.:–—-]\\s*$')) THEN '{k}'" for k, p in S.CAPTIONS)
    + " WHEN length(s) > 90 OR length(b) > 60 THEN NULL "
    + " ".join(f"WHEN regexp_matches(b, {_q(p)}) THEN CASE WHEN len(string_split_regex(b, '\\s+')) <= 6{f' AND {_LABEL}' if k in (*S.DROPPED, 'abstract') else ''} THEN '{k}' END" for k, p in S.HEADS)
    + f" WHEN regexp_matches(b, {_q(S.CAPS)}) AND regexp_matches(b, '[A-Z]{{3}}') AND len(string_split_regex(b, '\\s+')) BETWEEN 2 AND 6 AND NOT s LIKE '%.' AND NOT regexp_matches(b, {_q(S.CHROME)}) THEN 'body' END"
)
SECTIONS = f"""t AS ({TEXT}), a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
 c AS (SELECT doc_id, i, l, {_T} AS s FROM a),
 p AS (SELECT w[x : x + n - 1] AS piece FROM (SELECT unnest(['{"','".join(S.STAMPS)}']) AS w), range(1, 14) r(x), range(2, 5) m(n) WHERE x + n - 1 <= length(w)),
 k AS (SELECT * FROM c WHERE NOT (regexp_matches(s, '^[A-Z]{{1,4}}[0-9]{{0,3}}$') AND s NOT IN ('{"','".join(S.TERMS)}') AND regexp_replace(s, '[0-9]+$', '') IN (SELECT piece FROM p)) OR s NOT IN (SELECT s FROM c d WHERE d.doc_id = c.doc_id GROUP BY s HAVING count(*) >= 5)),
 h AS (SELECT *, regexp_replace(regexp_replace(s, '^[0-9]+(\\.[0-9]+)*[.)]?\\s*', ''), '[:.]\\s*$', '') AS b FROM k), g AS (SELECT *, {_KIND} AS kind FROM h),
 f AS (SELECT *, count(kind) OVER w AS n, sum(length(l) + 1) OVER w - length(l) - 1 AS pos FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 e AS (SELECT doc_id, n, coalesce(max(kind), 'front') AS kind, max(CASE WHEN kind IS NOT NULL THEN s END) AS heading, min(pos) AS start,
   regexp_replace(regexp_replace(coalesce(string_agg(CASE WHEN kind IS NULL THEN l WHEN kind IN ('table', 'figure') THEN s END, chr(10) ORDER BY i), ''), '^\\s+', ''), '\\s+$', '') AS text FROM f GROUP BY doc_id, n),
 sections AS (SELECT doc_id, CASE WHEN kind = 'front' AND (total < 15000 OR length(text) > total * 0.25) THEN 'body' ELSE kind END AS kind, heading, text, CAST(start AS INTEGER) AS start FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM e WHERE text <> ''))"""


def documents(spark, d):
    heads = F.array(*map(F.lit, HEADINGS))
    pick = lambda i: F.get(heads, (F.floor((i + F.col("doc_id")) / 3) * 7 + F.col("doc_id")) % len(HEADINGS))
    line = lambda x, i: F.concat(F.when((i + F.col("doc_id")) % 3 == 0, F.concat(pick(i), F.lit("\n"))).otherwise(""), x)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query(f"WITH {SECTIONS} SELECT doc_id, kind, heading, text, start FROM sections")
def section_segments(spark, d):
    """T01-T03."""
    return documents(spark, d).select("doc_id", F.inline(S.segments(F.col("text"))))


def _cut(text: str, limit: str) -> str:
    head = f"substr({text}, 1, greatest(0, {limit} - {len(S.CUT_MARK) + 1}))"
    last = lambda what, n: f"(CASE WHEN strpos(reverse({head}), {what}) > 0 THEN length({head}) - strpos(reverse({head}), {what}) - {n} + 1 ELSE -1 END)"
    para, line, stop = last("chr(10) || chr(10)", 2), last("chr(10)", 1), last("' .'", 2)
    trim = lambda x: f"regexp_replace({x}, '\\s+$', '')"
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} WHEN {para} >= {limit} * 0.6 THEN {trim(f'substr({head}, 1, {para})')} || chr(10) || chr(10) || '{S.CUT_MARK}' WHEN {line} >= {limit} * 0.6 THEN {trim(f'substr({head}, 1, {line})')} || chr(10) || '{S.CUT_MARK}'"
        f" WHEN {stop} >= {limit} * 0.6 THEN substr({head}, 1, {stop} + 1) || ' {S.CUT_MARK}' ELSE {trim(head)} || ' {S.CUT_MARK}' END"
    )


@query(f"""WITH RECURSIVE {SECTIONS},
 u AS (SELECT *, '## ' || coalesce(regexp_replace(heading, '\\s*[:.]\\s*$', ''), 'Body') || chr(10) AS head, kind IN ('table', 'figure') AS grid, list_position(['{"','".join(S.FILL)}'], kind) AS place FROM sections WHERE kind NOT IN ('front', 'references', 'disclosures', 'abstract')),
 tries AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, place, start) AS k FROM (SELECT *, unnest(CASE WHEN grid THEN [0, 3] ELSE [2] END) AS turn FROM u)),
 fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS tables, CAST([] AS STRUCT(start INTEGER, kind VARCHAR, grid BOOLEAN, chunk VARCHAR, chars BIGINT)[]) AS kept FROM (SELECT DISTINCT doc_id FROM tries)
  UNION ALL SELECT doc_id, k, CASE WHEN ok THEN spent + length(head) + length(body) + 2 ELSE spent END, CASE WHEN ok AND turn = 0 THEN spent + length(head) + length(body) + 2 ELSE tables END,
   CASE WHEN ok THEN list_append(kept, {{'start': start, 'kind': kind, 'grid': grid, 'chunk': head || body, 'chars': length(body)}}) ELSE kept END
  FROM (SELECT *, budget >= 600 AND length(body) >= least(600, length(text)) AND NOT list_contains(list_transform(kept, lambda x: x.start), start) AS ok FROM (SELECT *, {_cut("text", "budget")} AS body FROM
   (SELECT y.doc_id, y.k, x.spent, x.tables, x.kept, y.turn, y.head, y.text, y.start, y.kind, y.grid, least({MOST}, CASE y.turn WHEN 0 THEN {int(MOST * 0.6 + 0.5)} WHEN 2 THEN CASE WHEN x.tables > 0 THEN least({MOST}, greatest(12000, CAST(floor(x.tables / 0.3 + 0.5) AS BIGINT))) ELSE {MOST} END ELSE {MOST} END) - x.spent - length(y.head) AS budget
    FROM fold x JOIN tries y ON y.doc_id = x.doc_id AND y.k = x.k + 1)))),
 done AS (SELECT doc_id, kept FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1),
 gone AS (SELECT doc_id, count(*) FILTER (WHERE kind IN ('front', 'references', 'disclosures', 'abstract')) AS dropped FROM sections GROUP BY doc_id),
 o AS (SELECT t.doc_id, t.text AS source, d.kept, trim(t.text, ' ' || chr(9) || chr(10) || chr(13)) = '' OR d.kept IS NULL OR len(d.kept) = 0 OR (len(d.kept) = 1 AND d.kept[1].kind = 'body' AND d.kept[1].start = 0 AND starts_with(d.kept[1].chunk, '## Body') AND coalesce(g.dropped, 0) = 0) AS fell_back FROM t LEFT JOIN done d USING (doc_id) LEFT JOIN gone g USING (doc_id))
 SELECT doc_id, fell_back, CASE WHEN fell_back THEN '' ELSE array_to_string(list_transform(kept, lambda x: x.kind || ':' || x.chars), ',') END AS kept,
  CASE WHEN fell_back THEN substr(source, 1, {MOST}) ELSE regexp_replace(array_to_string(list_transform(list_sort(list_transform(kept, lambda x: {{'prose': NOT x.grid, 'start': x.start, 'chunk': x.chunk}})), lambda x: x.chunk), chr(10) || chr(10)), '\\s+$', '') END AS text FROM o""")
def excerpt_budget(spark, d):
    """T04, T06."""
    got = documents(spark, d).select("doc_id", S.excerpt(F.col("text"), MOST).alias("e"))
    return got.select("doc_id", "e.fell_back", F.array_join(F.transform("e.kept", lambda k: F.concat_ws(":", k["kind"], k["chars"].cast("string"))), ",").alias("kept"), "e.text")
