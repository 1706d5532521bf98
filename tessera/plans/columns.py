"""Column functions over columns of the tables. Their SQL works out the values from the tables, by other means where there are any."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.functions import effects as E
from tessera.functions import identifiers as I
from tessera.functions import validate as V
from tessera.functions.sections import let
from tessera.plans.readings import query
from tessera.sources.tables import table


@query("""SELECT o_orderkey, strftime(d, '%b %-d') AS short, strftime(d, '%b %-d ''%y') AS short_year, strftime(d, '%a, %d %b %Y 00:00:00 GMT') AS rfc822, CASE o_orderkey % 3 WHEN 2 THEN strftime(d, '%Y') ELSE strftime(d, '%Y-%m-%d') END AS loose,
 strftime(d, '%m') AS month, CASE WHEN o_custkey % 4 = 0 THEN strftime(d, '%Y') ELSE strftime(d, '%Y-%m') END AS year_month, CAST(d + CAST(o_custkey % 90 - 30 AS INTEGER) AS VARCHAR) AS shifted, year(d) AS full_year,
 CASE WHEN o_custkey % 5 = 0 THEN strftime(d, '%Y') WHEN o_custkey % 5 = 1 THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y-%m-%d') END AS parts, CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m') WHEN 2 THEN strftime(d, '%Y') END AS first
 FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def dates_of_orders(spark, d):
    """Y01, Z03-Z10."""
    day, k, c = F.to_date("o_orderdate"), F.col("o_orderkey"), F.col("o_custkey")
    iso = day.cast("string")
    loose = F.when(k % 3 == 0, F.concat(F.lit("on "), F.date_format(day, "yyyy/M/d"))).when(k % 3 == 1, F.date_format(day, "yyyy-MM-dd HH")).otherwise(F.concat(F.lit("Spring "), F.date_format(day, "yyyy")))
    first = F.when(k % 4 == 0, F.concat(F.lit("9 of "), iso, F.lit(", then 2001"))).when(k % 4 == 1, F.concat(F.lit("from "), F.date_format(day, "yyyy-MM"), F.lit(" on"))).when(k % 4 == 2, F.concat(F.lit("in "), F.date_format(day, "yyyy"))).otherwise("none, 12345")
    part = lambda f, ok: F.when(ok, f(day)).otherwise(0)
    return table(spark, d, "orders").select(
        "o_orderkey", D.short_date(iso).alias("short"), D.short_date(iso, True).alias("short_year"), D.rfc822(iso).alias("rfc822"), D.loose_date(loose).alias("loose"),
        D.month_number(F.when(k % 2 == 0, F.date_format(day, "MMMM")).otherwise(F.date_format(day, "M"))).alias("month"), D.year_month(F.when(c % 4 == 0, F.date_format(day, "yyyy")).otherwise(F.concat(F.lit(" "), iso))).alias("year_month"),
        D.shifted(iso, (c % 90 - 30).cast("int")).alias("shifted"), D.full_year(F.when((k % 2 == 0) & (F.year(day) >= 2000), F.date_format(day, "yy")).otherwise(F.date_format(day, "yyyy"))).cast("long").alias("full_year"),
        D.date_parts(F.year(day), part(F.month, c % 5 != 0), part(F.dayofmonth, c % 5 > 1)).alias("parts"), D.first_date(first).alias("first"),
    )


_NUMBERS = "concat('rate ', CAST(l_quantity AS INTEGER), '.50% of 1,', lpad(CAST(l_partkey % 1000 AS {text}), 3, '0'), ' at 0·', l_suppkey % 10, ' and ', l_linenumber % 10, '-', l_orderkey, ' (', l_linenumber, ' %)')"


@query(f"""WITH t AS (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, l_partkey % 1000 + 1000 AS n, CAST(l_suppkey % 10 AS VARCHAR) AS s, CAST(l_linenumber % 10 AS VARCHAR) AS l FROM lineitem)
 SELECT l_orderkey, l_linenumber, 'rate ' || q || '.50% of ' || n || ' at 0.' || s || ' and ' || l || '-' || l_orderkey || ' (' || l_linenumber || ' %)' AS plain,
 array_to_string(list_sort(list_distinct([q || '.50', CAST(n AS VARCHAR), '0.' || s, l, CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l || '.' || l_orderkey])), ' ') AS forms,
 array_to_string(list_sort(list_distinct([q || '.5', CAST(l_linenumber AS VARCHAR)])), ' ') AS percents, array_to_string(list_sort(list_distinct([q || '.50%', '0.' || s, l_linenumber || '%'])), ' ') AS traced,
 'y' || CASE WHEN n = 1500 OR l_orderkey = 1500 OR l_linenumber = 1500 THEN 'y' ELSE 'n' END AS grounded FROM t""")
def numbers_of_lines(spark, d):
    """N07, N08, N11, N31, V10."""
    table(spark, d, "lineitem").createOrReplaceTempView("tessera_lineitem")
    rows = spark.sql(f"SELECT l_orderkey, l_linenumber, l_suppkey, {_NUMBERS.format(text='STRING')} AS t FROM tessera_lineitem")
    t = F.col("t")
    joined = lambda x: F.array_join(F.array_sort(x), " ")
    claims = F.array(F.concat(F.lit("."), F.col("l_suppkey") % 10), F.lit("1500"))
    # made once for both marks
    marks = let(E.grounded(claims, t)["grounded"], lambda g: F.array_join(F.transform(claims, lambda x: F.when(F.array_contains(g, x), "y").otherwise("n")), ""))
    return rows.select("l_orderkey", "l_linenumber", E.plain_numbers(t).alias("plain"), joined(E.number_forms(t)).alias("forms"), joined(E.percents(t)).alias("percents"), joined(E.traced_values(t)).alias("traced"), marks.alias("grounded"))


@query("""WITH t AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, split_part(split_part(url, '#', 1), '?', 2) AS q, CASE WHEN strpos(url, '#') > 0 THEN '#' || split_part(url, '#', 2) ELSE '' END AS frag FROM pages),
 p AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '') AS ps FROM t)
 SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS path_only, regexp_replace(h, '^www\\.', '') AS host,
 'https://' || regexp_replace(h, '^www\\.', '') || rtrim(path, '/') || '?' || array_to_string(list_transform(list_sort(list_concat(list_filter(ps, lambda x: NOT regexp_matches(x, '^(utm_|ref=)')), ['z=' || page_id || ' x', 'a=1/2'])), lambda x: x), '&') AS canonical,
 split_part(url, '#', 1) || CASE WHEN q = '' THEN '?' ELSE '&' END || 'tag=' || split_part(path, '/', 2) || '&tag=p-' || page_id || frag AS tagged,
 split_part(split_part(url, '#', 1), '?', 1) || CASE WHEN len(list_filter(ps, lambda x: x NOT LIKE 'utm_source=%' AND x NOT LIKE 'page=%')) > 0 THEN '?' || array_to_string(list_filter(ps, lambda x: x NOT LIKE 'utm_source=%' AND x NOT LIKE 'page=%'), '&') ELSE '' END || frag AS stripped,
 split_part(path, '/', 2) || ',p-' || page_id AS tags FROM p""")
def addresses_of_pages(spark, d):
    """C13, C15, C35, C36, F04."""
    u, n = F.col("url"), F.col("page_id").cast("string")
    lang = F.split_part(F.regexp_extract(u, "^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit("/"), F.lit(2))
    bare, frag = F.regexp_extract(u, "^([^#]*)", 1), F.regexp_extract(u, "(#.*)$", 1)
    more = lambda x: F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), x, frag)
    tagged = V.with_tags(more(F.lit("Tag=old")), F.array(F.concat(F.lit("p-"), n), lang))
    return table(spark, d, "pages").select(
        "page_id", I.path_only(u).alias("path_only"), I.host(u).alias("host"), I.canonical_url(more(F.concat(F.lit("z="), n, F.lit("+x&utm_medium=m&%61=1%2F2")))).alias("canonical"), tagged.alias("tagged"),
        V.without_parameters(u, ["utm_source", "page"]).alias("stripped"), F.array_join(V.url_tags(more(F.concat(F.lit("tag="), F.upper(lang), F.lit("&TAG=p-"), n, F.lit("&tag=no_slug&tag="), lang))), ",").alias("tags"),
    )


_LAST = "strpos(reverse(substr(text, 1, 60)), ' ')"


@query(f"""SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN {_LAST} > 0 AND 60 - {_LAST} > 40 THEN regexp_replace(substr(text, 1, 60 - {_LAST}), '\\s+$', '') || '…' ELSE regexp_replace(substr(text, 1, 60), '\\s+$', '') || '…' END AS relevance,
 CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || chr(10) || '[truncated]' ELSE text END AS capped, CASE WHEN length(text) <= 46 THEN 58 WHEN length(text) <= 78 THEN 50 WHEN length(text) <= 118 THEN 42 ELSE 36 END AS headline,
 replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped, CASE WHEN coalesce(lang, '') <> '' AND coalesce(source, '') <> '' THEN '/study/' || source || '-' || lang || '/' END AS share,
 array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(substr(text, 1, 300)), '[^a-z0-9]+'), lambda w: length(w) > 3))), ' ') AS words FROM documents WHERE text IS NOT NULL""")
def cuts_of_documents(spark, d):
    """C31, C34, C38, C40, C46, Y07."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", D.relevance(t).alias("relevance"), D.capped(t).alias("capped"), D.headline_size(t).alias("headline"), I.escaped_xml(t).alias("escaped"), D.share_url(F.lit("x"), F.col("source"), F.col("lang")).alias("share"), F.array_join(F.array_sort(D.long_words(F.substring(t, 1, 300))), " ").alias("words"))


@query("""WITH t AS (SELECT p_partkey, lower(p_type) AS ty, replace(lower(p_brand), '#', '-') AS b, replace(lower(p_name), ' ', '-') AS n, p_size FROM part)
 SELECT p_partkey, ty || ' ' || b AS slugs, b IN ('brand-13', 'brand-5') AS held, p_size % 2 = 1 AS clearable, CASE WHEN ty < b AND p_size % 3 > 0 THEN ty || '+' || b WHEN p_size % 3 = 0 THEN n END AS path, p_size % 4 > 0 AS safe, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS id_date FROM t""")
def tags_of_parts(spark, d):
    """F01-F03, F05, F25, F28, F35, P27."""
    ty, b, n, size = F.lower("p_type"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.col("p_size")
    toks = V.tokens(F.concat(F.lit("Type:"), F.upper(ty), F.lit("  brand:"), b, F.lit(" broken: :x bare type2:"), ty))
    day = F.concat(F.lit("2024-01-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"))
    card = F.concat(day, F.lit("#"), n)
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(V.slugs(toks), " ").alias("slugs"), V.matches(F.array(F.lit("brand-13"), F.lit("brand-5"), ty), V.slugs(toks)).alias("held"), V.clearable(F.array(ty, b), F.when(size % 2 == 1, F.array(ty)).otherwise(F.array(b, ty))).alias("clearable"),
        F.array_join(V.tag_path(F.when(size % 3 == 0, n).otherwise(F.concat(ty, F.lit("+"), b))), "+").alias("path"), V.safe_slug(F.when(size % 4 > 0, n).otherwise(F.col("p_name"))).alias("safe"), F.when(V.card_id(card), V.id_date(card)).alias("id_date"),
    )
