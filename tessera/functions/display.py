"""Texts as readers see them: cuts, labels, dates, escapes. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, and what joins parts.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DOT = " · "


def short_date(c: Column, year: bool = False) -> Column:
    """`Mon D`, with year `Mon D 'YY`; other text as it is."""
    m = F.regexp_extract(c, "^[0-9]{4}-([0-9]{2})-[0-9]{2}$", 1).try_cast("int")
    label = F.concat(F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), m - 1), F.lit("?")), F.lit(" "), F.substring(c, 9, 2).try_cast("int").cast("string"))
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(label, F.lit(" '"), F.substring(c, 3, 2)) if year else label).otherwise(c)


def rfc822(c: Column) -> Column:
    """Midnight UTC of an ISO date; empty for what is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.concat(c, F.lit(" 00:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit(""))


def loose_date(c: Column) -> Column:
    """Year, month and day with / or - as ISO, else a year alone, else NULL."""
    p = "([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
    part = lambda k: F.lpad(F.regexp_extract(c, p, k), 2, "0")
    year = F.nullif(F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit(""))
    return F.when(c.rlike(p), F.concat_ws("-", F.regexp_extract(c, p, 1), part(2), part(3))).otherwise(year)


def month_number(c: Column) -> Column:
    """Two digits of a month's name or number; 01 for others."""
    at = F.array_position(F.array(*(F.lit(m.lower()) for m in MONTHS)), F.substring(F.lower(c), 1, 3))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0")).when(c.rlike("^[0-9]{1,2}$"), F.lpad(c, 2, "0")).otherwise("01")


def year_month(c: Column) -> Column:
    """Year and month of an anchored date, the year alone if the month is none; other shapes NULL."""
    p = "^([0-9]{4})(?:-([0-9]{2}))?(?:-[0-9]{2})?$"
    t = F.trim(c)
    m = F.regexp_extract(t, p, 2)
    return F.when(t.rlike(p), F.when(m.try_cast("int").between(1, 12), F.concat(F.regexp_extract(t, p, 1), F.lit("-"), m)).otherwise(F.regexp_extract(t, p, 1)))


def shifted(c: Column, days: Column) -> Column:
    """The ISO date some days later."""
    return F.date_add(c.cast("date"), days).cast("string")


def full_year(c: Column) -> Column:
    """Of two or four digits."""
    return F.when(F.length(c) == 4, c.cast("int")).otherwise(2000 + c.cast("int"))


def date_parts(y: Column, m: Column, d: Column) -> Column:
    """As much of a date as its parts give; NULL without a year."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    has = lambda x: F.coalesce(x != 0, F.lit(False))
    return F.when(has(y), F.when(has(m) & has(d), F.concat_ws("-", y.cast("string"), two(m), two(d))).when(has(m), F.concat_ws("-", y.cast("string"), two(m))).otherwise(y.cast("string")))


def first_date(c: Column) -> Column:
    """The first full or partial ISO date in a text, else NULL."""
    return F.nullif(F.regexp_extract(c, r"\b([0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?)\b", 1), F.lit(""))


def json_for_script(c: Column) -> Column:
    """JSON that may stand in a page's script."""
    for a, b in (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def share_url(site: Column, date: Column, slug: Column) -> Column:
    """NULL unless all parts are there."""
    return F.when((F.coalesce(site, F.lit("")) != "") & (F.coalesce(date, F.lit("")) != "") & (F.coalesce(slug, F.lit("")) != ""), F.concat(F.lit("/study/"), date, F.lit("-"), slug, F.lit("/")))


def _cut(c: Column, most: int, least: float) -> Column:
    """Cut at the last blank beyond least, with an ellipsis."""
    head = F.substring(c, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    short = F.when((F.instr(head, " ") > 0) & (at > least), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(short, r"\s+$", ""), F.lit("…")))


def relevance(c: Column) -> Column:
    """C38."""
    return _cut(c, 60, 40)


def folded(c: Column) -> Column:
    """C39 for text in composed form: plain quotes and blanks."""
    return F.translate(c, "‘’‚′“”„″\u00a0", "''''\"\"\"\" ")


def capped(c: Column, most: int = 4000, marker: str = "\n[truncated]") -> Column:
    """The head, with a marker where something is missing."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def listed(fields: Column) -> Column:
    """An English list of what was merged; NULL for nothing to tell."""
    has = lambda *names: F.arrays_overlap(fields, F.array(*map(F.lit, names)))
    bits = F.filter(F.array(F.when(has("figure_ocr_md", "figure_structured_md"), "figures"), F.when(has("fulltext_excerpt_md"), "full text"), F.when(has("abstract"), "the abstract"), F.when(has("pdf_path"), "the filed PDF")), lambda x: x.isNotNull())
    n = F.size(bits)
    return F.when(n == 1, F.get(bits, F.lit(0))).when(n > 1, F.concat(F.array_join(F.slice(bits, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(bits, n - 1)))


def without_front_matter(c: Column) -> Column:
    """C43."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^---\r?\n.*?\r?\n---[ \t]*\r?\n?", ""), r"^\s+|\s+$", "")


def headline_size(c: Column) -> Column:
    """C46."""
    n = F.length(c)
    return F.when(n <= 46, 58).when(n <= 78, 50).when(n <= 118, 42).otherwise(36)


def _tag_content(html: Column, attribute: str, value: str) -> Column:
    tag = F.regexp_extract(html, rf"(?i)(<meta\b[^>]*\b{attribute}=[\"']{value}[\"'][^>]*>)", 1)
    return F.nullif(F.trim(F.regexp_extract(tag, r"(?i)\bcontent=[\"']([^\"']*)[\"']", 1)), F.lit(""))


def build_stamp(html: Column, name: str) -> Column:
    """The content of the build's meta tag."""
    return _tag_content(html, "name", name)


def image_url(html: Column) -> Column:
    """The shared image's address."""
    return _tag_content(html, "property", "og:image")


def deployed(html: Column, date: Column, stamp: Column, name: str) -> Column:
    """the page names the date's image and, if a stamp is expected, exactly that one."""
    expected = F.trim(F.coalesce(stamp, F.lit("")))
    return F.coalesce(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & html.contains(F.concat(F.lit("/og/"), date, F.lit(".png"))) & ((expected == "") | F.coalesce(build_stamp(html, name) == expected, F.lit(False))), F.lit(False))


def subline(n: Column, completion: Column, phrase: Column) -> Column:
    """The parts there are."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(DOT, F.concat(F.lit("n="), n.cast("string")), F.concat(F.lit("primary completion "), filled(completion)), filled(phrase))


def watching(n: Column) -> Column:
    """NULL for none."""
    return F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " trial").otherwise(" trials"), F.lit(" watching")))


def comparator(c: Column) -> Column:
    """Y02."""
    return F.coalesce(c.rlike(r"^\s*🔗"), F.lit(False))


def applies(c: Column) -> Column:
    """struct(yes, no): the text before and from the first `does not`; NULL if one is empty."""
    p = r"(?is)^([^\n]*?)(\bdoes\s+not\b.*)$"
    yes = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, p, 1), r"(?i)^\s*represents\s*", ""), r"[.;,\s]+$", ""))
    no = F.trim(F.regexp_extract(c, p, 2))
    return F.when((yes != "") & (no != ""), F.struct(yes.alias("yes"), no.alias("no")))


def endpoint_class(c: Column) -> Column:
    """Y06."""
    return F.when(c == "overall-survival", "hard").when(c == "local-control", "local control").when(c == "safety", "safety").otherwise("surrogate")


def long_words(c: Column) -> Column:
    """Distinct lower words of more than three characters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 3))


def word_overlap(a: Column, b: Column) -> Column:
    """Common words by the smaller set; 0 if one is empty."""
    x, y = long_words(a), long_words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def section(c: Column) -> Column:
    """By the leading sign."""
    sign = F.regexp_extract(c, r"^\s*(🔍|💊|📊|📐|⚠️|⚠)", 1)
    return F.when(sign.isin("🔍", "💊"), "methods").when(sign.isin("📊", "📐"), "results").when(sign != "", "critique").otherwise("notes")


def tag_free(c: Column, most: int) -> Column:
    """Without scripts, styles and tags, entities to blanks, single blanks, cut; empty is NULL."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, "&[A-Za-z#0-9]+;", " "), r"\s+", " ")), 1, most), F.lit(""))


def axis_mean(sums: Column, n: Column) -> Column:
    """A mean with one decimal, half up."""
    return F.floor(sums / n * 10 + 0.5) / 10
