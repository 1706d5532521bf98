"""Column builders for identifiers, URLs, HTML, numbers and text lines. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small words that don't count in titles.
STOP = "a an and the of in on for to with from by at as is are was vs versus or".split()


def slugify(c: Column, most: int = 64) -> Column:
    """C07 for text whose diacritics are already folded: lower, other signs to '-', trimmed, at most 64, else `study`."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), "-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "study").otherwise(s)


def endpoint_norm(c: Column) -> Column:
    """Lower, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def acronym_norm(c: Column) -> Column:
    """Trimmed, single blanks, upper."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def public_url(url: Column) -> Column:
    """C14: scheme, host and path; NULL unless http or https."""
    return F.when(F.lower(url).rlike("^https?://"), F.regexp_extract(url, "^([^?#]*)", 1))


def decoded(c: Column) -> Column:
    """The six entities, ampersand last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def html_title(html: Column) -> Column:
    return collapsed(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta(html: Column, name: str) -> Column:
    """A meta tag's content, name before content."""
    return F.nullif(decoded(F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)), F.lit(""))


def article_text(html: Column) -> Column:
    """T08 for pages of one article: its text without scripts, styles, navigation and tags."""
    body = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    return collapsed(decoded(F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style|nav|aside|footer)[^>]*>.*?</(script|style|nav|aside|footer)>", " "), "<[^>]*>", " ")))


def significant(c: Column) -> Column:
    """Distinct lower-case tokens of letters and digits that are no small words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP)))


def overlap(a: Column, b: Column) -> Column:
    """Common tokens by the size of the smaller set; 0 for an empty set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def numbers(c: Column) -> Column:
    """Distinct decimals and whole numbers of two digits or more."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([0-9]+\.[0-9]+|[0-9]{2,})"), F.lit(1)))


def line_keys(text: Column) -> Column:
    """Distinct non-empty lines, lower, single blanks, digits alike."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"[ \t]+", " ")), "[0-9]+", "#")), lambda x: x != ""))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
