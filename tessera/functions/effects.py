"""Numbers, statistics and their axes. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.sections import let

# Rungs of the axis, its least half width, the axis without data, and families by ordered patterns.
RUNGS = [1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0, 50.0, 100.0]
ROOM = 1.15
FAMILIES = [
    (r"(?i)\bmetastasis-?free\b|\bMFS\b", "mfs"),
    (r"(?i)\bdisease-?free\b|\bDFS\b", "dfs"),
    (r"(?i)\bevent-?free\b|\bEFS\b", "efs"),
    (r"(?i)\b(locoregional|loco-regional|local)\b.*\b(recurrence|failure|progression|control)\b", "local"),
    (r"(?i)\b(recurrence|relapse)\b", "recurrence"),
    (r"(?i)\bbiochemical\b", "biochemical"),
    (r"(?i)\bprogression-?free\b|\bPFS\b", "pfs"),
    (r"(?i)\boverall survival\b|\bOS\b", "os"),
    (r"(?i)\bcomplete response\b|\bpCR\b|\bresponse\b", "response"),
    (r"(?i)\btoxicity\b|\bgrade\s*[≥>]?\s*[0-9]|\blymphedema\b|\binduration\b|\bplaque\b", "toxicity"),
    (r"(?i)\bquality of life\b|\bqol\b|\bwell-?being\b|\bcomposite score\b|\bbreast-?q\b", "pro"),
]


def snapped(x: Column) -> Column:
    """The first rung that is at least x, else the next power of ten."""
    out = F.pow(F.lit(10.0), F.ceil(F.log10(x)))
    for rung in reversed(RUNGS):
        out = F.when(x <= rung, rung).otherwise(out)
    return out


def family(name: Column) -> Column:
    """The first family whose pattern the endpoint's name matches; `unknown` for none, `other` for a name without family."""
    n = F.trim(F.coalesce(name, F.lit("")))
    out = F.when(n == "", "unknown")
    for pattern, label in FAMILIES:
        out = out.when(n.rlike(pattern), label)
    return out.otherwise("other")


def bucket(name: Column, kind: Column) -> Column:
    """N18."""
    return F.concat(family(name), F.lit("::"), kind)


def half_width(point: Column) -> Column:
    """What one ratio asks of its axis, as a logarithm; NULL for what is no positive number."""
    return F.when(point.isNotNull() & ~F.isnan(point) & (point > 0) & (point < float("inf")), F.abs(F.log(point)))


def axis_end(widest: Column) -> Column:
    """The upper end of the axis for the widest half width; its lower end is 1 over it. No data: 4."""
    return F.when(widest.isNull(), F.lit(4.0)).otherwise(snapped(F.exp(F.greatest(widest, F.log(F.lit(2.0))) * ROOM)))


def on_axis(v: Column, lo: Column, hi: Column, width: Column) -> Column:
    """The place of v on a logarithmic axis, kept within it."""
    x = (F.log(v) - F.log(lo)) / (F.log(hi) - F.log(lo)) * width
    return F.least(width, F.greatest(F.lit(0.0), x))


def tick(v: Column) -> Column:
    """A tick's label."""
    one = F.when(v % 1 == 0, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v))
    return F.when(v >= 10, F.format_string("%.0f", F.floor(v + 0.5).cast("double"))).when(v >= 1, one).otherwise(F.regexp_replace(F.format_string("%.2f", v), "0$", ""))


def inset_span(lo: Column, hi: Column, cut_lo: Column, cut_hi: Column, chevron: Column) -> Column:
    """struct(left, right); inset at a cut end where the span is wide enough."""
    inset = F.when(hi - lo > chevron * 2, chevron).otherwise(0.0)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(F.when(cut_lo, lo + inset).otherwise(lo).alias("left"), F.when(cut_hi, hi - inset).otherwise(hi).alias("right")))


def bars(a: Column, b: Column, percent: Column, width: Column) -> Column:
    """struct(a, b, max): two values as bar lengths; percent scales end at 100 at least."""
    peak = F.greatest(a, b)
    top = F.when(percent, F.greatest(F.lit(100.0), peak)).when(peak == 0, 1.0).otherwise(peak * 1.05)
    w = lambda v: F.greatest(F.lit(0.0), F.least(width, v / top * width))
    return F.struct(w(a).alias("a"), w(b).alias("b"), top.alias("max"))


def described(kind: Column, point: Column, lo: Column, hi: Column, level: Column) -> Column:
    """N22 for ratios."""
    ends = F.concat(lo, F.lit(" to "), hi)
    return F.concat(kind, F.lit(" "), point, F.when(lo.isNull() | hi.isNull(), "").when(level.isNotNull(), F.concat(F.lit(", "), level, F.lit("% CI "), ends)).otherwise(F.concat(F.lit(", interval "), ends)))


def plain_numbers(c: Column) -> Column:
    """Mid dots to points, dashes to hyphens, commas of thousands dropped."""
    c = F.regexp_replace(F.regexp_replace(c, "[·•∙]", "."), "[−–—]", "-")
    return F.regexp_replace(c, r"([0-9]),(?=[0-9]{3}\b)", "$1")


def _number(raw: Column) -> Column:
    """A number as written without needless zeros."""
    return F.regexp_replace(F.regexp_replace(raw, r"^0+(?=[0-9])", ""), r"\.0*$|(\.[0-9]*[1-9])0+$", "$1")


def number_forms(c: Column) -> Column:
    """Distinct numbers as written, and with dashes read as points."""
    dashed = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?<![0-9.])([0-9]-[0-9]+)(?![0-9.])"), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit(".")))
    return let(plain_numbers(c), lambda t: F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), dashed(t))))


def number_values(c: Column) -> Column:
    """The same as values."""
    return F.array_distinct(F.transform(number_forms(c), _number))


def percents(c: Column) -> Column:
    """Distinct values before a percent sign."""
    return F.array_distinct(F.transform(F.regexp_extract_all(plain_numbers(c), F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1)), _number))


def traced_values(c: Column) -> Column:
    """Distinct percents and decimals, without commas."""
    found = F.regexp_extract_all(plain_numbers(c), F.lit(r"([0-9][0-9,]*\.?[0-9]*\s*%|(?<![0-9.])[0-9]+\.[0-9]+(?![0-9]))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[,\s]", "")))


def _known(source: Column) -> Column:
    """struct(values, raws): a source's numbers, found once for all claims."""
    return let(number_forms(source), lambda raws: F.struct(F.array_distinct(F.transform(raws, _number)).alias("values"), raws.alias("raws")))


def _split(marked: Column) -> Column:
    """struct(grounded, ungrounded) of an array of struct(hit, x)."""
    kept = lambda m, want: F.transform(F.filter(m, lambda y: y["hit"] if want else ~y["hit"]), lambda y: y["x"])
    return let(marked, lambda m: F.struct(kept(m, True).alias("grounded"), kept(m, False).alias("ungrounded")))


def grounded(claims: Column, source: Column) -> Column:
    """struct(grounded, ungrounded): claimed numbers by whether the source's text has them."""
    first = lambda p: _number(F.regexp_replace(F.regexp_extract(p, r"^(-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))", 1), r"^\.", "0."))
    hit = lambda k, x: let(plain_numbers(x), lambda p: F.array_contains(k["values"], first(p)) | F.array_contains(k["raws"], p))
    return _split(let(_known(source), lambda k: F.transform(claims, lambda x: let(F.trim(x), lambda t: F.struct(hit(k, t).alias("hit"), t.alias("x"))))))


def audited(text: Column, source: Column) -> Column:
    """As V10 for all numbers of a text; percents must be percents in a source that has any."""
    found = F.regexp_extract_all(plain_numbers(text), F.lit(r"([0-9]+(?:\.[0-9]+)?(?:\s*%)?)"), F.lit(1))
    raw = lambda x: F.regexp_extract(x, r"^([0-9.]+)", 1)
    plain = lambda k, x: F.array_contains(k["values"], _number(raw(x))) | F.array_contains(k["raws"], raw(x))
    hit = lambda k, shares, x: F.when(x.endswith("%") & (F.size(shares) > 0), F.array_contains(shares, _number(raw(x)))).otherwise(plain(k, x))
    marked = lambda k, shares: F.transform(found, lambda x: F.struct(hit(k, shares, x).alias("hit"), F.regexp_replace(x, r"\s", "").alias("x")))
    return _split(let(_known(source), lambda k: let(percents(source), lambda shares: marked(k, shares))))


def plain_stat(c: Column) -> Column:
    """Lower, single blanks, no punctuation at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), r"^[\s,;:]+|[\s.,;:]+$", ""))


def stat_atoms(c: Column) -> Column:
    """Ratios with their measure, percents, durations."""
    s = plain_stat(c)
    ratio = F.transform(F.regexp_extract_all(s, F.lit(r"(\b(?:a?hr|or|rr|irr)\s*[=:]?\s*[0-9]+\.?[0-9]*)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^([a-z]+)\s*[=:]?\s*", "$1 "))
    share = F.transform(F.regexp_extract_all(s, F.lit(r"([0-9]+\.?[0-9]*)\s*%"), F.lit(1)), lambda x: F.concat(x, F.lit("%")))
    span = F.transform(F.regexp_extract_all(s, F.lit(r"([0-9]+\.?[0-9]*\s*(?:months?|mo|yrs?|years?|wks?|weeks?)\b)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^([0-9.]+)\s*", "$1 "))
    return F.array_distinct(F.concat(ratio, share, span))


def same_stat(a: Column, b: Column) -> Column:
    """Whether two texts share an atom."""
    return F.coalesce(F.arrays_overlap(stat_atoms(a), stat_atoms(b)), F.lit(False))


def number_token(c: Column) -> Column:
    """Commas to points, a leading zero dropped."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit(","), F.lit(".")), r"^0(\.[0-9]+)$", "$1")


def number_pairs(c: Column) -> Column:
    """Distinct pairs of neighbouring numbers, the lesser first."""
    toks = F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)"), F.lit(1)), number_token)
    size = lambda x: F.concat(F.lit("0"), x).cast("double")
    pair = lambda x, y: F.when(size(x) <= size(y), F.concat(x, F.lit("~"), y)).otherwise(F.concat(y, F.lit("~"), x))
    return F.array_distinct(F.zip_with(F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), pair))


def clamped(x: Column) -> Column:
    """Within 0 and 1; what is no number is 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def followup_months(x: Column) -> Column:
    """0 to 600 with one decimal, half up; else NULL."""
    return F.when(~F.isnan(x) & (x >= 0) & (x <= 600), F.floor(x * 10 + 0.5) / 10)


def sparkline(counts: Column, width: float = 80.0, height: float = 10.0) -> Column:
    """The points of a line through counts, scaled by their maximum; none for fewer than two."""
    top = F.greatest(F.lit(1.0), F.array_max(counts).cast("double"))
    step = F.lit(width - 2) / (F.size(counts) - 1)
    point = lambda v, i: F.concat(F.format_string("%.2f", F.lit(1.0) + step * i), F.lit(","), F.format_string("%.2f", F.lit(height - 1) - v.cast("double") / top * (height - 2)))
    return F.when(F.size(counts) >= 2, F.array_join(F.transform(counts, point), " ")).otherwise("")
