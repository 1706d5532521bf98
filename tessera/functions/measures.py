"""Effect estimates read from short statistics: ratios with their interval, and pairs of values. JVM-side only.

Each reader gives one struct or NULL. NULL is a result: what can't be read without a guess isn't read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.sections import let

# What counts as blank, and the forms of a ratio, an interval, a pair, names of arms, and heads of tables.
WS = r"[\s\u000b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
RATIO = rf"(?i)(?<![A-Za-z])((?:adjusted{WS}+|sub-?|s|a)?(HR|OR|RR){WS}*[=:]?{WS}*{NUMBER})"
INTERVAL = rf"([0-9]{{2}}){WS}*%{WS}*CI[\s:]*\(?{WS}*{NUMBER}{WS}*(?:-|to){WS}*{NUMBER}{WS}*\)?"
BRACKET = rf"(?i)^(?:{WS}|[,;:])*\({WS}*{NUMBER}{WS}*(?:-|to){WS}*{NUMBER}{WS}*\)"
UNIT = "(%|mo|months?|pts?|Gy)?"
PAIR = rf"(?i){NUMBER}{WS}*{UNIT}{WS}+vs\.?{WS}+{NUMBER}{WS}*{UNIT}"
ARMS = rf"(?i)\(([^()]{{1,40}}?){WS}+vs\.?{WS}+([^()]{{1,40}}?)\)"
NEAR, TAIL = 12, 52
NOT_ARMS = r"(?i)\b(trial|study|cohort|subgroup|group|setting|site|entity|modality|technique|regimen|status|stage|population|line|histolog|menopaus|feature|failure|grade|morbidity|therapy)\b"
ARM = r"(?i)^\s*arm\s+[a-z0-9]|\b(control|placebo|observation|obs|soc|standard|no\s+\w+|usual care|sham)\b"
ACRONYM = r"^\s*[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*\s*(?:\(\s*n\s*=[^)]*\))?\s*$"
STATISTIC = r"(?i)^\s*(p|p-?value|hr|or|rr|95%\s*ci|hr\s*\(95%\s*ci\)|.*\bci\b.*)\s*[,)]?\s*$"
HORIZON = r"(?i)^[0-9]+\s*-?\s*(y|yr|yrs|year|years|mo|month|months|wk|week|weeks|d|day|days)$"
CELL = rf"(?i)^{WS}*{NUMBER}{WS}*(%|mo|months?)?{WS}*$"

RATIO_TYPE = "struct<kind:string,point:double,lo:double,hi:double,level:int>"
PAIR_TYPE = "struct<a:double,b:double,unit:string,label_a:string,label_b:string>"


def plain_ratio_text(c: Column) -> Column:
    """Points and hyphens for what journals print in their place."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[·∙]", "."), "[‒–—−]", "-")


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def _interval(text: Column, pattern: str, first: int, level: bool) -> Column:
    """struct(level, a, b) of the first match; NULL without one, or if an end isn't above 0."""
    a, b = (_group(text, pattern, first + i).try_cast("double") for i in (0, 1))
    of = _group(text, pattern, first - 1).try_cast("int") if level else F.lit(None).cast("int")
    return let(F.struct(of.alias("level"), a.alias("a"), b.alias("b")), lambda x: F.when((x["a"] > 0) & (x["b"] > 0), x))


def _sole(text: Column) -> Column:
    """The interval of a text that has exactly one."""
    return F.when(F.regexp_count(text, F.lit("(?i)" + INTERVAL)) == 1, _interval(text, "(?i)" + INTERVAL, 2, True))


def ratio(value: Column, detail: Column) -> Column:
    """Kind, point, lo, hi, level of the first ratio of value, else of detail.

    Its interval opens within NEAR characters behind it, or is the only one of the other text, else of its own. An unlabelled bracket counts only directly
    behind the ratio. A labelled interval that doesn't hold the point makes the whole NULL, an unlabelled one is no interval.
    """
    side = lambda own, other: F.struct(own.alias("own"), other.alias("other"), _group(own, RATIO, 1).alias("hit"))
    texts = F.struct(plain_ratio_text(value).alias("v"), plain_ratio_text(detail).alias("d"))
    # the detail is asked only where the value holds no ratio
    sides = let(texts, lambda t: let(side(t["v"], t["d"]), lambda x: F.when(x["hit"] != "", x).otherwise(side(t["d"], t["v"]))))
    return let(sides, lambda t: F.when(t["hit"] != "", _ratio(t["own"], t["other"], t["hit"]))).cast(RATIO_TYPE)


def _ratio(own: Column, other: Column, hit: Column) -> Column:
    """The ratio written as hit in own, with its interval."""
    kind, point = F.upper(_group(hit, "(?i)(HR|OR|RR)", 1)), _group(hit, NUMBER + "$", 1).try_cast("double")
    tail = F.substr(own, F.regexp_instr(own, F.lit(RATIO)) + F.length(hit), F.lit(TAIL))
    near = rf"(?is)^.{{0,{NEAR}}}?{INTERVAL}"
    beside = let(tail, lambda t: F.when(t.rlike(near), _interval(t, near, 2, True)).otherwise(_interval(t, BRACKET, 1, False)))
    ci = F.coalesce(beside, _sole(other), _sole(own))

    def made(x):
        point, ci = x["point"], x["ci"]
        fits = (ci["b"] >= ci["a"]) & (point >= ci["a"]) & (point <= ci["b"])
        below = hit.rlike("(?i)sub-?|^s") & ~hit.rlike(rf"(?i)^(adjusted|a){WS}*HR")
        name = F.when(x["kind"].isin("OR", "RR"), x["kind"]).when(below, "SHR").otherwise("HR")
        kept = lambda c: F.when(fits, c)
        found = F.struct(name.alias("kind"), point.alias("point"), kept(ci["a"]).alias("lo"), kept(ci["b"]).alias("hi"), kept(ci["level"]).alias("level"))
        return F.when((point > 0) & ~F.coalesce(ci["level"].isNotNull() & ~fits, F.lit(False)), found)

    return let(F.struct(kind.alias("kind"), point.alias("point"), ci.alias("ci")), made)


def unit_name(c: Column) -> Column:
    u = F.lower(c)
    return F.when(u == "%", "%").when(u.startswith("mo"), "mo").when(u.startswith("pt"), "pts").when(u == "gy", "Gy")


def pair(value: Column) -> Column:
    """A, b, unit and labels of "a vs b". NULL with another number of "vs" outside brackets, with values not reached, two units, or two zeros."""
    return let(plain_ratio_text(value), _pair).cast(PAIR_TYPE)


def _pair(v: Column) -> Column:
    value = lambda i: _group(v, PAIR, i).try_cast("double")
    unit = lambda i: let(_group(v, PAIR, i), unit_name)
    once = F.regexp_count(F.regexp_replace(v, r"\([^()]*\)", " "), F.lit(r"(?i)\bvs\.?\b")) == 1
    label = lambda i: let(F.trim(_group(v, ARMS, i)), lambda x: F.when(~x.rlike(r"^[0-9.,%\s]*$"), x))
    labels = let(F.struct(label(1).alias("a"), label(2).alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), x))

    def made(x):
        ok = ~((x["a"] == 0) & (x["b"] == 0)) & F.coalesce(x["ua"] == x["ub"], F.lit(True))
        named = lambda n: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.coalesce(x["ua"], x["ub"]).alias("unit"), n["a"].alias("label_a"), n["b"].alias("label_b"))
        return F.when(ok, let(labels, named))

    parts = F.struct(value(1).alias("a"), value(3).alias("b"), unit(2).alias("ua"), unit(4).alias("ub"))
    return F.when(v.rlike(PAIR) & once & ~v.rlike(r"(?i)\b(NR|not reached)\b"), let(parts, made))


def arm_columns(columns: Column) -> Column:
    """struct(a, b: places from 0, name_a, name_b) of the two columns of a table that are arms; NULL unless its heads say so.

    The first head is an endpoint, at most with a time; besides statistics two columns are left; none names another axis; one is called
    an arm or a control, or one has its n and not both are mere acronyms.
    """
    head = F.get(columns, F.lit(0))
    time = let(F.trim(_group(head, r"\(([^)]*)\)", 1)), lambda t: (t == "") | t.rlike(HORIZON))
    numbered = F.transform(columns, lambda c, i: F.struct(i.alias("i"), c.alias("c")))

    def arms(left):
        some = lambda pattern: F.exists(left, lambda x: x["c"].rlike(pattern))
        ok = (F.size(left) == 2) & ~some(NOT_ARMS) & ~head.rlike(NOT_ARMS)
        ok &= some(ARM) | (some(r"(?i)\(\s*n\s*=") & ~F.forall(left, lambda x: x["c"].rlike(ACRONYM)))
        one, two = F.get(left, F.lit(0)), F.get(left, F.lit(1))
        return F.when(ok, F.struct(one["i"].alias("a"), two["i"].alias("b"), one["c"].alias("name_a"), two["c"].alias("name_b")))

    return F.when((F.size(columns) >= 3) & head.rlike(r"(?i)^\s*endpoint\b") & time, let(F.filter(F.slice(numbered, 2, 10**6), lambda x: ~x["c"].rlike(STATISTIC)), arms))


def _label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), rf"{WS}+", " "))


def names_endpoint(label: Column, endpoint: Column) -> Column:
    """Equal but for case and blanks; or the shorter, of at least five characters, stands in the longer between word limits."""
    return let(_label(endpoint), lambda want: let(_label(label), lambda row: _names(row, want)))


def _names(row: Column, want: Column) -> Column:
    def inside(x):
        # the pattern differs from row to row: it is made only where the text itself is there
        plain = F.replace(x["short"], F.lit(r"\E"), F.lit(""))
        return (F.length(x["short"]) >= 5) & F.contains(x["long"], plain) & F.regexp_like(x["long"], F.concat(F.lit(r"(^|\W)\Q"), plain, F.lit(r"\E(\W|$)")))

    swap = F.length(want) <= F.length(row)
    sides = F.struct(F.when(swap, want).otherwise(row).alias("short"), F.when(swap, row).otherwise(want).alias("long"))
    return F.coalesce((row != "") & (want != "") & ((row == want) | let(sides, inside)), F.lit(False))


def pair_of_table(columns: Column, rows: Column, endpoint: Column) -> Column:
    """A, b, unit, labels from the first row of the endpoint whose cells in both arms are plain numbers."""
    return let(arm_columns(columns), lambda arms: F.when(arms.isNotNull(), let(_label(endpoint), lambda want: _pair_of_rows(arms, rows, want)))).cast(PAIR_TYPE)


def _pair_of_rows(arms: Column, rows: Column, want: Column) -> Column:
    value = lambda c: _group(c, CELL, 1).try_cast("double")
    cells = lambda r: F.struct(F.get(r, arms["a"]).alias("a"), F.get(r, arms["b"]).alias("b"))

    def plain(c):
        """A cell's text where it is a mere number."""
        return let(plain_ratio_text(c), lambda t: F.when(t.rlike(CELL) & ~t.rlike(RATIO) & ~c.rlike("(?i)" + INTERVAL), t))

    def numbers(c):
        both = F.struct(plain(c["a"]).alias("a"), plain(c["b"]).alias("b"))
        return let(both, lambda x: x["a"].isNotNull() & x["b"].isNotNull() & ((value(x["a"]) > 0) | (value(x["b"]) > 0)))

    fits = lambda r: F.coalesce(let(_label(F.get(r, F.lit(0))), lambda row: _names(row, want)) & let(cells(r), numbers), F.lit(False))

    def made(c):
        unit = lambda x: let(_group(x, CELL, 2), unit_name)
        return F.struct(value(c["a"]).alias("a"), value(c["b"]).alias("b"), F.coalesce(unit(c["a"]), unit(c["b"])).alias("unit"), arms["name_a"].alias("label_a"), arms["name_b"].alias("label_b"))

    row = F.get(F.filter(rows, fits), F.lit(0))
    return let(row, lambda r: F.when(r.isNotNull(), let(F.struct(plain_ratio_text(F.get(r, arms["a"])).alias("a"), plain_ratio_text(F.get(r, arms["b"])).alias("b")), made)))


def effect(value: Column, detail: Column, endpoint: Column, tables: Column) -> Column:
    """struct(form, ratio, pair): a ratio, else a pair of values, else the first of tables (columns, rows) that gives a pair; NULL for none."""
    t = F.get(F.filter(F.transform(tables, lambda x: pair_of_table(x["columns"], x["rows"], endpoint)), lambda x: x.isNotNull()), F.lit(0))
    none = lambda of: F.lit(None).cast(of)
    made = lambda form, a, b: F.struct(F.lit(form).alias("form"), a.alias("ratio"), b.alias("pair"))
    table = let(t, lambda x: F.when(x.isNotNull(), made("table", none(RATIO_TYPE), x)))
    paired = let(pair(value), lambda x: F.when(x.isNotNull(), made("paired", none(RATIO_TYPE), x)).otherwise(table))
    return let(ratio(value, detail), lambda x: F.when(x.isNotNull(), made("ratio", x, none(PAIR_TYPE))).otherwise(paired))
