"""Sections of a long text: its lines as headings, blocks between them, and a budgeted excerpt. JVM-side only.

All functions take one text's column and work inside the row, so a corpus is never shuffled for them. Arrays that grow in a fold hold what a budget
lets in; everything else is one pass over the lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that publishers stamp on proofs, and terms that are never taken for pieces of them.
STAMPS = "ACCEPTED MANUSCRIPT UNCORRECTED PROOF DRAFT CONFIDENTIAL EMBARGOED PROVISIONAL PREPRINT RETRACTED".split()
TERMS = (
    "OS PFS DFS EFS MFS RFS DMFS TTP ORR DCR PCR CR PR SD PD HR OR RR SHR CI SE IQR ITT PP AE SAE QOL RT CT MRI PET SBRT SABR IMRT EBRT VMAT IGRT ADT TACE TARE "
    "RFA MWA LDLT LT NCT PMID DOI HCC AJCC BCLC ECOG PS GTV CTV PTV ITV IGTV OAR DSC MDA HD AFP PSA IVC LN MVI NA NR NS NE NC ND"
).split()
FRAGMENT, REPEATS = "^[A-Z]{1,4}[0-9]{0,3}$", 5
#: Slices of two to four letters of the stamps.
PIECES = sorted({w[i : i + n] for w in STAMPS for n in (2, 3, 4) for i in range(len(w) - n + 1)})

# Heads of sections by kind, captions, and lines that only look like heads.
HEADS = [
    ("references", r"(?i)^(references|bibliography|literature cited)\b"),
    ("disclosures", r"(?i)^(conflicts? of interest|competing interests?|(authors'? )?disclosures?|funding|financial support|support|acknowledge?ments?|data (availability|sharing)|data supplement|study protocol|author contributions?|corresponding author|prior presentation|article information|authors info|equal contribution|accompanying content|reprints?|ethics (statement|approval))\b"),
    ("abstract", r"(?i)^(abstract|summary|graphical abstract)\b"),
    ("intro", r"(?i)^(introduction|background)\b"),
    ("methods", r"(?i)^(methods?|materials and methods|patients and methods|methodology|study design)\b"),
    ("results", r"(?i)^(results?|findings)\b"),
    ("discussion", r"(?i)^(discussion|conclusions?|interpretation|comment)\b"),
]
CAPTIONS = [
    ("table", r"(?i)^(?:supplementary|supplemental|appendix)?\s*table\s+[0-9]+(?:\.[0-9]+)*[a-z]?\s*(?:[.:–—-]|\(continued\)|$)"),
    ("figure", r"(?i)^(?:supplementary|supplemental|appendix)?\s*fig(?:ure|\.)?\s*[0-9]+(?:\.[0-9]+)*[a-z]?\s*(?:[.:–—-]|\(continued\)|$)"),
]
CAPS = r"^[A-Z][A-Z0-9 ,&/’'()-]*[A-Z0-9)]$"
CHROME = (
    r"(?i)^(follow us|subscribe|sign in|share|cite this|related articles?|recommended articles?)\b|^(asco|nejm|jama|elsevier|springer|wiley|lancet)\b"
    r"|^(original reports?|original article|review article|editorial|commentary|letters?)\b"
    r"|^(january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{4}$|^[A-Z][A-Z0-9-]{1,9}\s+[0-9]+(\s*\([0-9]+\))?$"
)
CAPTION_CHARS, BARE_CAPTION_CHARS, HEAD_CHARS, BARE_HEAD_CHARS, HEAD_WORDS = 300, 24, 90, 60, 6
DROPPED = ("front", "references", "disclosures")
FRONT_SHARE, SHORT_DOCUMENT = 0.25, 15_000
# The order in which a budget is spent, and its bounds.
FILL = ("table", "figure", "results", "body", "methods", "discussion", "intro", "abstract")
EXCERPT, LEAST_SECTION, TABLES_MOST, TABLES_LEAST, LEAST_EXCERPT = 40_000, 600, 0.6, 0.3, 12_000
CUT_MARK, CUT_FROM = "…[section truncated]", 0.6

SEGMENT = "struct<kind:string,heading:string,text:string,start:int>"
_BLANK = r"[\s\u000b   ﻿]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def _words(c: Column) -> Column:
    return F.split(c, r"\s+")


def without_stamps(text: Column) -> Column:
    """The text without lines that are pieces of a stamp and stand alone on REPEATS lines or more. Terms stay."""
    return F.array_join(_unstamped(F.split(text, "\n")), "\n")


def _unstamped(lines: Column) -> Column:
    piece = lambda s: s.rlike(FRAGMENT) & ~s.isin(TERMS) & F.regexp_replace(s, "[0-9]+$", "").isin(PIECES)
    often = lambda found: F.filter(F.array_distinct(found), lambda s: F.size(F.filter(found, lambda x: x == s)) >= REPEATS)
    # what is a piece is found once, in the lines without their blanks
    return let(lines, lambda rows: let(let(F.filter(F.transform(rows, trimmed), piece), often), lambda gone: F.when(F.size(gone) == 0, rows).otherwise(F.filter(rows, lambda x: ~F.array_contains(gone, trimmed(x))))))


def _label(bare: Column) -> Column:
    """Whether a head is a label rather than the start of a sentence."""
    words = _words(trimmed(bare))
    return (trimmed(bare) != "") & (bare.rlike(r"[:.]\s*$") | (F.size(words) <= 2) | ~bare.rlike("[a-z]") | F.forall(words, lambda w: (F.length(w) < 4) | w.rlike("^[^a-z]")))


def heading(line: Column) -> Column:
    """The kind of section that a line opens; NULL for a line of text."""
    return let(trimmed(line), _heading)


def _heading(s: Column) -> Column:
    n = F.length(s)
    bare = F.regexp_replace(F.regexp_replace(s, r"^[0-9]+(\.[0-9]+)*[.)]?\s*", ""), r"[:.]\s*$", "")
    out = F.when((s == "") | s.rlike("@|://"), F.lit(None).cast("string"))
    for kind, pattern in CAPTIONS:
        hit = F.regexp_extract(s, pattern, 0)
        out = out.when((n <= CAPTION_CHARS) & (hit != "") & (hit.rlike(r"[.:–—-]\s*$") | (n <= BARE_CAPTION_CHARS)), kind)
    return out.when(n <= HEAD_CHARS, let(bare, lambda b: _named(s, b)))


def _named(s: Column, bare: Column) -> Column:
    words = F.size(_words(bare))
    out = F.when(F.length(bare) > BARE_HEAD_CHARS, F.lit(None).cast("string"))
    for kind, pattern in HEADS:
        ok = words <= HEAD_WORDS
        out = out.when(bare.rlike(pattern), F.when(ok & _label(bare) if kind in (*DROPPED, "abstract") else ok, kind))
    shouted = bare.rlike(CAPS) & bare.rlike("[A-Z]{3}") & words.between(2, HEAD_WORDS) & ~s.endswith(".") & ~bare.rlike(CHROME)
    return out.when(shouted, "body")


def segments(text: Column) -> Column:
    """Kind, heading, text, start of each section that has text. What stands before the first head is `front`, or `body` where it is too much of the whole to be a title page."""
    return let(_unstamped(F.split(F.coalesce(text, F.lit("")), "\n")), lambda lines: let(_blocks(lines), _relabelled)).cast(f"array<{SEGMENT}>")


def _blocks(lines: Column) -> Column:
    """kind, heading, text, start of what stands between heads, empty ones too."""
    marked = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"), heading(x).alias("kind"))), lambda m: m["kind"].isNotNull())
    front = F.struct(F.lit(None).cast("string").alias("x"), F.lit(-1).alias("i"), F.lit("front").alias("kind"))
    bounds = lambda heads: F.zip_with(F.concat(F.array(front), heads), F.concat(F.transform(heads, lambda h: h["i"]), F.array(F.size(lines))), lambda h, end: F.struct(h.alias("h"), F.slice(lines, h["i"] + 2, end - h["i"] - 1).alias("own")))
    return let(let(marked, bounds), lambda every: F.zip_with(every, _starts(every), _block))


def _starts(every: Column) -> Column:
    """Where each block starts; a block's length is with its head, each line with its break."""
    size = lambda b: F.coalesce(F.length(b["h"]["x"]) + 1, F.lit(0)) + F.aggregate(b["own"], F.lit(0), lambda a, x: a + F.length(x) + 1)
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("a"))
    return F.aggregate(F.transform(every, size), none, lambda s, x: F.struct((s["n"] + x).alias("n"), F.concat(s["a"], F.array(s["n"])).alias("a")), lambda s: s["a"])


def _block(b: Column, at: Column) -> Column:
    kind, head = b["h"]["kind"], trimmed(b["h"]["x"])
    # a caption is part of its block, another head is not
    own = F.when(kind.isin("table", "figure"), F.concat(F.array(head), b["own"])).otherwise(b["own"])
    return F.struct(kind.alias("kind"), head.alias("heading"), trimmed(F.array_join(own, "\n")).alias("text"), at.alias("start"))


def _relabelled(every: Column) -> Column:
    total = F.aggregate(every, F.lit(0), lambda a, s: a + F.length(s["text"]))
    article = lambda s, n: (s["kind"] == "front") & ((n < SHORT_DOCUMENT) | (F.length(s["text"]) > n * FRONT_SHARE))
    named = lambda n: F.transform(F.filter(every, lambda s: s["text"] != ""), lambda s: F.struct(F.when(article(s, n), "body").otherwise(s["kind"]).alias("kind"), s["heading"].alias("heading"), s["text"].alias("text"), s["start"].alias("start")))
    return let(total, named)


def _end(text: Column, what: str) -> Column:
    """Characters before the last occurrence; -1 without one."""
    at = F.instr(F.reverse(text), what[::-1])
    return F.when(at > 0, F.length(text) - at - len(what) + 1).otherwise(-1)


def cut(text: Column, limit: Column) -> Column:
    """At most limit characters, with a mark: cut at a paragraph, a line, a sentence if one ends beyond CUT_FROM of the limit, else anywhere."""
    head = F.substr(text, F.lit(1), F.greatest(F.lit(0), limit - len(CUT_MARK) - 1))
    end = lambda c: F.regexp_replace(c, rf"{_BLANK}+$", "")
    mark = F.lit(CUT_MARK)

    def shorter(head):
        upto = lambda n: F.substr(head, F.lit(1), n)
        para, line, stop = _end(head, "\n\n"), _end(head, "\n"), _end(head, ". ")
        far = lambda at: at >= limit * CUT_FROM
        out = F.when(far(para), F.concat(end(upto(para)), F.lit("\n\n"), mark)).when(far(line), F.concat(end(upto(line)), F.lit("\n"), mark))
        return out.when(far(stop), F.concat(upto(stop + 1), F.lit(" "), mark)).otherwise(F.concat(end(head), F.lit(" "), mark))

    return F.when(F.length(text) <= limit, text).otherwise(let(head, shorter))


def _value(line: Column) -> Column:
    """Whether a line holds a cell's value and no word."""
    s = trimmed(line)
    return s.rlike("(?i)^n/?a$") | (~s.rlike("[A-Za-z]") & s.rlike("[0-9]"))


def detached(text: Column) -> Column:
    """Why a table's values can't be tied to its rows; NULL where they can.

    Values that stand alone, farther in than the labels, while labels have none beside them; or, without such, two and more lines of mere values in a row.
    """
    caption = lambda x: trimmed(x).rlike(CAPTIONS[0][1]) | trimmed(x).rlike(CAPTIONS[1][1])
    row = lambda x: F.struct(x.alias("x"), _indent(x).alias("in"), _value(x).alias("value"), caption(x).alias("caption"))
    rows = F.transform(F.filter(F.split(text, "\n"), lambda x: trimmed(x) != ""), row)
    left = lambda rows: F.array_min(F.transform(rows, lambda r: r["in"]))
    return let(rows, lambda every: let(left(every), lambda n: let(F.filter(every, lambda r: ~r["caption"]), lambda some: _apart(some, n))))


def _indent(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, rf"^{_BLANK}+", ""))


def _apart(rows: Column, left: Column) -> Column:
    orphan = lambda r: r["value"] & (r["in"] > left + 2)
    cells = lambda x: F.slice(F.split(F.substr(x, left + 1), r"\s{2,}"), 2, 10**6)
    needy = F.size(F.filter(rows, lambda r: ~orphan(r) & (r["in"] <= left + 2) & ~F.exists(cells(r["x"]), _value)))
    longer = lambda s, r: F.when(r["value"], s["run"] + 1).otherwise(0)
    step = lambda s, r: F.struct(longer(s, r).alias("run"), F.greatest(s["most"], longer(s, r)).alias("most"))
    run = F.aggregate(rows, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda s: s["most"])
    lone = lambda n: F.when(n >= 2, F.concat(F.lit("row association uncertain: "), n, F.lit(" consecutive value-only lines with no row label between them, so the values cannot be tied to rows")))
    both = lambda n, k: F.when(n > 0, F.concat(F.lit("row association uncertain: "), n, F.lit(" row label(s) carry no value on their own line and "), k, F.lit(" value(s) are detached from their rows")))
    return let(F.size(F.filter(rows, orphan)), lambda k: F.when(k == 0, let(run, lone)).otherwise(let(needy, lambda n: both(n, k))))


def _name(s: Column) -> Column:
    return F.coalesce(F.regexp_replace(s["heading"], r"\s*[:.]\s*$", ""), F.concat(F.upper(F.substring(s["kind"], 1, 1)), F.substring(s["kind"], 2, 20)))


KEPT = "struct<i:int,kind:string,heading:string,chars:int,truncated:boolean,note:string,chunk:string,start:int>"


def excerpt(text: Column, most: int = EXCERPT, with_abstract: bool = False) -> Column:
    """Text, kept (kind, heading, chars, truncated, note, ... in order of filling), dropped (kinds), fell_back.

    Sections are tried in FILL's order: tables and figures up to TABLES_MOST of the budget, then text up to what leaves them TABLES_LEAST of the
    whole, then tables and figures again with what is left. One that gets less than LEAST_SECTION characters is left out. Without any section the text's head is taken.
    """
    out = DROPPED if with_abstract else (*DROPPED, "abstract")
    return let(F.coalesce(text, F.lit("")), lambda source: let(segments(source), lambda found: let(_filled(found, most, out), lambda kept: _composed(source, found, kept, most, out))))


def _grid(s: Column) -> Column:
    return s["kind"].isin("table", "figure")


def _filled(found: Column, most: int, out: tuple[str, ...]) -> Column:
    """The sections that a budget lets in, in order of filling."""
    place = F.create_map(*(F.lit(x) for i, k in enumerate(FILL) for x in (k, i)))
    # pass 0: tables; 1: an abstract, beyond the bound of text; 2: text; 3: tables again
    turn = lambda s, k: F.struct(k.alias("turn"), F.try_element_at(place, s["kind"]).alias("order"), s["start"].alias("at"), s.alias("s"))
    passes = lambda s: F.when(_grid(s), F.array(F.lit(0), F.lit(3))).when(s["kind"] == "abstract", F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    tries = F.flatten(F.transform(F.filter(found, lambda s: ~s["kind"].isin(*out)), lambda s: F.transform(passes(s), lambda k: turn(s, k))))
    nothing = F.struct(F.lit(0).alias("spent"), F.lit(0).alias("tables"), F.array().cast(f"array<{KEPT}>").alias("kept"))
    return F.aggregate(F.array_sort(tries), nothing, lambda state, x: _tried(state, x, most), lambda s: s["kept"])


def _tried(state: Column, x: Column, most: int) -> Column:
    """The state (spent, tables: what they took in pass 0, kept) after one section."""
    prose = F.when(state["tables"] > 0, F.least(F.lit(most), F.greatest(F.lit(LEAST_EXCERPT), F.floor(state["tables"] / TABLES_LEAST + 0.5).cast("int")))).otherwise(most)
    ceiling = F.when(x["turn"] == 0, int(most * TABLES_MOST + 0.5)).when(x["turn"] == 2, prose).otherwise(most)

    def with_head(head):
        return let(F.least(ceiling, F.lit(most)) - state["spent"] - F.length(head), lambda budget: F.when((budget < LEAST_SECTION) | F.exists(state["kept"], lambda k: k["start"] == x["at"]), state).otherwise(let(_noted(x["s"]), lambda f: let(cut(f["full"], budget), lambda body: with_body(head, f, body)))))

    def with_body(head, f, body):
        one = F.struct(F.size(state["kept"]).alias("i"), x["s"]["kind"].alias("kind"), x["s"]["heading"].alias("heading"), F.length(body).alias("chars"), (F.length(body) < F.length(f["full"])).alias("truncated"), f["note"].alias("note"), F.concat(head, body).alias("chunk"), x["at"].alias("start")).cast(KEPT)
        spent = state["spent"] + F.length(head) + F.length(body) + 2
        grown = F.struct(spent.alias("spent"), F.when(x["turn"] == 0, spent).otherwise(state["tables"]).alias("tables"), F.concat(state["kept"], F.array(one)).alias("kept"))
        return F.when(F.length(body) < F.least(F.lit(LEAST_SECTION), F.length(f["full"])), state).otherwise(grown)

    return let(F.concat(F.lit("## "), _name(x["s"]), F.lit("\n")), with_head)


def _noted(s: Column) -> Column:
    """struct(full, note): the text with marks of ours broken, and with a note before a table whose values are detached."""
    plain = F.regexp_replace(F.regexp_replace(s["text"], "(?m)^## ", "#\u200b# "), r"\[(?=row association)", "[\u200b")
    marked = lambda full, note: F.struct(F.when(note.isNotNull(), F.concat(F.lit("["), note, F.lit("]\n"), full)).otherwise(full).alias("full"), note.alias("note"))
    return let(plain, lambda full: let(F.when(s["kind"] == "table", detached(full)), lambda note: marked(full, note)))


def _composed(source: Column, found: Column, kept: Column, most: int, out: tuple[str, ...]) -> Column:
    dropped = F.array_distinct(F.transform(F.filter(found, lambda s: s["kind"].isin(*out)), lambda s: s["kind"]))
    ordered = F.array_sort(F.transform(kept, lambda k: F.struct((~_grid(k)).alias("prose"), k["start"].alias("start"), k["chunk"].alias("chunk"))))
    whole = trimmed(F.array_join(F.transform(ordered, lambda k: k["chunk"]), "\n\n"))
    lone = F.get(kept, F.lit(0))
    none = F.array().cast(f"array<{KEPT}>")

    def made(gone, failed):
        return F.struct(F.when(failed, F.substring(source, 1, most)).otherwise(whole).alias("text"), F.when(failed, none).otherwise(kept).alias("kept"), F.when(failed, F.array().cast("array<string>")).otherwise(gone).alias("dropped"), failed.alias("fell_back"))

    # one block without a head and nothing dropped: no section was found
    failed = lambda gone: (trimmed(source) == "") | (F.size(kept) == 0) | ((F.size(kept) == 1) & (lone["kind"] == "body") & lone["heading"].isNull() & (F.size(gone) == 0))
    return let(dropped, lambda gone: let(failed(gone), lambda f: made(gone, f)))
