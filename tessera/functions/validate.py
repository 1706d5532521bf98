"""Closed vocabularies, shapes of ids, and rows read from untrusted JSON. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed vocabularies.
MODALITIES = "radiation surgery systemic combined".split()
INTENTS = "curative palliative supportive".split()
METHODOLOGIES = "phase-3-rct phase-2-trial phase-1 retrospective meta-analysis real-world-evidence consensus-guideline".split()
FACETS = "primary-efficacy quality-of-life long-term-followup safety-toxicity subgroup-secondary translational health-economic".split()
MATURITIES = "conference-abstract full-publication".split()
CONTENT_TYPES = "study_report review".split()
VERDICTS = {
    "practice-changing": ("🚀", "Practice-changing", "#1a5e3a"),
    "challenges-soc": ("↔️", "Challenges SOC", "#9a5a1a"),
    "confirmatory": ("🔄", "Confirmatory", "#0a4b8a"),
    "early-signal": ("🧪", "Early signal", "#1a6a7a"),
    "methodologically-limited": ("⚠️", "Caveats dominate", "#8a3a1a"),
    "consensus": ("🧭", "Consensus", "#5a3a8a"),
    "unclear": ("❔", "Unclear", "#555"),
}
REVIEW_GLYPH, NO_GLYPH = "🗞️", "·"
SITES = {
    "cns": ("CNS", "🧠"),
    "head-neck": ("Head & Neck", "👄"),
    "thoracic": ("Thoracic / Lung", "🫁"),
    "breast": ("Breast", "🎀"),
    "upper-gi": ("GI Upper", "🍽️"),
    "hepatobiliary": ("Hepatobiliary", "🟡"),
    "lower-gi": ("GI Lower", "🌀"),
    "gyn": ("Gynecologic", "🌷"),
    "prostate": ("Prostate", "🌰"),
    "bladder": ("Bladder", "💧"),
    "kidney": ("Kidney", "🫘"),
    "gu-other": ("Germ Cell / Other GU", "♂️"),
    "skin": ("Skin / Melanoma", "🌞"),
    "sarcoma": ("Sarcoma", "🦴"),
    "leukemia": ("Leukemia", "🩸"),
    "lymphoma": ("Lymphoma", "🌐"),
    "myeloma": ("Myeloma / Plasma Cell", "🩹"),
    "oligo-mets": ("Oligometastatic / Mets", "🎯"),
    "supportive": ("Supportive / QoL", "🤝"),
    "safety": ("Safety / Regulatory", "⚠️"),
    "multi-site": ("Cross-cutting", "📊"),
    "other": ("Other", "📋"),
}
#: Offsets of the id ranges of papers and slides.
PAPER, SLIDE = 1_000_000_000, 2_000_000_000
CAPPED_VERDICTS, CAP = ["practice-changing", "challenges-soc", "confirmatory"], "early-signal"
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def one_of(c: Column, values: list[str]) -> Column:
    """Membership; NULL is no member."""
    return F.coalesce(c.isin(values), F.lit(False))


def enum(c: Column, values: list[str]) -> Column:
    """Trimmed and lower, if it is a member; else NULL."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(values), v)


def exact(c: Column, values: list[str]) -> Column:
    """The value itself if it is a member, never a near match."""
    return F.when(c.isin(values), c)


def content_type(c: Column) -> Column:
    """Blanks and hyphens to underscores; a study report unless another type is named."""
    v = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when(v.isin(CONTENT_TYPES), v).otherwise(CONTENT_TYPES[0])


def _looked_up(c: Column, values: dict, k: int) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for name, v in values.items() for x in (name, v[k]))), c)


def verdict_emoji(c: Column) -> Column:
    """P08."""
    return _looked_up(c, VERDICTS, 0)


def verdict_label(c: Column) -> Column:
    return _looked_up(c, VERDICTS, 1)


def verdict_color(c: Column) -> Column:
    """P09."""
    return _looked_up(c, VERDICTS, 2)


def rail_emoji(verdict: Column, kind: Column) -> Column:
    """P10: the verdict's emoji, else the review glyph, else a dot."""
    return F.coalesce(verdict_emoji(verdict), F.when(kind == "review", REVIEW_GLYPH), F.lit(NO_GLYPH))


def site_label(c: Column) -> Column:
    """`Other` for unknown sites."""
    return F.coalesce(_looked_up(c, SITES, 0), F.lit(SITES["other"][0]))


def site_emoji(c: Column) -> Column:
    return F.coalesce(_looked_up(c, SITES, 1), F.lit(SITES["other"][1]))


def compatible(current: Column, prior: Column) -> Column:
    """the same objective, or long follow-up that matures primary efficacy; unknown ones never are."""
    return F.coalesce((current == prior) | ((current == "long-term-followup") & (prior == "primary-efficacy")), F.lit(False))


def safe_slug(c: Column) -> Column:
    """F25."""
    return F.coalesce(c.rlike(SLUG), F.lit(False))


def study_slug(c: Column) -> Column:
    """a slug of at most 64 characters."""
    return safe_slug(c) & (F.length(c) <= 64)


def card_id(c: Column) -> Column:
    """`date#slug`."""
    return F.coalesce(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}#.+$"), F.lit(False))


def id_date(c: Column) -> Column:
    """P27."""
    return F.substring(c, 1, 10)


def composite(date: Column, slug: Column) -> Column:
    """P28."""
    return F.concat(date, F.lit("#"), slug)


def tag_path(c: Column) -> Column:
    """the tags of `a+b+c` if they are one to three safe ones, in order and different; else NULL."""
    parts = F.split(c, "[+]")
    ok = (F.size(parts) <= 3) & F.forall(parts, safe_slug) & (F.array_sort(F.array_distinct(parts)) == parts)
    return F.when(F.coalesce(ok, F.lit(False)), parts)


def canonical_tags(tags: Column, built: Column, single: Column) -> Column:
    """sorted and joined, if it is a valid single tag or a built intersection; else NULL."""
    name = F.array_join(F.array_sort(tags), "+")
    return F.when((F.size(tags) == 1) & F.array_contains(single, name), name).when((F.size(tags) > 1) & F.array_contains(built, name), name)


def tokens(c: Column) -> Column:
    """`ns:slug` tokens, lower; malformed ones are left out."""
    kept = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: (F.instr(t, ":") > 1) & (F.instr(t, ":") < F.length(t)))
    return F.transform(kept, F.lower)


def slugs(tokens_: Column) -> Column:
    """distinct slugs of tokens."""
    return F.array_distinct(F.transform(tokens_, lambda t: F.regexp_replace(t, "^[^:]*:", "")))


def matches(card: Column, wanted: Column) -> Column:
    """a card's slugs hold all wanted ones; nothing wanted: all match."""
    return F.size(F.array_except(wanted, card)) == 0


def clearable(active: Column, locked: Column) -> Column:
    """F05."""
    return F.size(F.array_except(active, locked)) > 0


def _pairs(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")


def url_tags(url: Column) -> Column:
    """distinct valid slugs of the address's `tag` parameters."""
    values = F.transform(F.filter(_pairs(url), lambda p: F.lower(F.substring_index(p, "=", 1)) == "tag"), lambda p: F.lower(F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")), F.lit("")))))
    return F.array_distinct(F.filter(values, safe_slug))


def without_parameters(url: Column, keys: list[str]) -> Column:
    """The address without these parameters."""
    kept = F.filter(_pairs(url), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(keys))
    return F.concat(F.regexp_extract(url, "^([^?#]*)", 1), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), F.regexp_extract(url, "(#.*)$", 1))


def with_tags(url: Column, tags: Column) -> Column:
    """The `tag` parameters replaced by these tags, sorted, at the end."""
    bare = without_parameters(url, ["tag"])
    added = F.array_join(F.transform(F.array_sort(tags), lambda t: F.concat(F.lit("tag="), t)), "&")
    page, fragment = F.regexp_extract(bare, "^([^#]*)", 1), F.regexp_extract(bare, "(#.*)$", 1)
    return F.concat(page, F.when(F.size(tags) > 0, F.concat(F.when(page.contains("?"), "&").otherwise("?"), added)).otherwise(""), fragment)


def paper_ref(id_: Column) -> Column:
    """The id in the papers' range; out of range: an error."""
    return F.when((id_ >= 0) & (id_ < PAPER), id_ + PAPER).otherwise(F.raise_error(F.lit("id outside the range of source references")).cast("long"))


def slide_ref(id_: Column) -> Column:
    """P19."""
    return F.when((id_ >= 0) & (id_ < PAPER), id_ + SLIDE).otherwise(F.raise_error(F.lit("id outside the range of source references")).cast("long"))


def source_ref(id_: Column) -> Column:
    """`type:id` of an id with its range."""
    return F.when(id_ >= SLIDE, F.concat(F.lit("slide:"), id_ - SLIDE)).when(id_ >= PAPER, F.concat(F.lit("paper:"), id_ - PAPER)).otherwise(F.concat(F.lit("tweet:"), id_))


def allowed_ids(c: Column) -> Column:
    """whole numbers of a comma list; a blank list is NULL, which is not the empty one."""
    numbers = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[+-]?[0-9]+$"))
    return F.when(F.trim(c) != "", F.array_distinct(F.transform(numbers, lambda x: x.cast("long"))))


def authorised(id_: Column, allowed: Column) -> Column:
    """no list allows all, an empty one none."""
    return F.when(allowed.isNull(), True).otherwise(F.coalesce(F.array_contains(allowed, id_), F.lit(False)))


def strings(json: Column) -> Column:
    """Trimmed non-blank strings of a JSON array; anything else: an empty list."""
    parsed = F.from_json(json, "array<string>")
    return F.coalesce(F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def seen_ids(json: Column) -> Column:
    """Distinct valid card ids of a JSON array; no JSON or no array is NULL, which is not the empty set."""
    parsed = F.from_json(json, "array<string>")
    return F.when(F.trim(json).startswith("[") & parsed.isNotNull(), F.array_distinct(F.filter(parsed, card_id)))


def questions(json: Column) -> Column:
    """At most five; none is NULL."""
    q = strings(json)
    return F.when(F.size(q) > 0, F.slice(q, 1, 5))


def discussed(json: Column) -> Column:
    """Names of 2 to 40 characters, the first of each spelling, at most eight."""
    names = F.filter(strings(json), lambda x: F.length(x).between(2, 40) & x.rlike("[A-Za-z0-9]"))
    low = F.transform(names, F.lower)
    return F.slice(F.filter(names, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, 8)


def significance(c: Column, least: int = 40, most: int = 900) -> Column:
    """Single blanks; NULL below least characters, cut at most."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) >= least, F.rtrim(F.substring(t, 1, most)))


def interpretation(c: Column, least: int = 600, most: int = 6000) -> Column:
    """Paragraphs with single blanks; NULL below least characters, cut at most."""
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    t = F.array_join(parts, "\n\n")
    return F.when(F.length(t) >= least, F.rtrim(F.substring(t, 1, most)))


def capped_verdict(verdict: Column, preprint: Column) -> Column:
    """Three strong verdicts of a preprint become an early signal."""
    return F.when(preprint & verdict.isin(CAPPED_VERDICTS), CAP).otherwise(verdict)


def consensus_verdict(methodology: Column, verdict: Column) -> Column:
    """A guideline's verdict is consensus, if it has one."""
    return F.when((methodology == "consensus-guideline") & verdict.isNotNull(), "consensus").otherwise(verdict)


def review_verdict(kind: Column, verdict: Column) -> Column:
    """Reviews have none."""
    return F.when(F.coalesce(kind != "review", F.lit(True)), verdict)


def unfenced(c: Column) -> Column:
    """A10: without the code fences around it."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*", ""), r"(?i)\s*```$", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def after_build(queued: Column, built: Column) -> Column:
    """queued after the build; an unknown build time counts as before."""
    return F.when(built.isNull() | F.isnan(built), True).otherwise(queued > built)


def outside_window(date: Column, today: Column) -> Column:
    """F16: before yesterday."""
    return date < F.date_sub(today.cast("date"), 1).cast("string")


def needs_rebuild(date: Column, today: Column, published: Column) -> Column:
    """F17."""
    return published | outside_window(date, today)


def content_depth(excerpt: Column, abstract: Column) -> Column:
    """C41."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(has(excerpt), "full text available").when(has(abstract), "abstract only").otherwise("no abstract or full text")
