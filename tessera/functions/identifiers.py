"""Identifiers and addresses in text: DOIs, registrations, article ids, hosts, acronym keys. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.sections import let

# Patterns and lists that decide which identifiers are found.
DOI_CORE = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
DOI_TAIL = r"(?i)(?:/(?:full|fulltext|abstract|pdf|epdf|html|meta|references|citations))+/?$"
NCT = r"(?i)\bNCT[0-9]{8}\b"
PMID = r"(?i)\b(?:PMID|PubMed)[:\s]\s*([0-9]{4,9})\b"
DOI_CITED = r"(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)(10\.[0-9]{4,}/[^\s\"<>)]+)"
PMID_URL = r"(?i)https?://(?:www\.)?pubmed\.ncbi\.nlm\.nih\.gov/([0-9]+)(?:/|\b)"
PMID_NOTE = r"(?i)\bPMID\s*[:.]?\s*([0-9]+)"
PMC_URL = r"(?i)https?://(?:(?:www\.)?ncbi\.nlm\.nih\.gov/pmc|pmc\.ncbi\.nlm\.nih\.gov)/articles/(PMC[0-9]+)"
DOI_URL = r"(?i)https?://(?:dx\.)?doi\.org/(10\.[0-9]{4,9}/[-._;()/:a-z0-9]+)"
JOURNALS = "thelancet nejm jamanetwork annals nature sciencedirect springer wiley onlinelibrary.wiley academic.oup ascopubs aacrjournals bmj cell medrxiv biorxiv researchsquare tandfonline karger frontiersin mdpi journals.lww ahajournals atsjournals ersjournals jto redjournal practicalradonc".split()
JOURNAL_URL = r"(?i)https?://(?:www\.)?(?:" + "|".join(j.replace(".", r"\.") for j in JOURNALS) + r")\.(?:org|com|net)\b"
NOT_PAPERS = r"(?i)https?://(?:www\.)?(?:twitter|x|t\.co|youtube|youtu\.be|google|bit\.ly)\.[a-z]+"
OUTLETS = {
    "ascopost.com": "The ASCO Post",
    "urotoday.com": "UroToday",
    "onclive.com": "OncLive",
    "targetedonc.com": "Targeted Oncology",
    "cancernetwork.com": "Cancer Network",
    "healio.com": "Healio",
    "medpagetoday.com": "MedPage Today",
    "oncodaily.com": "OncoDaily",
    "dailynews.ascopubs.org": "ASCO Daily News",
}
TRACKING = r"(?i)^(?:utm_|fbclid$|gclid$|mc_(?:cid|eid)$|igshid$|_hs(?:enc|mi)$|ref(?:_src)?$)"
PREPRINT_DOIS = ["10.1101", "10.21203"]
PREPRINT_HOSTS = r"(^|\.)(medrxiv\.org|biorxiv\.org|researchsquare\.com)$"
PREPRINT_NAMES = r"(?i)\b(?:medrxiv|biorxiv|research\s*square)\b"
IMAGE_HOSTS = ["pbs.twimg.com"]
LONGEST_URL = 2048
# Names that are endpoints, genes, statistics, groups or societies, not trials.
NOT_TRIALS = (
    "OS PFS DFS MFS BFS BFFS BPFS CFFS CPFS EFS ORR CR PR SD DOR DCR DCB TTR TTP HR OR RR CI CIF KM NS RT CT PET CT-PET MRI BCS BCT WBI PBI APBI "
    "SBRT EBRT IMRT VMAT IGRT WPRT SRT ADT ARSI IO TKI PARP CDK CAR-T BTK HER2 ER PD-L1 TMB MSI BRCA TP53 EGFR ALK ROS1 TROP2 PSMA CTLA-4 PD-1 "
    "AE SAE TRAE PD NCT PMID DOI PMC NSCLC CRC HCC mCRPC mUC BCM ITT PP PPS FAS mITT ECOG KPS AJCC TNM YR MO WK FX FFS"
).split()
NOT_TRIAL_PATTERN = r"^(?:(?:FIGO|PHASE|GRADE|WHO|ECOG|RECIST|ASA|NYHA|BCLC|ISUP|AJCC|TNM|KPS)[0-9]+|COVID-?19)$"
GROUPS = "EORTC NRG RTOG DBCG ANZUP SWOG GETUG NSABP GOG CALGB ALLIANCE NCIC CCTG TROG MRC BOOG IBCSG BIG SAKK JCOG KROG RADCOMP NCCTG SWENOTECA CTG".split()
SOCIETIES = "ARS ASTRO ASCO ESMO AACR ASH SABCS NCCN EAU ESTRO GUCS GICS ESGO SGO AUA RSNA".split()
ACRONYM = r"\b[A-Z][A-Z0-9]{2,}(?:-[A-Z0-9]+)*\b"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match; NULL if none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _first_spellings(values: Column, key) -> Column:
    """values without those whose key an earlier one has."""
    return let(values, lambda v: let(F.transform(v, key), lambda keys: F.filter(v, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def doi(c: Column) -> Column:
    """The first DOI anywhere, %2F undone, publishers' path tails and end punctuation dropped, lower; NULL if none."""
    core = _found(F.regexp_replace(F.trim(c), "(?i)%2F", "/"), f"({DOI_CORE})")
    return F.regexp_replace(F.lower(F.regexp_replace(core, DOI_TAIL, "")), r"[.,;)\]]+$", "")


def bare_doi(c: Column) -> Column:
    """Whether the trimmed text is one DOI and nothing else."""
    return F.coalesce(F.trim(c).rlike(f"^{DOI_CORE}$"), F.lit(False))


def dois(c: Column) -> Column:
    """Distinct normalised DOIs in order."""
    return F.array_distinct(F.filter(F.transform(_all(c, f"({DOI_CORE})"), doi), lambda x: x.isNotNull()))


def cited_dois(c: Column) -> Column:
    return _first_spellings(_all(c, DOI_CITED), F.lower)


def citations(c: Column) -> Column:
    """`kind:id` of registrations, then article ids, then DOIs, each kind distinct and in order."""
    named = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(f"{kind}:"), x))
    ncts = F.array_distinct(F.transform(_all(c, NCT, 0), F.upper))
    return F.concat(named("nct", ncts), named("pubmed", F.array_distinct(_all(c, PMID))), named("doi", cited_dois(c)))


def linked(c: Column) -> Column:
    """The text escaped, with citations as anchors; the first of overlapping ones wins."""
    mark = "\x01"
    pattern = r"(?i)\bNCT[0-9]{8}\b|\b(?:PMID|PubMed)[:\s]\s*[0-9]{4,9}\b|(?:doi:\s*|https?://(?:dx\.)?doi\.org/)10\.[0-9]{4,}/[^\s\"<>)]+"
    parts = F.split(F.regexp_replace(F.translate(c, mark, ""), f"({pattern})", f"{mark}$1{mark}"), mark)
    anchor = lambda href, label: F.concat(F.lit('<a href="'), href, F.lit('" target="_blank" rel="noopener" class="citation">'), escaped(label), F.lit("</a>"))
    nct = lambda p: anchor(F.concat(F.lit("https://clinicaltrials.gov/study/"), F.upper(p)), F.upper(p))
    pmid = lambda p: anchor(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.regexp_extract(p, PMID, 1)), p)
    other = lambda p: anchor(F.concat(F.lit("https://doi.org/"), F.regexp_extract(p, DOI_CITED, 1)), p)
    one = lambda p, i: F.when(i % 2 == 0, escaped(p)).when(p.rlike(f"^{NCT}$"), nct(p)).when(p.rlike(f"^{PMID}$"), pmid(p)).otherwise(other(p))
    return F.array_join(F.transform(parts, one), "")


def escaped(c: Column, quote: str = "&#39;") -> Column:
    """The five entities, ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", quote)):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped_xml(c: Column) -> Column:
    """C31."""
    return escaped(c, "&apos;")


def sole_doi(c: Column) -> Column:
    """The DOI that alone is cited, in its first spelling; NULL for none or several."""
    kept = _first_spellings(F.filter(cited_dois(c), lambda x: doi(x).isNotNull()), doi)
    return F.when(F.size(kept) == 1, F.get(kept, F.lit(0)))


def paper_target(c: Column) -> Column:
    """`pmid:`, `pmc:`, `doi:` or `url:` and the value; NULL for what is no paper."""
    t = F.trim(c)
    named = lambda kind, value: F.concat(F.lit(f"{kind}:"), value)
    out = F.when(t.rlike("^[0-9]+$"), named("pmid", t)).when(t.rlike(PMC_URL), named("pmc", F.upper(F.regexp_extract(t, PMC_URL, 1))))
    out = out.when(t.rlike(PMID_URL), named("pmid", F.regexp_extract(t, PMID_URL, 1))).when(t.rlike(DOI_URL) | bare_doi(t), named("doi", doi(t)))
    return out.when(t.rlike("(?i)^https://") & ~t.rlike(NOT_PAPERS), named("url", t))


def host(url: Column) -> Column:
    """Lower-case host without www; NULL for what is no absolute address."""
    return F.regexp_replace(F.lower(_found(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")), r"^www\.", "")


def path_only(url: Column) -> Column:
    """Up to the first ? or #."""
    return F.regexp_extract(url, "^([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Https, host without www, no end slash, no tracking parameters, the rest decoded and sorted by name; no address: cut at ? and #."""
    plain = F.regexp_replace(path_only(url), "/+$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), "/+$", "")
    # names and values are read as a form's: decoded, + is a blank
    plus = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    cut = lambda p: F.instr(F.concat(p, F.lit("=")), "=")
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    named = F.transform(parts, lambda p, i: F.struct(plus(F.substr(p, F.lit(1), cut(p) - 1)).alias("k"), i.alias("i"), plus(F.substr(p, cut(p) + 1)).alias("v")))
    order = F.array_sort(F.filter(named, lambda x: ~x["k"].rlike(TRACKING)))
    query = F.when(F.size(order) > 0, F.concat(F.lit("?"), F.array_join(F.transform(order, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&"))).otherwise("")
    return F.when(host(url).isNotNull(), F.concat(F.lit("https://"), host(url), path, query)).otherwise(plain)


def url_doi(url: Column) -> Column:
    """The DOI in an address's decoded path."""
    raw = path_only(url)
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return doi(F.regexp_replace(_found(path, r"/(10\.[0-9]{4,9}/.+)$"), r"(?i)/(?:full|fulltext|abstract|pdf|epdf|html|meta|references|citations)/?$", ""))


def outlet(url: Column) -> Column:
    """The trade outlet's name of an address's host; NULL for others."""
    h, out = host(url), None
    for name, label in OUTLETS.items():
        out = F.when(h == name, label) if out is None else out.when(h == name, label)
    return out


def trade_press(url: Column) -> Column:
    """F11."""
    return outlet(url).isNotNull()


def paper_urls(c: Column) -> Column:
    """C17: distinct addresses of known paper hosts in a text, end punctuation trimmed."""
    urls = F.transform(_all(c, r"(?i)(https?://[^\s<>\")]+)"), lambda u: F.regexp_replace(F.substring(u, 1, LONGEST_URL), r"[.,;)\]]+$", ""))
    known = lambda u: u.rlike(DOI_URL) | u.rlike(PMC_URL) | u.rlike(JOURNAL_URL) | trade_press(u)
    return F.array_distinct(F.filter(urls, lambda u: ~u.rlike(PMID_URL) & ~u.rlike(NOT_PAPERS) & known(u)))


def pmids(c: Column) -> Column:
    """C20: distinct article ids of addresses, then of citations."""
    return F.array_distinct(F.concat(_all(c, PMID_URL), _all(c, PMID_NOTE)))


def handle(url: Column) -> Column:
    """C23."""
    return F.concat(F.lit("@"), _found(url, r"(?:twitter\.com|x\.com)/([A-Za-z0-9_]{1,15})\b"))


def post_id(url: Column) -> Column:
    """C24."""
    return _found(url, "status/([0-9]+)")


def drop_command(c: Column) -> Column:
    """`drop <date>/<slug>` as struct(date, slug); NULL for other texts."""
    pattern = r"(?i)^drop\s+([0-9]{4}-[0-9]{2}-[0-9]{2})[/\s]+([a-z0-9][a-z0-9-]*)$"
    t = F.trim(c)
    return F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).alias("date"), F.lower(F.regexp_extract(t, pattern, 2)).alias("slug")))


def preprint(doi_: Column, journal: Column, url: Column) -> Column:
    """by registrant, by host or by the journal's name."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(doi_, F.lit("")))), r"^https?://(?:dx\.)?doi\.org/", "")
    return F.substring_index(bare, "/", 1).isin(PREPRINT_DOIS) | F.coalesce(host(url).rlike(PREPRINT_HOSTS), F.lit(False)) | F.coalesce(journal.rlike(PREPRINT_NAMES), F.lit(False))


def safe_image(url: Column) -> Column:
    """https, and the host itself is on the list."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?i:https)://([^/?#:@]+)", 1)).isin(IMAGE_HOSTS), F.lit(False))


def trial_key(name: Column) -> Column:
    """the capitals at a name's start without signs; NULL for endpoints, groups alone, societies and short ones."""
    lead = F.regexp_extract(F.trim(name), r"^([A-Z][A-Z0-9]*(?![a-z])(?:[-\s][A-Z0-9]+(?![a-z]))*)", 1)
    first = F.regexp_extract(lead, r"^([^-\s]*)", 1)
    key = F.regexp_replace(lead, "[^A-Z0-9]", "")
    refused = first.isin(NOT_TRIALS) | first.rlike(NOT_TRIAL_PATTERN) | first.isin(SOCIETIES) | (first.isin(GROUPS) & (key == first))
    return F.when((F.length(key) >= 3) & ~refused, key)


def trial_keys(c: Column) -> Column:
    """Distinct keys of the acronyms in a text."""
    return F.array_distinct(F.filter(F.transform(_all(c, f"({ACRONYM})"), trial_key), lambda k: k.isNotNull()))


def trial_names(c: Column) -> Column:
    """Acronyms that can name a trial: with a digit or a hyphen, and on no list. Used by G16."""
    ok = lambda a: ~a.isin(NOT_TRIALS) & ~a.rlike(NOT_TRIAL_PATTERN) & a.rlike("[0-9-]")
    return F.array_distinct(F.filter(_all(c, f"({ACRONYM})"), ok))
