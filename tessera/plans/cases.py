"""Column functions as queries: a row of `orders` picks one of a function's cases, so that every case runs over the whole table.

The SQL picks the expected value in the same way. Expected values are written from the rules, not from the code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import display as D
from tessera.functions import effects as E
from tessera.functions import identifiers as I
from tessera.functions import validate as V
from tessera.operators import lineage
from tessera.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "bigint": "BIGINT"}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def case(name: str, build: Callable[..., Column], rows: list[tuple], out: str = "string", inputs: list[str] | None = None) -> None:
    """rows: inputs, then the expected value."""
    kinds = inputs or ["string"] * (len(rows[0]) - 1)
    n = len(rows)

    def run(spark, d):
        at = (F.col("id") % n + 1).cast("int")
        args = [F.element_at(F.array(*(F.lit(r[i]).cast(k) for r in rows)), at) for i, k in enumerate(kinds)]
        return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).select("id", build(*args).cast(out).alias("out"))

    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey AS id, CAST([{', '.join(literal(r[-1]) for r in rows)}][o_orderkey % {n} + 1] AS {TYPES[out]}) AS out FROM orders"


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def pair(c: Column) -> Column:
    return F.concat(joined(c["grounded"]), F.lit(" / "), joined(c["ungrounded"]))


LIST, NUMBERS, FLOATS = "array<string>", "array<bigint>", "array<double>"

case("doi_first", I.doi, [
    ("https://doi.org/10.1056/NEJMoa2034577", "10.1056/nejmoa2034577"), ("doi: 10.1016/S0140-6736(21)00896-5.", "10.1016/s0140-6736(21)00896-5"), ("https://www.thelancet.com/x?doi=10.1016%2Fj.ijrobp.2020.01.001", "10.1016/j.ijrobp.2020.01.001"),
    ("https://ascopubs.org/doi/10.1200/JCO.20.01234/full", "10.1200/jco.20.01234"), ("10.1001/jama.2020.1/fulltext/pdf/", "10.1001/jama.2020.1"), ("no identifier here", None), ("10.12/short", None), (None, None), ("(10.1002/abc123).", "10.1002/abc123"),
])
case("doi_bare", I.bare_doi, [("10.1056/NEJMoa2034577", True), ("  10.1056/nejm ", True), ("doi:10.1056/nejm", False), ("10.1056/nejm and more", False), ("", False), (None, False)], "boolean")
case("doi_all", lambda c: joined(I.dois(c)), [("see 10.1000/a1 and doi:10.1000/B2, again 10.1000/A1.", "10.1000/a1|10.1000/b2"), ("none", ""), ("https://doi.org/10.1000/x/pdf", "10.1000/x")])
case("citations", lambda c: joined(I.citations(c)), [
    ("NCT01234567 and nct01234567, PMID: 12345678", "nct:NCT01234567|pubmed:12345678"), ("doi:10.1000/AbC and https://doi.org/10.1000/abc", "doi:10.1000/AbC"), ("PubMed 23456 then NCT00000001 then doi: 10.5555/z", "nct:NCT00000001|pubmed:23456|doi:10.5555/z"),
    ("a bare 10.1000/abc is no citation", ""), ("XNCT01234567 NCT012345678", ""),
])
case("linkify", I.linked, [
    ("a < b & \"c\"", "a &lt; b &amp; &quot;c&quot;"), ("see nct01234567.", 'see <a href="https://clinicaltrials.gov/study/NCT01234567" target="_blank" rel="noopener" class="citation">NCT01234567</a>.'),
    ("PMID: 1234 ok", '<a href="https://pubmed.ncbi.nlm.nih.gov/1234" target="_blank" rel="noopener" class="citation">PMID: 1234</a> ok'), ("doi:10.1000/x", '<a href="https://doi.org/10.1000/x" target="_blank" rel="noopener" class="citation">doi:10.1000/x</a>'),
])
case("doi_sole", I.sole_doi, [("doi:10.1000/AbC, later doi:10.1000/abc/full", "10.1000/AbC,"), ("doi:10.1000/a doi:10.1000/b", None), ("10.1000/a", None), ("https://doi.org/10.1000/Zz", "10.1000/Zz")])
case("paper_target", I.paper_target, [
    (" 12345678 ", "pmid:12345678"), ("https://www.ncbi.nlm.nih.gov/pmc/articles/pmc123456/", "pmc:PMC123456"), ("https://pubmed.ncbi.nlm.nih.gov/34567/", "pmid:34567"), ("https://doi.org/10.1000/XY", "doi:10.1000/xy"), ("10.1000/XY", "doi:10.1000/xy"),
    ("https://www.nejm.org/a", "url:https://www.nejm.org/a"), ("http://www.nejm.org/a", None), ("https://twitter.com/a", None), ("https://youtube.com/w", None), ("text", None),
])
case("url_canonical", I.canonical_url, [
    ("http://www.Example.org/a/b/?utm_source=x&b=2&a=1#frag", "https://example.org/a/b?a=1&b=2"), ("https://example.org/a?igshid=1&_hsenc=2&_hsmi=3&ref_src=4&ref=5", "https://example.org/a"), ("https://example.org/a?utm_anything=1&reference=2", "https://example.org/a?reference=2"),
    ("https://example.org//", "https://example.org"), ("not an address?x#y", "not an address"), ("https://example.org/a?mc_cid=1&mc_other=2", "https://example.org/a?mc_other=2"),
])
case("url_path_only", I.path_only, [("https://a.org/b?c#d", "https://a.org/b"), ("a#b?c", "a"), ("plain", "plain")])
case("url_doi", I.url_doi, [("https://ascopubs.org/doi/10.1200/JCO.20.01/full", "10.1200/jco.20.01"), ("https://x.org/doi/10.1000%2FAbc?q=1", "10.1000/abc"), ("https://x.org/a", None), ("https://x.org/10.1000/z/pdf/", "10.1000/z")])
case("paper_urls", lambda c: joined(I.paper_urls(c)), [
    ("read https://www.nejm.org/doi/full/1. and https://x.com/a/status/1 and (https://doi.org/10.1000/ab)", "https://www.nejm.org/doi/full/1|https://doi.org/10.1000/ab"), ("https://pubmed.ncbi.nlm.nih.gov/1/ https://example.org/x", ""),
    ("https://onclive.com/view/a, https://onclive.com/view/a", "https://onclive.com/view/a"), ("https://pmc.ncbi.nlm.nih.gov/articles/PMC12", "https://pmc.ncbi.nlm.nih.gov/articles/PMC12"),
])
case("outlet_label", I.outlet, [("https://www.urotoday.com/a", "UroToday"), ("https://dailynews.ascopubs.org/x", "ASCO Daily News"), ("https://ascopubs.org/x", None), ("urotoday.com", None)])
case("trade_press", lambda c: I.trade_press(c), [("https://ONCLIVE.com/a", True), ("https://sub.onclive.com/a", False), ("nothing", False)], "boolean")
case("pmids", lambda c: joined(I.pmids(c)), [("https://pubmed.ncbi.nlm.nih.gov/123/ PMID: 456 pmid 123", "123|456"), ("PMID.789", "789"), ("none", "")])
case("handle", I.handle, [("https://x.com/some_one/status/12", "@some_one"), ("https://twitter.com/AbC", "@AbC"), ("https://example.org/a", None)])
case("post_id", I.post_id, [("https://x.com/a/status/1234567?s=20", "1234567"), ("https://x.com/a", None)])
case("drop_command", lambda c: F.concat_ws("/", I.drop_command(c)["date"], I.drop_command(c)["slug"]), [("drop 2026-05-30/Some-Slug", "2026-05-30/some-slug"), ("DROP  2026-05-30   a1", "2026-05-30/a1"), ("drop 2026-5-30/a", ""), ("please drop 2026-05-30/a", "")])
case("preprint", I.preprint, [("10.1101/2020.01.01", None, None, True), ("https://doi.org/10.21203/rs.1", None, None, True), ("10.1056/x", None, "https://www.medrxiv.org/a", True), (None, "bioRxiv", None, True), (None, "Research  Square", None, True), ("10.1056/x", "NEJM", "https://notmedrxiv.org/a", False)], "boolean")
case("safe_image", I.safe_image, [("https://pbs.twimg.com/media/a.jpg", True), ("http://pbs.twimg.com/a.jpg", False), ("https://pbs.twimg.com.evil.org/a", False), ("x", False)], "boolean")
case("dedup_key", I.trial_key, [
    ("ENZARAD (ANZUP 1303)", "ENZARAD"), ("EORTC 22922 (long follow-up)", "EORTC22922"), ("10-yr SBRT outcomes", None), ("NRG Oncology RTOG 0539", None), ("EXTEND Trial", "EXTEND"), ("OS results", None), ("PHASE3 of X", None), ("ASTRO guideline", None),
    ("RTOG", None), ("PACE-B: toxicity", "PACEB"), ("AB", None), ("KEYNOTE-522 update", "KEYNOTE522"), (None, None),
])
case("text_trial_keys", lambda c: joined(I.trial_keys(c)), [("In KEYNOTE-522 and PACE the OS was longer; again KEYNOTE-522.", "KEYNOTE522|PACE"), ("no trial", ""), ("RTOG and NRG alone", "")])

case("identity_predicate", lambda na, ka, sa, nb, kb, sb: lineage.same_trial(F.split(na, ","), F.filter(F.split(ka, ","), lambda x: x != ""), sa, F.split(nb, ","), F.filter(F.split(kb, ","), lambda x: x != ""), sb), [
    ("NCT1", "", "a", "nct1", "", "b", True), ("NCT1", "K", "a", "NCT2", "K", "a", False), ("NCT1", "K", "a", "NCT1", "J", "a", False), ("", "K", "a", "", "K", "a", True), ("", "K", "a", "", "K", "b", False), ("", "K", None, "", "K", None, False),
    ("NCT1", "", "a", "", "K", "a", False), ("", "", "a", "", "", "a", False), ("NCT1,NCT2", "K", "a", "NCT2", "K", "c", True), ("NCT1", "K", "a", "", "K", "a", True),
], "boolean")
case("identity_keys", lambda n, a: joined(lineage.keys_of(n, F.split(a, ","))), [("PACE-B: toxicity", "OTHER-1", "PACEB"), ("Outcomes of a trial", "KEYNOTE-1,OS", "KEYNOTE1"), ("Outcomes", None, "")])
case("facet_compatible", V.compatible, [("primary-efficacy", "primary-efficacy", True), ("long-term-followup", "primary-efficacy", True), ("primary-efficacy", "long-term-followup", False), (None, "primary-efficacy", False), (None, None, False)], "boolean")
case("estimate_moved", lineage.moved, [("HR 0.5", "x", "HR  0.5 ", "x", False), ("HR 0.5", None, "HR 0.6", None, True), (None, "a", "1", "b", True), ("1", None, None, "b", False), ("", "a", "1", "a", False)], "boolean")
case("ratio_changed", lambda a, b, c, x, y, z: lineage.ratio_moved([a, b, c], [x, y, z]), [(0.5, 0.4, 0.6, 0.5, 0.4, 0.6, False), (0.5, None, None, 0.5, None, None, False), (0.5, None, 0.6, 0.5, 0.4, 0.6, True), (0.5, 0.4, 0.6, 0.51, 0.4, 0.6, True)], "boolean", ["double"] * 6)
case("suppression_blockers", lambda s, n, f, g, m, p: joined(lineage.blockers(s == "y", n == "y", f.cast("double"), g.cast("double"), m, p)), [
    ("y", "y", "24", "12", "full-publication", "conference-abstract", ""), ("n", "y", "24", "12", "full-publication", "full-publication", "identity"), ("y", "n", None, "12", "full-publication", "full-publication", "endpoint|followup"),
    ("n", "n", "6", "12", "conference-abstract", "full-publication", "identity|endpoint|followup|maturity"), ("y", "y", "12", "12", None, "full-publication", "maturity"),
])
case("primary_blocker", lambda c: lineage.primary_blocker(F.filter(F.split(c, ","), lambda x: x != "")), [("identity,endpoint", "endpoint"), ("identity", "identity"), ("followup,maturity", "followup"), ("", None)])
case("identity_only", lambda c: lineage.identity_only(F.filter(F.split(c, ","), lambda x: x != "")), [("identity", True), ("identity,endpoint", False), ("", False)], "boolean")

case("axis_rung", E.snapped, [(1.0, 1.5), (1.5, 1.5), (3.5, 4.0), (4.5, 5.0), (6.0, 7.0), (12.0, 15.0), (25.0, 30.0), (99.0, 100.0), (100.5, 1000.0), (2000.0, 10000.0)], "double", ["double"])
case("endpoint_families", E.family, [
    ("Overall survival", "os"), ("OS at 5 years", "os"), ("Progression-free survival", "pfs"), ("Metastasis-free survival", "mfs"), ("disease free interval", "other"), ("Disease-free survival", "dfs"), ("EFS", "efs"), ("Local recurrence", "local"),
    ("Locoregional control", "local"), ("Relapse", "recurrence"), ("Biochemical failure", "biochemical"), ("pCR rate", "response"), ("Grade ≥3 events", "toxicity"), ("Quality of life", "pro"), ("Cost", "other"), ("  ", "unknown"), (None, "unknown"),
])
case("axis_bucket", E.bucket, [("PFS", "HR", "pfs::HR"), (None, "OR", "unknown::OR"), ("Cost", "RR", "other::RR")])
case("axis_end", lambda p: F.round(E.axis_end(E.half_width(p)), 6), [(1.0, 3.0), (0.5, 3.0), (0.2, 7.0), (6.0, 10.0), (0.0, 4.0), (-1.0, 4.0), (None, 4.0)], "double", ["double"])
case("axis_place", lambda v: F.round(E.on_axis(v, F.lit(0.25), F.lit(4.0), F.lit(100.0)), 6), [(1.0, 50.0), (4.0, 100.0), (0.1, 0.0), (2.0, 75.0), (9.0, 100.0)], "double", ["double"])
case("axis_tick", E.tick, [(0.25, "0.25"), (0.5, "0.5"), (2.0, "2"), (1.5, "1.5"), (20.0, "20"), (0.33333, "0.33")], "string", ["double"])
case("bar_inset", lambda a, b: F.concat_ws("|", *(F.format_string("%.1f", E.inset_span(a, b, F.lit(True), F.lit(True), F.lit(4.0))[k]) for k in ("left", "right"))), [(10.0, 30.0, "14.0|26.0"), (10.0, 16.0, "10.0|16.0"), (0.0, 8.5, "4.0|4.5")], "string", ["double"] * 2)
case("paired_bars", lambda a, b: F.concat_ws("|", *(F.format_string("%.1f", E.bars(a, b, F.lit(True), F.lit(200.0))[k]) for k in ("a", "b", "max"))), [(50.0, 25.0, "100.0|50.0|100.0"), (120.0, 60.0, "200.0|100.0|120.0")], "string", ["double"] * 2)
case("effect_prose", E.described, [("HR", "0.62", "0.48", "0.8", "95", "HR 0.62, 95% CI 0.48 to 0.8"), ("OR", "1.5", "1.1", "2", None, "OR 1.5, interval 1.1 to 2"), ("RR", "0.9", None, "1.2", "95", "RR 0.9")])
case("numeric_plain", E.plain_numbers, [("0·62 (0·48–0·80)", "0.62 (0.48-0.80)"), ("1,234 and 12,345,678", "1234 and 12345678"), ("−5 — 3", "-5 - 3")])
case("numeric_forms", lambda c: joined(E.number_forms(c)), [("0.62 and 12, 12", "0.62|12"), ("HR 0-62", "0|62|0.62"), ("p=0.050", "0.050")])
case("numeric_values", lambda c: joined(E.number_values(c)), [("0.620 007 1.0", "0.62|7|1"), ("p=0.050", "0.05"), ("1,234", "1234"), ("100", "100")])
case("percent_values", lambda c: joined(E.percents(c)), [("64.50 % vs 12%, 12", "64.5|12"), ("none 5", "")])
case("traced_values", lambda c: joined(E.traced_values(c)), [("64.5% of 1,200 had 3.25 and 1,200%", "64.5%|3.25|1200%"), ("1.2.3", "1.2"), ("12", "")])
case("grounding_partition", lambda a, s: pair(E.grounded(F.split(a, ";"), s)), [("0.62;48;0.9", "HR 0·62 (48 events)", "0.62|48 / 0.9"), ("1,234", "n=1234", "1,234 / "), ("5.0", "5", "5.0 / ")])
case("grounding_audit", lambda a, s: pair(E.audited(a, s)), [("64% and 12", "64% of 12", "64%|12 / "), ("64%", "64 of 100, 30%", " / 64%"), ("64%", "64 of 100", "64% / ")])
case("stat_plain", E.plain_stat, [("  HR 0.48 ;", "hr 0.48"), (",;A  b.", "a b")])
case("stat_measures", lambda c: joined(E.stat_atoms(c)), [("HR 0.48 (64.5%)", "hr 0.48|64.5%"), ("aHR=0.7; 20.4 months", "ahr 0.7|20.4 months"), ("rr : 1.2", "rr 1.2"), ("nothing 5", "")])
case("stat_shared", E.same_stat, [("HR 0.48", "hr = 0.48, p<0.01", True), ("64.5%", "HR 0.645", False), ("none", "HR 1", False)], "boolean")
case("number_token", E.number_token, [("1,5", "1.5"), ("0.62", ".62"), ("10.62", "10.62"), ("0", "0")])
case("number_pairs", lambda c: joined(E.number_pairs(c)), [("0.62 (0.80, 0.48)", ".62~.80|.48~.80"), ("5", ""), ("2 1 2", "1~2")])
case("clamp_unit", E.clamped, [(0.5, 0.5), (-1.0, 0.0), (7.0, 1.0), (float("nan"), 0.0), (None, 0.0)], "double", ["double"])
case("followup_months", E.followup_months, [(12.34, 12.3), (12.25, 12.3), (-1.0, None), (601.0, None), (0.0, 0.0), (600.0, 600.0)], "double", ["double"])
case("sparkline_points", lambda c: E.sparkline(F.transform(F.split(c, ","), lambda x: x.cast("int"))), [("0,1", "1.00,9.00 79.00,1.00"), ("5", ""), ("2,4,0", "1.00,5.00 40.00,1.00 79.00,9.00")])

case("modality_valid", lambda c: V.one_of(c, V.MODALITIES), [("radiation", True), ("Radiation", False), (None, False), ("combined", True)], "boolean")
case("intent_valid", lambda c: V.one_of(c, V.INTENTS), [("curative", True), ("cure", False), (None, False)], "boolean")
case("methodology_valid", lambda c: V.one_of(c, V.METHODOLOGIES), [("phase-3-rct", True), ("phase-3", False), ("consensus-guideline", True)], "boolean")
case("site_valid", lambda c: V.one_of(c, list(V.SITES)), [("cns", True), ("brain", False), ("multi-site", True), ("other", True)], "boolean")
case("facet_valid", lambda c: V.one_of(c, V.FACETS), [("translational", True), ("efficacy", False)], "boolean")
case("maturity_valid", lambda c: V.one_of(c, V.MATURITIES), [("full-publication", True), ("full", False)], "boolean")
case("content_type_valid", lambda c: V.one_of(c, V.CONTENT_TYPES), [("review", True), ("study_report", True), ("study report", False)], "boolean")
case("enum_tag", lambda c: V.enum(c, V.MODALITIES), [(" Radiation ", "radiation"), ("x", None), (None, None)])
case("facet_guard", lambda c: V.exact(c, V.FACETS), [("safety-toxicity", "safety-toxicity"), ("Safety-toxicity", None)])
case("content_type", V.content_type, [("Review", "review"), ("study-report", "study_report"), (" study  report ", "study_report"), ("other", "study_report"), (None, "study_report")])
case("verdict_emoji", V.verdict_emoji, [("practice-changing", "🚀"), ("consensus", "🧭"), ("x", None), (None, None)])
case("verdict_label", V.verdict_label, [("methodologically-limited", "Caveats dominate"), ("challenges-soc", "Challenges SOC"), ("x", None)])
case("verdict_color", V.verdict_color, [("unclear", "#555"), ("early-signal", "#1a6a7a"), (None, None)])
case("rail_emoji", V.rail_emoji, [("confirmatory", "review", "🔄"), (None, "review", "🗞️"), (None, "study_report", "·"), (None, None, "·")])
case("site_label", V.site_label, [("cns", "CNS"), ("upper-gi", "GI Upper"), ("unknown", "Other"), (None, "Other")])
case("site_emoji", V.site_emoji, [("kidney", "🫘"), ("x", "📋")])
case("slug_safe", V.safe_slug, [("a-b-1", True), ("a--b", False), ("A", False), ("-a", False), (None, False)], "boolean")
case("slug_study", V.study_slug, [("a" * 64, True), ("a" * 65, False), ("a_b", False)], "boolean")
case("card_id_shape", V.card_id, [("2026-05-30#a-b", True), ("2026-05-30", False), (None, False)], "boolean")
case("card_id_date", V.id_date, [("2026-05-30#a-b", "2026-05-30")])
case("card_id_of", V.composite, [("2026-05-30", "a", "2026-05-30#a")])
case("tag_path", lambda c: joined(V.tag_path(c)), [("a+b", "a|b"), ("b+a", None), ("a+a", None), ("a+b+c+d", None), ("a", "a"), ("A+b", None), ("", None)])
case("tags_canonical", lambda t, b, s: V.canonical_tags(F.split(t, ","), F.split(b, ","), F.split(s, ",")), [("b,a", "a+b,c+d", "a", "a+b"), ("a", "a+b", "a,b", "a"), ("c", "a+b", "a", None), ("a,c", "a+b", "a", None)])
case("filter_tokens", lambda c: joined(V.tokens(c)), [("Modality:Radiation  x :y z: intent:curative", "modality:radiation|intent:curative"), (None, ""), ("", "")])
case("filter_slugs", lambda c: joined(V.slugs(V.tokens(c))), [("a:x b:x c:y", "x|y")])
case("filter_matches", lambda c, w: V.matches(F.split(c, ","), F.filter(F.split(w, ","), lambda x: x != "")), [("a,b,c", "a,c", True), ("a,b", "a,d", False), ("a", "", True)], "boolean")
case("filter_clearable", lambda a, b: V.clearable(F.split(a, ","), F.split(b, ",")), [("a,b", "a", True), ("a", "a,b", False)], "boolean")
case("filter_url_tags", lambda c: joined(V.url_tags(c)), [("https://x.org/?tag=a&TAG=B&tag=a&tag=no%20good&q=1#f", "a|b"), ("https://x.org/", "")])
case("filter_url_built", lambda u, t: V.with_tags(u, F.filter(F.split(t, ","), lambda x: x != "")), [("https://x.org/p?tag=z&q=1#f", "b,a", "https://x.org/p?q=1&tag=a&tag=b#f"), ("https://x.org/p", "a", "https://x.org/p?tag=a"), ("https://x.org/p?Tag=a", "", "https://x.org/p")])
case("url_stripped", lambda u: V.without_parameters(u, ["tag"]), [("https://x.org/p?tag=a&q=1", "https://x.org/p?q=1"), ("https://x.org/p?tag=a#f", "https://x.org/p#f"), ("https://x.org/p", "https://x.org/p")])
case("source_ref", V.source_ref, [(5, "tweet:5"), (1_000_000_007, "paper:7"), (2_000_000_009, "slide:9")], "string", ["bigint"])
case("source_ref_paper", V.paper_ref, [(7, 1_000_000_007), (0, 1_000_000_000)], "bigint", ["bigint"])
case("source_ref_slide", V.slide_ref, [(9, 2_000_000_009)], "bigint", ["bigint"])
case("allowed_ids", lambda c: F.when(V.allowed_ids(c).isNotNull(), F.array_join(V.allowed_ids(c).cast("array<string>"), "|")), [(" 1, -5,x,1", "1|-5"), ("  ", None), (None, None), ("x", "")])
case("allowed_check", lambda i, c: V.authorised(i.cast("bigint"), V.allowed_ids(c)), [("1", "1,2", True), ("3", "1,2", False), ("3", None, True), ("3", "x", False), (None, "1", False)], "boolean")
case("json_strings", lambda c: joined(V.strings(c)), [('[" a ", "", "b"]', "a|b"), ("not json", ""), (None, ""), ("[]", "")])
case("json_seen_ids", lambda c: F.when(V.seen_ids(c).isNotNull(), joined(V.seen_ids(c))), [('["2026-05-30#a", "bad", "2026-05-30#a"]', "2026-05-30#a"), ("[]", ""), ("{}", None), ("x", None), (None, None)])
case("json_questions", lambda c: joined(V.questions(c)), [('["a","b","c","d","e","f"]', "a|b|c|d|e"), ("[]", None), (None, None)])
case("json_discussed", lambda c: joined(V.discussed(c)), [('["PACE", "pace", "x", "--", "RTOG 0539"]', "PACE|RTOG 0539")])
case("significance_text", lambda c: F.length(V.significance(c)), [("short", None), ("word  " * 10, 49), ("x" * 950, 900)], "bigint")
case("interpretation_text", lambda c: F.length(V.interpretation(c)), [("short", None), ("x" * 400 + "\n\n \n" + "y" * 300, 702), ("x" * 7000, 6000)], "bigint")
case("verdict_capped", lambda v, p: V.capped_verdict(v, p == "y"), [("practice-changing", "y", "early-signal"), ("practice-changing", "n", "practice-changing"), ("unclear", "y", "unclear")])
case("verdict_consensus", V.consensus_verdict, [("consensus-guideline", "unclear", "consensus"), ("consensus-guideline", None, None), ("phase-1", "unclear", "unclear")])
case("verdict_review", V.review_verdict, [("review", "unclear", None), ("study_report", "unclear", "unclear"), (None, "unclear", "unclear")])
case("unfenced", V.unfenced, [("```json\n{\"a\":1}\n```", '{"a":1}'), ("```\n[1]\n```", "[1]"), (" {} ", "{}")])
case("queued_after_build", V.after_build, [(5.0, 4.0, True), (4.0, 5.0, False), (1.0, None, True), (1.0, float("nan"), True)], "boolean", ["double"] * 2)
case("window_outside", V.outside_window, [("2026-05-28", "2026-05-30", True), ("2026-05-29", "2026-05-30", False)], "boolean")
case("window_rebuild", lambda d, t, p: V.needs_rebuild(d, t, p == "y"), [("2026-05-30", "2026-05-30", "y", True), ("2026-05-30", "2026-05-30", "n", False), ("2026-05-01", "2026-05-30", "n", True)], "boolean")
case("content_depth", V.content_depth, [("x", "y", "full text available"), (" ", "y", "abstract only"), (None, None, "no abstract or full text")])

case("date_short", D.short_date, [("2026-05-03", "May 3"), ("2026-13-03", "? 3"), ("x", "x")])
case("date_short_year", lambda c: D.short_date(c, True), [("2026-12-31", "Dec 31 '26")])
case("date_rfc822", D.rfc822, [("2026-05-30", "Sat, 30 May 2026 00:00:00 GMT"), ("bad", ""), ("2026-02-31", "")])
case("date_loose", D.loose_date, [("2026/5/3", "2026-05-03"), ("on 2026-11-30.", "2026-11-30"), ("Spring 2019", "2019"), ("none", None)])
case("date_month", D.month_number, [("March", "03"), ("7", "07"), ("11", "11"), ("x", "01"), ("sept", "09")])
case("date_year_month", D.year_month, [("2026-05-30", "2026-05"), ("2026-13", "2026"), ("2026", "2026"), ("May 2026", None), (" 2026-01 ", "2026-01")])
case("date_shifted", lambda c: D.shifted(c, F.lit(-1)), [("2026-03-01", "2026-02-28")])
case("date_full_year", D.full_year, [("26", 2026), ("2019", 2019)], "bigint")
case("date_parts", D.date_parts, [(2026, 5, 3, "2026-05-03"), (2026, 5, None, "2026-05"), (2026, None, None, "2026"), (None, 5, 3, None), (2026, None, 3, "2026")], "string", ["int"] * 3)
case("date_first", D.first_date, [("issued 2026-05 then 2027", "2026-05"), ("none", None)])
case("xml_escaped", I.escaped_xml, [("a & <b> \"c\" 'd'", "a &amp; &lt;b&gt; &quot;c&quot; &apos;d&apos;")])
case("json_script", D.json_for_script, [('{"a":"</script>"}', '{"a":"\\u003c/script>"}')])
case("share_url", D.share_url, [("s", "2026-05-30", "a", "/study/2026-05-30-a/"), ("s", "", "a", None), (None, "d", "a", None)])
case("relevance_cut", D.relevance, [("short", "short"), ("word " * 11 + "abcdefghij", "word " * 10 + "word…"), ("x" * 70, "x" * 60 + "…")])
case("question_folded", D.folded, [("it’s “so”", "it's \"so\"")])
case("excerpt_cap", lambda c: D.capped(c, 5, "..."), [("abcdef", "abcde..."), ("abcde", "abcde")])
case("merge_described", lambda c: D.listed(F.split(c, ",")), [("figure_ocr_md,abstract,pdf_path", "figures, the abstract and the filed PDF"), ("abstract", "the abstract"), ("title", None), ("fulltext_excerpt_md,abstract", "full text and the abstract")])
case("front_matter", D.without_front_matter, [("---\na: 1\n---\nbody\n", "body"), ("plain", "plain")])
case("headline_size", D.headline_size, [("x" * 46, 58), ("x" * 47, 50), ("x" * 79, 42), ("x" * 119, 36)], "bigint")
case("build_stamp", lambda c: D.build_stamp(c, "site:build"), [('<meta name="site:build" content=" 42 ">', "42"), ("<html>", None)])
case("image_url", D.image_url, [("<meta content='/a.png' property='og:image'/>", "/a.png"), ("<meta property='og:image' content=' '>", None)])
case("page_deployed", lambda h, d, s: D.deployed(h, d, s, "site:build"), [('/og/2026-05-30.png <meta name="site:build" content="7">', "2026-05-30", "7", True), ('/og/2026-05-30.png <meta name="site:build" content="7">', "2026-05-30", "8", False), ("/og/2026-05-30.png", "2026-05-30", None, True), ("", "2026-05-30", None, False)], "boolean")
case("trial_subline", lambda n, c, p: D.subline(n.cast("int"), c, p), [("120", "2027-01", " phrase ", "n=120 · primary completion 2027-01 · phrase"), (None, None, "", ""), ("5", "", None, "n=5")])
case("watching_badge", D.watching, [(1, "1 trial watching"), (3, "3 trials watching"), (0, None)], "string", ["int"])
case("bullet_comparator", D.comparator, [(" 🔗 vs X", True), ("x 🔗", False)], "boolean")
case("bullet_section", D.section, [("🔍 a", "methods"), ("💊 a", "methods"), ("📊 a", "results"), ("⚠️ a", "critique"), ("a", "notes")])
case("applies_split", lambda c: F.concat_ws("|", D.applies(c)["yes"], D.applies(c)["no"]), [("Represents older adults; does not cover children", "older adults|does not cover children"), ("no such text", ""), ("does not apply", "")])
case("endpoint_class", D.endpoint_class, [("overall-survival", "hard"), ("local-control", "local control"), ("x", "surrogate"), (None, "surrogate")])
case("words_long", lambda c: joined(D.long_words(c)), [("The long-term control, control!", "long|term|control")])
case("words_overlap", lambda a, b: F.round(D.word_overlap(a, b), 6), [("alpha beta gamma", "alpha beta", 1.0), ("alpha", "", 0.0), ("alpha beta", "alpha delta", 0.5)], "double")
case("html_plain", lambda c: D.tag_free(c, 20), [("<p>a&nbsp;b</p><script>x</script>", "a b"), ("<br>", None), ("x" * 30, "x" * 20)])
case("title_overlap", lambda a, b: F.round(_overlap(a, b), 6), [("Proton therapy for prostate cancer", "Prostate cancer proton therapy", 1.0), ("a of the", "x", 0.0)], "double")


def _overlap(a: Column, b: Column) -> Column:
    from tessera.functions.text import overlap, significant

    return overlap(significant(a), significant(b))
