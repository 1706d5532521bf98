"""Trials that a text names, and claims about them that its sources don't hold. JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.identifiers import NOT_TRIAL_PATTERN, NOT_TRIALS, _first_spellings
from tessera.functions.sections import let, trimmed

# The form of a name, capitals that name no trial, and what counts as a statistic or a number worth checking.
NAME = r"(\b[A-Z][A-Z0-9]{2,}(?:-[A-Za-z0-9]+)*)"
OTHERS = (
    "NEJM JAMA JCO LANCET BMJ ANNALS EJC IJROBP RADIOTHER ESMO ASCO ASTRO AACR SABCS NCCN EAU ESTRO ARS ARPI ARTA ARSI SOC BSC PSA LHRH GNRH ADC MAB "
    "RCT PRISMA CONSORT ITT QOL HRQOL PRO PROS MCID BEFORE AFTER NOT ONLY BOTH ALL NONE MORE LESS NEW OLD YES NO AND THE FOR WITH WITHOUT VERSUS "
    "SRS SIB IMPT PBT HDR LDR IORT TBI CSI MDT BID TID QID QDS PRN IVF SUB PER HRR HRD MMR DDR ATM PTEN CDH1 AKT MTOR VEGF "
    "CTC CTDNA IHC ISH FISH NGS WES WGS OCR AUC MDT ICU ITU LOS QALY ICER FDA EMA NHS NICE"
).split()
ROMAN, STAGE = "^(?:I{2,3}|IV|VI{0,3}|IX|XI{0,3})[A-C]?$", "^(?:[TNM][0-9]+[A-Z]?)+$"
STATISTIC = r"(?i)\b(?:a?HR|OR|RR|SHR)\s*[=:]?\s*[0-9]|[0-9]{2}\s*%\s*CI|\bp\s*[=<>]\s*\.?[0-9]|[0-9]+(?:\.[0-9]+)?\s*%|\bmedian\b[^.;]{0,40}?[0-9]|\bn\s*=\s*[0-9]"
NUMBER, ATTACHED = r"([0-9]+\.[0-9]+|[0-9]{2,})", 90


def plain(c: Column) -> Column:
    """Letters and digits only, lower."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_trial(name: Column) -> Column:
    """whether capitals can name a trial; what stands before the first hyphen decides."""
    ok = lambda lead: (F.length(lead) >= 3) & ~lead.isin([*NOT_TRIALS, *OTHERS]) & ~lead.rlike(NOT_TRIAL_PATTERN) & ~lead.rlike(STAGE) & ~lead.rlike(ROMAN)
    return let(F.upper(F.substring_index(name, "-", 1)), ok)


def named_trials(text: Column) -> Column:
    """C11: the trials that a text names, each in its first spelling."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME), F.lit(1)), lambda x: is_trial(x) & (F.length(plain(x)) >= 3))
    return _first_spellings(found, plain)


def unsourced(text: Column, source: Column) -> Column:
    """Named trials that the source doesn't mention, however it is spelled there."""
    return let(plain(F.coalesce(source, F.lit(""))), lambda hay: _missing(text, hay))


def _missing(text: Column, hay: Column) -> Column:
    return F.filter(named_trials(text), lambda x: F.instr(hay, plain(x)) == 0)


def unsourced_claims(text: Column, source: Column) -> Column:
    """Trials that the source doesn't mention and that a clause with a statistic gives a number, within ATTACHED characters behind the name, that the source doesn't hold. The last spelling of each."""
    parts = F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("**"), F.lit("")), r"(?<=[.;])\s+"), trimmed), lambda c: (c != "") & c.rlike(STATISTIC))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))
    behind = lambda c, x: F.substr(c, F.instr(c, x) + F.length(x), F.lit(ATTACHED))
    bad = lambda s: F.flatten(F.transform(parts, lambda c: F.filter(_missing(c, s["hay"]), lambda x: F.size(F.array_except(numbers(behind(c, x)), s["held"])) > 0)))
    keyed = lambda names: F.transform(names, lambda x: F.struct(plain(x).alias("k"), x.alias("x")))
    last = lambda names: let(keyed(names), lambda kx: F.transform(F.array_distinct(F.transform(kx, lambda y: y["k"])), lambda k: F.element_at(F.filter(kx, lambda y: y["k"] == k), -1)["x"]))
    known = F.coalesce(source, F.lit(""))
    return let(F.struct(plain(known).alias("hay"), numbers(known).alias("held")), lambda s: let(bad(s), last))
