"""Mixing sources to target weights: iterative proportional fitting, then Bernoulli sampling.

Tokens are summed by cell (source, language, topic). The cells' weights start at their token counts
and are raked in turn to the target share of each source, of each language and of each topic, until
all marginals are met, or until targets that can't be met together (a value that occurs only with others) bring no more progress; column met says which. A document's sampling probability is its cell's weight by its tokens, scaled so that
the expected tokens are BUDGET of the input's, no probability above 1 (calibration: cells at 1 are fixed and the rest scaled
again). A document stays if a hash of its key and text is below its probability, so a rerun keeps the same ones.

Default targets are shares by the power TEMPER of a value's tokens, which lifts small sources.
DataFrame functions only; the cells are the only thing that is iterated over, as tables in the shared folder.

Cases: null source, language or topic are values of their own ("(none)"). Empty texts have 0
tokens and stay with probability 1 of their cell's scale. Targets of values that don't occur are left out, and the
rest is scaled to 1. No documents: no rows. Rows are drawn by key and text: rows equal in both stay or go together, null keys are drawn like others.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import row_hash, stored, unit

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.7
BUDGET = 0.8
TOLERANCE = 1e-6
#: Raking ends when a round brings less than this share of progress; targets that can't be met together end so.
PROGRESS = 1e-3


def token_count(text: Column) -> Column:
    """Words by blanks: the weight of a document."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: what share of the text's words holds figures, signs or table bars."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1))
    bars, figures = F.regexp_count(t, F.lit("[|]")), F.regexp_count(t, F.lit("[0-9]"))
    return F.when(bars * 40 > n, "table").when(figures * 40 > n, "figures").when(n < 600, "short").when(n < 4000, "medium").otherwise("long")


def cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def targets(cell: DataFrame, dimension: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """cell with column t_<dimension>: the target share of its value; shares of the values that occur add up to 1."""
    w = Window.partitionBy(dimension)
    total = F.sum("tokens").over(w)
    if given is None:
        raw = F.pow(total, F.lit(temper))
    else:
        raw = functools.reduce(lambda c, kv: c.when(F.col(dimension) == kv[0], F.lit(float(kv[1]))), given.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    one = cell.withColumn("_raw", raw).withColumn("_n", F.count(F.lit(1)).over(w))
    scale = one.agg(F.sum(F.col("_raw") / F.col("_n"))).first()[0] or 1.0
    return one.withColumn(f"t_{dimension}", F.col("_raw") / F.lit(scale)).drop("_raw", "_n")


def rake(cell: DataFrame, given: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """cell with columns share (its raked share of all tokens) and met (whether all marginals are within TOLERANCE)."""
    given = given or {}
    cell = cell.where("tokens > 0")
    for d in DIMENSIONS:
        cell = targets(cell, d, given.get(d), temper)
    total = cell.agg(F.sum("tokens")).first()[0] or 1.0
    cell = stored(cell.withColumn("share", F.col("tokens") / total).coalesce(1), "cells")
    before = float("inf")
    while True:
        for d in DIMENSIONS:
            own = F.sum("share").over(Window.partitionBy(d))
            cell = cell.withColumn("share", F.when(own > 0, F.col("share") * F.col(f"t_{d}") / own).otherwise(0.0))
        cell = stored(cell, "raked")
        off = F.lit(0.0)
        for d in DIMENSIONS[:-1]:
            off = F.greatest(off, F.abs(F.sum("share").over(Window.partitionBy(d)) - F.col(f"t_{d}")))
        worst = cell.withColumn("_off", off).agg(F.max("_off")).first()[0]
        if worst is None or worst < TOLERANCE or worst > before * (1 - PROGRESS):
            break
        before = worst
    return cell.withColumn("met", F.lit(worst is None or worst < TOLERANCE))


def calibrate(cell: DataFrame, budget: float) -> tuple[float, float]:
    """(scale, tokens): scale such that sum(tokens * min(1, scale * share / tokens)) is budget of all tokens."""
    total, most = cell.agg(F.sum("tokens"), F.sum(F.when(F.col("share") > 0, F.col("tokens")))).first()
    if not total:
        return 0.0, 0.0
    wanted, scale = min(budget * total, most or 0.0), budget * total
    while True:  # scale only grows, and each time more cells are at 1
        ratio = F.lit(scale) * F.col("share") / F.col("tokens")
        full, rest = cell.agg(F.sum(F.when(ratio >= 1, F.col("tokens")).otherwise(0.0)), F.sum(F.when(ratio < 1, F.col("share")).otherwise(0.0))).first()
        new = (wanted - full) / rest if rest > 1e-12 else scale
        if abs(new - scale) <= 1e-9 * scale:
            break
        scale = max(new, scale)
    return scale, total


def weigh(rows: DataFrame, given: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET) -> DataFrame:
    """source, lang, topic, p, share, met: the sampling probability of each cell."""
    cell = stored(cells(rows), "mix")
    raked = rake(cell, given, temper)
    scale, _ = calibrate(raked, budget)
    p = F.least(F.lit(1.0), F.lit(scale) * F.col("share") / F.col("tokens"))
    return cell.select(*DIMENSIONS).join(raked.select(*DIMENSIONS, p.alias("p"), "share", "met"), list(DIMENSIONS), "left").select(*DIMENSIONS, F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("met", F.lit(True)).alias("met"))


def _dimensions(text: str, topics: Column | None) -> dict[str, Column]:
    none = lambda c: F.coalesce(c, F.lit("(none)"))
    return {"source": none(F.col("source")), "lang": none(F.col("lang")), "topic": none(topic(F.col(text)) if topics is None else topics)}


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", topics: Column | None = None, given: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET) -> DataFrame:
    """key, source, lang, topic, n_tokens, p, share, met, kept; one row for each row of docs."""
    rows = docs.select(F.col(key).alias("k"), row_hash(key, text).alias("r"), *(c.alias(d) for d, c in _dimensions(text, topics).items()), token_count(F.col(text)).alias("n_tokens"))
    rows = stored(rows, "mix-rows")
    # one row for each cell; joined by a hash map if Spark finds it small, else by shuffle
    got = rows.join(weigh(rows, given, temper, budget), list(DIMENSIONS), "left")
    return got.select(F.col("k").alias(key), *DIMENSIONS, "n_tokens", "p", "share", "met", (unit(F.col("r"), "mix") < F.col("p")).alias("kept"))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", topics: Column | None = None, given: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET) -> DataFrame:
    """docs that the mix keeps; all columns stay, whatever their names. Only the cells' probabilities are moved, where they are few."""
    dims = _dimensions(text, topics)
    p = weigh(docs.select(*(c.alias(d) for d, c in dims.items()), token_count(F.col(text)).alias("n_tokens")), given, temper, budget)
    plain = docs.select(*(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(docs.columns)), *(c.alias(f"d_{d}") for d, c in dims.items()), row_hash(key, text).alias("r"))
    p = p.select(*(F.col(d).alias(f"p_{d}") for d in DIMENSIONS), "p")
    on = [F.col(f"d_{d}") == F.col(f"p_{d}") for d in DIMENSIONS]
    return plain.join(p, on, "left").where(unit(F.col("r"), "mix") < F.col("p")).select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))
