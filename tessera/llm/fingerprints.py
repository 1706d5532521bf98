"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A text is cut after each line end or sentence end, so that its pieces put together are the text.
A piece hashes to LANES bits; the fingerprint is the sum of these 0/1 vectors over all pieces, each lane
modulo 2 ** 16, and the number of pieces modulo 2 ** 32. So it doesn't depend on the pieces' order,
and a piece is put in or taken out by adding or subtracting its vector. Two lanes are held in each long.

With signs instead of bits, the difference of two fingerprints is an AMS sketch: its mean square
estimates how many pieces are in one text but not in the other, from which likeness() follows.

DataFrame functions only. Cases: null text is empty text, which has no pieces: all zeros; two empty texts are alike (1.0).
Equal texts have equal fingerprints. neighbours() orders by key, nulls first; rows of equal key are ordered by
text; the row after the last is the first; a single row is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 128
HALVES = 32
LOW = 0xFFFF
BOTH = (1 << 32) | 1
MASK = (LOW << 32) | LOW
#: Rows of a neighbour window, about, as long as BUCKETS ** 2 windows do; beyond, windows grow with the rows and are sorted by spilling.
BUCKET_ROWS = 1000
BUCKETS = 64


def pieces(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?\n])(?![.!?\n])"), lambda p: p != "")


def fingerprint(text: Column) -> Column:
    """struct(n long, lanes array<long>)."""
    width = LANES // 2
    zero = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(0).cast("long").alias(f"v{i}") for i in range(width)))
    hashes = F.transform(pieces(text), lambda p: F.struct(*(F.xxhash64(p, F.lit(s)).alias(f"h{s}") for s in range(LANES // 64))))

    def add(acc, h):
        bits = [F.shiftrightunsigned(h[f"h{s}"], i).bitwiseAND(F.lit(BOTH)) for s in range(LANES // 64) for i in range(HALVES)]
        return F.struct((acc["n"] + F.lit(1).cast("long")).alias("n"), *((acc[f"v{i}"] + b).alias(f"v{i}") for i, b in enumerate(bits)))

    return F.aggregate(hashes, zero, add, lambda a: F.struct(a["n"].alias("n"), F.array(*(a[f"v{i}"].bitwiseAND(F.lit(MASK)) for i in range(width))).alias("lanes")))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together (sign 1), or of a without the pieces of b (sign -1)."""

    def lane(x, y):
        low = F.pmod(x.bitwiseAND(F.lit(LOW)) + sign * y.bitwiseAND(F.lit(LOW)), F.lit(LOW + 1))
        high = F.pmod(F.shiftright(x, 32) + sign * F.shiftright(y, 32), F.lit(LOW + 1))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.struct(F.pmod(a["n"] + sign * b["n"], F.lit(1 << 32)).alias("n"), F.zip_with(a["lanes"], b["lanes"], lane).alias("lanes"))


def likeness(a: Column, b: Column) -> Column:
    """1 - (pieces in one but not in the other) / (pieces of both), estimated; 0 to 1; 1 for equal ones."""
    n = a["n"] - b["n"]

    def square(d):
        signed = F.pmod(2 * d - n + F.lit(1 << 16), F.lit(1 << 17)) - F.lit(1 << 16)
        return (signed * signed).cast("double")

    each = F.zip_with(a["lanes"], b["lanes"], lambda x, y: square(x.bitwiseAND(F.lit(LOW)) - y.bitwiseAND(F.lit(LOW))) + square(F.shiftright(x, 32) - F.shiftright(y, 32)))
    apart = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / LANES
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / F.greatest(a["n"] + b["n"], F.lit(1)))))


def written(fp: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(fp["n"])), 8, "0"), F.array_join(F.transform(fp["lanes"], lambda x: F.concat(F.lpad(F.lower(F.hex(F.shiftright(x, 32))), 4, "0"), F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(LOW)))), 4, "0"))), ""))


def neighbours(rows: DataFrame, key: str, carry: list[str], tie: str) -> DataFrame:
    """rows with a column `next`: the struct of carry of the row after it.

    Rows are dealt to ranges of the key that quantiles bound (at most BUCKETS ** 2 numbers come to the
    driver); the first row of a range stands also at the end of the range before, so one exchange does.
    """
    n, low, first = rows.agg(F.count(F.lit(1)), F.min(key), F.count_if(F.col(key).isNull())).first()
    if not n:
        return rows.withColumn("next", F.struct(*carry))
    cuts: list = []
    if low is not None:
        wanted = min(BUCKETS * BUCKETS, max(1, n // BUCKET_ROWS))
        got = rows.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)] or [0.5], 20 * wanted)).first()[0]
        cuts = sorted({low, *(x for x in got if x > low)}) if wanted > 1 else [low]
        cuts = cuts[0 if first else 1 :]
    # cuts[i] begins range i + 1; range 0 begins with the nulls or the least key
    outer = cuts[::BUCKETS]
    values = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<long>")
    coarse = F.array(*map(F.lit, outer)) if cuts else F.array().cast("array<long>")
    at = F.size(F.filter(coarse, lambda x: x <= F.col(key)))
    fine = F.size(F.filter(F.slice(values, F.greatest((at - 1) * BUCKETS, F.lit(0)) + 1, F.when(at > 0, BUCKETS).otherwise(0)), lambda x: x <= F.col(key)))
    bucket = F.coalesce(F.greatest((at - 1) * BUCKETS, F.lit(0)) + fine, F.lit(0))
    last = len(cuts)
    own = rows.withColumn("_b", bucket)
    head = F.col(key).isNull() if first else F.col(key) == F.lit(low)
    begins = head if not cuts else head | F.exists(F.slice(values, F.greatest(F.col("_b"), F.lit(1)), 1), lambda x: (x == F.col(key)) & (F.col("_b") > 0))
    both = own.withColumn("_at", F.explode(F.when(F.coalesce(begins, F.lit(False)), F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost")), F.struct(F.when(F.col("_b") == 0, last).otherwise(F.col("_b") - 1).alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost"))))))
    w = Window.partitionBy("_at.b").orderBy(F.col("_at.ghost"), F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first())
    return both.withColumn("next", F.lead(F.struct(*carry)).over(w)).where(~F.col("_at.ghost")).drop("_at", "_b")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each text, and it
    with its last quarter replaced by the next text's first characters."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("n", F.char_length("t").cast("long")).withColumn("f", fingerprint(F.col("t")))
    got = neighbours(rows, key, ["t", "f"], "t").withColumn("k", F.floor(F.col("n") / 4).cast("int"))
    got = got.withColumn("e", F.concat(F.substring(F.col("t"), F.lit(1), (F.col("n") - F.col("k")).cast("int")), F.substring(F.col("next.t"), F.lit(1), F.col("k"))))
    got = got.select(key, "n", "f", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("e")).alias("g"), F.col("next.f").alias("h"))
    return got.select(key, F.col("n").alias("n_chars"), "edited_sha256", written(F.col("f")).alias("fingerprint"), written(F.col("g")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("h")).alias("near_next"))
