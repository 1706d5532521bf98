"""Secret scans: character Markov models of random strings and of ordinary identifiers.

Base spans come from fixed patterns and always stay. Beside them, long tokens of letters and
digits and signs of base64 are scored: two first-order Markov models over characters, trained from labelled samples, give a
log-likelihood ratio for each character. Samples of secrets are strings that are random by construction (hex, base32, base64 and
alphanumeric digests of numbers); samples of ordinary identifiers are all words of all documents, counted by word first. Tokens
above THRESHOLD and with letters and digits mixed are added as kind `random`.

DataFrame functions only. The models' tables hold at most 66 * 66 entries, whatever the input.

Positions: every match is marked in a copy of the text with a character that no pattern accepts, and
lengths of the parts before it are added up; texts that hold the mark have it replaced by another such character first.

Cases: null text is empty. Spans are in code points, end exclusive. Matches of one kind don't overlap; an added token that overlaps a base
span is left out. Rows of repeated or null doc_id are scanned each by their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_hash, stored

KINDS = ("assign", "access", "hex", "random")
# The contract's patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=@-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])"
MARK, OTHER = "\x01", "\x02"
#: Numbers whose digests are the random sample.
RANDOM = 400
THRESHOLD = 0.15


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, stop, s)> of all leftmost matches, in code points."""
    plain = F.regexp_replace(text, MARK, OTHER)
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,stop:int,s:string>>").alias("out"))

    def step(acc, part):
        end = acc["at"] + F.char_length(part)
        one = F.struct(acc["at"].alias("start"), end.alias("stop"), part.alias("s"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(parts, zero, step, lambda a: a["out"])).otherwise(F.array().cast("array<struct<start:int,stop:int,s:string>>"))


def base(text: Column) -> list[Column]:
    group = lambda s: F.regexp_extract(s, ASSIGN, 1)
    return [F.filter(matches(text, ASSIGN), lambda m: F.char_length(group(m["s"])) >= 6), F.filter(matches(text, ACCESS), lambda m: F.char_length(m["s"]) >= 20), matches(text, HEX)]


def steps(token: Column) -> Column:
    """The pairs of neighbouring characters; the first pairs with a blank."""
    return F.transform(F.sequence(F.lit(1), F.char_length(token)), lambda i: F.substring(F.concat(F.lit(" "), token), i, F.lit(2)))


def fit(docs: DataFrame, text: str = "text") -> DataFrame:
    """pair, llr: the log-likelihood ratio of each pair of characters, random against ordinary."""
    spark = docs.sparkSession
    words = F.split(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z0-9_]+")
    ordinary = docs.select(F.explode(words).alias("s")).where(F.char_length("s") > 3).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("s").rlike("^[A-Za-z][A-Za-z_]{3}"))
    d = F.sha2(F.col("id").cast("string").cast("binary"), 512)
    b64 = F.base64(F.unhex(d))
    random = spark.range(RANDOM).select(F.explode(F.array(F.substring(d, 1, 40), F.translate(F.substring(b64, 1, 40), "\r\n", ""), F.regexp_replace(b64, "[^A-Za-z0-9]", ""), F.upper(F.regexp_replace(b64, "[^A-Za-z2-7]", "")))).alias("s"), F.lit(1).alias("n"))
    pairs = lambda df, name: df.select(F.explode(steps(F.col("s"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias(name))
    got = pairs(ordinary, "o").join(pairs(random, "r"), "pair", "full").select("pair", F.substring("pair", 1, 1).alias("a"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("r", F.lit(0)).alias("r"))
    got = stored(got, "pairs").withColumn("b", F.substring("pair", 2, 1))
    of = got.groupBy("a").agg(F.sum("o").alias("ao"), F.sum("r").alias("ar"))
    to = got.groupBy("b").agg(F.sum("o").alias("bo"), F.sum("r").alias("br"))
    no, nr = got.agg(F.sum("o"), F.sum("r")).first()
    # pairs are smoothed toward the second character's own share, so that rare first characters tell nothing
    rate = lambda x, n: F.log((F.col(x) + 33.0 * (F.col(f"b{x}") + 0.5) / ((n or 0) + 33.0)) / (F.col(f"a{x}") + 33.0))
    return stored(got.join(of, "a").join(to, "b").select("pair", (rate("r", nr) - rate("o", no)).alias("llr")), "markov")


def scored(tokens: DataFrame, model: DataFrame, by: list[str], token: str) -> DataFrame:
    """by and llr: the mean log-likelihood ratio for each character of a token. An unseen pair counts 0."""
    # at most 66 * 66 rows: the alphabet of TOKEN and the blank
    return tokens.select(*by, F.explode(steps(F.col(token))).alias("pair")).join(F.broadcast(model), "pair", "left").groupBy(*by).agg(F.avg(F.coalesce("llr", F.lit(0.0))).alias("llr"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, base and found: arrays of struct(start, kind, stop), by start and kind. found has all spans."""
    model = fit(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    a, c, h = base(t)
    kind = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["stop"].alias("stop"))
    spans = F.array_sort(F.concat(*(F.transform(x, kind(k)) for k, x in enumerate((a, c, h)))))
    mixed = F.filter(matches(t, TOKEN), lambda m: m["s"].rlike("[0-9]") & m["s"].rlike("[A-Za-z]"))
    rows = stored(docs.select(F.col(key).alias("k"), row_hash(key, text).alias("r"), spans.alias("base"), mixed.alias("more")).withColumn("more", F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))), "secrets")
    tokens = rows.where(F.size("more") > 0).select(F.explode("more.s").alias("s")).distinct()
    llr = scored(tokens, model, ["s"], "s").where(F.col("llr") >= threshold)
    loose = rows.where(F.size("more") > 0).select("k", "r", F.explode("more").alias("m"))
    kept = loose.join(llr, F.col("m.s") == F.col("s"), "left_semi").groupBy(F.col("k").alias("k2"), F.col("r").alias("r2")).agg(F.array_distinct(F.collect_list(kind(3)(F.col("m")))).alias("added"))
    return rows.join(kept, F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2")), "left").select(F.col("k").alias(key), "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,stop:int>>")))).alias("found"))


def written(spans) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
