"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is WINDOW
consecutive words of an item, or a whole shorter item. A window can be within a document only if all its
words are, so its rarest word is a necessary prefix token: the window's words are ordered by their
count over all documents, and only the rarest is joined with the documents' words. The joined word's
position fixes where the window must begin and end; places outside the document are dropped (length and
positional bounds), and the rest is verified word by word.

Documents are dealt in blocks of BLOCK words, each with as many words around it as a window
needs, so that a match is verified in its own row, and long documents don't burden one task.

DataFrame functions only. The item side is broadcast only if its windows and names have at most MAX_BROADCAST bytes; else
Spark joins it by shuffle. Cases: null or empty texts have no words, so no hits; an item without words has no window; items with
equal windows are all named; rows of repeated or null doc_id are judged each by its own text; null item_id is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_hash, stored, without

WINDOW = 13
BLOCK = 64
#: Bytes of windows' words and items' names up to which the item side is broadcast.
MAX_BROADCAST = 32 << 20
# Fixed value: characters that separate words, after A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words; A-Z only, also in texts with other letters."""
    t = F.coalesce(text, F.lit(""))
    # lower() is far faster than translate() and the same on ASCII
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each different window: win (words), item_ids (all items with it, sorted as strings)."""
    n = F.size("w")
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(n > 0)
    rows = rows.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).alias("i"))
    return rows.groupBy(F.slice("w", F.col("i"), window).alias("win")).agg(F.sort_array(F.collect_set("item")).alias("item_ids"))


def join(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Verified occurrences: k, r (key and hash of the row), start (word number from 0), len, item_ids."""
    wins = stored(windows(items, item_key, item_text, window).withColumn("id", F.xxhash64("win")), "windows")
    size = F.octet_length(F.concat_ws(" ", "win")) + F.octet_length(F.concat_ws(",", "item_ids")) + 64
    small = (wins.agg(F.sum(size.cast("long"))).first()[0] or 0) <= MAX_BROADCAST
    hint = F.broadcast if small else (lambda df: df)
    wide = docs.select(F.col(key).alias("k"), row_hash(key, text).alias("r"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    rarity = stored(wide.select(F.explode("w").alias("word")).join(hint(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "rarity")
    # the rarest word of each window; a window with a word that no document has can't occur
    each = wins.select("win", "item_ids", F.posexplode("win").alias("offset", "word")).join(rarity, "word", "left")
    prefix = each.groupBy("win", "item_ids").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("offset"))).alias("p")).where("p.n > 0")
    prefix = stored(prefix.select(F.col("p.word").alias("word"), F.col("p.offset").alias("offset"), F.size("win").alias("len"), "win", "item_ids"), "prefix")
    n = F.size("w")
    block = F.explode(F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).alias("from")
    cut = wide.select("k", "r", n.alias("n"), "w", block)
    side = F.greatest(F.col("from") - (window - 1), F.lit(0))
    cut = cut.select("k", "r", "n", "from", side.alias("base"), F.slice("w", side + 1, BLOCK + 2 * (window - 1)).alias("b"))
    # blocks carry few words more than their own: one row for each of these, its block beside it
    own = cut.select("k", "r", "n", "base", "from", "b", F.posexplode(F.slice("b", F.col("from") - F.col("base") + 1, BLOCK)).alias("at", "word"))
    found = own.join(hint(prefix), "word").withColumn("start", F.col("from") + F.col("at") - F.col("offset"))
    found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    found = found.where(F.slice("b", F.col("start") - F.col("base") + 1, F.col("len")) == F.col("win"))
    return found.select("k", "r", "start", "len", "item_ids")


def judged(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """k, r (key and hash of the row), n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of docs."""
    hits = stored(join(docs, items, key, text, item_key, item_text, window), "hits")
    # starts of a document are few numbers, at most one for each of its words
    covered = hits.select("k", "r", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy("k", "r").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("k", "r", F.explode("item_ids").alias("i")).distinct().groupBy(F.col("k").alias("k2"), F.col("r").alias("r2")).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("i")), ",").alias("ids"))
    found = stored(covered.join(named, F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2"))).drop("k2", "r2"), "contaminated")
    n_words = docs.select(F.col(key).alias("key"), row_hash(key, text).alias("row"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    got = n_words.join(found, F.col("key").eqNullSafe(F.col("k")) & (F.col("row") == F.col("r")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return got.select(F.col("key").alias("k"), F.col("row").alias("r"), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of docs."""
    return judged(docs, items, key, **names).drop("r").withColumnRenamed("k", key)


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """docs without those that are contaminated; all columns stay."""
    bad = stored(judged(docs, items, key, text, **names).where("contaminated").select("k", "r"), "bad")
    return without(docs, bad, key, text)
