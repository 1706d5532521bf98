"""N-gram Jaccard join of documents: a grouped prefix join.

A document's set are its distinct SHINGLE-word shingles (64-bit hashes); with fewer words the whole
sequence is one. Two documents link if DEN * intersection >= NUM * union. Sets are ordered by rarity:
counts of hash buckets over all documents, then the hash. If two sets link, the first n - ceil(3n/4) + 1
values of both have one in common (prefix filter). Documents with equal prefix and size form one
group, which stands in the index once; equal sets are one member. Families of groups that share prefix values are divided
by size, and groups that meet none of a fitting size are dropped; what is left is
expanded to its members; pairs of members pass a length and a bitmap test, then they are verified exactly on whole sets.
The number of links is that of other classes whose set links, counted over all pairs; documents with equal sets have the same number.

Cases: null and empty texts have an empty set and link with nothing; null keys link with nothing and are their own
class (null). Rows of equal key are one document for links; each row is returned. Without documents, no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, by_value, byte_values, mix, runs, shingles, slices_of, small_batches, space_classes, spans, stored, strings, sum_slices, tidy
from tessera.llm.linking import bitmap, by_size, components, families, filter_of, link, passing, size_class

by_value(__name__)
SHINGLE = 5
NUM, DEN = 75, 100
#: Buckets of the rarity counts; a fixed size. Any order that all sets share gives right results; counts make it a fast one.
RARITY_BITS = 18
_WIDTH = 1 << 13
#: Least bits of a set's bitmap, which drops most pairs before whole sets are moved.
BITS = 1024


def sets(column, k: int = SHINGLE):
    """Sorted distinct shingles of each text of an Arrow column."""
    u8, offs = strings(column)
    cls, val = space_classes(), byte_values(True)
    for a, b in spans(offs):
        cut = offs[a : b + 1] - offs[a]
        h, at, _ = runs(u8[offs[a] : offs[b]], cut, cls, val)
        edge = np.searchsorted(at, cut)
        every = shingles(h, k)
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            s = np.sort(every[i : j - k + 1] if j - i >= k else shingles(h[i:j], k))
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def buckets(s: np.ndarray) -> np.ndarray:
    return (s >> U64(64 - RARITY_BITS)).astype(np.int64)


def rarity(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Occurrences of each bucket's shingles, repeats counted; texts of fewer than k words don't count."""
    def run(batches):
        out = np.zeros(1 << RARITY_BITS, np.int64)
        for b in batches:
            u8, offs = strings(b.column("t"))
            for i, j in spans(offs):
                cut = offs[i : j + 1] - offs[i]
                h, at, _ = runs(u8[offs[i] : offs[j]], cut, space_classes(), byte_values(True))
                row = np.searchsorted(cut, at, "right")
                if len(h) >= k:
                    out += np.bincount(buckets(shingles(h, k)[row[: len(h) - k + 1] == row[k - 1 :]]), minlength=1 << RARITY_BITS)
        yield slices_of(out, _WIDTH)

    with small_batches(docs.sparkSession):
        return sum_slices(docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), "part int, slice int, counts binary"), _WIDTH, RARITY_BITS)


def rarest(s: np.ndarray, rare: np.ndarray, n: int) -> np.ndarray:
    """The first n of sorted s by count, then by value."""
    order = np.sort((rare[buckets(s)].astype(U64) << U64(32)) | np.arange(len(s), dtype=U64))
    return s[(order[:n] & U64(2**32 - 1)).astype(np.int64)]


def _hash(s: np.ndarray, salt: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ U64(salt)).sum(dtype=U64) + U64(len(s))).view(np.int64)) if len(s) else 0


def prefixes(docs: DataFrame, counts: np.ndarray, key: str, text: str, num: int, den: int, k: int) -> DataFrame:
    """doc, n, h (of the set), g (of size and prefix), prefix and bits (of the set); the last two once for each set in a task, else null."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # 2**RARITY_BITS numbers

    def run(batches):
        rare, seen = shared.value, set()
        for b in batches:
            n, h, g, prefix, bits = [], [], [], [], []
            for s, keyed in zip(sets(b.column("t"), k), b.column("doc").is_valid().to_pylist(), strict=True):
                m, whole, own = len(s), _hash(s, 0), 0
                # null keys link with nothing, so they never stand for their set
                fresh = m > 0 and keyed and whole not in seen
                if m:
                    p = rarest(s, rare, m - -(-num * m // den) + 1)
                    own = _hash(p, m)
                if fresh and len(seen) < 1 << 20:
                    seen.add(whole)
                n.append(m)
                h.append(whole)
                g.append(own)
                prefix.append(p.tobytes() if fresh else None)
                bits.append(bitmap(s, BITS) if fresh else None)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())], names=["doc", "n", "h", "g", "prefix", "bits"])

    return docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).mapInArrow(tidy(run), "doc bigint, n bigint, h bigint, g bigint, prefix binary, bits binary")


def tokens(rows: DataFrame, num: int, den: int, bits: np.ndarray | None = None) -> DataFrame:
    """token, item, s: the prefixes' values with their group and its size class; with bits only values that pass this filter."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)  # a fixed size

    def run(batches):
        for b in batches:
            n = np.array([len(x.as_buffer()) // 8 for x in b.column("prefix")], np.int64)
            token = np.frombuffer(b"".join(x.as_buffer() for x in b.column("prefix")), np.int64)
            item, s = (np.repeat(x, n) for x in (b.column("g").to_numpy(), size_class(b.column("n").to_numpy(), num, den)))
            if shared is not None:
                hit = passing(shared.value, token)
                token, item, s = token[hit], item[hit], s[hit]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(item), pa.array(s)], names=["token", "item", "s"])

    return rows.where("prefix is not null and doc is not null").select("g", "n", "prefix").mapInArrow(tidy(run), "token bigint, item bigint, s int")


def sets_of(docs: DataFrame, text: str, k: int):
    """A function that gives item (a set's hash) and s (the set) for at least the items wanted, each once."""
    def make(wanted: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))  # a fixed size

        def run(batches):
            seen = set()
            for b in batches:
                for s in sets(b.column("t"), k):
                    h = _hash(s, 0)
                    if len(s) and h not in seen and passing(shared.value, np.array([h]))[0]:
                        if len(seen) < 1 << 20:
                            seen.add(h)
                        # a set at a time, so that memory is that of one
                        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["item", "s"])

        return docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), "item bigint, s binary").dropDuplicates(["item"])

    return make


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, k: int = SHINGLE) -> DataFrame:
    """key, n_shingles, component_id, class_id (least document with an equal set), links (with other classes); one row for each row of docs."""
    counts = rarity(docs, text, k)
    with small_batches(docs.sparkSession):
        rows = stored(prefixes(docs, counts, key, text, num, den, k), "sets")
    some = rows.where("n > 0 and doc is not null")
    reps = stored(some.groupBy("h", "g", "n").agg(F.min("doc").alias("rep"), F.first("bits", ignorenulls=True).alias("bits")), "reps")
    # a group of several members is a family of its own
    own = reps.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("g").alias("item"), F.col("g").alias("p"))
    sized = by_size(families(tokens(rows, num, den), lambda bits: tokens(rows, num, den, bits)))
    fams = sized.union(own).groupBy("item").agg(F.collect_set("p").alias("fams"))
    members = reps.join(fams.hint("merge"), F.col("g") == F.col("item")).select(F.explode("fams").alias("p"), F.col("h").alias("item"), "n", "bits", "fams")
    with small_batches(docs.sparkSession):  # whole sets are as long as texts
        linked = stored(link(members, sets_of(docs.where(F.col(key).isNotNull()), text, k), num, den), "linked")
    comp = components(linked.select(F.col("item").alias("a"), F.col("root").alias("b")))
    number = linked.groupBy("item").agg(F.sum("links").alias("links"))
    labels = stored(reps.select("h", "rep").join(comp.join(number, "item", "left"), F.col("h") == F.col("item"), "left").select("h", "rep", F.coalesce("comp", "h").alias("comp"), F.coalesce("links", F.lit(0)).alias("links")), "labels")
    least = labels.groupBy("comp").agg(F.min("rep").alias("least"))
    mine = (F.col("n") > 0) & F.col("doc").isNotNull()
    got = rows.select("doc", "n", "h").join(labels.join(least, "comp").select("h", "rep", "least", "links"), "h", "left")
    return got.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(mine, F.col("least")).otherwise(F.col("doc")).alias("component_id"), F.when(mine, F.col("rep")).otherwise(F.col("doc")).alias("class_id"), F.when(mine, F.col("links")).otherwise(F.lit(0)).alias("links"))


def one_of_each(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs without those that aren't the least of their component; all columns stay."""
    name = f"gone_{uuid.uuid4().hex}"
    gone = stored(join(docs, key, **options).where(F.col("component_id") != F.col(key)).select(F.col(key).alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(key).cast("bigint") == F.col(name), "left_anti")
