"""Ranked lexical search: three-phase uniform-threshold top-k (TPUT) over term-partitioned postings.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; they are compared as 64-bit hashes.
Postings of the queries' terms lie in a table dealt by term and block of documents, so that a
frequent term's list is in several places; nobody holds a whole list. Scores are those of the contract: an integer weight of the term
times an integer part that grows with the term's count in a document and falls with the document's length.

Phase 1 takes the first K postings of each list. Their sums name documents of which the best are scored exactly;
the K-th score tau is a lower bound, and a list's first posting bounds all others. Phase 2: one threshold for all lists of an item, the
largest t for which a document with at most t in each list (and no more than the list's first) stays below SHARE of tau;
postings above it are fetched from every list, lists that never pass it aren't read. They are dealt by document and added up; a document's sum and
t for each list that it wasn't seen in bound its score, and sums raise tau. Phase 3 looks up exact scores of documents whose bound reaches tau. None that belongs to the
first K can be left out: one that wasn't fetched is below tau.

Cases: null and empty texts have no terms: such documents are in no list and don't count, such items give no rows. Equal scores are
ordered by key, nulls first; rows of null or repeated key are documents of their own. Repeated rows of the same item and text are one item, an item of
several texts has the first documents of each. Both tables may have any further columns. No documents or items: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_value, byte_values, runs, small_batches, spans, stored, strings, tidy
from tessera.llm.linking import filter_of, groups, passing

by_value(__name__)
K = 20
#: Documents of phase 1 that are scored exactly for the lower bound, for each item.
TRIED = 3 * K
#: Share of the lower bound that documents outside of phase 2 may reach; any up to 1 is right, less fetches more postings and looks up fewer documents.
SHARE = 0.2
#: Items whose lists are asked for at once, about; more are taken in blocks.
ITEMS = 512
_ROW = 40


def term_classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    c[48:58] = c[65:91] = c[97:123] = 1
    c[128:] = 1
    return c


def _terms(column):
    """For runs of rows: first row, number of rows, rows of the terms (from 0), hashes of the terms."""
    u8, offs = strings(column)
    cls, val = term_classes(), byte_values(True)
    for a, b in spans(offs):
        cut = offs[a : b + 1] - offs[a]
        h, at, _ = runs(u8[offs[a] : offs[b]], cut, cls, val)
        yield a, b - a, np.searchsorted(cut, at, "right") - 1, h


def _counted(row: np.ndarray, h: np.ndarray):
    """Distinct (row, h) with their counts."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(at, append=len(h))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """q (of the item and its text), term, times."""
    def run(batches):
        for b in batches:
            q = b.column("q")
            for a, _, row, h in _terms(b.column("t")):
                r, t, n = _counted(row, h)
                yield pa.RecordBatch.from_arrays([q.take(pa.array(r + a)), pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["q", "term", "times"])

    return items.select(F.xxhash64(key, text).alias("q"), F.col(text).alias("t")).distinct().mapInArrow(tidy(run), "q bigint, term bigint, times bigint")


def postings(docs: DataFrame, terms: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings row, term, tf, n of at least terms(item), dealt by term and block of rows, and the documents with a term: row, key, n (their terms)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filter_of(terms))  # a fixed size
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << _ROW
        for b in batches:
            keys = b.column("k")
            for a, m, row, h in _terms(b.column("t")):
                n = np.bincount(row, minlength=m)
                own = np.flatnonzero(n)
                hit = passing(shared.value, h.view(np.int64))
                r, t, tf = _counted(row[hit], h[hit])
                every = np.concatenate([own, r])
                of = keys.slice(a, m).take(pa.array(np.concatenate([own, np.full(len(r), -1)]), mask=np.arange(len(every)) >= len(own)))
                # a document's own row has no term
                cols = [pa.array(first + a + every), of, pa.array(np.concatenate([np.zeros(len(own), np.int64), t.view(np.int64)]), mask=np.arange(len(every)) < len(own)), pa.array(np.concatenate([np.zeros(len(own), np.int32), tf.astype(np.int32)])), pa.array(n[every])]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "k", "term", "tf", "n"])
            first += b.num_rows

    with small_batches(spark):
        rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(run), f"row bigint, k {kind}, term bigint, tf int, n bigint")
        # a document's own row goes by its block and number, a posting by its term and block
        block = F.shiftright("row", _ROW + 3)
        rows = stored(rows.repartition(F.coalesce("term", "row"), block).sortWithinPartitions("term"), "postings")
    return rows.where("term is not null").drop("k"), rows.where("term is null").select("row", "k", "n")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """q, tau: the k-th highest score of scores(q, row, score), 0 if there are fewer."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
    top = scores.withColumn("place", place).where(F.col("place") <= k)
    return top.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0).alias("tau"))


def _exact(wanted: DataFrame, lists: DataFrame, probes: DataFrame) -> DataFrame:
    """q, row, score of wanted(q, row), over all lists of the item."""
    got = lists.join(wanted, "row").join(probes.select("q", "term", "weight"), ["q", "term"])
    return got.groupBy("q", "row").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def thresholds(probes: DataFrame, tau: DataFrame, share: float) -> DataFrame:
    """q, t, rest: the uniform threshold of an item's lists and what a document that passes it nowhere can reach. probes(q, most): a list's greatest score.

    A document with at most t in each list reaches sum(min(t, most)). With the i least lists summed to p of m, that is the
    least of p + (m - i) * t, so the largest t below a goal is the greatest of (goal - p) div (m - i).
    """
    by = Window.partitionBy("q").orderBy("most").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.greatest(F.floor(F.col("tau") * F.lit(share)).cast("bigint") - 1, F.lit(0))
    rows = probes.join(tau, "q").select("q", "most", "tau", goal.alias("goal"), F.coalesce(F.sum("most").over(by), F.lit(0)).alias("p"), F.count(F.lit(1)).over(by).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("q")).alias("m"))
    t = rows.groupBy("q").agg(F.greatest(F.lit(0), F.max(F.expr("(goal - p) div (m - i)"))).alias("t"))
    return rows.join(t, "q").groupBy("q", "t", "tau").agg(F.sum(F.least("most", "t")).alias("rest"))


def _fetched(lists: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, row, seen (the sum over lists where the posting passes), most (what the whole score can be): documents that can be among an item's first k.

    Postings that pass for an item at least are dealt by document; a task adds them up for all items, which are few (a block), and
    leaves out documents whose bound is below tau or below the k-th sum that it has seen itself.
    """
    rows = asked.select("q", "term", "weight", "least", "t", "tau", "rest").toPandas()  # at most ITEMS items' lists
    rows = rows.sort_values("term", kind="stable")
    q, col = np.unique(rows["q"].to_numpy(np.int64), return_inverse=True)
    term, begin = np.unique(rows["term"].to_numpy(np.int64), return_index=True)
    begin = np.append(begin, len(rows))
    weight, least = rows["weight"].to_numpy(np.int64), rows["least"].to_numpy(np.int64)
    t, tau, rest = (np.zeros(len(q), np.int64) for _ in range(3))
    for to, name in ((t, "t"), (tau, "tau"), (rest, "rest")):
        to[col] = rows[name].to_numpy(np.int64)
    shared = lists.sparkSession.sparkContext.broadcast((q, col, term, begin, weight, least, t, tau, rest))

    def run(batches):
        q, col, term, begin, weight, least, t, tau, rest = shared.value
        best = np.zeros((k, len(q)), np.int64)
        for table in groups(batches, ["row"]) if len(q) else ():
            docs, doc = np.unique(table.column("row").to_numpy(), return_inverse=True)
            part, place = table.column("part").to_numpy(), np.searchsorted(term, table.column("term").to_numpy())
            n = begin[place + 1] - begin[place]
            at = np.repeat(begin[place] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            pair = np.repeat(np.arange(len(n)), n)
            some = part[pair] >= least[at]
            at, pair = at[some], pair[some]
            score, cell, size = part[pair] * weight[at], doc[pair] * len(q) + col[at], len(docs) * len(q)
            # floats add up exactly to 2**53, so halves of the scores are added
            high, low, times = (np.bincount(cell, w, size).astype(np.int64).reshape(len(docs), -1) for w in (score >> 24, score & (2**24 - 1), None))
            seen = (high << 24) + low
            best = -np.partition(-np.concatenate([best, seen]), k - 1, axis=0)[:k]
            most = seen + rest - t * times
            d, c = np.nonzero((seen > 0) & (most >= tau) & (most >= best.min(axis=0)))
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(q[c]), pa.array(docs[d]), pa.array(seen[d, c]), pa.array(most[d, c])], names=["q", "row", "seen", "most"])

    lowest = asked.groupBy("term").agg(F.min("least").alias("lowest"))
    fetched = lists.join(lowest, "term").where("part >= lowest").select("row", "term", "part")
    return fetched.repartition("row").sortWithinPartitions("row").mapInArrow(tidy(run), "q bigint, row bigint, seen bigint, most bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank (from 1), key, score: each item's k documents of highest score above 0."""
    wanted = stored(item_terms(items, item, item_text), "items")
    lists, own = postings(docs, wanted.select(F.col("term").alias("item")).distinct(), key, text)
    total = own.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()  # two numbers
    count, length = max(1, total["N"]), max(1, total["L"])
    m = F.lit(75) + F.expr(f"(25 * n * {count}L) div {length}L")
    lists = lists.withColumn("m", m).select("row", "term", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)").alias("part"))
    # df counts documents, as a posting is one; the first postings of each list bound it
    terms = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("first"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1))).cast("bigint")
    probes = stored(wanted.join(terms, "term").select("q", "term", (F.col("times") * weight).alias("weight"), "first").where("weight > 0").withColumn("most", F.col("weight") * F.col("first")), "probes")

    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("part").desc(), "row"))
    used = probes.select("term").distinct()
    heads = lists.join(used, "term").withColumn("place", place).where(F.col("place") <= k).select("term", "row", "part")
    sums = heads.join(probes, "term").groupBy("q", "row").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "row"))
    tried = stored(sums.withColumn("place", best).where(F.col("place") <= max(TRIED, k)).select("q", "row"), "tried")
    bounds = stored(thresholds(probes, _kth(_exact(tried, lists, probes), k), SHARE), "bounds")

    asked = stored(probes.join(bounds, "q").where("most > t").select("q", "term", "weight", "t", "tau", "rest", F.expr("t div weight + 1").alias("least")), "asked")
    blocks = max(1, -(-bounds.count() // ITEMS))
    part = [stored(_fetched(lists, asked.where(F.pmod("q", F.lit(blocks)) == i), k), "candidates") for i in range(blocks)]
    seen = part[0]
    for other in part[1:]:
        seen = seen.union(other)
    # sums of what was seen raise the lower bound once more
    low = _kth(seen.select("q", "row", F.col("seen").alias("score")), k)
    left = stored(seen.join(low, "q").where("most >= tau").select("q", "row"), "left")

    scores = _exact(left, lists, probes).where("score > 0").join(own.select("row", "k"), "row")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("k").asc_nulls_first(), "row"))
    top = scores.withColumn("rank", rank).where(F.col("rank") <= k)
    names = items.select(F.xxhash64(item, item_text).alias("q"), F.col(item).alias("item")).distinct()
    return top.join(names, "q").select(F.col("item").alias(item), "rank", F.col("k").alias(key), "score")
