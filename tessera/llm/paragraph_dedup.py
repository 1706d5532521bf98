"""Substring dedup: near copies of lines by MinHash, and word runs that are equal anywhere.

Near copies: units are lines; a line of more than LONG words is cut where its words' hashes say so. A
unit's set are its distinct five-word shingles. Equal word sequences are one item. BANDS bands of ROWS MinHash
values are tuned for recall: 0.9987 of the pairs at Jaccard 0.75 collide, more above it; items in one band's family are verified
by exact Jaccard, and components are classes of repeats. Units of fewer than LEAST shingles match only if they are equal: they have no bands.

Equal runs: every RUN consecutive words of a document, across lines and from any word on, are a window. A window's anchor
is its GRAM words with the least hash, so equal windows have equal anchors. Windows whose anchor stands at several places are
compared by hash, all of one anchor together; so every run of RUN words or more that occurs twice is found to the word.

A passage is a run of neighbouring or overlapping units and windows that occur several times, of at
least MIN_WORDS words. The first occurrence of a class or window (by document, then place) stays, the others are to be removed.

Cases: null and empty texts have no unit; blank lines are none. Units of fewer than five words are one shingle. Rows of equal key are
one document whose units repeat each other only if they differ in place. Null keys are left out. No repeats: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, by_value, byte_values, mix, runs, shingles, shingles_at, space_classes, spans, stored, strings, tidy
from tessera.llm.linking import _and_none, bitmap, components, families, filter_of, link, passing

by_value(__name__)
SHINGLE = 5
NUM, DEN = 75, 100
BANDS, ROWS = 8, 2
LEAST = 3
#: Least bits of a unit's bitmap.
BITS = 512
MIN_WORDS = 40
#: Words of a window and of its anchor.
RUN, GRAM = 40, 8
#: Bits of the filter over anchors that occur several times; a fixed size. What passes it is compared exactly.
ANCHOR_BITS = 26
#: Anchors at more places than this go by way of their windows, which are combined before they are moved.
HOT = 4096
LONG = 80
CUT_MIN, CUT_MASK = 12, 15
#: Lower bits of a shingle that are left out.
LOW = U64(20)


def units(u8: np.ndarray, offs: np.ndarray):
    """Word hashes, and for each unit its row, first word and end word. Units have a word at least."""
    h, at, _ = runs(u8, offs, space_classes(), byte_values(True))
    if not len(h):
        return h, *(np.zeros(0, np.int64) for _ in range(3))
    row = np.searchsorted(offs, at, "right") - 1
    line = np.searchsorted(np.flatnonzero(u8 == 10), at)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    ends = np.append(first[1:], len(h))
    if (ends - first > LONG).any():
        more = [first]
        for a, b in zip(first[ends - first > LONG], ends[ends - first > LONG], strict=True):
            marks, last = np.flatnonzero((h[a:b] >> U64(20)) & U64(CUT_MASK) == 0) + a + 1, a
            for m in marks:
                if m - last >= CUT_MIN and b - m >= CUT_MIN:
                    more.append(np.array([m]))
                    last = m
        first = np.sort(np.concatenate(more))
        ends = np.append(first[1:], len(h))
    return h, row[first], first, ends


def _sets(h, first, ends):
    """All units' distinct shingles one after the other, each unit's sorted, and the number of each.

    Shingles keep their upper 44 bits, so that they sort as one number with their unit's; two
    sets of a hundred shingles meet by chance once in a thousand million pairs.
    """
    n = ends - first
    out_n = np.maximum(n - SHINGLE + 1, 1)
    begin = np.cumsum(out_n) - out_n
    of = np.repeat(np.arange(len(first)), out_n)
    at = np.arange(len(of)) + np.repeat(first - begin, out_n)
    s = shingles(h, SHINGLE)[np.minimum(at, max(len(h) - SHINGLE, 0))]
    for m in range(1, SHINGLE):
        few = np.flatnonzero(n == m)
        s[begin[few]] = shingles_at(h, first[few], m)
    s >>= LOW
    if len(first) < 1 << int(LOW):
        both = np.sort((of.astype(U64) << (U64(64) - LOW)) | s)
        new = np.concatenate([[True], both[1:] != both[:-1]])
        both = both[new]
        return both << LOW, np.bincount((both >> (U64(64) - LOW)).astype(np.int64), minlength=len(first))
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])])
    return s[new] << LOW, np.bincount(of[new], minlength=len(first))


def _blocks(column):
    u8, offs = strings(column)
    for a, b in spans(offs):
        h, row, first, ends = units(u8[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        if len(h):
            s, n = _sets(h, first, ends)
            place = np.arange(len(h)) - np.repeat(first, ends - first)
            item = mix(np.add.reduceat(mix(h + place.astype(U64) * U64(0xA0761D6478BD642F)), first) + (ends - first).astype(U64))
            yield a + row, first, ends, s, n, np.cumsum(n) - n, item.view(np.int64)


def unit_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, unit (number in the document), word (its first one's number), n_words, item (hash of the words in order), bands (hashes as binary, null for small sets)."""
    seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    names = ["doc", "unit", "word", "n_words", "item"]

    def run(batches):
        seen = set()
        for b in batches:
            docs_ = b.column("doc")
            for row, first, ends, s, n, at, item in _blocks(b.column("t")):
                out = np.empty((len(n), BANDS), U64)
                for i in range(BANDS):
                    acc = np.full(len(n), U64(i + 1))
                    for j in range(ROWS):
                        v = s * seeds[i * ROWS + j]
                        acc = mix(acc * U64(31) + np.minimum.reduceat(v ^ (v >> U64(32)), at))
                    out[:, i] = acc
                new = [m >= LEAST and x not in seen for m, x in zip(n.tolist(), item.tolist(), strict=True)]
                if len(seen) < 1 << 20:
                    seen.update(item.tolist())
                bands = pa.array([x.tobytes() if y else None for x, y in zip(out, new, strict=True)], pa.binary())
                fresh = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                number = np.arange(len(row)) - np.repeat(fresh, np.diff(fresh, append=len(row)))
                word = first - np.repeat(first[fresh], np.diff(fresh, append=len(row)))
                yield pa.RecordBatch.from_arrays([docs_.take(pa.array(row)), *(pa.array(x) for x in (number, word, ends - first, item)), bands], names=[*names, "bands"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).mapInArrow(tidy(run), ", ".join(f"{x} bigint" for x in names) + ", bands binary")


def tokens(rows: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """token, item: the units' bands; with bits only those that pass this filter."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)  # a fixed size

    def run(batches):
        for b in batches:
            token = np.frombuffer(b"".join(x.as_buffer() for x in b.column("bands")), np.int64)
            item = np.repeat(b.column("item").to_numpy(), BANDS)
            if shared is not None:
                hit = passing(shared.value, token)
                token, item = token[hit], item[hit]
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(item)], names=["token", "item"])

    return rows.where("bands is not null").select("item", "bands").mapInArrow(tidy(run), "token bigint, item bigint")


def unit_sets(docs: DataFrame, text: str, items: DataFrame, small: bool) -> DataFrame:
    """item, s (sorted shingles) for at least the items, each once; with small item, n, bits (their number and bitmap)."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(items))  # a fixed size
    names = ["item", "n", "bits"] if small else ["item", "s"]

    def run(batches):
        bits, seen = shared.value, set()
        for b in batches:
            for _, _, _, s, n, at, item in _blocks(b.column("t")):
                some = [i for i in np.flatnonzero(passing(bits, item)).tolist() if int(item[i]) not in seen]
                one = dict(zip((int(item[i]) for i in some), some, strict=True))
                if len(seen) < 1 << 20:
                    seen.update(one)
                found = [s[at[i] : at[i] + n[i]] for i in one.values()]
                rest = [pa.array([len(x) for x in found], pa.int64()), pa.array([bitmap(x, BITS) for x in found], pa.binary())] if small else [pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(list(one), pa.int64()), *rest], names=names)

    return docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), "item bigint, n bigint, bits binary" if small else "item bigint, s binary").dropDuplicates(["item"])


def anchored(h: np.ndarray, row: np.ndarray):
    """Each window's first word, its anchor's place and hash, and the window's hash; row: each word's document, in order."""
    none = np.zeros(0, np.int64)
    if len(h) < RUN:
        return none, none, none.view(U64), none.view(U64)
    gram = shingles(h, GRAM)
    best = np.arange(len(gram))

    def wider(best, by):
        """The leftmost least gram of two neighbouring ranges, by apart."""
        x, y = best[:-by], best[by:]
        return np.where(gram[y] < gram[x], y, x)

    size, wanted = 1, RUN - GRAM + 1
    while size < wanted:
        by = min(size, wanted - size)
        best, size = wider(best, by), size + by
    at = np.flatnonzero(row[: len(h) - RUN + 1] == row[RUN - 1 :])
    anchor = best[at]
    return at, anchor, gram[anchor], shingles(h, RUN)[at]


def _windows(column):
    """For each block of rows: its first row, each word's row, the first word of each row, and what anchored() gives."""
    u8, offs = strings(column)
    for a, b in spans(offs):
        cut = offs[a : b + 1] - offs[a]
        h, at, _ = runs(u8[offs[a] : offs[b]], cut, space_classes(), byte_values(True))
        row = np.searchsorted(cut, at, "right") - 1
        yield a, row, np.searchsorted(row, np.arange(b - a)), *anchored(h, row)


def anchors(docs: DataFrame, text: str) -> DataFrame:
    """item: the hash of each anchor, once for each place."""
    def run(batches):
        for b in batches:
            for *_, anchor, g, _ in _windows(b.column("t")):
                new = np.flatnonzero(np.diff(anchor, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64))], names=["item"])

    return docs.select(F.col(text).alias("t")).mapInArrow(tidy(run), "item bigint")


def occurrences(docs: DataFrame, key: str, text: str, several: np.ndarray, hot: np.ndarray) -> DataFrame:
    """item (anchor), doc, word (of the first window), s (hashes of the windows with this anchor, one after the other), hot, for at least the anchors of several. several, hot: filters."""
    shared = docs.sparkSession.sparkContext.broadcast((several, hot))  # a fixed size

    def run(batches):
        bits, hot = shared.value
        for b in batches:
            doc = b.column("doc")
            for a, row, begin, at, anchor, g, w in _windows(b.column("t")):
                # windows whose anchors are equal and that follow each other are one row, as in a text of one repeated phrase
                new = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (row[at[1:]] != row[at[:-1]]))) if len(at) else at
                end = np.append(new[1:], len(at))
                item = g[new].view(np.int64)
                hit = passing(bits, item)
                new, end, item = new[hit], end[hit], item[hit]
                own = row[at[new]]
                s = pa.array([w[i:j].tobytes() for i, j in zip(new.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(item), doc.take(pa.array(a + own)), pa.array(at[new] - begin[own]), s, pa.array(passing(hot, item))], names=["item", "doc", "word", "s", "hot"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).mapInArrow(tidy(run), "item bigint, doc bigint, word bigint, s binary, hot boolean")


def _repeated(item, doc, word, s):
    """Spans of windows that occur at several places; whole anchors' rows."""
    n = np.array([len(x) // 8 for x in s], np.int64)
    of = np.repeat(np.arange(len(n)), n)
    w = np.frombuffer(b"".join(s), U64)
    at = word[of] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((at, doc[of], w))
    w, of, at = w[order], of[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    size = np.diff(first, append=len(w))
    last = first + size - 1
    head = np.repeat(first, size)
    same = (doc[of] == doc[of[head]]) & (at == at[head])
    end = np.repeat(last, size)
    several = (doc[of[head]] != doc[of[end]]) | (at[head] != at[end])
    # spans of each row, apart by whether they are to be removed and by gaps
    of, at, gone, from_ = of[several], at[several], ~same[several], doc[of[head]][several]
    by = of * 2 + gone
    order = np.lexsort((at, by))
    by, of, at, gone, from_ = (x[order] for x in (by, of, at, gone, from_))
    if not len(by):
        return by, by, by, gone, by, by
    first = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]) | (at[1:] - at[:-1] > RUN)]))
    last = np.append(first[1:], len(by)) - 1
    return doc[of[first]], at[first], at[last] + RUN, gone[first], item[of[first]], np.minimum.reduceat(from_, first)


def equal_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, lo, hi (words), gone, class_id (the anchor), first: spans of windows that occur at several places."""
    names = ["doc", "lo", "hi", "gone", "class_id", "first"]
    several = stored(anchors(docs.where(F.col(key).isNotNull()), text).groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "anchors")
    found = occurrences(docs, key, text, filter_of(several, ANCHOR_BITS), filter_of(several.where(F.col("c") > HOT), ANCHOR_BITS))
    found = stored(found, "occurrences")

    def run(batches):
        kept = None
        for b in _and_none(batches):
            t = None if b is None else pa.Table.from_batches([b])
            whole = kept if b is None else (t if kept is None else pa.concat_tables([kept, t]))
            if whole is None or not len(whole):
                continue
            item = whole.column("item").to_numpy()
            # the last anchor's rows may go on in the next batch
            cut = len(item) if b is None else int(np.flatnonzero(item != item[-1])[-1] + 1) if item[0] != item[-1] else 0
            now, kept = whole.slice(0, cut), whole.slice(cut)
            if cut:
                got = _repeated(item[:cut], now.column("doc").to_numpy(), now.column("word").to_numpy(), now.column("s").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=names)

    def apart(batches):
        for b in batches:
            s = [x.as_buffer() for x in b.column("s")]
            n = np.array([len(x) // 8 for x in s], np.int64)
            of = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            w = np.frombuffer(b"".join(s), np.int64)
            # places of one window in one kind are one row unless they are further apart than a window is long
            order = np.lexsort((i, w, of))
            w, of, i = w[order], of[order], i[order]
            if not len(w):
                continue
            first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (of[1:] != of[:-1]) | (i[1:] - i[:-1] > RUN)))
            size = np.diff(first, append=len(w))
            second = pa.array(i[np.minimum(first + 1, len(i) - 1)], mask=size < 2)
            cols = [pa.array(w[first]), pa.array(i[first]), second, pa.array(i[first + size - 1]), pa.array(size), *(b.column(k).take(pa.array(of[first])) for k in ("item", "sid", "doc", "word", "c"))]
            yield pa.RecordBatch.from_arrays(cols, names=["w", "lo", "second", "hi", "n", "item", "sid", "doc", "word", "c"])

    rows = found.where("not hot").repartition("item").sortWithinPartitions("item")
    few = rows.select("item", "doc", "word", "s").mapInArrow(tidy(run), "doc bigint, lo bigint, hi bigint, gone boolean, class_id bigint, first bigint")
    # of a hot anchor's rows nearly all have the same windows: these are looked at once, not once a row
    hot = found.where("hot").withColumn("sid", F.xxhash64("s"))
    place = F.struct("doc", "word")
    kinds = hot.groupBy("item", "sid").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("c"), F.first("s").alias("s"))
    kinds = kinds.select("item", "sid", "at.doc", "at.word", "c", "s")
    schema = ", ".join(f"{x} bigint" for x in ("w", "lo", "second", "hi", "n", "item", "sid", "doc", "word", "c"))
    windows = stored(kinds.mapInArrow(tidy(apart), schema), "windows")
    heads = windows.groupBy("w").agg(F.min(F.struct("doc", (F.col("word") + F.col("lo")).alias("at"))).alias("head"), F.sum(F.col("c") * F.col("n")).alias("places")).where("places > 1").select("w", "head")
    own = (F.col("doc") == F.col("head.doc")) & (F.col("word") + F.col("lo") == F.col("head.at"))
    # the first row of a kind may be the first occurrence of some windows; all others are repeats
    one = lambda cls, lo, hi: F.struct(F.lit(cls).alias("cls"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    parts = F.when(own, F.array(one("any", "lo", "hi"), one("kept", "lo", "lo"), one("gone", "second", "hi"))).otherwise(F.array(one("any", "lo", "hi"), one("gone", "lo", "hi")))
    hit = windows.join(heads, "w").select("item", "sid", "doc", "word", F.col("head.doc").alias("first"), F.explode(F.filter(parts, lambda x: x["lo"].isNotNull())).alias("x"))
    hit = hit.select("item", "sid", "doc", "word", "first", "x.cls", "x.lo", "x.hi")
    w = Window.partitionBy("item", "sid", "cls").orderBy("lo", "hi")
    new = F.coalesce(F.col("lo") - F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) > RUN, F.lit(True)).cast("int")
    hit = hit.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans_ = hit.groupBy("item", "sid", "doc", "word", "cls", "run").agg(F.min("lo").alias("lo"), (F.max("hi") + RUN).alias("hi"), F.min("first").alias("first"))
    spans_ = spans_.groupBy("item", "sid", F.col("doc").alias("d"), F.col("word").alias("o")).agg(F.collect_list(F.struct("cls", "lo", "hi", "first")).alias("each"))
    mine = (F.col("doc") == F.col("d")) & (F.col("word") == F.col("o"))
    many = hot.select("item", "sid", "doc", "word").join(spans_, ["item", "sid"]).select("item", "doc", "word", F.explode(F.filter("each", lambda x: (x["cls"] == "any") != mine)).alias("x"))
    many = many.select("doc", (F.col("word") + F.col("x.lo")).alias("lo"), (F.col("word") + F.col("x.hi")).alias("hi"), (F.col("x.cls") != "kept").alias("gone"), F.col("item").alias("class_id"), F.col("x.first").alias("first"))
    return few.unionByName(many)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """key, first_word, last_word (numbers in the document), n_words, removed_words, class_ids, first_doc_id (the least document of its classes): one row for each repeated passage."""
    equal = stored(equal_runs(docs, key, text), "equal")
    rows = stored(unit_rows(docs, key, text), "units")
    repeated = rows.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("item")
    fams = stored(families(tokens(rows), lambda bits: tokens(rows, bits)).groupBy("item").agg(F.collect_set("p").alias("fams")), "families")
    have = docs.where(F.col(key).isNotNull())
    members = unit_sets(have, text, fams, True).join(fams, "item").select(F.explode("fams").alias("p"), "item", "n", "bits", "fams")
    linked = components(link(members, lambda items: unit_sets(have, text, items, False), NUM, DEN).select(F.col("item").alias("a"), F.col("root").alias("b")))
    classes = repeated.union(linked.select("item")).distinct().join(linked, "item", "left").select("item", F.coalesce("comp", "item").alias("class_id"))
    found = rows.select("doc", "unit", "word", "n_words", "item").join(classes, "item").select("doc", "unit", "word", "n_words", "class_id")
    found = stored(found, "repeated")
    heads = found.groupBy("class_id").agg(F.min(F.struct("doc", "unit")).alias("head"))
    gone = (F.col("doc") != F.col("head.doc")) | (F.col("unit") != F.col("head.unit"))
    near = found.join(heads, "class_id").select("doc", F.col("word").alias("lo"), (F.col("word") + F.col("n_words")).alias("hi"), gone.alias("gone"), "class_id", F.col("head.doc").alias("first"))
    # spans that touch or overlap are one passage
    w = Window.partitionBy("doc").orderBy("lo", "hi")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True))
    fresh = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max(F.when(F.col("gone"), F.col("hi"))).over(before), F.lit(0))), F.lit(0))
    runs_ = near.unionByName(equal).withColumn("new", new).withColumn("removed", F.when(F.col("gone"), fresh).otherwise(0)).withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = runs_.groupBy("doc", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("removed").alias("removed_words"), F.sort_array(F.collect_set("class_id")).alias("class_ids"), F.min("first").alias("first_doc_id"))
    got = got.withColumn("n_words", F.col("hi") - F.col("lo")).where(F.col("n_words") >= min_words)
    return got.select(F.col("doc").alias(key), F.col("lo").alias("first_word"), (F.col("hi") - 1).alias("last_word"), "n_words", "removed_words", "class_ids", "first_doc_id")
