"""Links between items that share tokens: families, verification, connected components.

Used by the n-gram join (tokens are prefix shingles) and by paragraph dedup (tokens are MinHash bands).
Pairs of a token's items are never listed. The least item of a token gives its family its name; all items of the token are in
that family, so two items that share a token share a family. The tokens of a group of copies have few
least items, so the group is in few families, however many tokens it shares. A family is cut into blocks, and a task compares two
blocks as matrices: first bitmaps, which bound the intersection, then whole sets of the items that have a
partner left. A pair counts in the least family that both are in, so each link is found and counted once, exactly. What a task gives back
is one row an item: the number of its links there, and the least item that it is connected with there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, by_value, stored, tidy

by_value(__name__)
#: Bits of the filter over candidate items; a fixed size, and only a filter: what passes it is joined exactly.
FILTER_BITS = 24
#: Bits of a part of the filter, as bitmap_construct_agg makes them.
_PART_BITS = 15
#: Items and values of a block of a family, about. A task holds two blocks.
BLOCK, BLOCK_VALUES = 1024, 1 << 20
#: Columns of the matrices that count common values; bounds them.
COLUMNS = 1 << 12
#: Families of at most so many items are compared pair by pair, many families at once.
SMALL = 12


def components(edges: DataFrame) -> DataFrame:
    """item, comp (least item of its component) for all items of edges(a, b). Rounds go on until nothing changes."""
    cur = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = None
    while True:
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            break
        was = state
        # large star: each larger neighbour is tied to the least one
        both = cur.union(cur.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each neighbour that is not larger, and the item itself, is tied to the least one
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        cur = stored(small.where("u != v").distinct(), "star")
    return cur.groupBy(F.col("u").alias("item")).agg(F.min("v").alias("comp")).union(cur.select(F.col("v").alias("item"), F.col("v").alias("comp")).distinct())


def filter_of(items: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """Bits (packed, highest first) at the places of items(item). What comes to the driver is one bit for each place: a fixed size."""
    place = F.col("item").bitwiseXOR(F.shiftrightunsigned("item", size)).bitwiseXOR(F.shiftrightunsigned("item", 2 * size)).bitwiseAND(F.lit((1 << size) - 1))
    cut = items.select(place.alias("place")).select(F.shiftright("place", _PART_BITS).alias("part"), F.col("place").bitwiseAND(F.lit((1 << _PART_BITS) - 1)).alias("bit"))
    out = np.zeros((1 << size - _PART_BITS, 1 << _PART_BITS - 3), np.uint8)
    for part, bits in cut.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[part] = np.packbits(np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little"))
    return out.reshape(-1)


def filter_bits(items: int) -> int:
    """Eight places an item, between bounds that keep the filter at 16 MB at most; it is only a filter, so any size is right."""
    return min(27, max(_PART_BITS, (8 * items).bit_length()))


def passing(bits: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which items have their bit in filter_of()'s filter."""
    size = len(bits).bit_length() + 2
    u = items.view(U64)
    place = ((u ^ (u >> U64(size)) ^ (u >> U64(2 * size))) & U64((1 << size) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def bitmap(s: np.ndarray, least: int) -> bytes:
    """A bit for each place of a set's values among least places, or among at least two places a value; a power of two."""
    bits = max(least, 1 << (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(s >> U64(65 - bits.bit_length())).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of the rows, which come sorted by names; a group is never divided."""
    kept = None
    for b in _and_none(batches):
        t = None if b is None else pa.Table.from_batches([b])
        whole = kept if t is None else (t if kept is None else pa.concat_tables([kept, t]))
        if whole is None or not len(whole):
            kept = None if b is None else kept
            continue
        cut = len(whole)
        if b is not None:
            last = np.zeros(len(whole), bool)
            for n in names:
                v = whole.column(n).to_numpy()
                last |= v != v[-1]
            other = np.flatnonzero(last)
            cut = int(other[-1]) + 1 if len(other) else 0
        now, kept = whole.slice(0, cut), whole.slice(cut)
        if cut:
            yield now


def _and_none(batches):
    yield from batches
    yield None


def starts(t: pa.Table, names: list[str]) -> np.ndarray:
    """Where groups begin, and the end."""
    new = np.ones(len(t), bool)
    new[1:] = False
    for n in names:
        v = t.column(n).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(t))


def _lists(column) -> list[np.ndarray]:
    return [x.values.to_numpy() for x in column]


def counted_here(p: int, families: list[np.ndarray]) -> np.ndarray:
    """For each pair of items whether p is the least family they share. families: each item's, p among them."""
    less = [f[f < p] for f in families]
    row = np.repeat(np.arange(len(less)), [len(f) for f in less])
    if not len(row):
        return np.ones((len(less), len(less)), bool)
    _, col, c = np.unique(np.concatenate(less), return_inverse=True, return_counts=True)
    row, col = row[c[col] > 1], col[c[col] > 1]
    return common(row, col, len(less)) == 0


def common(row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """How many columns each two of n rows have in common; (row, col) are distinct."""
    out = np.zeros((n, n), np.float32)
    if not len(row):
        return out
    col = np.unique(col, return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int(col[-1]) + 1, COLUMNS):
        i, j = np.searchsorted(col, (a, a + COLUMNS))
        has = np.zeros((n, min(COLUMNS, int(col[-1]) + 1 - a)), np.float32)
        has[row[i:j], col[i:j] - a] = 1
        out += has @ has.T
    return out


def _apart(block: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Pairs that a task for blocks lo and hi compares: those across, or with one block all within."""
    return block[:, None] != block[None, :] if lo != hi else ~np.eye(len(block), dtype=bool)


def _folded(bits: list, size: int) -> np.ndarray:
    """Bitmaps as bits of one size, a row each; wider ones folded."""
    out = np.zeros((len(bits), size), bool)
    for row, b in zip(out, bits, strict=True):
        row[:] = np.unpackbits(np.frombuffer(b, np.uint8)).view(bool).reshape(size, -1).any(axis=1)
    return out


def _likely(n: np.ndarray, bits: list, num: int, den: int) -> np.ndarray:
    """Pairs whose bitmaps allow den * intersection >= num * union: values at places that the other set hasn't are not in it.

    Two bitmaps are compared in the size of the smaller one; sizes that differ much don't arise, as those sets' own sizes don't match.
    """
    ok = (num + den) * np.minimum(n[:, None], n[None, :]) >= num * (n[:, None] + n[None, :])
    width = np.array([8 * len(b) for b in bits])
    for w in np.unique(width):
        rows = np.flatnonzero(width >= w)
        if not ok[np.ix_(rows, rows)].any():
            continue
        b, m = _folded([bits[i] for i in rows.tolist()], int(w)), n[rows]
        both = np.zeros((len(rows), len(rows)), np.float32)
        for a in range(0, int(w), COLUMNS):
            part = b[:, a : a + COLUMNS].astype(np.float32)
            both += part @ part.T
        size = b.sum(axis=1)
        most = np.minimum(m[:, None] - size[:, None] + both, m[None, :] - size[None, :] + both)
        ok[np.ix_(rows, rows)] &= (num + den) * most >= num * (m[:, None] + m[None, :])
    return ok


def _small_pairs(begin: np.ndarray, size: np.ndarray, n: np.ndarray, bits: list, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second row of the likely pairs of many small groups."""
    row = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(begin + size, size) - row - 1
    a = np.repeat(row, after)
    b = a + 1 + np.arange(int(after.sum())) - np.repeat(np.cumsum(after) - after, after)
    keep = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
    a, b = a[keep], b[keep]
    least = min(map(len, bits))
    keep = np.ones(len(a), bool)
    narrow = np.array([len(x) == least for x in bits])
    words = np.zeros((len(bits), least), np.uint8)
    words[narrow] = np.frombuffer(b"".join(x for x, y in zip(bits, narrow, strict=True) if y), np.uint8).reshape(-1, least)
    words, same = words.view(U64), np.flatnonzero(narrow[a] & narrow[b])
    for i in range(0, len(same), 1 << 14):
        at = same[i : i + (1 << 14)]
        x, y, p, q = words[a[at]], words[b[at]], n[a[at]], n[b[at]]
        most = np.minimum(p - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), q - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        keep[at] = (num + den) * most >= num * (p + q)
    for i in np.flatnonzero(~(narrow[a] & narrow[b])).tolist():
        keep[i] = _likely(n[[a[i], b[i]]], [bits[a[i]], bits[b[i]]], num, den)[0, 1]
    return a[keep], b[keep]


def _partners_left(num: int, den: int):
    """Rows of a family's pair of blocks that have a likely partner there."""
    keys = ["p", "lo", "hi"]

    def run(batches):
        for t in groups(batches, keys):
            edge = starts(t, keys)
            begin, size = edge[:-1], np.diff(edge)
            n, bits = t.column("n").to_numpy(), [x.as_buffer() for x in t.column("bits")]
            p, lo, hi, block, fam = t.column("p").to_numpy(), t.column("lo").to_numpy(), t.column("hi").to_numpy(), t.column("block").to_numpy(), t.column("fams")
            keep = np.zeros(len(t), bool)
            few = (size > 1) & (size <= SMALL) & (lo[begin] == hi[begin])
            a, b = _small_pairs(begin[few], size[few], n, bits, num, den)
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if not (keep[i] and keep[j]):
                    own = p[i] == min(set(fam[i].as_py()) & set(fam[j].as_py()))
                    keep[i] |= own
                    keep[j] |= own
            for g in np.flatnonzero((size > 1) & ~few).tolist():
                i, j = edge[g], edge[g + 1]
                if lo[i] != hi[i] and (block[i:j] == block[i]).all():
                    continue
                ok = _likely(n[i:j], bits[i:j], num, den) & _apart(block[i:j], lo[i], hi[i])
                some = np.flatnonzero(ok.any(axis=1))
                if len(some):
                    ok = ok[np.ix_(some, some)] & counted_here(p[i], _lists(fam.slice(i, j - i).take(pa.array(some))))
                    keep[i + some[ok.any(axis=1)]] = True
            out = t.filter(pa.array(keep)).select(["p", "lo", "hi", "block", "item", "fams"])
            yield from out.combine_chunks().to_batches()

    return run


def _linked(num: int, den: int):
    """item, links (in this family's pair of blocks), root (the least item that it's connected with there)."""
    keys = ["p", "lo", "hi"]

    def run(batches):
        for t in groups(batches, keys):
            edge = starts(t, keys)
            items, roots, numbers = [], [], []
            item, block, lo, hi, p = (t.column(c).to_numpy() for c in ("item", "block", "lo", "hi", "p"))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                sets = [np.frombuffer(x.as_buffer(), U64) for x in t.column("s").slice(i, j - i)]
                n = np.array([len(s) for s in sets])
                row, (_, col, c) = np.repeat(np.arange(len(n)), n), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                seen = c[col] > 1
                both = common(row[seen], col[seen], len(n))
                ok = (both > 0) & (den * both.astype(np.float64) >= num * (n[:, None] + n[None, :] - both)) & _apart(block[i:j], lo[i], hi[i])
                ok &= counted_here(p[i], _lists(t.column("fams").slice(i, j - i)))
                label = item[i:j].copy()
                while True:
                    new = np.minimum(label, np.where(ok, label[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (new == label).all():
                        break
                    label = new
                some = ok.any(axis=1)
                items.append(item[i:j][some])
                numbers.append(ok.sum(axis=1)[some])
                roots.append(label[some])
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (items, numbers, roots)], names=["item", "links", "root"])

    return run


def families(index: DataFrame, tokens: Callable[[np.ndarray], DataFrame]) -> DataFrame:
    """item, p: each item's families, distinct, with what else the index has of an item. index(token, item, ...); tokens(filter) gives the index again, at least its rows whose token passes the filter."""
    several = stored(index.groupBy("token").agg(F.min("item").alias("p"), F.max("item").alias("q")).where("p != q").select("token", "p"), "tokens")
    bits = filter_of(several.select(F.col("token").alias("item")), filter_bits(several.count()))
    # both grow with the input, so neither is ever broadcast
    return tokens(bits).join(several.hint("merge"), "token").drop("token").distinct()


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Classes a little wider than den / num: sizes that allow a link are in equal or neighbouring classes."""
    return np.floor(np.log(n) / (np.log(den / num) * (1 + 1e-6))).astype(np.int32)


def by_size(fams: DataFrame) -> DataFrame:
    """item, p of fams(item, p, s), distinct, divided by the items' size classes s: two items of one family in equal or neighbouring classes share one again.

    Each item is in its own class and in the next; classes without a pair that isn't in another are left out, and so are items without any.
    """
    fams = stored(fams, "sized")
    size = fams.groupBy("p", "s").agg(F.count(F.lit(1)).alias("m"))
    both = size.select("p", F.col("s").alias("c"), "m", F.lit(True).alias("own")).union(size.select("p", F.col("s") + 1, "m", F.lit(False)))
    # a class that only smaller items are in has no pair that their own class hasn't
    kept = both.groupBy("p", "c").agg(F.sum("m").alias("m"), F.max("own").alias("some")).where("m > 1 and some").select("p", "c")
    to = kept.select("p", F.col("c").alias("s"), "c").union(kept.select("p", F.col("c") - 1, "c")).groupBy("p", "s").agg(F.collect_list("c").alias("cs"))
    return fams.join(to, ["p", "s"]).select("item", "p", F.explode("cs").alias("c")).select("item", F.xxhash64("p", "c").alias("p"))


def link(members: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """item, links, root for items that link with others, in several rows each. To be added up, and joined to components.

    members(p, item, n, bits, fams): the families' items, with the size and bitmap of their set and all their families (bigints).
    sets(items) gives item, s for at least the items, each once: sorted u64 values as binary.
    """
    members = stored(members, "members")
    size = members.groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("v")).where("m > 1")
    blocks = F.least("m", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("v") / BLOCK_VALUES))).cast("int").alias("blocks")
    dealt = members.join(size.select("p", blocks), "p").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    by = ["p", "lo", "hi"]
    dealt = dealt.select(*by, "block", "item", "n", "bits", "fams").repartition(*by).sortWithinPartitions(*by)
    likely = stored(dealt.mapInArrow(tidy(_partners_left(num, den)), "p bigint, lo int, hi int, block int, item bigint, fams array<bigint>"), "likely")
    whole = sets(likely.select("item")).join(likely, "item").select(*by, "block", "item", "fams", "s").repartition(*by).sortWithinPartitions(*by)
    return whole.mapInArrow(tidy(_linked(num, den)), "item bigint, links bigint, root bigint")
