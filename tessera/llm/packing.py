"""Best-fit packing of documents into sequences: bounded-space online best fit.

Documents are tokenized whole, in tasks, with an end id after each. A document of more than SIZE ids is cut into pieces of SIZE
ids, the last may be shorter; others are one piece. Pieces are dealt evenly to packing tasks, whatever their keys.
A task takes its pieces as they come and holds at most OPEN sequences open, in a bitset keyed by free space (bit f is set if
one with f free places is open): a piece goes where the least space is left that holds it, else it opens a sequence; beyond OPEN
the fullest closes. Pieces come in runs of about OPEN in descending length, so that short ones fill what long
ones left; open sequences stay open for the next run. What a task holds doesn't grow with its pieces.

Cases: null text is empty and has only the end id. Null and repeated keys keep their own rows. Documents may have any further columns. No documents: no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_value, small_batches, spans, stored, strings, tidy

by_value(__name__)
#: Ids of a sequence.
SIZE = 4096
#: Sequences that a task holds open.
OPEN = 1024
#: Pieces of a packing task, about, as long as spark.sql.shuffle.partitions allows so many tasks; a task can take any number.
TASK = 1 << 15
#: Bytes of text that are tokenized at once.
PIECE = 2 << 20
#: Words whose ids a task remembers.
REMEMBERED = 300_000
#: Words of these letters, with or without a sign behind them: the tokenizer's pattern makes one piece of each part. Without U+0130, whose lower case holds a mark.
STEM, SIGNS = "[A-Za-zÀ-ÖØ-öø-įı-ſ]+", ",.;:!?"
_MARK = "\x01"


class _Words:
    """Ids of texts by a tokenizer that drops white space, lower-cases, and ends words with a mark. Stems of words are encoded once and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 65535:
            raise ValueError("ids need more than 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.mark = self._ids(_MARK)
        self.signs = pa.array(list(SIGNS))
        own = [self._ids(s) for s in SIGNS]
        # with a sign of several ids words would have to be taken whole
        self.sign_ids = np.array([x[0] for x in own]) if all(len(x) == 1 for x in own) else None
        self.simple = re.compile(STEM).fullmatch
        self.forget()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def forget(self) -> None:
        self.places, self.used = {}, 0
        self.pool, self.at, self.lens = np.zeros(1 << 16, np.uint16), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, names: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n, m = len(self.places), self.used + len(ids)
        while m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(names) > len(self.at):
            self.at, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.lens))
        self.pool[self.used : m] = ids
        self.at[n : n + len(names)], self.lens[n : n + len(names)] = self.used + np.cumsum(lens) - lens, lens
        self.places.update(zip(names, range(n, n + len(names)), strict=True))
        self.used = m

    def _each(self, names: list[str]) -> None:
        own = [self._ids(w) for w in names]
        self._add(names, np.concatenate(own), np.array([len(x) for x in own]))

    def _learn(self, names: list[str]) -> None:
        stems = [w for w in names if self.simple(w)]
        rest = [w for w in names if not self.simple(w)]
        for a in range(0, len(stems), 5000):
            some = stems[a : a + 5000]
            got = self._ids(" ".join(some))
            last = np.flatnonzero(self.ends[got])  # a stem is one word of the pattern, and only its last token ends a word
            self._add(some, got, np.diff(last, prepend=-1)) if len(last) == len(some) else self._each(some)
        marked = [w for w in rest if _MARK in w or len(self.mark) != 1]
        if marked:
            self._each(marked)
        rest = [w for w in rest if not (_MARK in w or len(self.mark) != 1)]
        for a in range(0, len(rest), 5000):
            some = rest[a : a + 5000]
            got = self._ids(f" {_MARK} ".join([*some, ""]))
            at = np.flatnonzero(got == self.mark[0])
            self._add(some, got[got != self.mark[0]], np.diff(at, prepend=-1) - 1) if len(at) == len(some) else self._each(some)

    def _spelled(self, words):
        """Ids of distinct words one after the other, and the number of each."""
        import itertools

        import pyarrow.compute as pc

        sign = np.full(len(words), -1)
        names = words
        if self.sign_ids is not None:
            got = pc.extract_regex(words, f"^(?P<stem>{STEM})(?P<sign>[{SIGNS}]?)$")
            names = pc.coalesce(pc.utf8_lower(pc.struct_field(got, "stem")), words)
            sign = pc.index_in(pc.struct_field(got, "sign"), value_set=self.signs).fill_null(-1).to_numpy()
        coded = names.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.places) > REMEMBERED:
            self.forget()
        place = np.fromiter(map(self.places.get, names, itertools.repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(place < 0).tolist()
        if new:
            self._learn([names[i] for i in new])
            place[new] = [self.places[names[i]] for i in new]
        place = place[coded.indices.to_numpy()]
        lens = self.lens[place]
        more = lens + (sign >= 0)
        last = np.cumsum(more) - 1
        index = np.repeat(self.at[place] - (last + 1 - more), more) + np.arange(int(more.sum()))
        signed = sign >= 0
        index[last[signed]] = 0
        ids = self.pool.take(index) if len(index) else np.zeros(0, np.uint16)
        if signed.any():
            ids[last[signed]] = self.sign_ids[sign[signed]]
        return ids, more

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts, and the number of ids of each."""
        import pyarrow.compute as pc

        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        pool, size = self._spelled(coded.dictionary)
        at, codes = np.cumsum(size) - size, coded.indices.to_numpy()
        lens = size[codes]
        ends = np.cumsum(lens)
        index = np.repeat((at[codes] - ends + lens).astype(np.int32), lens)  # a part has few ids
        index += np.arange(len(index), dtype=np.int32)
        total = np.append(0, ends)
        edge = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy().astype(np.int64)))
        return pool.take(index) if len(index) else np.zeros(0, np.uint16), total[edge[1:]] - total[edge[:-1]]


def _slices(u8: np.ndarray) -> list[tuple[int, int]]:
    """A long text's parts of about PIECE bytes, cut at white space."""
    out, a = [], 0
    while a < len(u8):
        b = min(len(u8), a + PIECE)
        while b < len(u8):
            gap = np.flatnonzero(np.isin(u8[b : b + PIECE], (9, 10, 11, 12, 13, 32)))
            b = b + int(gap[0]) if len(gap) else min(len(u8), b + PIECE)
            if len(gap):
                break
        out.append((a, b))
        a = b
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece (from 0), start (the document's ids before it), length, ids (u32, little-endian) of each document's pieces."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        words = _Words(tokenizer)
        for b in batches:
            keys = b.column("k")
            u8, offs = strings(b.column("t"))
            for a, z in spans(offs, PIECE):
                lo, hi = int(offs[a]), int(offs[z])
                cuts = _slices(u8[lo:hi]) if z == a + 1 and hi - lo > PIECE else None
                if cuts is None:
                    ids, n = words.ids(_column(u8[lo:hi], offs[a : z + 1] - lo))
                else:
                    ids = np.concatenate([words.ids(_column(u8[lo + i : lo + j], np.array([0, j - i])))[0] for i, j in cuts])
                    n = np.array([len(ids)])
                yield from _rows(keys.slice(a, z - a), ids, n, end_id, size)

    with small_batches(docs.sparkSession):
        return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(run), f"k {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("k", key)


def _column(u8: np.ndarray, offs: np.ndarray):
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(u8)))


def _rows(keys, ids: np.ndarray, n: np.ndarray, end_id: int, size: int):
    """Batches of the pieces of some texts."""
    last = np.cumsum(n + 1) - 1
    every = np.full(int(n.sum()) + len(n), end_id, np.uint32)
    body = np.ones(len(every), bool)
    body[last] = False
    every[body] = ids
    parts = n // size + 1
    doc = np.repeat(np.arange(len(n)), parts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = piece * size
    length = np.minimum(n[doc] + 1 - start, size)
    at = (last - n)[doc] + start
    for a in range(0, len(doc), 1000):
        z = min(a + 1000, len(doc))
        part = np.ascontiguousarray(every[at[a] : at[z - 1] + length[z - 1]], "<u4")
        offs = np.append(4 * (at[a:z] - at[a]), part.nbytes).astype(np.int32)
        binary = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offs), pa.py_buffer(part)])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[a:z])), pa.array(piece[a:z].astype(np.int32)), pa.array(start[a:z]), pa.array(length[a:z]), binary], names=["k", "piece", "start", "length", "ids"])


class _Bins:
    """Open sequences by free space. place(length) gives a sequence's number and the place in it."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.bits, self.open, self.count = 0, {}, 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            self.open.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.size - free

    def _take(self, free: int) -> int:
        same = self.open[free]
        number = same.pop()
        if not same:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number


def pack(cut: DataFrame, size: int = SIZE, most: int = OPEN) -> DataFrame:
    """cut, with sequence_id and offset. cut has piece and length (at most size); it is read twice, so let it be a stored table."""
    spark = cut.sparkSession
    names = cut.columns
    rows = cut.count()
    tasks = max(1, min(-(-rows // TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    runs = max(1, rows // (tasks * most))

    def run(batches):
        from pyspark import TaskContext

        bins = _Bins(size, most, TaskContext.get().partitionId() << 33)
        for b in batches:
            got = [bins.place(n) for n in b.column(names.index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array([s for s, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], names=[*names, "sequence_id", "offset"])

    of = F.pmod(F.xxhash64(*names), F.lit(runs))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return cut.repartition(tasks).sortWithinPartitions(of, F.col("length").desc(), *names).mapInArrow(tidy(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces that have their ids. A sequence is bounded, so its pieces are too."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    cut = pieces(docs, tokenizer, end_id, key=key, text=text).select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    with small_batches(docs.sparkSession):
        return pack(stored(cut, "pieces"))
