"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks.

Documents are tokenized whole, in ascending key order, with an end id after each. The ids of a
segment (whole documents, about SEGMENT ids) are cut into blocks of BLOCK ids. A block is coded by its own model from
scratch, so blocks are decoded independently and in any order; the coder runs all blocks of a
batch in lockstep as numpy lanes.

Model of a block: three predictors learn while ids are coded: by the last two ids (order 2), by
the last id (order 1), and a table of recent ids (order 0). Their predictions and a uniform
rest over ids up to the block's largest are mixed linearly with weights that follow, every PACE ids, which predictor
is right. An id is coded with one step of a range coder with carry, in the interval of the highest order that
predicts it. Weights are integers; registers are whole numbers below 2 ** 49 in IEEE doubles, where products are exact
and floors of quotients are those of integers, so decoding is exact on any machine.

File format: a Parquet table of segments in the shared folder, ascending by (part, seg); each row has its
documents' keys and lengths, and a payload: the number of blocks (u32), for each block a header (u32 ids, u32 24-bit words, u32 crc32 of the
ids as little-endian u32), then all blocks' words in three little-endian bytes each: the largest id, then the code. Ids are below 2 ** 16.

Cases: null text is empty and has only the end id. No documents: no segments, no rows. Repeated keys keep their own rows, ordered by text. A damaged block raises ValueError.
"""

from __future__ import annotations

import itertools
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_value, shared_dir, small_batches, strings, tidy

by_value(__name__)
BLOCK = 4096
SEGMENT = 1 << 18
#: Blocks that are coded in lockstep.
LANES = 2048
#: A lane's range is from WORD to TOP, in which an id's interval is parts of TOTAL.
TOTAL = 1 << 22
WORD, TOP = 2.0**24, 2.0**48
SUM = 1 << 21
#: Fixed parts of the weights: order 2, order 1, order 0; the uniform rest has what is left.
FLOOR = (1 << 16, 1 << 16, 1 << 19)
BITS2, BITS1 = 11, 10
#: Weights follow the predictors' hits every so many ids, by a fourth of the difference.
PACE, RATE = 8, 2
SPREAD, STIR = np.uint16(40503), np.uint16(30011)
#: Words and parts of words whose ids a worker remembers, from task to task: some 40 bytes each.
REMEMBERED = 300_000
#: Rows of a batch that goes to a worker; they are cut further by PIECE.
ROWS = 1000
#: Bytes of text that are tokenized at once.
PIECE = 2 << 20
#: Letters and signs for regular expressions. The byte-level pattern makes one piece of letters, and one of signs behind them.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = r"!-&(-/:-@\[-`{-~"
#: Bytes of such letters: ASCII, and two bytes from 0xC3 0x80 to 0xC9 0x8F, but for 0xC3 0x97 and 0xC3 0xB7.
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
SIGN = np.isin(np.arange(256), [*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


class _Coder:
    """The models and range-coder registers of lanes that run together. Registers are whole numbers below 2 ** 49 in doubles."""

    def __init__(self, alphabet: np.ndarray):
        self.n = lanes = len(alphabet)
        self.t2 = np.full(lanes << BITS2, 65535, np.uint16)
        self.t1 = np.full(lanes << BITS1, 65535, np.uint16)
        self.t0 = np.full(lanes << BITS1, 65535, np.uint16)
        row = np.arange(lanes)
        self.o2, self.o1, self.o4 = row << BITS2, row << BITS1, row << 2
        self.alphabet = alphabet.astype(np.int64)
        self.q = np.full((3, lanes), SUM // 4)
        self.kinds = np.zeros((PACE, lanes), np.uint8)
        self.i1 = self.o1  # where order 1 stands: the slot of the last id
        self.h1 = self.h2 = np.zeros(lanes, np.uint16)
        self.range = np.full(lanes, TOP)
        self.weigh()

    def narrow(self, keep: int) -> None:
        """Goes on with the first so many lanes only."""
        n = self.n = int(keep)
        for k in ("o2", "o1", "o4", "alphabet", "i1", "h1", "h2", "range", "w2", "w21", "w210"):
            setattr(self, k, getattr(self, k)[:n])
        self.q, self.kinds = self.q[:, :n], self.kinds[:, :n]

    def weigh(self) -> None:
        """Bounds of the four kinds of prediction in an interval of TOTAL, and the width of one id in each."""
        base = np.zeros((self.n, 4), np.int64)
        np.cumsum(self.q.T + FLOOR, axis=1, out=base[:, 1:])
        unit = np.diff(base, axis=1, append=TOTAL)
        unit[:, 2] >>= BITS1
        unit[:, 3] //= self.alphabet
        base = base.astype(float)
        self.w2, self.w21, self.w210 = base.T[1:].copy()
        self.base, self.unit = base.ravel(), unit.astype(float).ravel()

    def follow(self) -> None:
        """Weights follow the kinds of the last PACE ids."""
        for k in range(3):
            q = self.q[k]
            q += (np.add.reduce(self.kinds == k, 0, np.uint8).astype(np.int64) * (SUM // PACE) - q) >> RATE
        self.weigh()


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The 24-bit words of each block of ids: first the largest id, then the code."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lens = np.array([len(blocks[i]) for i in order])
    steps = int(lens[0])
    ids = np.zeros((steps, len(order)), np.uint16)
    for j, i in enumerate(order):
        ids[: lens[j], j] = blocks[i]
    most = ids.max(0, initial=0).astype(np.int64)
    c = _Coder(most + 1)
    width = steps + 16  # an id takes less than 24 bits
    out = np.zeros(len(order) * width, np.uint32)
    begin = np.arange(len(order)) * width
    out[begin] = most
    used = begin + 1
    low, end_low = np.zeros(len(order)), np.zeros(len(order))
    # what can be done for PACE steps at once is; lanes end between such stretches
    cuts = sorted({*range(0, steps, PACE), *lens.tolist()})
    for t, z in itertools.pairwise(cuts):
        if (live := int(np.searchsorted(-lens, -t, "left"))) < c.n:
            end_low[live : c.n] = low[live:]
            low = low[:live]
            c.narrow(live)
        x = ids[t:z, : c.n]
        h = np.concatenate([c.h2[None], c.h1[None], x * SPREAD])
        i2 = c.o2 + ((h[:-2] * STIR ^ h[1:-1]) >> 16 - BITS2)
        slot = h[2:] >> 16 - BITS1
        i0 = c.o1 + slot
        got = np.empty((3, z - t, c.n), np.uint16)
        i1 = c.i1
        for j in range(z - t):
            y, g, k = x[j], i2[j], i0[j]
            c.t2.take(g, out=got[0, j], mode="wrap")
            c.t1.take(i1, out=got[1, j], mode="wrap")
            c.t0.take(k, out=got[2, j], mode="wrap")
            c.t2[g] = y
            c.t1[i1] = y
            c.t0[k] = y
            i1 = k
        c.i1, c.h2, c.h1 = i1, h[-2], h[-1]
        miss = got != x
        not1 = miss[0] & miss[1]
        not0 = not1 & miss[2]
        kind = miss[0].view(np.uint8) + not1.view(np.uint8) + not0.view(np.uint8)
        at = c.o4 + kind
        sizes = c.unit.take(at)
        starts = np.where(not0, x, slot) * not1 * sizes
        starts += c.base.take(at)
        u = used[: c.n]
        for start, size in zip(starts, sizes, strict=True):
            r = c.range
            r *= 1 / TOTAL
            np.floor(r, r)
            start *= r
            low += start
            size *= r
            small = size < WORD
            word = low * (1 / WORD)
            np.floor(word, word)
            out[u] = word.astype(np.uint32)  # 25 bits, with a carry; stays only where the place moves on
            u += small
            up = small * WORD
            word *= up
            low -= word
            np.maximum(up, 1, out=up)
            low *= up
            size *= up
            c.range = size
        c.kinds[t % PACE : t % PACE + z - t] = kind
        if z % PACE == 0:
            c.follow()
    end_low[: c.n] = low
    out[used] = np.ceil(end_low * (1 / WORD))  # within the range, which is WORD at least; then zeros
    used += 1
    got = [None] * len(order)
    for j, i in enumerate(order):
        words = out[begin[j] : used[j]]
        while (carry := words >> 24).any():
            words &= 0xFFFFFF
            words[:-1] += carry[1:]
        got[i] = words.copy()
    return got


def decode(words: list[np.ndarray], lens: np.ndarray) -> list[np.ndarray]:
    if not words:
        return []
    order = np.argsort(-lens, kind="stable")
    size = lens[order]
    steps = int(size[0])
    width = max(len(w) for w in words) + 4
    code = np.zeros(len(order) * width, np.uint32)
    for j, i in enumerate(order):
        code[j * width : j * width + len(words[i])] = words[i]
    at = np.arange(len(order)) * width
    c = _Coder(code[at].astype(np.int64) + 1)
    v = code[at + 1] * WORD + code[at + 2]
    at += 3
    ids = np.zeros((steps, len(order)), np.uint16)
    live = np.searchsorted(-size, -np.arange(steps), "left").tolist()
    for t in range(steps):
        if live[t] < c.n:
            c.narrow(live[t])
            v, at = v[: c.n], at[: c.n]
        h = c.h2 * STIR
        h ^= c.h1
        h >>= 16 - BITS2
        i2 = c.o2 + h
        r = c.range
        r *= 1 / TOTAL
        np.floor(r, r)
        # a quotient of whole numbers below 2 ** 48 and 2 ** 26 never rounds up to a whole number
        f = v / r
        kind = (f >= c.w2).view(np.uint8) + (f >= c.w21).view(np.uint8)
        kind += (f >= c.w210).view(np.uint8)
        k = c.o4 + kind
        start, unit = c.base.take(k), c.unit.take(k)
        f -= start
        f /= unit
        np.floor(f, f)
        x = f.astype(np.uint16)
        recent = c.t0.take(c.o1 + (x & (1 << BITS1) - 1), mode="wrap")
        known = np.where(kind == 0, c.t2.take(i2, mode="wrap"), c.t1.take(c.i1, mode="wrap"))
        x = np.where(kind > 2, x, np.where(kind == 2, recent, known))
        ids[t, : c.n] = x
        h = x * SPREAD
        i0 = c.o1 + (h >> 16 - BITS1)
        c.t2[i2] = x
        c.t1[c.i1] = x
        c.t0[i0] = x
        c.i1, c.h2, c.h1 = i0, c.h1, h
        f *= unit
        f += start
        f *= r
        v -= f
        unit *= r
        small = unit < WORD
        up = small * WORD
        np.maximum(up, 1, out=up)
        v *= up
        more = code.take(at, mode="wrap")
        more *= small
        v += more
        at += small
        unit *= up
        c.range = unit
        c.kinds[t % PACE] = kind
        if (t + 1) % PACE == 0:
            c.follow()
    got: list = [None] * len(order)
    for j, i in enumerate(order):
        got[i] = ids[: size[j], j].astype(np.uint32)
    return got


class _Segment:
    def __init__(self, part: int, seg: int):
        self.part, self.seg, self.keys, self.lens, self.ids, self.n = part, seg, [], [], [], 0

    def blocks(self) -> list[np.ndarray]:
        all_ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint16)
        return [all_ids[a : a + BLOCK] for a in range(0, len(all_ids), BLOCK)]


def _payload(blocks: list[np.ndarray], words: list[np.ndarray]) -> bytes:
    head = np.array([[len(b), len(w), zlib.crc32(b.astype("<u4").tobytes())] for b, w in zip(blocks, words, strict=True)], "<u4")
    return np.uint32(len(blocks)).astype("<u4").tobytes() + head.tobytes() + b"".join(w.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for w in words)


def _opened(payload: bytes):
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    head = np.frombuffer(payload, "<u4", 3 * n, 4).reshape(n, 3)
    words = np.zeros((int(head[:, 1].sum()), 4), np.uint8)
    words[:, :3] = np.frombuffer(payload, np.uint8, offset=4 + 12 * n).reshape(-1, 3)
    words = words.view("<u4").ravel()
    cuts = np.cumsum(head[:, 1].astype(np.int64))
    return head, np.split(words, cuts[:-1]) if n else []


def _spelling():
    """A function from a text to the signs by which a byte-level model writes its UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = np.arange(256, dtype="<u2")
    signs[sorted({*range(256)} - {*shown})] = 256 + np.arange(256 - len(shown))
    return lambda text: signs[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


def _byte_level(tok) -> bool:
    """Whether the tokenizer cuts texts by the byte-level pattern, and has no added token that cut words could hold."""
    import re

    kind = repr(tok.pre_tokenizer)
    plain = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind
    simple = re.compile(rf" ?[{LETTERS}]*[{SIGNS}]*(\n[{LETTERS}]*[{SIGNS}]*)?").fullmatch
    return plain and tok.normalizer is None and not any(simple(t.content) for t in tok.get_added_tokens_decoder().values())


def _flat(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places at, at + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lens)
    index = np.repeat((at - ends + lens).astype(np.int32), lens)  # a piece has few ids, and the pool too
    index += np.arange(len(index), dtype=np.int32)
    return index


def _cut(words, cuttable: bool):
    """Words, an Arrow column, as parts that the byte-level pattern cuts anyway: the parts, and their places (5 x words).

    A word is letters with signs behind them or not, once or twice with a line feed between. Its parts are the first
    letters, signs, line feed, second letters, signs; -1 is nothing. What isn't so is its own first part. First parts
    have a blank before them.
    """
    n = len(words)
    at = np.full((5, n), -1, np.int64)
    at[0] = np.arange(n)
    if not cuttable or not n:
        return _blank_before(words), at
    u8, offs = strings(words)
    u8 = np.append(u8, np.uint8(0))
    begin, end = offs[:-1], offs[1:]
    letter = LETTER[u8]
    for lead, first, last in ((0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC9, 0x90, 0xFF)):
        after = np.flatnonzero(u8 == lead) + 1
        letter[after[(u8[after] >= first) & (u8[after] <= last)]] = False

    def beyond(inside):
        """A function from a place to the next that is not inside, or the word's end."""
        others, before = np.flatnonzero(~inside), np.cumsum(~inside) - ~inside
        return lambda place: np.minimum(others[before[place]], end)

    letters, signs = beyond(letter), beyond(SIGN[u8])
    stop = letters(begin)
    feed = signs(stop)
    begin2 = np.minimum(feed + 1, end)
    stop2 = letters(begin2)
    end2 = signs(stop2)
    second = (feed < end) & (u8[feed] == 10) & (stop2 > begin2) & (end2 == end)
    ok = (stop > begin) & ((feed == end) | second)
    second &= ok
    own = [_blank_before(_slices(u8, begin, np.where(ok, stop, end)))]
    for k, x, a, z in ((1, ok & (feed > stop), stop, feed), (2, second, feed, begin2), (3, second, begin2, stop2), (4, second & (end2 > stop2), stop2, end2)):
        at[k, x] = sum(map(len, own)) + np.arange(int(x.sum()))
        own.append(_slices(u8, a[x], z[x]))
    return pa.concat_arrays(own), at


def _blank_before(words):
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar(" ", pa.large_string()))


def _slices(u8: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """An Arrow column of the texts from begin to end."""
    lens = end - begin
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    data = u8[_flat(begin, lens)]
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(offs), pa.py_buffer(data))


def word_ids(path: str):
    """A function from an Arrow column of texts to all their ids (u16) and the number of ids of each.

    The tokenizer's pattern never joins what stands before a single blank between two signs with what stands after
    it, so words are encoded apart, with the blank before them; letters, signs and line feeds within a word are too, as
    the pattern cuts there. What was encoded is remembered. Texts with blanks beside other white space are encoded whole.
    """
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.tok = path, Tokenizer.from_file(path)
        if kept.tok.get_vocab_size() > 65535:
            raise ValueError("ids need more than 16 bits")
        kept.texts = None
    tok = kept.tok
    pieces, spelled = tok.model.tokenize, _spelling()
    byte_level = _byte_level(tok)
    begins = np.zeros(1 << 16, bool)  # ids of tokens that begin with the blank
    for token, i in tok.get_vocab().items():
        begins[i] = token.startswith("\u0120")

    def encoded(texts):
        """The ids of short texts, an Arrow column, and how many each has; and the order in which they come."""
        simple = np.zeros(len(texts), bool)
        if byte_level:
            simple = pc.match_substring_regex(texts, f"^ ?[{LETTERS}]+$").to_numpy(zero_copy_only=False)
        ascii_ = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
        blank = pc.starts_with(texts, " ").to_numpy(zero_copy_only=False)
        order = [np.flatnonzero(x) for x in (simple & ascii_, simple & ~ascii_, ~simple & blank, ~simple & ~blank)]
        own = [texts.take(pa.array(x)) for x in order]
        ids, lens = [], []  # lists of numbers only, so that Python's collector has nothing to look at
        # letters go to the model alone
        spelt = pc.replace_substring(own[0], " ", "\u0120").to_pylist()
        if len(own[1]):
            spelt += spelled("\n".join(own[1].to_pylist())).split(spelled("\n"))
        for w in spelt:
            got = [t.id for t in pieces(w)]
            ids += got
            lens.append(len(got))
        # words with a blank before them, many in one text
        words = own[2].to_pylist()
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            got = tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids
            cut = np.flatnonzero(begins[np.array(got, np.uint16)])  # only a word's first token begins with a blank
            if len(cut) == len(part):
                ids += got
                lens += np.diff(cut, append=len(got)).tolist()
            else:  # a tokenizer of another kind
                for w in part:
                    got = tok.encode(w, add_special_tokens=False).ids
                    ids += got
                    lens.append(len(got))
        for w in own[3].to_pylist():
            got = tok.encode(w, add_special_tokens=False).ids
            ids += got
            lens.append(len(got))
        return np.array(ids, np.uint16), np.array(lens, np.int64), np.concatenate(order)

    def learn(texts) -> np.ndarray:
        """Keeps the ids of new texts, and tells in which order."""
        ids, lens, order = encoded(texts)
        kept.texts = pa.concat_arrays([kept.texts, texts.take(pa.array(order))])
        kept.at = np.append(kept.at, len(kept.pool) + np.cumsum(lens) - lens)
        kept.lens = np.append(kept.lens, lens.astype(np.int32))
        kept.pool = np.append(kept.pool, ids)
        kept.again = np.append(kept.again, np.zeros(len(lens), bool))
        return order

    def forget() -> None:
        """Keeps what was met again since the last time only."""
        some = np.flatnonzero(kept.again)
        if len(some) > REMEMBERED // 2:
            some = some[:0]
        lens = kept.lens[some]
        kept.pool = kept.pool.take(_flat(kept.at[some], lens))
        kept.texts, kept.lens, kept.at = kept.texts.take(pa.array(some)), lens, np.cumsum(lens, dtype=np.int64) - lens
        kept.again = np.zeros(len(some), bool)

    def places(texts) -> np.ndarray:
        """Where the ids of texts, an Arrow column, are kept. Forgets nothing."""
        coded = texts.dictionary_encode()
        found = pc.index_in(coded.dictionary, kept.texts)
        kept.again[found.drop_null().to_numpy()] = True
        if found.null_count:
            new = coded.dictionary.filter(pc.is_null(found))
            known = len(kept.texts)
            order = learn(new)
            at = found.fill_null(-1).to_numpy().astype(np.int64)
            at[np.flatnonzero(at < 0)[order]] = np.arange(known, known + len(new))
        else:
            at = found.to_numpy().astype(np.int64)
        return at[coded.indices.to_numpy()]

    def plain(words) -> np.ndarray:
        """Where words, an Arrow column, have no white space at either end, and a sign at least."""
        return pc.and_(pc.equal(pc.utf8_trim_whitespace(words), words), pc.greater(pc.binary_length(words), 0)).to_numpy(zero_copy_only=False)

    def run(column):
        texts = column.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
        first = np.cumsum(counts) - counts
        if kept.texts is None:
            kept.texts, kept.pool, kept.again = pa.array([], pa.large_string()), np.zeros(0, np.uint16), np.zeros(0, bool)
            kept.at, kept.lens = np.zeros(0, np.int64), np.zeros(0, np.int32)
        if len(kept.texts) > REMEMBERED:
            forget()
        odd = ~plain(words)
        # words are behind a blank, the first word of a text is not; what isn't plain has no ids here
        stems, parts_at = _cut(pc.if_else(pa.array(odd), pa.scalar("a", pa.large_string()), words), byte_level)
        place = places(pa.concat_arrays([stems, words.take(pa.array(codes[first]))]))
        n = len(words)
        heads = place[len(stems) :]
        parts_at[0, odd] = -1
        own = place[parts_at]
        lens = np.where(parts_at >= 0, kept.lens[own], 0)
        # each word's ids in a row, then those of the heads
        pool = np.concatenate([kept.pool.take(_flat(kept.at[own].T.ravel(), lens.T.ravel())), kept.pool.take(_flat(kept.at[heads], kept.lens[heads]))])
        lens = np.concatenate([lens.sum(0), kept.lens[heads]])
        at = np.cumsum(lens) - lens
        which = codes.astype(np.int64)
        which[first] = n + np.arange(len(first))
        lens = lens[which]
        ids = pool.take(_flat(at[which], lens))
        sizes = np.add.reduceat(lens, first)
        whole = np.flatnonzero(np.add.reduceat(odd[codes].astype(np.int64), first)) if odd.any() else []
        if len(whole):
            cut = np.split(ids, np.cumsum(sizes)[:-1])
            for i in whole:
                cut[i] = np.array(tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint16)
                sizes[i] = len(cut[i])
            ids = np.concatenate(cut)
        return ids, sizes

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> str:
    """Writes the token files and returns their path."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import itertools

        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, seg, segs, lanes, ids_of = TaskContext.get().partitionId(), None, [], 0, word_ids(tokenizer)
        number = 0

        def flush():
            blocks = [s.blocks() for s in segs]
            words = encode([b for x in blocks for b in x])
            payloads, a = [], 0
            for x in blocks:
                payloads.append(_payload(x, words[a : a + len(x)]))
                a += len(x)
            cols = [pa.array([s.part for s in segs], pa.int32()), pa.array([s.seg for s in segs], pa.int32()), pa.array([s.keys for s in segs], pa.list_(of)), pa.array([s.lens for s in segs], pa.list_(pa.int64())), pa.array(payloads, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seg", "keys", "lens", "payload"])

        of = pa.int64()
        for b in batches:
            of = b.column("k").type
            keys, texts = b.column("k").to_pylist(), b.column("t")
            sizes = pc.binary_length(texts.cast(pa.large_string()).fill_null("")).to_numpy()
            # pieces of bounded size, or one text
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE, prepend=0)).tolist()
            for a, z in itertools.pairwise(sorted({0, *cuts, len(keys)})):
                ids_all, n_all = ids_of(texts.slice(a, z - a))
                done = 0
                for k, n_ids in zip(keys[a:z], n_all.tolist(), strict=True):
                    raw = ids_all[done : done + n_ids]
                    done += n_ids
                    if seg is None:
                        seg = _Segment(part, number)
                        number += 1
                    ids = np.append(raw, np.uint16(end_id))
                    seg.keys.append(k)
                    seg.lens.append(len(ids))
                    seg.ids.append(ids)
                    seg.n += len(ids)
                    if seg.n >= SEGMENT:
                        segs.append(seg)
                        lanes += -(-seg.n // BLOCK)
                        seg = None
                        if lanes >= LANES:
                            yield flush()
                            segs, lanes = [], 0
        if seg is not None:
            segs.append(seg)
        if segs:
            yield flush()

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).repartitionByRange(parts, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())
    files = rows.mapInArrow(tidy(run), f"part int, seg int, keys array<{kind}>, lens array<bigint>, payload binary")
    with small_batches(spark, ROWS):
        files.write.option("compression", "none").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document, from the files."""
    rows = spark.read.parquet(path)
    kind = rows.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            held, lanes = [], 0
            for r in b.to_pylist():
                held.append((r, *_opened(r["payload"])))
                lanes += len(held[-1][1])
                if lanes >= LANES:
                    yield from restored(held)
                    held, lanes = [], 0
            yield from restored(held)

    def restored(held):
        if not held:
            return
        heads = np.concatenate([h for _, h, _ in held])
        with np.errstate(all="ignore"):  # only damaged words leave the numbers; their checksum tells
            ids = decode([w for _, _, ws in held for w in ws], heads[:, 0].astype(np.int64))
        for x, h in zip(ids, heads, strict=True):
            if zlib.crc32(x.astype("<u4").tobytes()) != h[2]:
                raise ValueError("a block's checksum is wrong")
        out, a = [], 0
        for r, h, _ in held:
            own = np.concatenate(ids[a : a + len(h)])
            a += len(h)
            ends = np.cumsum(np.array(r["lens"], np.int64))
            crc, raw = [], own.astype("<u4").tobytes()
            for s, e in zip(ends - r["lens"], ends, strict=True):
                crc.append(zlib.crc32(raw[4 * s : 4 * e]))
            out += [(r["part"], r["seg"], k, int(e - n), n, c) for k, e, n, c in zip(r["keys"], ends, r["lens"], crc, strict=True)]
        cols = list(zip(*out, strict=True))
        types_ = (pa.int32(), pa.int32(), None, pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) if t else pa.array(c, pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()) for c, t in zip(cols, types_, strict=True)], names=["part", "seg", "k", "at", "n_tokens", "ids_crc32"])

    # segments are few numbers each: their places in the whole are summed by part, then over parts
    sizes = rows.select("part", "seg", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each range partition
    part = part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    places = sizes.select("part", "seg", before.alias("before")).join(part, "part").select("part", "seg", (F.col("before") + F.col("first")).alias("base"))
    got = rows.mapInArrow(tidy(run), f"part int, seg int, k {kind}, at bigint, n_tokens bigint, ids_crc32 bigint")
    return got.join(places, ["part", "seg"]).select(F.col("k").alias("key"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs' token files, reads them back: key, start, n_tokens, ids_crc32."""
    return read(docs.sparkSession, write(docs, tokenizer, end_id, key, text)).withColumnRenamed("key", key)
