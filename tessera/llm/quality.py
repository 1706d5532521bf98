"""Quality classifier: random-indexing word vectors, pooled, then a two-layer numpy network.

Tokens are runs of letters, digits or signs. Beside its own token every run gives a shape token
(all capitals, capitalised, repeated, kind and length), so that words never seen in training still
count. Each token hashes to one of BUCKETS; a bucket has a random index vector, and its word vector is the
sum of the index vectors of tokens up to WINDOW away, over all documents. A document is the
mean and the root mean square of its tokens' vectors, and the shares of its shape tokens' vectors.

The network learns from a bounded sample of about MAX_TRAIN labelled rows, chosen by a hash of doc_id; a part
of it that the network doesn't learn from sets the temperature. Scoring reads every whole text,
map-only.

Cases: null and empty texts are scored as a document without tokens. Without labels of both
classes the score is the share of label 1 (0.5 without labels). Labels of unknown doc_id and null
labels are left out; repeated ones count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, by_value, byte_values, mix, runs, slices_of, small_batches, spans, stored, strings, sum_slices, tidy, unit

by_value(__name__)
#: Bound of the training sample: expected labelled rows.
MAX_TRAIN = 6000
BITS = 14
DIMS = 32
SHAPES = 64
WINDOW = 2
HIDDEN = 24
SEED = 7
_WIDTH = 1 << 13
#: Tokens whose contexts are summed at once; bounds the memory.
_TOKENS = 1 << 16


def token_classes() -> np.ndarray:
    c = np.full(256, 3, np.uint8)
    c[:33] = 0
    c[127] = 0
    for a, b in ((65, 91), (97, 123), (128, 256)):
        c[a:b] = 1
    c[48:58] = 2
    return c


def tokens(u8: np.ndarray, offs: np.ndarray):
    """Bucket and shape of each token, and the number of tokens of each row."""
    cls, raw, low = token_classes(), byte_values(False), byte_values(True)
    h, at, lens = runs(u8, offs, cls, raw)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    upper = np.concatenate([[0], np.cumsum((u8 >= 65) & (u8 <= 90))])
    caps = upper[at + lens] - upper[at]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    kind = cls[u8[at]].astype(np.int64)
    shape = np.where(caps >= np.maximum(2, lens * 0.5), 2, np.where(caps > 0, 1, 0)) + 3 * same
    # 6 shapes of letters by 3 lengths; digits and signs by length and repetition
    step = np.where(lens <= 3, 0, np.where(lens <= 8, 1, 2))
    shape = np.where(kind == 1, shape * 3 + step, np.where(kind == 2, 18 + 2 * step + same, 24 + 2 * np.minimum(lens - 1, 3) + same))
    sign = (kind == 3) & (lens <= 3)
    shape = np.where(sign, 32 + (h & U64(31)).astype(np.int64), shape)
    rows = np.diff(np.searchsorted(at, offs))
    return (h & U64((1 << BITS) - 1)).astype(np.int64), shape, rows


def index_vectors(n: int, salt: int) -> np.ndarray:
    """Sparse ternary random vectors: about a quarter of the entries are +1 or -1."""
    r = mix(np.arange(n * DIMS, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))
    return np.where(r & U64(7) == 0, 1, np.where(r & U64(7) == 1, -1, 0)).astype(np.float32).reshape(n, DIMS)


def context_counts(out: np.ndarray, bucket: np.ndarray, rows: np.ndarray, index: np.ndarray) -> None:
    """Adds to out [buckets, DIMS] the index vectors (small integers) of each token's neighbours in its row."""
    row = np.repeat(np.arange(len(rows)), rows)
    for a in range(0, len(bucket), _TOKENS):
        lo, hi = max(0, a - WINDOW), min(len(bucket), a + _TOKENS + WINDOW)
        own, of = bucket[lo:hi], row[lo:hi]
        vec, ctx = index[own], np.zeros((hi - lo, DIMS), np.int16)
        for d in range(1, WINDOW + 1):
            ok = (of[d:] == of[:-d]).astype(np.int16)[:, None]
            ctx[d:] += vec[:-d] * ok
            ctx[:-d] += vec[d:] * ok
        mine = slice(a - lo, a - lo + min(_TOKENS, len(bucket) - a))
        order = np.argsort(own[mine].astype(np.uint16), kind="stable")
        o = own[mine][order]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        out[o[first]] += np.add.reduceat(ctx[mine][order], first, axis=0, dtype=np.int64)


def pooled(u8: np.ndarray, offs: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """[rows, 3 * DIMS + 1]: mean and root mean square of word vectors, mean of shape vectors, length."""
    n = len(offs) - 1
    out = np.zeros((n, 3 * DIMS + 1), np.float32)
    for a, b in spans(offs):
        bucket, shape, rows = tokens(u8[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        some = np.flatnonzero(rows)
        if not len(some):
            continue
        first = (np.cumsum(rows) - rows)[some]
        total = np.zeros((len(some), 2 * DIMS), np.float64)
        for x in range(0, len(bucket), 1 << 16):  # bounded, also for one very long text
            y = min(len(bucket), x + (1 << 16))
            cut = np.clip(first, x, y)
            live = np.flatnonzero((np.append(first[1:], len(bucket)) > x) & (first < y))
            total[live] += np.add.reduceat(words[bucket[x:y]], cut[live] - x, axis=0)
        count = rows[some][:, None]
        share = np.bincount(np.repeat(np.arange(len(some)), rows[some]) * SHAPES + shape, minlength=len(some) * SHAPES).reshape(-1, SHAPES) / count
        out[a + some, : 2 * DIMS] = np.hstack([total[:, :DIMS] / count, np.sqrt(total[:, DIMS:] / count)])
        out[a + some, 2 * DIMS : 3 * DIMS] = share @ shapes
        out[a + some, -1] = np.log1p(rows[some])
    return out


def _train(x: np.ndarray, y: np.ndarray, steps: int = 1500) -> list[np.ndarray]:
    r = np.random.default_rng(SEED)
    p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        i = r.integers(0, len(x), 256)
        hid = np.tanh(x[i] @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
        back = np.outer(err, p[2]) * (1 - hid**2)
        grads = [x[i].T @ back + 1e-4 * p[0], back.sum(0), hid.T @ err + 1e-4 * p[2], np.array([err.sum()])]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            p[k] -= 0.01 * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    w1, b1, w2, b2 = net["p"]
    return np.tanh((x - net["mean"]) / net["sd"] @ w1 + b1) @ w2 + b2


def scores(x: np.ndarray, net: dict) -> np.ndarray:
    if net["p"] is None:
        return np.full(len(x), net["prior"])
    return 1 / (1 + np.exp(-np.clip(logits(x, net) / net["t"], -30, 30)))


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, of a fixed grid."""
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t))
    return float(min(np.geomspace(0.25, 8, 41), key=loss))


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", key: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> dict:
    """A model from the labelled rows where learn (a condition on labels) holds."""
    known = labels.where(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    n = known.count()
    share = unit(F.col("k"), "quality")
    chosen = known.where(share < min(1.0, max_train / max(n, 1)))
    # a bounded number of narrow rows: its size is that of the sample
    sample = stored(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k"), "quality-sample")
    index = index_vectors(1 << BITS, SEED).astype(np.int16)

    def contexts(batches):
        out = np.zeros((1 << BITS, DIMS), np.int64)
        for b in batches:
            u8, offs = strings(b.column("t"))
            for x, y in spans(offs):
                bucket, _, rows = tokens(u8[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
                context_counts(out, bucket, rows, index)
        yield slices_of(out.ravel(), _WIDTH)

    bits = BITS + int(np.log2(DIMS))
    with small_batches(docs.sparkSession):
        words = sum_slices(docs.select(F.col(text).alias("t")).mapInArrow(tidy(contexts), "part int, slice int, counts binary"), _WIDTH, bits).reshape(-1, DIMS).astype(np.float32)
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-6)
    words, shapes = np.hstack([words, words**2]), index_vectors(SHAPES, SEED + 1)

    def pool(batches):
        for b in batches:
            x = pooled(*strings(b.column("t")), words, shapes)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "y", "x"])

    got = sorted((tuple(r) for r in sample.mapInArrow(tidy(pool), f"k {docs.schema[key].dataType.simpleString()}, y int, x binary").collect()), key=lambda r: (r[0], r[1], bytes(r[2])))
    y = np.array([r[1] for r in got], float)
    net = {"words": words, "shapes": shapes, "p": None, "t": 1.0, "prior": float(y.mean()) if len(y) else 0.5}
    if len(set(y)) < 2:
        return net
    x = np.vstack([np.frombuffer(r[2], np.float32) for r in got]).astype(np.float64)
    hold = np.arange(len(y)) % 5 == 4
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        hold[:] = False
    net |= {"mean": x[~hold].mean(0), "sd": x[~hold].std(0) + 1e-3}
    net["p"] = _train((x[~hold] - net["mean"]) / net["sd"], y[~hold])
    if hold.any():
        net["t"] = _temperature(logits(x[hold], net), y[hold])
    return net


def score(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """keep's columns, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        m = shared.value
        for b in batches:
            s = scores(pooled(*strings(b.column("_text")), m["words"], m["shapes"]).astype(np.float64), m)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double", "predicted int"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(tidy(run), schema)


def accepted(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs that the model doesn't reject; all columns stay, whatever their names. Rows are judged where they stand: nothing is moved."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    got = score(plain, model, f"c{docs.columns.index(text)}", tuple(plain.columns), threshold)
    return got.where("predicted = 1").select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))
