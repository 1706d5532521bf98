"""Language identification by nearest centroid.

Byte n-grams (1 to 3) of the case-folded text are hashed to DIMS features; a document is its
normalised TF-IDF vector. Each language has several centroids from spherical k-means, and a text
gets the language of the centroid with the greatest cosine. It is marked as rejected if that cosine is
lower than nearly all of that centroid's training members had.

Fitting reads a bounded sample: about PER_LANGUAGE labelled texts of each language, chosen by a hash
of doc_id. Prediction reads every whole text, map-only.

Cases: null text or text without a letter gives `und`, score 0, rejected. No labelled rows at all: every text is
`und`. Null languages are not learned. Equal cosines: the language that sorts first. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, by_value, mix, strings, tidy, unit

by_value(__name__)
DIMS = 4096
#: Bound of the training sample: expected texts of each language.
PER_LANGUAGE = 500
CENTROIDS = 3
#: Training members with a lower cosine than this share are taken as outliers: the rejection distance.
OUTLIERS = 0.002
BLOCK = 1 << 18


def _count(out: np.ndarray, row: np.ndarray, u8: np.ndarray, edge: np.ndarray) -> None:
    """Adds n-grams of u8 (rows ascending); edge: n-grams that begin before a row's first byte are skipped."""
    c = np.where((u8 >= 65) & (u8 <= 90), u8 + 32, u8)
    c = np.where((c >= 97) & (c <= 122) | (c >= 128), c, 32).astype(np.int64)
    base = row.astype(np.int64) * DIMS
    code = c.copy()
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * 257 + c[n - 1 :]
        if not len(code):
            return
        ok = edge[n - 1 :] >= n - 1
        f = (mix(code.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(n)) & U64(DIMS - 1)).astype(np.int64)
        out += np.bincount((base[n - 1 :] + f)[ok], minlength=out.size)[: out.size]


def features(u8: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts [rows, DIMS] of one block of rows; long texts are taken in pieces that overlap."""
    n = len(offs) - 1
    out = np.zeros(n * DIMS, np.int64)
    a = 0
    while a < len(u8):
        b, lead = min(len(u8), a + BLOCK), min(2, a)
        pos = np.arange(a - lead, b)
        row = np.searchsorted(offs, pos, "right") - 1
        edge = pos - np.maximum(offs[row], a - lead)
        # n-grams that end in the two bytes of overlap were counted with the piece before
        part = np.zeros(out.size, np.int64)
        _count(part, row, u8[a - lead : b], edge)
        if lead:
            again = np.zeros(out.size, np.int64)
            _count(again, row[:lead], u8[a - lead : a], edge[:lead])
            part -= again
        out += part
        a = b
    return out.reshape(n, DIMS).astype(np.float32)


def _blocks(column, rows: int = 64):
    u8, offs = strings(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = min(n, a + rows, max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK, "right")) - 1))
        yield a, b, features(u8[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        a = b


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centroid is the mean, each next one the text farthest from all before."""
    c = _unit_rows(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
    for _ in range(12):
        near = (x @ c.T).argmax(axis=1)
        c = _unit_rows(np.vstack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(docs: DataFrame, learn, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict:
    """Centroids from the rows of docs where learn holds. The sample has about per_language texts of each language."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row for each language
    if not counts:
        return {"names": [], "c": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, int), "idf": np.ones(DIMS, np.float32), "least": np.zeros(0)}
    keep = F.lit(False)
    for name, n in counts.items():
        keep = keep | ((F.col(lang) == name) & (unit(F.col(key), "language") < per_language / n))

    def counted(batches):
        for b in batches:
            for a, z, x in _blocks(b.column("t")):
                yield pa.RecordBatch.from_arrays([b.column("l")[a:z], pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["l", "x"])

    got = sorted(tuple(r) for r in rows.where(keep).select(F.col(lang).alias("l"), F.col(text).alias("t")).mapInArrow(tidy(counted), "l string, x binary").collect())
    if not got:  # so few rows that the hash left none
        return fit(docs, learn, lang, text, key, 1 << 30, centroids) if per_language < 1 << 30 else {"names": [], "c": np.zeros((0, DIMS), np.float32), "of": np.zeros(0, int), "idf": np.ones(DIMS, np.float32), "least": np.zeros(0)}
    x = np.vstack([np.frombuffer(r[1], np.float32) for r in got])
    of = np.array([r[0] for r in got])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
    x = _unit_rows(np.log1p(x) * idf)
    names, c, owner, least = sorted(set(of)), [], [], []
    for i, name in enumerate(names):
        own = x[of == name]
        for v in _cluster(own, centroids):
            c.append(v)
            owner.append(i)
        near = (own @ np.vstack(c[-min(centroids, len(own)) :]).T).max(axis=1)
        least.append(float(np.quantile(near, OUTLIERS)) * 0.9)
    return {"names": names, "c": np.vstack(c).astype(np.float32), "of": np.array(owner), "idf": idf, "least": np.array(least)}


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred, score (greatest cosine), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS * CENTROIDS floats for each language

    def run(batches):
        m = shared.value
        for b in batches:
            says = np.array(b.column("_has").to_numpy(zero_copy_only=False), bool)
            names, score, far = np.full(len(says), "und", object), np.zeros(len(says)), np.ones(len(says), bool)
            if m["names"]:
                for a, z, x in _blocks(b.column("_text")):
                    cos = _unit_rows(np.log1p(x) * m["idf"]) @ m["c"].T
                    best = cos.argmax(axis=1)
                    who, top = m["of"][best], cos[np.arange(z - a), best]
                    names[a:z], score[a:z], far[a:z] = np.array(m["names"], object)[who], np.clip(top, 0, 1), top < m["least"][who]
                names[~says], score[~says], far[~says] = "und", 0.0, True
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(list(names), pa.string()), pa.array(score), pa.array(far)], names=[*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string", "score double", "rejected boolean"])
    return docs.select(*keep, F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("_has"), F.col(text).alias("_text")).mapInArrow(tidy(run), schema)
