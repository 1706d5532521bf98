"""Personal data: weakly supervised span classification.

Base spans come from fixed patterns and checks and always stay. Beside them, looser patterns
propose candidates (masked addresses, local phone numbers, cards and addresses of machines in
other spellings). Labelers vote on every span: pattern labelers (checks of form), gazetteers (lists of endings,
number ranges) and context labelers (words and signs around it). Expectation-maximisation over
the counts of vote patterns estimates each labeler's reliability without labels; the posteriors are soft
labels that train a log-linear span classifier on features of its own (the span's shape, signs and length, the words
beside it, hashed), and candidates above its threshold are added.

Vote patterns are at most 3 ** labelers for each kind and features FEATURES, whatever the input, and only their counts over all
documents reach the driver. Texts are read whole, once; candidates are kept in the shared folder.

Cases: null text is empty. Spans are in code points, end exclusive. Candidates that overlap a
base span or an earlier candidate of their kind are dropped. Rows with equal doc_id stay apart.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_value, stored, tidy

by_value(__name__)
KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. (email is matched around each "@".)
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Gazetteers.
ENDINGS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu ch at nl be pt pl se no dk fi ie ca au jp cn in br mx ar ru".split())
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "addr", "login", "ping"),
    "card": ("card", "visa", "pay", "credit", "carte", "karte", "tarjeta", "iban"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "handy", "ruf", "appel", "llam"),
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{2,64} ?[\[({<](?:at|AT|@)[\])}>] ?[A-Za-z0-9-]{2,63}(?: ?[\[({<](?:dot|DOT|\.)[\])}>] ?[A-Za-z0-9-]{2,63}|\.[A-Za-z0-9-]{2,63})+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[._/ -]{1,3}[0-9]{4}){3}(?![0-9A-Za-z.])",
    "phone": r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.])",
}
#: Characters of which a loose match of the kind has one, as a quick test.
HINTS = {"email": r"(?i)at[\])}>]|@[\])}>]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[._/ -]{1,3}[0-9]{4}", "phone": r"[0-9]{3}[ .)-]{1,2}[0-9]{3}[ .-][0-9]{4}"}
LABELERS = ("form", "check", "gazetteer", "cue", "edges", "alone")
NEAR = 40
FEATURES = 256
#: How much a feature counts against the posterior of the votes; features aren't independent.
DAMP = 0.5
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str, domain) -> list[tuple[int, int]]:
    """All leftmost matches, found from each "@": the local part can't hold one, so its start is where
    its characters begin, or the end of the match before."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := domain.match(text, at + 1)):
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str, c: dict) -> dict[str, list[tuple[int, int]]]:
    got: dict = {k: [] for k in KINDS}
    if "@" in text:
        got["email"] = emails(text, c["domain"])
    if c["digit"].search(text):
        got["ip"] = [m.span() for m in c["ip"].finditer(text) if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split(".")))]
        got["card"] = [m.span() for m in c["card"].finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            got["phone"] = [m.span() for m in c["phone"].finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return got


def votes(kind: str, text: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains; in the order of LABELERS."""
    s, before = text[a:b], text[max(0, a - NEAR) : a].lower()
    d = digits(s)
    form = 1 if base else -1 if kind in ("ip", "phone") and not re.search(r"[:(]", s) else 0
    if kind == "card":
        check, known = (1 if luhn(d) else -1), 1 if d[:1] in ("3", "4", "5", "6") else -1
    elif kind == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
        check, known = 1 if len(tail) > 1 else -1, 1 if tail in ENDINGS else -1
    elif kind == "ip":
        check, known = 0 if base else 1, -1 if s.startswith(("0.", "255.")) else 0
    else:
        check, known = 1 if 9 <= len(d) <= 15 else -1, 1 if s[0] == "+" or s.startswith(("(", "00")) else 0
    cue = 1 if any(w in before for w in CUES[kind]) else 0
    edges = 1 if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) else -1
    # tables of figures hold many numbers near to each other
    around = sum(ch.isdigit() for ch in text[max(0, a - NEAR) : a] + text[b : b + NEAR])
    return form, check, known, cue, edges, -1 if around > 20 else 1 if not around else 0


def features(kind: str, text: str, a: int, b: int) -> list[int]:
    """Numbers below FEATURES: shape, signs, length, and the words beside a span."""
    s = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", s)))
    before = re.findall(r"\w+", text[max(0, a - NEAR) : a].lower())[-2:]
    after = re.findall(r"\w+", text[b : b + NEAR].lower())[:1]
    own = [f"shape {shape}", f"signs {''.join(sorted(set(re.sub('[A-Za-z0-9]', '', s))))}", f"length {len(s) // 4}", f"next {text[b : b + 1]}", *(f"before {w}" for w in before), *(f"after {w}" for w in after)]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % FEATURES for x in own})


def compiled() -> dict:
    """ASCII only where letters and digits are meant so."""
    return {"domain": re.compile(DOMAIN), "ip": re.compile(IP), "card": re.compile(CARD), "phone": re.compile(PHONE), "digit": re.compile("[0-9]"), "loose": {k: (re.compile(HINTS[k]), re.compile(LOOSE[k])) for k in KINDS}}


def propose(text: str, c: dict) -> list[tuple[int, int, int, bool, tuple[int, ...], list[int]]]:
    """(kind's number, start, end, base, votes, features) of a text, by kind and start."""
    base, out = base_spans(text, c), []
    ends = {k: np.array([b for _, b in v]) for k, v in base.items()}
    taken = lambda x, y: any(i < len(v) and v[i][0] < y for k, v in base.items() for i in [int(np.searchsorted(ends[k], x, "right"))])
    for k, kind in enumerate(KINDS):
        own = [(a, b, True) for a, b in base[kind]]
        hint, loose = c["loose"][kind]
        if hint.search(text):
            for m in loose.finditer(text):
                if not taken(m.start(), m.end()):
                    own.append((*m.span(), False))
        out += [(k, a, b, is_base, votes(kind, text, a, b, is_base), features(kind, text, a, b)) for a, b, is_base in sorted(own)]
    return out


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict, np.ndarray, float]:
    """Posterior of each vote pattern, reliabilities [labeler, class, vote + 1], prior; by EM over counts."""
    keys = sorted(patterns)
    v, n = np.array(keys) + 1, np.array([patterns[k] for k in keys], float)
    post = np.clip(((v - 1).sum(axis=1) + 3) / 6, 0.05, 0.95)
    for _ in range(rounds):
        prior = (n * post).sum() / n.sum()
        prior = min(max(prior, 0.02), 0.98)
        table = np.zeros((v.shape[1], 2, 3))
        for c, w in ((1, n * post), (0, n * (1 - post))):
            for j in range(v.shape[1]):
                # smoothed toward labelers that are better than chance
                table[j, c] = np.bincount(v[:, j], w, minlength=3) + ((1, 2, 4) if c else (4, 2, 1))
        table /= table.sum(axis=2, keepdims=True)
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]]) for j in range(v.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, post, strict=True)), table, prior


Key = tuple[int, tuple[int, ...]]


def posteriors(counts: dict[Key, int]) -> dict[Key, float]:
    """Of each kind and vote pattern."""
    out: dict = {}
    for k in range(len(KINDS)):
        if own := {key: n for (kind, key), n in counts.items() if kind == k}:
            out |= {(k, key): float(p) for key, p in estimate(own)[0].items()}
    return out


def classifier(post: dict[Key, float], counts: dict[Key, int], with_feature: dict[tuple[Key, int], int]) -> np.ndarray:
    """[kinds, FEATURES]: what each feature adds to a span's log odds; from soft counts of spans for and against that have it."""
    total, seen = np.zeros((2, len(KINDS), 1)), np.zeros((2, len(KINDS), FEATURES))
    for (k, key), n in counts.items():
        total[:, k, 0] += n * np.array([post[k, key], 1 - post[k, key]])
    for ((k, key), f), n in with_feature.items():
        seen[:, k, f] += n * np.array([post[k, key], 1 - post[k, key]])
    rate = np.log((seen + 0.5) / (total + 1))
    return DAMP * np.where(seen.sum(axis=0) > 0, rate[0] - rate[1], 0.0)


SPANS = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:string,feats:array<int>>>"


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, spans with votes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        c = compiled()
        fields = [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("feats", pa.list_(pa.int32()))]
        for b in batches:
            rows = []
            for t in b.column("t"):
                s = t.as_py()
                rows.append([] if not s else [{"kind": k, "start": x, "stop": y, "base": is_base, "votes": ",".join(map(str, v)), "feats": f} for k, x, y, is_base, v, f in propose(s, c)])
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(rows, pa.list_(pa.struct(fields)))], names=["k", "spans"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(tidy(run), f"k {kind}, spans {SPANS}").withColumnRenamed("k", key)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, base and found: arrays of struct(kind, start, stop), by kind and start. found has all spans."""
    got = stored(candidates(docs, key, text), "pii")
    one = got.select(F.explode("spans").alias("s"))
    named = lambda k, v: (k, tuple(map(int, v.split(","))))
    # both are bounded by the number of patterns and features
    counts = {named(r[0], r[1]): r[2] for r in one.groupBy("s.kind", "s.votes").count().collect()}
    having = {(named(r[0], r[1]), r[2]): r[3] for r in one.select("s.kind", "s.votes", F.explode("s.feats").alias("f")).groupBy("kind", "votes", "f").count().collect()}
    post = posteriors(counts)
    weights = classifier(post, counts, having)
    # what a span's features must add up to at least, for each vote pattern
    needs = {f"{k}:{','.join(map(str, v))}": float(np.log(threshold / (1 - threshold)) - np.clip(np.log(max(q, 1e-9) / max(1 - q, 1e-9)), -4, 4)) for (k, v), q in post.items()}
    need = F.create_map(*(F.lit(x) for kv in sorted(needs.items()) for x in kv)) if needs else F.lit(None).cast("map<string,double>")
    flat = F.lit([float(x) for x in weights.reshape(-1)])
    adds = lambda s: F.aggregate(s["feats"], F.lit(0.0), lambda acc, f: acc + F.get(flat, s["kind"] * FEATURES + f))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    kept = F.filter("spans", lambda s: s["base"] | (adds(s) >= F.try_element_at(need, F.concat_ws(":", s["kind"].cast("string"), s["votes"]))))
    return got.select(key, F.transform(F.filter("spans", lambda s: s["base"]), plain).alias("base"), F.transform(kept, plain).alias("found"))


def written(spans):
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
