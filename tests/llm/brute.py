"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def fold(doc_id, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def tokens(rows, path: str):
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_file(path), {}, 0
    for d, t in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    t, num = text or "", lambda s: re.sub("[^0-9]", "", s)
    got = {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(num(m[0])) <= 19 and luhn(num(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(num(m[0])) <= 15],
    }
    return (*(len(v) for v in got.values()), sha(",".join(f"{k}:{a}:{b}" for k, v in got.items() for a, b in sorted(v))))


def secrets(text):
    t = text or ""
    got = [
        [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 6],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
        [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24],
    ]
    all_ = sorted((a, k, b) for k, v in enumerate(got) for a, b in v)
    return (*map(len, got), sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in all_)))


def shingle_set(text) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def find_root(parent, x):
    while parent[x] != x:
        x = parent[x] = parent[parent[x]]
    return x


def components(rows, num: int = 75, den: int = 100):
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    by, parent = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    both = defaultdict(int)
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[min(a, b), max(a, b)] += 1
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find_root(parent, a), find_root(parent, b)))
            parent[y] = x
    return {d: (len(s), find_root(parent, d)) for d, s in sets.items()}


def repeated_words(rows, run: int = 40):
    """The words (document, number) that lie in a run of so many words that occurs at several places."""
    at = defaultdict(set)
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        for i in range(len(w) - run + 1):
            at[tuple(w[i : i + run])].add((d, i))
    return {(d, i + j) for v in at.values() if len(v) > 1 for d, i in v for j in range(run)}


def links(rows, num: int = 75, den: int = 100):
    """The number of other sets that link with each document's."""
    sets = {d: shingle_set(t) for d, t in rows}
    every = set(sets.values())
    one = {s: sum(1 for o in every if o != s and (n := len(s & o)) and den * n >= num * len(s | o)) for s in every}
    return {d: (one[s],) for d, s in sets.items()}


def edits(rows):
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for i, (d, t) in enumerate(rows):
        nxt, k = rows[(i + 1) % len(rows)][1], len(t) // 4
        out[d] = (len(t), sha(t[: len(t) - k] + nxt[:k]))
    return out


def contamination(docs, items, window: int = 13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        if i is None or not w:
            continue
        for a in range(max(1, len(w) - window + 1)):
            wins[tuple(w[a : a + window])].add(str(i))
    sizes, out = {len(w) for w in wins}, {}
    for d, t in docs:
        w = split(t)
        hit, named = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in wins:
                    hit.update(range(a, a + n))
                    named |= wins[x]
        out[d] = (len(w), len(hit), len(named), sha(",".join(sorted(named))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def cut_pieces(rows, path: str, size: int, end: int = 1):
    """(doc_id, piece) to (start, length, crc32)."""
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(path), {}
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        for p, a in enumerate(range(0, len(ids), size)):
            out[d, p] = (a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes()))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k: int = 20):
    """Sorted (item_id, rank, doc_id, score); docs and items are lists of (key, text)."""
    import math
    from collections import Counter

    words = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    n, total, df, out = len(words), sum(x[2] for x in words), Counter(t for _, c, _ in words for t in c), []
    for item, text in set(items):
        asked, got = Counter(TERM.findall((text or "").translate(LOWER))), []
        for d, c, size in words:
            m = 75 + 25 * size * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                got.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, g[3], -g[0]) for i, g in enumerate(sorted(got)[:k])]
    return sorted(out, key=repr)


BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows (conv, turn, role, text) after the contract's damage, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out, {r[0] for r in rows}


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows (turn, role, text); strings are carried whole."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "" if text.rstrip(BLANKS)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")
    begins = lambda s: re.fullmatch("s?(ua)*u?", s)
    # what role string was made, to least cost, edits and turns
    held = {"": (0, "", [])}

    def inserted(held):
        out = dict(held)
        for _ in range(3):
            for s, (cost, audit, turns) in list(out.items()):
                for who in ("user", "assistant"):
                    to, new = s + who[0], (cost + 3, audit + "I", [*turns, f"{who}:"])
                    if begins(to) and (to not in out or new < out[to]):
                        out[to] = new
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for s, (cost, audit, turns) in inserted(held).items():
            ways = [(s, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((s + role[:1], more, "K", [f"{role}:{text}"]))
                ways += [(s + who[0], 3 + more, "R", [f"{who}:{text}"]) for who in ("user", "assistant")]
            for to, price, letter, said in ways:
                new = (cost + price, audit + letter, turns + said)
                if begins(to) and (not role[:1] == "" or letter != "K") and (to not in after or new < after[to]):
                    after[to] = new
        least = min(x[0] for x in after.values())
        held = {s: x for s, x in after.items() if x[0] <= least + 12}
    cost, audit, turns = min(x for s, x in inserted(held).items() if legal.fullmatch(s))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(turns)))


def conversations(rows):
    left, every = damage(rows)
    return {c: repair([r[1:] for r in left if r[0] == c]) for c in every}
