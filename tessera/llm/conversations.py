"""Repair of conversations: a forward Viterbi DP over the states of a role grammar.

A conversation's rows come by turn, nulls first; rows of equal turn by role, then by a hash of the text. A row's first fault counts: blank (no
sign beside blanks), duplicate (role and text seen earlier), truncated (its last sign is none of `.!?`). Edits make the initials of the roles `(s?(ua)+)?`:
Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows), Insert of an empty turn of user or assistant 3; a truncated
row that stays adds 3. Of the cheapest edits the least string of initials is taken.

The DP goes through a conversation's rows once. The states are: nothing yet, s, u, a. After each row a state holds its least cost and which of
the four strings is least; inserts go before a row's edit, at most two, as more come back to a state that was cheaper. Strings end in a row's edit, so none
of a layer begins another, and their order is all that later rows need. A state that is dearer than another by more than any way between them is left out;
so layers differ in few ways, and a step is looked up. Strings are read back at the end.

First pass: rows without their texts, sorted by conversation; a task holds one number for each row of one conversation. Second pass: a conversation's
edits, then its rows with texts, one after the other. A conversation is in one task in both, since its hash can only be made in order; it needs no more memory for that.

Cases: nulls in role and text are one space; null conversation keys are one conversation; null turns come first and don't count for gaps. Rows may have any further
columns. Conversations without rows have zeros, an empty audit, and no repaired turns. No conversations: no rows.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_value, small_batches, stored, tidy

by_value(__name__)
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Any state reaches what another reaches at no more than this in addition: a delete and an insert.
APART = DELETE + INSERT
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROLES = ("user", "assistant")
#: States: nothing yet, s, u, a. Which role may follow, and the state then.
_START, _S, _U, _A = range(4)
_NEXT = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}}
_LEGAL = {"su", "ua", "au"}
_OK, _BLANK, _DUPLICATE, _TRUNCATED, _DROPPED = range(5)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The contract's damage: conv, turn, role, text, dropped. Dropped rows stay, marked, so that no conversation is lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    whole = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cut = rows.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(space(role)).alias(role), whole.alias(text), (kind == 0).alias("dropped"), F.explode(times).alias("copy"))
    return cut.drop("copy")


def _inserts(state: int):
    """States that inserts reach, with the number of inserts."""
    yield state, 0
    other = _A if state == _U else _U
    yield other, 1
    if state in (_START, _S):
        yield _A, 2


@functools.lru_cache(maxsize=1 << 16)
def _step(layer: tuple, initial: str, must: bool, cut: bool):
    """One row: layer holds (cost, rank) or None for each state. The next layer, what all costs grow by, and where each state came from."""
    best: list = [None] * 4
    for state, held in enumerate(layer):
        if held is None:
            continue
        cost, rank = held
        for now, n in _inserts(state):
            ways = [("D", now, DELETE)]
            if not must:
                more = TRUNCATED * cut
                to = _NEXT.get(initial, {}).get(now)
                if to is not None:
                    ways.append(("K", to, more))
                ways.append(("R", _A if now == _U else _U, REROLE + more))
            for letter, to, price in ways:
                found = (cost + INSERT * n + price, rank, "I" * n + letter, state)
                if best[to] is None or found < best[to]:
                    best[to] = found
    least = min(x[0] for x in best if x)
    kept = [x if x and x[0] <= least + APART else None for x in best]
    order = sorted((x[1], x[2]) for x in kept if x)
    after = tuple(None if x is None else (x[0] - least, order.index((x[1], x[2]))) for x in kept)
    return after, least, tuple(None if x is None else (x[3], x[2]) for x in kept)


FIRST = ((0, 0), None, None, None)


class _Fold:
    """The first pass over one conversation."""

    def __init__(self):
        self.layer, self.cost, self.back = FIRST, 0, []
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.faults, self.illegal, self.initial = [0] * 5, 0, None

    def row(self, turn, initial: str, fault: int) -> None:
        if fault == _DROPPED:
            return
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        self.layer, least, back = _step(self.layer, initial if initial in ("s", "u", "a") else "", fault in (_BLANK, _DUPLICATE), fault == _TRUNCATED)
        self.cost += least
        self.back.append(back)  # one of few tuples

    def result(self) -> tuple:
        ends = [(held[0] + INSERT * n, held[1], "I" * n, state) for state, held in enumerate(self.layer) if held for now, n in _inserts(state) if now in (_START, _A)]
        cost, _, last, state = min(ends)
        parts = [last]
        for back in reversed(self.back):
            state, letters = back[state]
            parts.append(letters)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults[_BLANK : _TRUNCATED + 1], self.illegal, self.cost + cost), "".join(reversed(parts))


def _marked(rows: DataFrame, conv: str, turn: str, role: str, text: str, dropped: str | None) -> DataFrame:
    said = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), said.alias("text"), F.unhex(F.md5(said.cast("binary"))).alias("h"), (F.col(dropped) if dropped else F.lit(False)).alias("dropped"))


def audits(marked: DataFrame) -> DataFrame:
    """conv, numbers, audit of each conversation of rows (conv, turn, role, text, h, dropped)."""
    kind = marked.schema["conv"].dataType.simpleString()
    end = F.rtrim("text", F.lit(BLANKS))
    state = F.when(F.col("dropped"), _DROPPED).when(end == "", _BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), _OK).otherwise(_TRUNCATED)
    small = marked.select("conv", "turn", "role", "h", state.alias("fault"))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "h", F.col("fault") == _DROPPED).orderBy(F.col("turn").asc_nulls_first()))
    small = small.withColumn("seen", seen).withColumn("fault", F.when(F.col("fault").isin(_OK, _TRUNCATED) & (F.col("seen") > 1), _DUPLICATE).otherwise(F.col("fault")))

    def run(batches):
        fold, of, out = None, None, []

        def made():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kinds[0]), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.string())], names=["conv", "numbers", "audit"])

        kinds = [pa.int64()]
        for b in batches:
            kinds[0] = b.column("conv").type
            for c, turn, initial, fault in zip(b.column("conv").to_pylist(), b.column("turn").to_pylist(), b.column("initial").to_pylist(), b.column("fault").to_pylist(), strict=True):
                if fold is None or c != of:
                    if fold is not None:
                        out.append((of, *fold.result()))
                    fold, of = _Fold(), c
                fold.row(turn, initial, fault)
            if out:
                yield made()
                out.clear()
        if fold is not None:
            out.append((of, *fold.result()))
            yield made()

    rows = small.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "role", "h", "seen").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h", "seen")
    return rows.select("conv", "turn", "initial", "fault").mapInArrow(tidy(run), f"conv {kind}, numbers array<bigint>, audit string")


def _walk(batches):
    """Each conversation (conv, numbers, audit, None), then its repaired turns (None, edit, role, text)."""
    audit, at, state = "", 0, _START

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _A if state == _U else _U
            yield None, "I", ROLES[state == _A], ""

    for b in batches:
        for c, numbers, role, text in zip(*(b.column(n).to_pylist() for n in ("conv", "numbers", "role", "text")), strict=True):
            if numbers is not None:
                yield from inserts()
                audit, at, state = text, 0, _START
                yield c, numbers, audit, None
                continue
            yield from inserts()
            letter, at = audit[at], at + 1
            if letter == "K":
                state = _NEXT[role[0]][state]
                yield None, letter, role, text
            elif letter == "R":
                state = _A if state == _U else _U
                yield None, letter, ROLES[state == _A], text
    yield from inserts()


def _together(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order, in one partition."""
    none = F.lit(None)
    said = marked.where("not dropped").select("conv", none.cast("array<bigint>").alias("numbers"), "turn", "role", "h", "text")
    first = edits.select("conv", "numbers", none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("h"), F.col("audit").alias("text"))
    order = (F.col("conv").asc_nulls_first(), F.col("numbers").isNull(), F.col("turn").asc_nulls_first(), "role", "h")
    return first.union(said).repartition("conv").sortWithinPartitions(*order).select("conv", "numbers", "role", "text")


def _prepared(rows, conv, turn, role, text, dropped) -> tuple[DataFrame, str]:
    marked = _marked(rows, conv, turn, role, text, dropped)
    return _together(marked, stored(audits(marked), "audits")), marked.schema["conv"].dataType.simpleString()


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None) -> DataFrame:
    """conv, place (from 0), edit (K, R or I), role, text: the turns of each repaired conversation."""
    both, kind = _prepared(rows, conv, turn, role, text, dropped)

    def run(batches):
        of, place, out, kinds = None, 0, [], pa.int64()

        def typed(batches):
            nonlocal kinds
            for b in batches:
                kinds = b.column("conv").type
                yield b

        def made():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (kinds, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv", "place", "edit", "role", "text"])

        for c, edit, who, said in _walk(typed(batches)):
            if said is None:
                of, place = c, 0
                continue
            out.append((of, place, edit, who, said))
            place += 1
            if len(out) == 1000:
                yield made()
                out.clear()
        if out:
            yield made()

    with small_batches(rows.sparkSession):
        got = both.mapInArrow(tidy(run), f"conv {kind}, place bigint, edit string, role string, text string")
    return got.withColumnRenamed("conv", conv)


def digest(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: str | None = None) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text`, newline-joined); one row for each conversation."""
    both, kind = _prepared(rows, conv, turn, role, text, dropped)

    def run(batches):
        import hashlib

        now, out, kinds = None, [], pa.int64()

        def typed(batches):
            nonlocal kinds
            for b in batches:
                kinds = b.column("conv").type
                yield b

        def made():
            cols = list(zip(*((c, n, a, h.hexdigest()) for c, n, a, h, _ in out), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (kinds, pa.list_(pa.int64()), pa.string(), pa.string()), strict=True)], names=["conv", "numbers", "audit", "repaired_sha256"])

        for c, numbers, who, said in _walk(typed(batches)):
            if said is None:
                if len(out) == 1000:
                    yield made()
                    out.clear()
                now = [c, numbers, who, hashlib.sha256(), False]
                out.append(now)
                continue
            if now[4]:
                now[3].update(b"\n")
            now[4] = True
            now[3].update(f"{who}:{said}".encode())
        if out:
            yield made()

    with small_batches(rows.sparkSession):
        got = both.mapInArrow(tidy(run), f"conv {kind}, numbers array<bigint>, audit string, repaired_sha256 string")
    return got.select(F.col("conv").alias(conv), *(F.col("numbers")[i].alias(n) for i, n in enumerate(NUMBERS)), "audit", "repaired_sha256")
