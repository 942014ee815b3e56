"""Repair of a conversation's structure by alignment to an alternating grammar.

A conversation is sound if its role initials spell ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of
user and assistant turns.  The turns are aligned to every feasible length of that string by Wagner-Fischer tables: keeping
a turn is free, giving it another role costs ``REROLE``, deleting it ``DELETE`` (blank turns and repeats must go), inserting
an empty turn ``INSERT``, and a turn cut short that stays ``CUT_SHORT``.  Tables run from the end of the conversation, so one
table serves all lengths: the string's last characters are the same.  Ukkonen's band holds them to the diagonals that a
path no dearer than the incumbent (a greedy repair) can reach.  All lengths of least cost are then traced together from the
start, letter by letter of their audits (Keep, Rerole, Delete, Insert); those that fall behind in ASCII order are dropped.

Only every so-manieth row of the table is stored; the trace makes the rows between again.

Each turn is sent twice, first without its text: a task first reads the classes of a conversation's turns, aligns them,
and then reads the turns themselves, in order, and passes them on repaired.  Texts are never gathered; what a task holds is
some bytes for each turn of one conversation and 2 * sqrt(turns) rows of its band.

Order and defined cases: turns stand by turn number (nulls first), then role, then a digest of role and text, so equal rows
are neighbours; a null conversation is one conversation; a null role or text is one space; a role without letters has no
initial and can't be kept.  A conversation whose turns are all gone is empty, and so is its audit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: Stands for an edit that is not allowed.
_NEVER = 1 << 40
_WHITE = " \t\n\x0b\x0c\r"
_ROLES = {"u": "user", "a": "assistant"}
#: Classes of short conversations whose audits a worker remembers.
MEMO, MEMO_TURNS = 100_000, 64

_audits: dict[str, tuple[int, str]] = {}


# One conversation's classes: for each turn its role initial and its state (x: must go, t: cut short, k: sound).


def incumbent(initials: list[str], states: list[str]) -> int:
    """The cost of a greedy repair: keep what fits, insert before what belongs to the other side, rerole the rest."""
    live = [(c, s) for c, s in zip(initials, states, strict=True) if s != "x"]
    cost = DELETE * (len(states) - len(live)) + CUT_SHORT * sum(s == "t" for _, s in live)
    if live and live[0][0] == "s":
        live = live[1:]
        if not live:  # a system turn alone would need a whole pair
            cost += 2 * INSERT
    user = True
    for c, _ in live:
        if c == ("u" if user else "a"):
            user = not user
        elif c in ("u", "a"):
            cost += INSERT  # the expected one before it
        else:
            cost += REROLE
            user = not user
    return min(cost + INSERT * (not user), DELETE * len(states))


class Tables:
    """Costs of aligning the turns from i on to the last r characters of the string, within the band.

    ``plain[i][r]``: nothing but pairs is left.  ``led[i][r]``: the system turn and r characters are left.  Columns are
    numbered from ``low[i]``.
    """

    def __init__(self, initials: list[str], states: list[str]):
        self.initials, self.states, self.n = initials, states, len(states)
        live = np.array([s != "x" for s in states], np.int64)
        self.rest = np.concatenate((np.cumsum(live[::-1])[::-1], [0]))  # live turns from i on
        cut_short = sum(s == "t" for s in states)
        slack = incumbent(initials, states) - DELETE * int(self.n - live.sum())
        over = slack - CUT_SHORT * cut_short  # what a path may cost beyond what any path costs, but for deleted short turns
        self.below = min(slack // DELETE, over // (DELETE - CUT_SHORT) if cut_short else over // DELETE) + 1
        self.above = max(0, over) // INSERT
        self.below = max(0, self.below)
        self.step = max(1, math.isqrt(self.n))
        self.stored: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        row = self._last()
        self.stored[self.n] = row
        for i in range(self.n - 1, -1, -1):
            row = self._row(i, row)
            if i % self.step == 0:
                self.stored[i] = row
        self.block: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def low(self, i: int) -> int:
        return max(0, int(self.rest[i]) - self.below)

    def _last(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.arange(self.low(self.n), int(self.rest[self.n]) + self.above + 1)
        return INSERT * r, np.full(len(r), _NEVER)

    def costs(self, i: int) -> tuple[int, int, int, int]:
        """Of turn i: keeping it as the system turn, as assistant, as user; giving it another role."""
        c, s = self.initials[i], self.states[i]
        if s == "x":
            return _NEVER, _NEVER, _NEVER, _NEVER
        extra = CUT_SHORT * (s == "t")
        return tuple(extra if c == x else _NEVER for x in "sau") + (REROLE + extra,)

    def _row(self, i: int, below: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        plain, led = below
        lead, assistant, user, rerole = self.costs(i)
        low, was = self.low(i), self.low(i + 1)
        r = np.arange(low, int(self.rest[i]) + self.above + 1)

        def shifted(values: np.ndarray, by: int) -> np.ndarray:
            """values of the row below at columns r - by; never outside its band."""
            at = r - by - was
            inside = (at >= 0) & (at < len(values))
            return np.where(inside, values[np.clip(at, 0, len(values) - 1)], _NEVER)

        match = np.where(r % 2 == 1, min(assistant, rerole), min(user, rerole))  # the r-th character from the end: odd a, even u
        best = np.minimum(DELETE + shifted(plain, 0), match + shifted(plain, 1))
        # An insertion costs the same in every column: a running minimum of what is left when those costs are taken off.
        here = np.minimum.accumulate(best - INSERT * r) + INSERT * r
        return np.minimum(here, _NEVER), np.minimum(np.minimum(DELETE + shifted(led, 0), lead + shifted(plain, 0)), _NEVER)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in self.stored:
            return self.stored[i]
        if i not in self.block:
            end = min(self.n, (i // self.step + 1) * self.step)
            row, self.block = self.stored[end], {}
            for k in range(end - 1, i // self.step * self.step, -1):
                row = self._row(k, row)
                self.block[k] = row
        return self.block[i]

    def at(self, i: int, r: np.ndarray, led: bool) -> np.ndarray:
        """Costs at columns r of row i."""
        values, at = self.row(i)[led], r - self.low(i)
        inside = (at >= 0) & (at < len(values))
        return np.where(inside, values[np.clip(at, 0, len(values) - 1)], _NEVER) if len(values) else np.full(len(r), _NEVER)


def aligned(initials: list[str], states: list[str]) -> tuple[int, str]:
    """(least cost, ASCII-least audit of that cost) of turns' initials and states."""
    if not states:
        return 0, ""
    t = Tables(initials, states)
    lengths = np.arange(0, len(t.row(0)[0]) + t.low(0), 2)  # even: whole pairs
    plain, led = t.at(0, lengths, False), np.where(lengths > 0, t.at(0, lengths, True), _NEVER)
    cost = int(min(plain.min(), led.min()))
    # The columns, and the cost still to come, of all paths whose audits agree so far: with pairs alone left, and with the
    # system turn still ahead.
    audit, i, on, ahead = [], 0, lengths[plain == cost], lengths[led == cost]
    left = {"on": np.full(len(on), cost), "ahead": np.full(len(ahead), cost)}
    while i < t.n or len(ahead) or not (on == 0).any():
        if i < t.n:
            lead, assistant, user, rerole = t.costs(i)
            after, after_led = t.at(i + 1, on, False), t.at(i + 1, ahead, True)
            gone, gone_led = DELETE + after == left["on"], DELETE + after_led == left["ahead"]
            if gone.any() or gone_led.any():
                audit.append("D")
                on, ahead, i = on[gone], ahead[gone_led], i + 1
                left = {"on": after[gone], "ahead": after_led[gone_led]}
                continue
        before = np.where(on > 0, t.at(i, on - 1, False), _NEVER)
        new = INSERT + before == left["on"]
        if new.any():
            audit.append("I")
            on, ahead = on[new] - 1, ahead[:0]
            left = {"on": before[new], "ahead": left["ahead"][:0]}
            continue
        after = np.where(on > 0, t.at(i + 1, on - 1, False), _NEVER)
        kept = np.where(on % 2 == 1, assistant, user) + after == left["on"]
        opened = t.at(i + 1, ahead, False)
        led_now = lead + opened == left["ahead"]
        i += 1
        if kept.any() or led_now.any():
            audit.append("K")
            on, left = np.concatenate((on[kept] - 1, ahead[led_now])), {"on": np.concatenate((after[kept], opened[led_now])), "ahead": left["ahead"][:0]}
        else:
            audit.append("R")
            other = rerole + after == left["on"]
            on, left = on[other] - 1, {"on": after[other], "ahead": left["ahead"][:0]}
        ahead = ahead[:0]
    return cost, "".join(audit)


def audit_of(initials: list[str], states: list[str]) -> tuple[int, str]:
    """``aligned``, remembered for short conversations: it depends on initials and states alone."""
    if len(states) > MEMO_TURNS:
        return aligned(initials, states)
    key = "".join(c if c in ("s", "u", "a") else "?" for c in initials) + "".join(states)
    if key not in _audits:
        if len(_audits) >= MEMO:
            _audits.clear()
        _audits[key] = aligned(initials, states)
    return _audits[key]


class Repair:
    """The edits of one conversation in order, applied to its turns as they come."""

    def __init__(self, initials: list[str], states: list[str]):
        self.cost, self.audit = audit_of(initials, states)
        first = next((k for k, e in enumerate(self.audit) if e != "D"), None)
        self.at, self.user = 0, True
        turn = sum(e in "KRD" for e in self.audit[:first]) if first is not None else 0
        self.led = first is not None and self.audit[first] == "K" and initials[turn] == "s"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns to insert here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._role(), ""

    def turn(self, role: str, text: str) -> tuple[str, str, str] | None:
        """(edit, role, text) of the next turn; None if it goes."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        if edit == "K" and self.led:
            self.led = False
            return edit, role, text
        return edit, role if edit == "K" else self._role(advance=False), self._advance(text)

    def _role(self, advance: bool = True) -> str:
        role = _ROLES["u" if self.user else "a"]
        if advance:
            self.user = not self.user
        return role

    def _advance(self, text: str) -> str:
        self.user = not self.user
        return text


# Spark


def _records(turns: DataFrame, gone: str | None) -> DataFrame:
    """(conv_id, phase, turn, role, dig, initial, state, text), dealt by conversation and in order: phase 0 tells each turn's
    class, phase 1 brings its text.  Turns marked ``gone`` only tell that their conversation is there."""
    missing = F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    base = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), missing.alias("gone"))
    inked = F.rtrim(F.col("text"), F.lit(_WHITE))
    last = F.right(inked, F.lit(1))
    state = F.when(F.col("gone"), "g").when(inked == "", "x").when(~last.isin(".", "!", "?"), "t").otherwise("k")
    light = F.struct(F.lit(0).alias("phase"), F.lit(None).cast("string").alias("text"))
    heavy = F.struct(F.lit(1).alias("phase"), F.col("text").alias("text"))
    dig = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marked = base.select("conv_id", "turn", "role", dig.alias("dig"), F.substring("role", 1, 1).alias("initial"), state.alias("state"), F.when(F.col("gone"), F.array(light)).otherwise(F.array(light, heavy)).alias("parts"))
    each = marked.select("conv_id", "turn", "role", "dig", "initial", "state", F.explode("parts").alias("part")).select("conv_id", "turn", "role", "dig", "initial", "state", "part.phase", "part.text")
    return each.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "phase", F.col("turn").asc_nulls_first(), "role", "dig")


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


class _Classes:
    """What phase 0 tells of one conversation."""

    def __init__(self):
        self.initials, self.states, self.seen = [], [], set()
        self.low = self.high = self.turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, state: str, dig: bytes) -> None:
        if state == "g":
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.turn
            self.high = self.turn = turn
        if self.initials:
            self.illegal += not _legal(self.initials[-1] + initial)
        if state == "x":
            self.blank += 1
        elif dig in self.seen:
            state = "x"
            self.duplicate += 1
        else:
            self.truncated += state == "t"
        self.seen.add(dig)
        self.initials.append(initial)
        self.states.append(state)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("turn", conv_id, place, edit, role, text) for each repaired turn and ("end", conv_id, classes, repair) for each
    conversation, from sorted records."""
    here, classes, repair, place, started = None, None, None, 0, False

    def rest() -> Iterator[tuple]:
        nonlocal repair, place
        if repair is None:
            repair = Repair(classes.initials, classes.states)
        for made in repair.inserted():
            yield ("turn", here, place, *made)
            place += 1
        yield "end", here, classes, repair

    for batch in batches:
        names = ("conv_id", "phase", "turn", "role", "dig", "initial", "state", "text")
        for conv, phase, turn, role, dig, initial, state, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if not started or conv != here:
                if started:
                    yield from rest()
                here, classes, repair, place, started = conv, _Classes(), None, 0, True
            if phase == 0:
                classes.add(turn, initial, state, dig)
                continue
            if repair is None:
                repair = Repair(classes.initials, classes.states)
                classes.seen.clear()
            for made in repair.inserted():
                yield ("turn", here, place, *made)
                place += 1
            made = repair.turn(role, text)
            if made:
                yield ("turn", here, place, *made)
                place += 1
    if started:
        yield from rest()


def _named(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: str | None) -> DataFrame:
    own = [F.col(f"`{c}`").alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))]
    return turns.select(*own, *([F.col(f"`{gone}`").alias("gone")] if gone else []))


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: str | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation after its cheapest repair, in order of place."""
    own = _named(turns, conv_col, turn_col, role_col, text_col, gone)
    names = ["conv_id", "place", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        types = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for b in batches:
                types = [b.column("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield b

        for kind, conv, *row in _conversations(typed()):
            if kind == "turn":
                held.append((conv, *row))
                size += len(row[-1])
                if len(held) >= 10_000 or size >= 1 << 22:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    records = _records(own, "gone" if gone else None)
    return records.mapInArrow(run, f"conv_id {dict(own.dtypes)['conv_id']}, place bigint, edit string, role string, text string")


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Counts are of the turns as they stand, each turn by its first fault; the digest is of the repaired turns' ``role:text``,
    joined by line ends, taken while they pass.
    """
    own = _named(turns, conv_col, turn_col, role_col, text_col, gone)
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types, digest = [], None, hashlib.sha256()

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for b in batches:
                types = [b.column("conv_id").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
                yield b

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for kind, conv, *row in _conversations(typed()):
            if kind == "turn":
                place, _, role, text = row
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                continue
            classes, repair = row
            held.append((conv, classes.gaps, classes.blank, classes.duplicate, classes.truncated, classes.illegal, repair.cost, repair.audit, digest.hexdigest()))
            digest = hashlib.sha256()
            if len(held) >= 2_000:
                yield made()
                held = []
        if held:
            yield made()

    shape = ", ".join([f"conv_id {dict(own.dtypes)['conv_id']}", *(f"{c} bigint" for c in _COUNTS), "audit string", "repaired_sha256 string"])
    return _records(own, "gone" if gone else None).mapInArrow(run, shape)


def _spelled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): turns damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 marks the turn as gone, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's; nulls are
    one space.
    """
    how = F.crc32(F.concat(_spelled("conv_id"), F.lit(":"), _spelled("turn")).cast("binary")) % 20
    text, role = _spelled("text"), _spelled("role")
    df = turns.select(
        "conv_id", "turn",
        F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (how == 0).alias("gone"),
        F.when(how == 3, 2).otherwise(1).alias("times"),
    )
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def op11(conversations: DataFrame) -> DataFrame:
    """The contract's columns for every conversation, from its damaged turns."""
    return audits(damaged(conversations), gone="gone")
