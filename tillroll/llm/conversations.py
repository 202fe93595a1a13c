"""Conversations put back into the order system, user, assistant, user, ... at least cost.

The turns of a conversation must read ``(s?(ua)+)?`` by the first letters of
their roles.  A turn is kept (K), given the role that is due (R, costs 2) or
deleted (D, 3); an empty turn of the role that is due can be inserted (I, 2).  Blank
and repeated turns have to be deleted, truncated ones that stay cost 1 more.
Of the cheapest ways the one whose letters come first is taken.

Turns are symbols of role and fault, and equal symbols in a row are one run.
Going back from a conversation's end, a run advances the costs of the four
states by powers of its min-plus transition, cached for lengths 1, 2, 4 and so on;
going forth, a run is halved down to its turns and the choices are read off.

A conversation is split.  Turns are dealt out by ranges of (conversation, turn)
and come in pieces of bounded size.  A piece that is a whole conversation is
solved where it lies.  Of the other pieces only the 4 x 4 transitions meet in
order: first back, which gives each piece the costs after it, then forth, which
gives each piece the state it starts in; in between and after that, the pieces
are worked on independently.  One task per conversation then reads its pieces
in order, as a hash over all of its text needs; the choices and the hash's
state are all that it holds.

Defined results: a null role or text is one space; a null ``conv_id`` is a
conversation like any other; null turns come first.  Rows of one turn are
ordered by role and SHA-256 of the text.  Equal rows are counted, not gathered.
Numbers beyond a long are the nearest long.  Other columns are ignored.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillroll.operators.joins import join_lookup
from tillroll.session import stage

PIECE_ROWS = 4096
PIECE_CHARS = 1 << 20

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States: nothing yet, after s, after u, after a.
STATES = range(4)
ACCEPTING = (0, 3)
FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
DUE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
NEVER = 1 << 60
LARGEST = (1 << 63) - 1

Costs = tuple[int, ...]  # of the way to the end, from each state
Symbol = tuple[str, bool]  # initial and truncated; MUST_GO if deletion is required
MUST_GO: Symbol = ("-", False)


def _with_inserts(costs: list[int]) -> Costs:
    """The costs if turns may be inserted first; more than two never pay."""
    best = list(costs)
    best[2] = min(costs[2], INSERT + costs[3])
    best[3] = min(costs[3], INSERT + costs[2])
    for state in (0, 1):
        best[state] = min(costs[state], INSERT + best[2])
    return tuple(min(c, NEVER) for c in best)


AT_END = _with_inserts([0 if state in ACCEPTING else NEVER for state in STATES])


def _edits(symbol: Symbol, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a turn: edit, cost and next state."""
    found = [("D", DELETE, state)]
    if symbol != MUST_GO:
        initial, truncated = symbol
        more = TRUNCATED if truncated else 0
        if initial in FOLLOWS[state]:
            found.append(("K", more, FOLLOWS[state][initial]))
        found.append(("R", RETYPE + more, DUE[state][1]))
    return found


@lru_cache(1 << 12)
def power(symbol: Symbol, exponent: int) -> tuple[Costs, ...]:
    """Least costs between all states over 2 ** exponent turns of one symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        columns = [_times(half, column) for column in zip(*half)]
    else:
        columns = [
            _with_inserts(
                [min((c for _, c, s in _edits(symbol, q) if s == end), default=NEVER) for q in STATES]
            )
            for end in STATES
        ]
    return tuple(zip(*columns))


def _times(matrix: tuple[Costs, ...], after: Costs) -> Costs:
    return tuple(min(NEVER, *[m + a for m, a in zip(row, after)]) for row in matrix)


@lru_cache(1 << 16)
def _advanced(symbol: Symbol, length: int, after: Costs) -> Costs:
    exponent = 0
    while length:
        if length & 1:
            after = _times(power(symbol, exponent), after)
        length >>= 1
        exponent += 1
    return after


def advance(symbol: Symbol, length: int, after: Costs) -> Costs:
    """The costs before a run, from those after it."""
    least = min(after)  # so that equal shapes meet in the cache
    before = _advanced(symbol, length, tuple(c - least if c < NEVER else c for c in after))
    return tuple(c + least if c < NEVER else c for c in before)


def _choose(symbol: Symbol, after: Costs, state: int) -> tuple[str, int]:
    least = min(after)
    return _chosen(symbol, tuple(c - least if c < NEVER else c for c in after), state)


@lru_cache(1 << 16)
def _chosen(symbol: Symbol, after: Costs, state: int) -> tuple[str, int]:
    """The edits of one turn, inserts before it included, and the state after it."""
    before = advance(symbol, 1, after)
    letters = ""
    while True:
        ways = {e: s for e, cost, s in _edits(symbol, state) if cost + after[s] == before[state]}
        if INSERT + before[DUE[state][1]] == before[state]:
            ways["I"] = DUE[state][1]
        letter = min(ways)
        letters, state = letters + letter, ways[letter]
        if letter != "I":
            return letters, state


def _unroll(symbol: Symbol, length: int, after: Costs, state: int, letters: list[str]) -> int:
    if length == 1:
        chosen, state = _choose(symbol, after, state)
        letters.append(chosen)
        return state
    half = length // 2
    state = _unroll(symbol, half, advance(symbol, length - half, after), state, letters)
    return _unroll(symbol, length - half, after, state, letters)


def costs_before(runs: list[tuple[Symbol, int]], after: Costs) -> list[Costs]:
    """The costs before each run and, last, after all."""
    found = [after]
    for symbol, length in reversed(runs):
        found.append(advance(symbol, length, found[-1]))
    return found[::-1]


def solve(runs: list[tuple[Symbol, int]], after: Costs, state: int, last: bool) -> tuple[int, str, int]:
    """Cost, edits and final state of a piece; ``last`` if the conversation ends with it."""
    costs = costs_before(runs, after)
    start, letters = state, []
    for (symbol, length), behind in zip(runs, costs[1:]):
        state = _unroll(symbol, length, behind, state, letters)
    cost = costs[0][start] - after[state]
    if last:
        cost += after[state]
        while state not in ACCEPTING:
            letters.append("I")
            state = DUE[state][1]
    return cost, "".join(letters), state


def transition(runs: list[tuple[Symbol, int]]) -> list[int]:
    """The 4 x 4 least costs between states over a piece, row by row."""
    columns = [
        costs_before(runs, tuple(0 if s == end else NEVER for s in STATES))[0] for end in STATES
    ]
    return [cost for row in zip(*columns) for cost in row]


def repaired_rows(
    runs: list[tuple[Symbol, int]], rows: list[dict[str, str]], letters: str, state: int
) -> list[dict[str, str]]:
    """The turns that ``letters`` leave; ``rows`` are those that need not go."""
    given = iter(rows)
    needed = (symbol == MUST_GO for symbol, length in runs for _ in range(length))
    found = []
    for letter in letters:
        if letter == "I":
            role, state = DUE[state]
            found.append({"role": role, "text": ""})
        elif not next(needed):
            row = next(given)
            if letter == "K":
                found.append(row)
                state = FOLLOWS[state][row["role"][:1]]
            elif letter == "R":
                role, state = DUE[state]
                found.append({"role": role, "text": row["text"]})
    return found


class _Piece:
    """Consecutive turns of one conversation, as they are read."""

    def __init__(self):
        self.counts = dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.first = self.last = None
        self.first_initial = self.last_initial = None
        self.symbols: list[tuple[Symbol, int]] = []
        self.rows: list[dict[str, str]] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, n: int, new: bool) -> None:
        """``n`` equal turns; ``new`` if there was no such role and text before."""
        counts, initial, end = self.counts, role[:1], text.rstrip(SPACES)[-1:]
        if self.counts["n"] == 0:
            self.first, self.first_initial = turn, initial
        elif self.last_initial + initial not in LEGAL:
            counts["illegal"] += 1
        counts["illegal"] += n - 1  # equal initials never follow each other
        counts["n"] += n
        if turn is not None:
            if turn != self.high:  # they come in order
                counts["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last, self.last_initial = turn, initial
        if not end:
            counts["blank"] += n
            self.symbols.append((MUST_GO, n))
        else:
            if new:
                truncated = end not in ENDS
                counts["truncated"] += truncated
                self.symbols.append(((initial if initial in ("s", "u", "a") else "", truncated), 1))
                self.rows.append({"role": role, "text": text})
                n -= 1
            if n:
                counts["duplicate"] += n
                self.symbols.append((MUST_GO, n))
        self.size += len(text) + 1

    def runs(self) -> list[tuple[Symbol, int]]:
        return [(s, sum(n for _, n in same)) for s, same in groupby(self.symbols, lambda x: x[0])]

    def row(self, conv_id, part: int, seq: int, whole: bool) -> dict:
        runs = self.runs()
        found = {"conv_id": conv_id, "part": part, "seq": seq, "whole": whole} | self.counts
        found |= {name: getattr(self, name) for name in _EDGES}
        if whole:
            cost, letters, _ = solve(runs, AT_END, 0, last=True)
            rows = repaired_rows(runs, self.rows, letters, 0)
            return found | {"cost": cost, "audit": letters, "rows": rows}
        coded = [{"initial": i, "truncated": t, "length": n} for (i, t), n in runs]
        return found | {"rows": self.rows, "runs": coded, "matrix": transition(runs)}


_EDGES = ("low", "high", "first", "last", "first_initial", "last_initial")
_STATS = (
    "n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
    "`first` long, `last` long, first_initial string, last_initial string"
)
_ROWS = "rows array<struct<role:string,text:string>>"
_RUNS = "runs array<struct<initial:string,truncated:boolean,length:long>>"


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _pieces(schema: pa.Schema, piece_rows: int, piece_chars: int):
    names = ("conv_id", "turn", "role", "text", "n", "mark")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        piece, known, split, new, ready, size = _Piece(), None, True, False, [], 0
        # The first and the last conversation of a task may go on in others.
        for batch in batches:
            for conv_id, turn, role, text, n, mark in zip(*(batch.column(c).to_pylist() for c in names)):
                changed = known is not None and known[0] != conv_id
                if changed or len(piece.symbols) >= piece_rows or piece.size >= piece_chars:
                    split = split or not changed
                    ready.append(piece.row(known[0], part, seq, whole=not split))
                    size += piece.size
                    piece, seq, split = _Piece(), seq + 1, split and not changed
                    if size >= piece_chars or len(ready) >= piece_rows:
                        yield _emit(ready, schema)
                        ready, size = [], 0
                known = (conv_id,)
                if mark:
                    new = True
                elif role is not None:
                    piece.add(turn, role, text, n, new)
                    new = False
        if known is not None:
            ready.append(piece.row(known[0], part, seq, whole=False))
            yield _emit(ready, schema)

    return cut


def _with_id(frame: DataFrame, *columns: str) -> StructType:
    """``conv_id`` as in ``frame``, and more columns."""
    rest = StructType.fromDDL(", ".join(columns))
    return StructType([frame.schema["conv_id"], *rest.fields])


def _each(frame: DataFrame, function: Callable, schema: StructType, *options: int) -> DataFrame:
    return frame.mapInArrow(function(to_arrow_schema(schema), *options), schema)


def _backward(schema: pa.Schema):
    """Each piece's costs after it, from the transitions of those that follow."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, after = None, AT_END
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                last = known != (row["conv_id"],)
                if last:
                    known, after = (row["conv_id"],), AT_END
                ready.append({"part": row["part"], "seq": row["seq"], "after": after, "is_last": last})
                m = row["matrix"]
                after = _times(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), after)
            yield _emit(ready, schema)

    return walk


def _runs_of(row: dict) -> list[tuple[Symbol, int]]:
    return [((r["initial"], r["truncated"]), r["length"]) for r in row["runs"]]


def _exits(schema: pa.Schema):
    """The state in which each piece ends, for all states that it may start in."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                runs, after = _runs_of(row), tuple(row["after"])
                before = costs_before(runs, after)[0]
                ends = [solve(runs, after, s, False)[2] if before[s] < NEVER else 0 for s in STATES]
                ready.append({k: row[k] for k in ("conv_id", "part", "seq", "after", "is_last")} | {"ends": ends})
            yield _emit(ready, schema)

    return leave


def _forward(schema: pa.Schema):
    """The state each piece starts in."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, 0
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if known != (row["conv_id"],):
                    known, state = (row["conv_id"],), 0
                ready.append({k: row[k] for k in ("part", "seq", "after", "is_last")} | {"start": state})
                state = row["ends"][state]
            yield _emit(ready, schema)

    return walk


def _finish(schema: pa.Schema):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                runs, start = _runs_of(row), row["start"]
                cost, letters, _ = solve(runs, tuple(row["after"]), start, row["is_last"])
                rows = repaired_rows(runs, row["rows"], letters, start)
                yield _emit([row | {"cost": cost, "audit": letters, "rows": rows}], schema)

    return finish


def _in_order(pieces: DataFrame, descending: bool = False) -> DataFrame:
    order = [F.desc(c) if descending else F.asc(c) for c in ("part", "seq")]
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def repaired(
    conversations: DataFrame,
    ids: DataFrame | None = None,
    *,
    piece_rows: int = PIECE_ROWS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The repaired turns and the edits, a piece of a conversation to a row.

    ``rows`` are the piece's turns after the repair, ``audit`` the letters of its
    edits, ``cost`` their cost; the others count the given rows.  ``part`` and ``seq``
    order the pieces, ``whole`` ones are all of a conversation.  Conversations named in ``ids`` are returned even without turns.
    """
    space = F.lit(" ")
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        F.lit(1).cast("long").alias("n"),
    )
    if ids is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
        turns = turns.unionByName(ids.select("conv_id", *none, F.lit(0).cast("long").alias("n")))
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    turns = stage(turns.withColumn("sha", F.unhex(F.sha2("text", 256))), "turns")

    # Where a role and text are said first; a mark just before that row.
    said = turns.where("role is not null").groupBy("conv_id", "role", "sha")
    said = said.agg(F.min("turn").alias("_turn"), F.count_if(F.col("turn").isNull()).alias("_no_turn"))
    marks = said.select(
        "conv_id",
        F.when(F.col("_no_turn") == 0, F.col("_turn")).alias("turn"),
        "role",
        F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n"),
        "sha",
    )
    keys = ("conv_id", "turn", "role", "sha")
    rows = marks.withColumn("mark", F.lit(True)).unionByName(turns.withColumn("mark", F.lit(False)))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.desc("mark")).drop("sha")

    place = "part int, seq long"
    edits = ("whole boolean", _STATS, "cost long, audit string", _ROWS)
    schema = _with_id(conversations, place, *edits, _RUNS, "matrix array<long>")
    pieces = stage(_each(rows, _pieces, schema, piece_rows, piece_chars), "pieces")
    result = _with_id(conversations, place, *edits)
    whole = pieces.where("whole").select(*result.names)
    parts = pieces.where("not whole")

    after = "after array<long>, is_last boolean"
    costs = _in_order(parts.select("conv_id", "part", "seq", "matrix"), descending=True)
    costs = stage(_each(costs, _backward, StructType.fromDDL(f"{place}, {after}")), "costs")
    ends = join_lookup(parts.select("conv_id", "part", "seq", "runs"), costs, ["part", "seq"])
    ends = stage(_each(ends, _exits, _with_id(parts, place, after, "ends array<int>")), "ends")
    starts = _each(_in_order(ends), _forward, StructType.fromDDL(f"{place}, {after}, start int"))
    starts = stage(starts, "starts")
    solved = join_lookup(parts.drop("matrix", "cost", "audit"), starts, ["part", "seq"])
    return whole.unionByName(stage(_each(solved, _finish, result), "solved"))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """The repaired turns one by one; order them by part, seq and place."""
    found = pieces.select("conv_id", "part", "seq", F.posexplode("rows").alias("place", "row"))
    return found.select("conv_id", "part", "seq", "place", "row.role", "row.text")


_SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


class _Summary:
    """Adds up the pieces of a conversation in their order."""

    def __init__(self):
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
        self.low = self.high = self.initial = None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, row: dict) -> None:
        for name in self.sums:
            self.sums[name] += row[name]
        if row["n"]:
            if self.initial is not None and self.initial + row["first_initial"] not in LEGAL:
                self.sums["illegal"] += 1
            self.initial = row["last_initial"]
        if row["low"] is not None:
            self.sums["turns"] -= self.high == row["low"]
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.audit.append(row["audit"])
        for turn in row["rows"]:
            self.hash.update(f"{chr(10) if self.begun else ''}{turn['role']}:{turn['text']}".encode())
            self.begun = True

    def row(self, conv_id) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.sums["turns"], LARGEST)
        sums = {k: v for k, v in self.sums.items() if k != "turns"}
        audit, digest = "".join(self.audit), self.hash.hexdigest()
        return {"conv_id": conv_id, "gaps": gaps, "audit": audit, "repaired_sha256": digest} | sums


def _summarise(schema: pa.Schema):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, summary = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if known != (row["conv_id"],):
                    if known:
                        yield _emit([summary.row(*known)], schema)
                    known, summary = (row["conv_id"],), _Summary()
                summary.add(row)
        if known:
            yield _emit([summary.row(*known)], schema)

    return summarise


def summary(pieces: DataFrame) -> DataFrame:
    """A row for each conversation: faults, cost, edits and a hash of what they leave."""
    schema = _with_id(pieces, _SUMMARY)
    whole = _each(pieces.where("whole"), _summarise, schema)
    return whole.unionByName(_each(_in_order(pieces.where("not whole")), _summarise, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults put into some rows, chosen by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    fault = F.col("_fault")
    spoilt = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    chosen = F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20
    rows = conversations.select("conv_id", "turn", "role", "text", chosen.alias("_fault"))
    rows = rows.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        spoilt.alias("text"),
        F.explode(copies).alias("_copy"),
    )
    return rows.drop("_copy")
