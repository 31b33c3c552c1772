"""Conversation structure repair: the cheapest edits that give an orderly exchange of roles.

An orderly conversation has the role initials `(s?(ua)+)?`: an automaton with
four states. The edits make it weighted: keep, rerole, delete, insert. Its
determinisation is lazy. A vector of the costs that are still to come from
each state, less their least, is a state of the deterministic automaton; the
transition table maps such a state and a row's symbol to the state before the
row and the cost between them, and is filled when a pair is met first. A scan
of the table over a conversation gives its cost. The trace goes against the
scan, along arcs that are tight (whose cost is exactly what the two vectors
differ by). Scans run from the last row to the first, so that the trace begins
with the first row, where of several tight arcs the one with the least letter
can be taken at once: that gives the ASCII-least audit.

Conversations of any length: rows are in pieces of bounded size
(`operators.ordered`). Almost every conversation is in one piece and is done
there. The others send a 4 x 4 matrix of costs for each piece, then, with the
costs behind a piece known, its four ends by beginning; only these small rows
meet by conversation, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, stored
from tallyforge.operators.ordered import PIECE, POS, SIZE, in_pieces, spans

#: White space of the contract: everything else is text.
SPACE = " \t\n\x0b\x0c\r"
INSERT = REROLE = 2
DELETE = 3
#: Far more than any cost that is not impossible.
NEVER = 1 << 40
#: State by role class (s, u, a, others) read in a state (nothing, s, u, a); None: no such arc.
STEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: The state after an inserted or reroled turn, and the role of such a turn.
NEXT = (2, 2, 3, 2)
NAME = {2: "user", 3: "assistant"}
#: Costs behind the last row: inserts that complete an exchange, and their letters.
END, LAST = (0, 4, 2, 0), ("", "II", "I", "")
#: Symbols of rows: GONE must be deleted; else the role's class, and TRUNCATED more for a truncated row.
GONE, TRUNCATED = 8, 4


class Automaton:
    """The lazily determinised automaton, read from the last row to the first."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        #: (number of the vector behind a row, its symbol): the number of the vector before it, what it is less by, and for each state the letters of the tight arcs.
        self.table: dict[tuple[int, int], tuple[int, int, tuple[str, ...]]] = {}

    def known(self, costs: Iterable[int]) -> tuple[int, int]:
        """A vector's number, and what was taken off to make its least cost 0."""
        costs = tuple(costs)
        least = min(costs)
        vector = tuple(c - least if c < NEVER else NEVER for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def before(self, behind: int, symbol: int) -> tuple[int, int, tuple[str, ...]]:
        found = self.table.get((behind, symbol))
        if found is None:
            found = self.table[behind, symbol] = self._arcs(self.vectors[behind], symbol)
        return found

    def _arcs(self, togo: tuple[int, ...], symbol: int) -> tuple[int, int, tuple[str, ...]]:
        arcs: list[dict[str, int]] = []
        for q in range(4):
            ways = {"D": DELETE + togo[q]}
            if symbol != GONE:
                extra = symbol // TRUNCATED
                kept = STEP[q][symbol % TRUNCATED]
                if kept is not None:
                    ways["K"] = extra + togo[kept]
                ways["R"] = REROLE + extra + togo[NEXT[q]]
            arcs.append(ways)
        direct = [min(*ways.values(), NEVER) for ways in arcs]
        costs = [min(direct[q], INSERT + direct[NEXT[q]], 2 * INSERT + direct[NEXT[NEXT[q]]], NEVER) for q in range(4)]
        letters = []
        for q in range(4):
            word = ""
            while costs[q] < NEVER:
                tight = [w for w, c in (*arcs[q].items(), ("I", INSERT + costs[NEXT[q]])) if c == costs[q]]
                word += min(tight)
                if word[-1] != "I":
                    break
                q = NEXT[q]
            letters.append(word)
        number, least = self.known(costs)
        return number, least, tuple(letters)

    def scan(self, symbols: bytes, behind: Iterable[int]) -> tuple[list[int], list[int]]:
        """Costs to go from each state at the first row, given those behind the last, and the number of the vector behind each row."""
        at, total = self.known(behind)
        numbers = [0] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            numbers[i] = at
            at, less, _ = self.before(at, symbols[i])
            total += less
        return [c + total if c < NEVER else NEVER for c in self.vectors[at]], numbers

    def trace(self, symbols: bytes, numbers: list[int], q: int) -> Iterator[tuple[str, int]]:
        """For each row its letters and the state before them, from state q on."""
        for symbol, number in zip(symbols, numbers, strict=True):
            word = self.before(number, symbol)[2][q]
            yield word, q
            q = after(word, q, symbol)

    def end(self, symbols: bytes, numbers: list[int], q: int) -> int:
        for symbol, number in zip(symbols, numbers, strict=True):
            q = after(self.before(number, symbol)[2][q], q, symbol)
        return q


def after(word: str, q: int, symbol: int) -> int:
    """The state behind a row that was edited by these letters (inserts, then the row's own)."""
    for letter in word:
        if letter == "K":
            q = STEP[q][symbol % TRUNCATED]
        elif letter != "D":
            q = NEXT[q]
    return q


def matrix(auto: Automaton, symbols: bytes) -> list[int]:
    """Costs from each state before a piece to each state behind it, by row."""
    columns = [auto.scan(symbols, [0 if t == q else NEVER for t in range(4)])[0] for q in range(4)]
    return [columns[t][q] for q in range(4) for t in range(4)]


def times(costs: list[int], behind: list[int]) -> list[int]:
    return [min(min(costs[4 * q + t] + behind[t] for t in range(4)), NEVER) for q in range(4)]


class Repaired:
    """A conversation that is being put together of its pieces, in order; a digest and sums, never its texts."""

    COUNTS = ("blank", "duplicate", "truncated")

    def __init__(self) -> None:
        self.gaps_from = self.gaps_to = self.last_turn = None
        self.turns = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(self.COUNTS, 0)
        self.initial: str | None = None
        self.audit: list[str] = []
        self.body, self.empty = hashlib.sha256(), True

    def add(self, turns: tuple, faults: tuple, initials: tuple, cost: int, audit: str, body: str) -> None:
        first, last, distinct = turns
        if first is not None:
            self.turns += distinct - (first == self.last_turn)
            self.gaps_from = first if self.gaps_from is None else self.gaps_from
            self.gaps_to = self.last_turn = last
        for name, n in zip(self.COUNTS, faults, strict=True):
            self.faults[name] += n
        begin, end, inside = initials
        if begin is not None:
            self.illegal += inside + (self.initial is not None and self.initial + begin not in ("su", "ua", "au"))
            self.initial = end
        self.cost += cost
        self.audit.append(audit)
        if body:
            self.body.update((body[1:] if self.empty else body).encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.gaps_from is None else self.gaps_to - self.gaps_from + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.body.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: What a piece adds to its conversation, in the order of Repaired.add.
ADDED = "first long, last long, distinct long, blank long, duplicate long, truncated long, begin string, end string, inside long, cost long, audit string, body string"


def symbols_of(rows: list[dict]) -> bytes:
    """A symbol for each row: its role's class and its fault (blank, duplicate, truncated or empty)."""
    out = bytearray()
    for r in rows:
        kind = "sua".find(r["role"][:1]) if r["role"] else 3
        out.append(GONE if r["fault"] in ("blank", "duplicate") else (3 if kind < 0 else kind) + TRUNCATED * (r["fault"] == "truncated"))
    return bytes(out)


def mend(auto: Automaton, rows: list[dict], behind: Iterable[int] = END, q: int = 0, last: bool = True) -> tuple:
    """What a piece of a conversation (turn, role, text, fault) adds, given the costs behind it and the state before it."""
    symbols = symbols_of(rows)
    _, numbers = auto.scan(symbols, behind)
    letters, body, cost, state = [], [], 0, q
    for row, symbol, (word, q) in zip(rows, symbols, auto.trace(symbols, numbers, q), strict=True):
        state = q
        for letter in word:
            if letter == "I":
                cost, state = cost + INSERT, NEXT[state]
                body.append(f"\n{NAME[state]}:")
            elif letter == "D":
                cost += DELETE
            else:
                state = STEP[state][symbol % TRUNCATED] if letter == "K" else NEXT[state]
                cost += symbol // TRUNCATED + REROLE * (letter == "R")
                body.append(f"\n{row['role'] if letter == 'K' else NAME[state]}:{row['text']}")
        letters.append(word)
    if last:
        for letter in LAST[state]:
            state, cost = NEXT[state], cost + INSERT
            body.append(f"\n{NAME[state]}:")
            letters.append(letter)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    faults = tuple(sum(r["fault"] == f for r in rows) for f in Repaired.COUNTS)
    inside = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    told = (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)
    return told, faults, (initials[0], initials[-1], inside) if rows else (None, None, 0), cost, "".join(letters), "".join(body)


def damage(rows: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, with places) as a faulty log would leave them; nulls are one space.

    By CRC-32 of `conv_id:turn`, of each 20 one is dropped (`gone`), loses its
    text, loses `.!?`, stands twice, or has the role user.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    hurt = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.sequence(F.lit(0), F.when(kind == 3, F.lit(1)).otherwise(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), hurt.alias("text"), (kind == 0).alias("gone"), PIECE, F.explode(copies).alias("_copy"), POS).withColumn(POS, F.col(POS) * 2 + F.col("_copy")).drop("_copy")


def own_fault(text: Column) -> Column:
    """Blank, truncated or empty; what repeats is told elsewhere."""
    said = F.rtrim(text, F.lit(SPACE))
    return F.when(said == "", F.lit("blank")).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))


def _rows_of(group: list[dict]) -> list[dict]:
    """Rows that are there; of those with role and text seen earlier in the group the fault is that."""
    seen, rows = set(), [r for r in group if not r["gone"]]
    for r in rows:
        said = hashlib.sha256(f"{r['role']}\0{r['text']}".encode()).digest()
        if said in seen and r["fault"] != "blank":
            r["fault"] = "duplicate"
        seen.add(said)
    return rows


def _each(work: Callable[[Automaton, list], tuple], columns: list[pa.Field]) -> Callable:
    """A mapInArrow function: `work` on every row's columns with one automaton for a task; gives the first column, then what it returns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        for part in slices(batches):
            rows = [work(auto, list(x)) for x in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], f.type) for i, f in enumerate(columns)]], names=[part.schema.names[0], *[f.name for f in columns]])

    return run


def _fields(ddl: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return [pa.field(*(lambda n, k: (n, kinds[k]))(*x.strip().split(" "))) for x in ddl.split(",")]


def _grouped(rows: DataFrame) -> DataFrame:
    """A row for each conversation and piece: its damaged rows in order. A piece is SIZE rows, and as many again that stand twice, at most."""
    kind = "turn", "role", "text", "fault", "gone"
    return rows.groupBy("conv_id", PIECE).agg(F.array_sort(F.collect_list(F.struct(POS, *kind))).alias("rows"))


def _streamed(keep: Callable, columns: list[pa.Field]) -> Callable:
    """A mapInArrow function over rows sorted by conversation and piece: `keep(state, row)` gives the next state and what stands beside conv_id and piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if conv != now:
                    now, state = conv, None
                state, told = keep(state, row)
                out.append(told)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([t[i] for t in out], f.type) for i, f in enumerate(columns)]], names=["conv_id", PIECE, *[f.name for f in columns]])

    return run


def _whole(short: DataFrame, kind: str) -> DataFrame:
    """Conversations in one piece."""

    def work(auto: Automaton, x: list) -> tuple:
        told = Repaired()
        told.add(*mend(auto, _rows_of(x[0])))
        return told.row()

    return _grouped(short).select("conv_id", "rows").mapInArrow(_each(work, _fields(RESULT)), f"conv_id {kind}, {RESULT}")


def _in_parts(long: DataFrame, kind: str) -> DataFrame:
    """Conversations in several pieces: matrices meet from the end, then ends by beginning from the front, then sums and digests."""
    key = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    first = long.filter("NOT gone").groupBy("conv_id", key.alias("_said")).agg(F.min(POS).alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"), "_said", "_first")
    marked = long.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (key == F.col("_said")), "left")
    marked = marked.withColumn("fault", F.when((F.col(POS) > F.col("_first")) & (F.col("fault") != "blank"), F.lit("duplicate")).otherwise(F.col("fault"))).drop("_conv", "_said", "_first")
    pieces = stored(_grouped(marked), "repair_pieces")
    symbols = pieces.select("conv_id", "rows", PIECE)

    costs = symbols.mapInArrow(_with_piece(lambda auto, x: (matrix(auto, symbols_of([r for r in x[0] if not r["gone"]])),), "costs array<long>"), f"conv_id {kind}, {PIECE} long, costs array<long>")
    ordered = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc(PIECE)).select("conv_id", PIECE, "costs")

    def back(state: list[int] | None, row: list) -> tuple:
        behind = list(END) if state is None else state
        return times(row[1], behind), (behind, int(state is None))

    behind = stored(ordered.mapInArrow(_streamed(back, _fields("behind array<long>, last int")), f"conv_id {kind}, {PIECE} long, behind array<long>, last int"), "repair_behind")
    on = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{PIECE}") == F.col(f"{b}.{PIECE}"))
    joined = symbols.alias("s").join(behind.alias("b"), on("s", "b")).select("s.conv_id", "s.rows", f"s.{PIECE}", "b.behind")

    def ends(auto: Automaton, x: list) -> tuple:
        marks = symbols_of([r for r in x[0] if not r["gone"]])
        numbers = auto.scan(marks, x[2])[1]
        return ([auto.end(marks, numbers, q) if _open(auto, marks, numbers, q) else q for q in range(4)],)

    ending = joined.mapInArrow(_with_piece(ends, "ends array<int>"), f"conv_id {kind}, {PIECE} long, ends array<int>")
    ordered = ending.repartition("conv_id").sortWithinPartitions("conv_id", PIECE).select("conv_id", PIECE, "ends")

    def ahead(state: int | None, row: list) -> tuple:
        begin = state or 0
        return row[1][begin], (begin,)

    entry = ordered.mapInArrow(_streamed(ahead, _fields("begin_state int")), f"conv_id {kind}, {PIECE} long, begin_state int")
    known = pieces.alias("s").join(behind.alias("b"), on("s", "b")).join(entry.alias("e"), on("s", "e")).select("s.conv_id", "s.rows", f"s.{PIECE}", "b.behind", "b.last", "e.begin_state")

    def work(auto: Automaton, x: list) -> tuple:
        rows, _, behind, last, begin = x
        turns, faults, initials, *rest = mend(auto, [r for r in rows if not r["gone"]], behind, begin, bool(last))
        return (*turns, *faults, *initials, *rest)

    added = known.mapInArrow(_with_piece(work, ADDED), f"conv_id {kind}, {PIECE} long, {ADDED}")
    return added.repartition("conv_id").sortWithinPartitions("conv_id", PIECE).mapInArrow(_sum_up, f"conv_id {kind}, {RESULT}")


def _open(auto: Automaton, symbols: bytes, numbers: list[int], q: int) -> bool:
    """Whether a repair can pass through this state at all."""
    return not symbols or bool(auto.before(numbers[0], symbols[0])[2][q])


def _with_piece(work: Callable, ddl: str) -> Callable:
    """As `_each`, for rows of conv_id, rows, piece and more: gives conv_id and piece, then what `work` returns."""
    return _each(lambda auto, x: (x[1], *work(auto, x)), [pa.field(PIECE, pa.int64()), *_fields(ddl)])


def _sum_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, one conversation after another, as its result; what is held is a batch and the audit."""
    now, told, kind = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], kind), *[pa.array([v], f.type) for v, f in zip(told.row(), fields, strict=True)]], names=["conv_id", *[f.name for f in fields]])

    fields = _fields(RESULT)
    for batch in batches:
        kind = batch.column(0).type
        for conv, _, *x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if told is None or conv != now:
                if told is not None:
                    yield out()
                now, told = conv, Repaired()
            told.add(tuple(x[:3]), tuple(x[3:6]), tuple(x[6:9]), *x[9:])
    if told is not None:
        yield out()


def repair_conversations(rows: DataFrame, hurt: Callable[[DataFrame], DataFrame] | None = None, size: int = SIZE) -> DataFrame:
    """The cheapest repair of every conversation of `rows` (conv_id, turn, role, text), a row each.

    Rows are ordered by turn (nulls first), then role and text; `hurt` may
    change them once they have their places (`damage`; without it nulls are one
    space and nothing else is changed). Faults, costs and edits are those of
    the module's head: blank rows and repeated ones must go, kept truncated ones
    cost 1. Returns conv_id, `gaps` (turn numbers missing between the least and
    the largest), `blank`, `duplicate`, `truncated`, `illegal` (neighbours whose
    initials are not su, ua or au), `cost`, `audit` and `repaired_sha256`. A
    role whose initial is none of s, u, a can't be kept; nor can an empty one. A
    null conv_id is a conversation of its own; a conversation without rows has
    zeros, an empty audit and the digest of nothing; an empty table no rows.
    """
    placed = in_pieces(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"], size)
    several = stored(spans(placed, ["conv_id"]).select(F.col("conv_id").alias("_conv"), F.col(PIECE).alias("_at")), "repair_spans")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(PIECE) == F.col("_at"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    spaced = lambda df: df.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}).withColumn("gone", F.lit(False))
    told = lambda df: (hurt or spaced)(df).withColumns({"fault": own_fault(F.col("text")), "turn": F.col("turn").cast("long")})
    short = told(placed.join(several, same, "left_anti"))
    if several.isEmpty():
        return _whole(short, kind)
    long = told(placed.join(several, same, "left_semi"))
    return _whole(short, kind).unionByName(_in_parts(long, kind))
