"""Conversation structure repair as a shortest path through composed automata.

Three machines are composed, lazily: an acceptor of the rows in order, a transducer of the
edits (keep, rerole, delete, insert) and an acceptor of the role grammar ``(s?(ua)+)?``. A
state of the composition is (row, grammar state); its arcs are made when it is visited. The
weight of a path is (cost, labels), least cost first and then the ASCII-least label string.
Rows come in topological order, so distances to the end are one backward sweep; from a state
each label leads to one next state, so the least label on a path of least cost, taken step
by step, is the least string.

A conversation may be of any length. Rows are sorted in ranges over all tasks and cut into
segments of bounded size; a segment that isn't a whole conversation is summed up as a 4 x 4
matrix of least costs, the matrices of a conversation are folded from its end, and each
segment is then walked by itself. Equal rows are one row with a count. Only the hash of the
repaired text, which is sequential by definition, streams through one task a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, materialise

#: Grammar states: 0 at the start, 1 behind s, 2 behind u, 3 behind a; 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPT = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: What a rerole or an insert gives in each state, and where it leads.
NEXT = ("u", "u", "a", "u")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = ("s", "u", "a", "")
NEVER = 1 << 60


def code(initial: str, fault: str) -> int:
    """A row as one small number: its role's initial and its fault."""
    return INITIALS.index(initial) * len(FAULTS) + FAULTS.index(fault)


@lru_cache(maxsize=None)
def arcs(row: int, state: int) -> tuple[tuple[str, int, int, bool], ...]:
    """Arcs of the composed machine at a row of this code: (label, cost, next state, the row is used up), by label."""
    initial, fault = INITIALS[row // len(FAULTS)], FAULTS[row % len(FAULTS)]
    out = [("D", DELETE, state, True), ("I", INSERT, GRAMMAR[state][NEXT[state]], False)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if initial in GRAMMAR[state]:
            out.append(("K", KEEP + more, GRAMMAR[state][initial], True))
        out.append(("R", REROLE + more, GRAMMAR[state][NEXT[state]], True))
    return tuple(out)


def _closed(direct: list[int]) -> tuple[int, ...]:
    """Distances with up to two inserts in front; more would only come back to where they began."""
    once = [GRAMMAR[q][NEXT[q]] for q in range(4)]
    return tuple(min(direct[q], INSERT + direct[once[q]], 2 * INSERT + direct[once[once[q]]]) for q in range(4))


#: Distance from each state behind the last row to acceptance.
FINAL = _closed([0 if q in ACCEPT else NEVER for q in range(4)])


def distances(rows: bytes, copies: tuple[int, ...], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost from each state before each row, given those behind the last one. Copies of a row are duplicates, which go."""
    out = [end]
    for row, n in zip(reversed(rows), reversed(copies), strict=True):
        after = out[-1]
        direct = [min(cost + after[to] for _, cost, to, used in arcs(row, q) if used) for q in range(4)]
        out.append(tuple(d + DELETE * (n - 1) for d in _closed(direct)))
    return out[::-1]


def walk(rows: bytes, copies: tuple[int, ...], end: tuple[int, ...], state: int, last: bool) -> tuple[list[str], str, int]:
    """Labels of each row (its inserts, then its own; of a row's copies the first), those behind the last row, the exit state."""
    ahead, labels = distances(rows, copies, end), []
    for k, (row, n) in enumerate(zip(rows, copies, strict=True)):
        said, spare = "", DELETE * (n - 1)
        here = ahead[k][state]
        used = False
        while not used:
            for label, cost, to, used in arcs(row, state):
                # before the row is used up its copies are still to be paid for; distances before it have them
                if cost + (ahead[k + 1][to] + spare if used else ahead[k][to]) == here:
                    said, here, state = said + label, here - cost - (spare if used else 0), to
                    break
            else:
                raise AssertionError("no arc lies on a shortest path")
        labels.append(said)
    tail = ""
    while last and state not in ACCEPT:
        tail, state = tail + "I", GRAMMAR[state][NEXT[state]]
    return labels, tail, state


_short_walk = lru_cache(maxsize=50_000)(walk)


def _walk(rows: bytes, *rest) -> tuple[list[str], str, int]:
    """:func:`walk`, remembered for short conversations, which look alike."""
    return (_short_walk if len(rows) <= 32 else walk)(rows, *rest)


def _facts(turns: DataFrame) -> DataFrame:
    """A row for each distinct (conversation, turn, role, text) and its number of copies, without the text."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    rows = turns.select(
        "conv",
        "turn",
        "role",
        _digest().alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        F.when(bare == "", 1).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
    )
    rows = rows.groupBy("conv", "turn", "role", "digest").agg(F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.count(F.lit(1)).alias("copies"))
    # of a role and text the row with the first turn (nulls first) isn't a duplicate; joined on the whole row, so no text is a hot key
    first = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("f")).select(
        F.col("conv").alias("conv1"), F.col("role").alias("role1"), F.col("digest").alias("digest1"), F.col("f.turn").alias("turn1"), F.lit(True).alias("first")
    )
    same = F.col("conv").eqNullSafe(F.col("conv1")) & F.col("turn").eqNullSafe(F.col("turn1")) & (F.col("role") == F.col("role1")) & (F.col("digest") == F.col("digest1"))
    fault = F.when((F.col("fault") == 1) | F.col("first").isNotNull(), F.col("fault")).otherwise(2)
    return rows.join(first, same, "left").select("conv", "turn", "role", "digest", "copies", (F.col("initial") * len(FAULTS) + fault).cast("int").alias("code"))


def _digest():
    """Texts are told apart by 128 bits of their SHA-256."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def _ordered(*more: str) -> list:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", *more]


def _segments(facts: DataFrame, longest: int) -> DataFrame:
    """Runs of a conversation's rows in order; ``whole`` where a run surely is all of it."""
    conv_type, turn_type = facts.schema["conv"].dataType, facts.schema["turn"].dataType
    schema = T.StructType(
        [
            T.StructField("conv", conv_type),
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("whole", T.BooleanType()),
            T.StructField("turns", T.ArrayType(turn_type)),
            T.StructField("roles", T.ArrayType(T.StringType())),
            T.StructField("digests", T.ArrayType(T.BinaryType())),
            T.StructField("copies", T.ArrayType(T.LongType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, block = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        held, done = [], []  # rows of the current run; finished runs
        conv, begun, touches = None, False, True

        def close(ends: bool) -> None:
            nonlocal block, held
            whole = ends and not touches and block_of_conv == 0
            _, turns, roles, digests, copies, codes = map(list, zip(*held, strict=True))
            done.append((conv, part, block, whole, turns, roles, digests, copies, bytes(codes)))
            block, held = block + 1, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return out

        block_of_conv = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if begun and row[0] != conv:
                    close(ends=True)
                    touches, block_of_conv = False, 0
                elif len(held) >= longest:
                    close(ends=False)
                    block_of_conv += 1
                conv, begun = row[0], True
                held.append(row)
            if done:
                yield flush()
        if held:
            touches = True  # the next part may go on with it
            close(ends=True)
            yield flush()

    order = _ordered()
    return facts.select("conv", "turn", "role", "digest", "copies", "code").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, schema)


def _vector(values) -> tuple[int, ...]:
    return tuple(map(int, values))


def _solve(segments: DataFrame) -> DataFrame:
    """Each segment with the state it is entered in, the distances behind it, and whether it is its conversation's last."""
    ahead = F.array(*(F.lit(v).cast("long") for v in FINAL))
    whole = segments.where("whole").select("*", F.lit(0).alias("state"), ahead.alias("ahead"), F.lit(True).alias("last"))
    split = segments.where("not whole")
    conv = T.StructField("conv", segments.schema["conv"].dataType)
    key = [conv, T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType())]
    vector = T.ArrayType(T.LongType())

    def matrix(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            columns = [[distances(c, _vector(n), tuple(0 if q == r else NEVER for q in range(4)))[0] for r in range(4)] for c, n in zip(f["codes"], f["copies"], strict=True)]
            yield f[["conv", "part", "block"]].assign(costs=[[int(v) for column in m for v in column] for m in columns])

    def back(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "block"], ascending=False)
        ahead, out = FINAL, []
        for costs in f["costs"]:
            out.append(list(ahead))
            ahead = tuple(min(int(costs[4 * r + q]) + ahead[r] for r in range(4)) for q in range(4))
        return f[["conv", "part", "block"]].assign(ahead=out)

    def exits(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [[_walk(c, _vector(n), _vector(a), q, False)[2] for q in range(4)] for c, n, a in zip(f["codes"], f["copies"], f["ahead"], strict=True)]
            yield f[["conv", "part", "block", "ahead"]].assign(exits=found)

    def forth(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["part", "block"])
        state, out = 0, []
        for to in f["exits"]:
            out.append(state)
            state = int(to[state])
        return f[["conv", "part", "block", "ahead"]].assign(state=out, last=[False] * (len(f) - 1) + [True])

    costs = T.StructType([*key, T.StructField("costs", vector)])
    ends = T.StructType([*key, T.StructField("ahead", vector)])
    left = T.StructType([*key, T.StructField("ahead", vector), T.StructField("exits", vector)])
    entered = T.StructType([*key, T.StructField("ahead", vector), T.StructField("state", T.IntegerType()), T.StructField("last", T.BooleanType())])

    def back_to(small: DataFrame) -> DataFrame:
        # a part has its blocks numbered, so these two are the key
        return split.join(small.drop("conv"), ["part", "block"])

    summed = split.select("conv", "part", "block", "codes", "copies").mapInPandas(matrix, costs)
    ahead_of = summed.groupBy("conv").applyInPandas(back, ends)
    left_in = back_to(ahead_of).select("conv", "part", "block", "codes", "copies", "ahead").mapInPandas(exits, left)
    return whole.unionByName(back_to(left_in.groupBy("conv").applyInPandas(forth, entered)))


def edits(turns: DataFrame, longest: int = 16_384) -> DataFrame:
    """conv, turn, role, digest, copies, code, label, tail: the cheapest edits, row by row; copies behind the first are deleted."""
    solved = _solve(materialise(_segments(_facts(turns), longest), "segments"))
    schema = T.StructType([*(f for f in solved.schema if f.name in ("turns", "roles", "digests", "copies")), T.StructField("conv", solved.schema["conv"].dataType), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("tails", T.ArrayType(T.StringType()))])
    names = ["turns", "roles", "digests", "copies", "conv", "codes", "state", "ahead", "last"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            column = dict(zip(names, batch.columns, strict=True))
            codes, labels, tails = [], [], []
            for rows, copies, ahead, state, last in zip(*(column[c].to_pylist() for c in ("codes", "copies", "ahead", "state", "last")), strict=True):
                said, tail, _ = _walk(rows, _vector(copies), _vector(ahead), state, last)
                codes.append(list(rows))
                labels.append(said)
                tails.append([""] * (len(said) - 1) + [tail])
            given = [column[c].cast(arrow.field(c).type) for c in ("turns", "roles", "digests", "copies", "conv")]
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(v, arrow.field(c).type) for c, v in (("codes", codes), ("labels", labels), ("tails", tails)))], schema=arrow)

    zipped = F.explode(F.arrays_zip("turns", "roles", "digests", "copies", "codes", "labels", "tails")).alias("z")
    rows = solved.select(*names).mapInArrow(label, schema).select("conv", zipped)
    return rows.select("conv", *(F.col(f"z.{many}").alias(one) for many, one in (("turns", "turn"), ("roles", "role"), ("digests", "digest"), ("copies", "copies"), ("codes", "code"), ("labels", "label"), ("tails", "tail"))))


class _Conversation:
    """Replays the edits of one conversation, given its rows in order, and counts what was wrong."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.pending, self.tail = conv, 0, None, ""
        self.audit: list[str] = []
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.cost = self.turns = 0
        self.initial = self.first = self.turn = None

    def row(self, turn, role: str, copies: int, code: int, label: str, tail: str) -> Iterator[tuple[str, str, str]]:
        """The inserts before a row, and the row itself where it is deleted; a row that stays waits for its text."""
        fault, initial = FAULTS[code % len(FAULTS)], INITIALS[code // len(FAULTS)]
        self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        legal = self.initial is None or (self.initial, initial) in (("s", "u"), ("u", "a"), ("a", "u"))
        self.illegal += (not legal) + copies - 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        self.audit.append(label + "D" * (copies - 1))
        self.cost += DELETE * (copies - 1)
        self.tail = tail
        yield from self._inserts(label[:-1])
        edit = label[-1]
        _, cost, to, _ = next(a for a in arcs(code, self.state) if a[0] == edit)
        self.pending = None if edit == "D" else (edit, role if edit == "K" else ROLES[NEXT[self.state]])
        self.cost, self.state = self.cost + cost, to

    def _inserts(self, labels: str) -> Iterator[tuple[str, str, str]]:
        for _ in labels:
            yield "I", ROLES[NEXT[self.state]], ""
            self.cost, self.state = self.cost + INSERT, GRAMMAR[self.state][NEXT[self.state]]

    def text(self, text: str) -> Iterator[tuple[str, str, str]]:
        if self.pending:
            yield (*self.pending, text)
            self.pending = None

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.audit.append(self.tail)
        yield from self._inserts(self.tail)

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.turn - self.first + 1 - self.turns


def _read(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))


def _replayed(turns: DataFrame, also: DataFrame | None, longest: int, schema: T.StructType, consume) -> DataFrame:
    """Streams each conversation's edits and texts in order; ``consume(conversation, repaired turns)`` gives rows of ``schema``."""
    rows = turns.select("conv", "turn", "role", _digest().alias("digest"), F.lit(2).alias("kind"), F.col("text"))
    made = edits(turns, longest).withColumn("kind", F.lit(1))
    both = made.unionByName(rows, allowMissingColumns=True)
    if also is not None:
        both = both.unionByName(also.select(F.col(also.columns[0]).alias("conv"), F.lit(0).alias("kind")).distinct(), allowMissingColumns=True)
    columns = ["conv", "kind", "turn", "role", "copies", "code", "label", "tail", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def incoming():
            for batch in batches:
                for part in range(0, batch.num_rows, 1000):
                    yield from zip(*(c.to_pylist() for c in batch.slice(part, 1000).columns), strict=True)

        def conversations():
            current = None
            for conv, kind, turn, role, copies, code_, label, tail, text in incoming():
                if current is None or conv != current.conv:
                    if current is not None:
                        yield from consume(current, current.end())
                        yield from consume(current, None)
                    current = _Conversation(conv)
                if kind == 1:
                    yield from consume(current, current.row(turn, role, copies, code_, label, tail))
                elif kind == 2:
                    yield from consume(current, current.text(text))
            if current is not None:
                yield from consume(current, current.end())
                yield from consume(current, None)

        held, size = [], 0
        for row in conversations():
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(held) >= 2000 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return both.repartition("conv").sortWithinPartitions(*_ordered("kind")).select(*columns).mapInArrow(run, schema)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", longest: int = 16_384) -> DataFrame:
    """The repaired turns: ``conv_col``, place (from 0), edit (K kept, R reroled, I inserted), role, text.

    Rows are taken by turn (nulls first), then role, then the text's SHA-256; repeated rows
    stand side by side. A null role or text is one space; a null id is a conversation. Blank
    and duplicate rows always go; an empty role has no place in the grammar; very long
    conversations and texts are repaired whole. Other columns, whatever their names, are not
    read. A conversation that loses all its turns has no rows; an empty table gives none.
    """
    given = _read(turns, conv_col, turn_col, role_col, text_col)
    schema = T.StructType([T.StructField("conv", given.schema["conv"].dataType), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def consume(conversation: _Conversation, repaired) -> Iterator[tuple]:
        for turn in repaired or ():
            place = getattr(conversation, "place", 0)
            conversation.place = place + 1
            yield (conversation.conv, place, *turn)

    return _replayed(given, None, longest, schema, consume).withColumnRenamed("conv", conv_col)


def repair_report(turns: DataFrame, also: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", longest: int = 16_384) -> DataFrame:
    """A row a conversation: what was wrong with it, what its repair costs, its edits, and the repaired turns' hash.

    ``conv_col``, gaps (turns missing between the first and the last), blank, duplicate,
    truncated, illegal (neighbours whose roles can't follow each other), cost, audit (the
    edits' initials), repaired_sha256 (``role:text`` of the turns that
    :func:`repair_conversations` gives, joined by newlines). ``also``: ids in its first
    column are listed even where they have no turn (zeros, empty audit, hash of nothing).
    Cases are as there.
    """
    given = _read(turns, conv_col, turn_col, role_col, text_col)
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField("conv", given.schema["conv"].dataType), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def consume(conversation: _Conversation, repaired) -> Iterator[tuple]:
        if not hasattr(conversation, "hash"):
            conversation.hash, conversation.mark = hashlib.sha256(), ""
        if repaired is not None:
            for _, role, text in repaired:
                conversation.hash.update(f"{conversation.mark}{role}:{text}".encode())
                conversation.mark = "\n"
            return
        c = conversation
        yield c.conv, c.gaps, c.counts["blank"], c.counts["duplicate"], c.counts["truncated"], c.illegal, c.cost, "".join(c.audit), c.hash.hexdigest()

    return _replayed(given, also, longest, schema, consume).withColumnRenamed("conv", conv_col)


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations damaged by rule, to try a repair on: by crc32(``id:turn``) mod 20, 0 drops a row, 1 empties its
    text, 2 takes its full stops, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col), F.col(turn_col), text(role_col).alias("role"), text(text_col).alias("text"), (F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col))) % 20).alias("h"))
    rows = rows.where("h != 0").select(
        conv_col,
        turn_col,
        F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")
