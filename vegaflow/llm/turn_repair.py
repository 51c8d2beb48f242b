"""Least-cost repair of conversation turns by a rank-compressed dynamic program.

A macro edit is a run of inserts and what happens to the next turn: D, ID, IID,
IIK ... R. The codes are prefix-free and ordered as their letters are, and every
layer (turn) takes exactly one, so of two histories that reach a layer the
lesser is told by the first code in which they differ. Instead of audit strings
a layer keeps, for each of the four states of the grammar ``(s?(ua)+)?``, its
cost, its rank among the states' histories, and the parent with the code; ranks
of the next layer come from (rank of the parent, place of the code). The audit
and the repaired turns are rebuilt from the parents at the end.

The same holds for stretches of turns: a stretch is a matrix from the state
before it to the state behind it with cost and rank, so a conversation of any
length is cut into stretches that many tasks solve; only the matrices of one
conversation meet, and then the stretches are rebuilt, each from its own ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vegaflow.llm.common import Workspace, text_slices

#: Turns and bytes of text of a stretch, and characters by which turns of one place and role are dealt to tasks.
STRETCH, STRETCH_BYTES, PREFIX = 4096, 1 << 23, 1024
SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant turn.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
CODES = sorted("I" * j + op for j in range(3) for op in "DKR")
FINE, TRUNCATED, UNFIT = range(3)
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def moves_of(initial: str, fault: int) -> list[list[tuple[int, int, int]]]:
    """For each state before a turn: (state behind it, cost, code) of the best macro edit to each state."""
    out = []
    for start in range(4):
        best: dict[int, tuple[int, int]] = {}
        for code, letters in enumerate(CODES):
            state, cost = start, 3 * letters.count("I")
            for _ in range(letters.count("I")):
                state = NEXT[state]
            if letters[-1] == "D":
                cost += 4
            else:
                if fault == UNFIT:
                    continue
                cost += 3 * (fault == TRUNCATED)
                if letters[-1] == "R":
                    state, cost = NEXT[state], cost + 3
                elif initial == "s" and state == START:
                    state = SYSTEM
                elif ROLE[NEXT[state]][0] == initial:
                    state = NEXT[state]
                else:
                    continue
            best[state] = min(best.get(state, (cost, code)), (cost, code))
        out.append([(state, *x) for state, x in best.items()])
    return out


MOVES = {(initial, fault): moves_of(initial, fault) for initial in "sua-" for fault in (FINE, TRUNCATED, UNFIT)}
#: Inserts at the end: (state, number) of the cheapest to an accepted end.
ENDS = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Layer = dict[int, tuple[int, int, int, int]]  # state -> (cost, rank, state before, code)


def step(layer: Layer, moves: list[list[tuple[int, int, int]]]) -> Layer:
    best: dict[int, tuple[int, int, int, int]] = {}
    for before, (cost, rank, *_) in layer.items():
        for state, more, code in moves[before]:
            key = (cost + more, rank, code, before)
            if state not in best or key < best[state]:
                best[state] = key
    order = sorted(best, key=lambda s: best[s][1:3])
    return {s: (best[s][0], i, best[s][3], best[s][2]) for i, s in enumerate(order)}


def layers_of(turns: list[tuple[str, int, int]], start: int) -> list[tuple[Layer, int]]:
    """(layer, times) for the turns (initial, fault, copies); a layer that only grows by one delete is kept once with its number."""
    now: Layer = {start: (0, 0, start, -1)}
    out = [(now, 1)]
    for initial, fault, copies in turns:
        now = step(now, MOVES[initial if initial in ("s", "u", "a") else "-", fault])
        out.append((now, 1))
        left = copies - 1
        while left:  # further copies are duplicates (or blank) and must go
            new = step(now, MOVES["-", UNFIT])
            same = {s: (c - 4, *x) for s, (c, *x) in new.items()} == now
            times = left if same else 1
            if times > 1:
                new = {s: (c + 4 * (times - 1), *x) for s, (c, *x) in new.items()}
            out.append((new, times))
            now, left = new, left - times
    return out


def path_of(layers: list[tuple[Layer, int]], end: int) -> list[tuple[int, int, int]]:
    """(state before, code, times) of every layer, first to last; a run of one code in one state is one entry."""
    path, state = [], end
    for layer, times in reversed(layers[1:]):
        while times:
            before, code = layer[state][2:]
            n = times if before == state else 1
            path.append((before, code, n))
            state, times = before, times - n
    return path[::-1]


class Stretch:
    """Turns in order after the damage, some of them with copies: faults, counts and the best repairs from a given state."""

    def __init__(self, rows: list[tuple]):
        """rows: (turn, role, text, copies, whether role and text were seen in an earlier row)."""
        self.rows = [r for r in rows if r[3]]
        self.turns, self.blank, self.duplicate, self.truncated, self.illegal = [], 0, 0, 0, 0
        last = None
        for _, role, text, copies, seen in self.rows:
            bare, initial = text.rstrip(SPACES), role[:1]
            if not bare:
                fault, self.blank = UNFIT, self.blank + copies
            else:
                self.duplicate += copies - (not seen)
                cut = not seen and bare[-1] not in ".!?"
                self.truncated += cut
                fault = UNFIT if seen else TRUNCATED if cut else FINE
            self.illegal += (last is not None and last + initial not in ("su", "ua", "au")) + (copies - 1)
            last = initial
            self.turns.append((initial, fault, copies))
        known = [r[0] for r in self.rows if r[0] is not None]
        self.low, self.high, self.distinct = (known[0], known[-1], len(set(known))) if known else (0, 0, 0)
        self.first, self.last = (self.turns[0][0], self.turns[-1][0]) if self.turns else (None, None)

    def repaired(self, layers: list[tuple[Layer, int]], end: int, tail: int = 0) -> tuple[str, list[str]]:
        """(audit, role:text lines) of the best history that ends in a state, with inserts behind it."""
        audit, lines, at, left = [], [], 0, self.rows[0][3] if self.rows else 0
        for state, code, times in path_of(layers, end):
            letters = CODES[code]
            audit.append(letters * times)
            for _ in range(letters.count("I")):
                state = NEXT[state]
                lines.append(f"{ROLE[state]}:")
            role, text = self.rows[at][1:3]
            if letters[-1] != "D":
                lines.append(f"{role if letters[-1] == 'K' else ROLE[NEXT[state]]}:{text}")
            left -= times
            if not left:
                at += 1
                left = self.rows[at][3] if at < len(self.rows) else 0
        audit.append("I" * tail)
        for _ in range(tail):
            end = NEXT[end]
            lines.append(f"{ROLE[end]}:")
        return "".join(audit), lines


def best_end(layer: Layer) -> int:
    return min(layer, key=lambda s: (layer[s][0] + 3 * ENDS[s], layer[s][1]))


def gap_count(low: int, high: int, distinct: int) -> int:
    return min(high - low + 1 - distinct, 2**63 - 1) if distinct else 0


def solve(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of a whole conversation; rows are (turn, role, text, copies)."""
    seen: set[tuple[str, str]] = set()
    marked = []
    for turn, role, text, copies in rows:
        if copies:
            marked.append((turn, role, text, copies, (role, text) in seen))
            seen.add((role, text))
    s = Stretch(marked)
    layers = layers_of(s.turns, START)
    last = layers[-1][0]
    end = best_end(last)
    audit, lines = s.repaired(layers, end, ENDS[end])
    return gap_count(s.low, s.high, s.distinct), s.blank, s.duplicate, s.truncated, s.illegal, last[end][0] + 3 * ENDS[end], audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped, 2: repeated) by the checksum of the row's place."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv_col), F.lit(":"), plain(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    text = F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"), F.lit(1).cast("long").alias("copies"))


def columns_of(kind: str, turn: str) -> list[tuple[str, str]]:
    return [("conv_id", kind), *((c, "bigint") for c in TOTALS), ("audit", "string"), ("repaired_sha256", "string"), ("turn", turn), ("role", "string"), ("text", "string"), ("copies", "bigint")]


def whole_or_raw(rows: DataFrame) -> DataFrame:
    """Solved conversations, and as they are (copies not null) the turns of those that may go on in another task or are long.

    A task sees rows in order; only its first and last conversation can have rows elsewhere.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = columns_of(kinds["conv_id"], kinds["turn"])
    names = [n for n, _ in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, size, first, raw = [], None, 0, True, False
        types = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        def plain() -> pa.RecordBatch:
            return out([(key, *[None] * 8, *r) for r in held])

        done: list[tuple] = []
        for whole in batches:
            long, text = pa.int64(), pa.string()
            types = [whole.schema.field(0).type, *[long] * 6, text, text, whole.schema.field(1).type, text, text, long]
            for b in text_slices(whole, 3, STRETCH_BYTES):
                for conv, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    if (held or raw) and conv != key:
                        if first or raw:
                            if held:
                                yield plain()
                        else:
                            done.append((key, *solve(held), *[None] * 4))
                        held, size, first, raw = [], 0, False, False
                    key = conv
                    held.append(row)
                    size += len(row[2])
                    if len(held) >= STRETCH or size >= STRETCH_BYTES:
                        yield plain()
                        held, size, raw = [], 0, True
                if done:
                    yield out(done)
                    done = []
        if held:
            yield plain()

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in schema))


def stretches(rows: DataFrame) -> DataFrame:
    """Sorted turns with ``seen`` cut into stretches: part, at, counts, matrix (16 costs, 16 ranks; -1 where there is no way) and the turns."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"conv_id {kinds['conv_id']}, part int, at int, matrix array<bigint>, counts array<bigint>, ends array<string>, turns array<{kinds['turn']}>, roles array<string>, texts array<string>, copies array<bigint>, seen array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held, key, size = TaskContext.get().partitionId(), 0, [], None, 0

        def out(kind: pa.DataType, turn: pa.DataType) -> pa.RecordBatch:
            s = Stretch(held)
            matrix = [-1] * 32
            for state in range(4):
                for end, (cost, rank, *_) in layers_of(s.turns, state)[-1][0].items():
                    matrix[4 * state + end], matrix[16 + 4 * state + end] = cost, rank
            counts = [s.blank, s.duplicate, s.truncated, s.illegal, s.distinct, s.low, s.high]
            cols = list(map(list, zip(*held, strict=True)))
            lists = [pa.array([c], pa.list_(t)) for c, t in zip(cols, (turn, pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)]
            head = [pa.array([key], kind), pa.array([part], pa.int32()), pa.array([at], pa.int32()), pa.array([matrix], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([[s.first, s.last]], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*head, *lists], names=["conv_id", "part", "at", "matrix", "counts", "ends", "turns", "roles", "texts", "copies", "seen"])

        types = None
        for whole in batches:
            types = whole.schema.field(0).type, whole.schema.field(1).type
            for b in text_slices(whole, 3, STRETCH_BYTES):
                for conv, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if held and (conv != key or len(held) >= STRETCH or size >= STRETCH_BYTES):
                        yield out(*types)
                        held, size, at = [], 0, at + 1
                    key = conv
                    held.append(tuple(row))
                    size += len(row[2])
        if held:
            yield out(*types)

    return rows.mapInArrow(run, schema)


def joined(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The best way through the stretches of one conversation: its totals, and per stretch the states at both ends and the inserts behind it."""
    parts = parts.sort_values(["part", "at"])
    now: Layer = {START: (0, 0, START, -1)}
    layers = []
    blank = duplicate = truncated = illegal = distinct = 0
    low = high = last = None
    for m, c, (a, z) in zip(parts["matrix"], parts["counts"], parts["ends"], strict=True):
        new: dict[int, tuple] = {}
        for i, (cost, rank, *_) in now.items():
            for o in range(4):
                if m[4 * i + o] >= 0:
                    k = (cost + int(m[4 * i + o]), rank, int(m[16 + 4 * i + o]), i)
                    if o not in new or k < new[o]:
                        new[o] = k
        order = sorted(new, key=lambda s: new[s][1:3])
        now = {s: (new[s][0], r, new[s][3], -1) for r, s in enumerate(order)}
        layers.append(now)
        c = list(map(int, c))
        blank, duplicate, truncated, illegal = blank + c[0], duplicate + c[1], truncated + c[2], illegal + c[3]
        if a is not None:
            illegal += last is not None and last + a not in ("su", "ua", "au")
            last = z
        if c[4]:
            distinct += c[4] - (high == c[5])
            low, high = c[5] if low is None else low, c[6]
    end = best_end(now)
    cost, tail = now[end][0] + 3 * ENDS[end], ENDS[end]
    ways, state = [], end
    for layer in reversed(layers):
        ways.append((layer[state][2], state))
        state = layer[state][2]
    live, gaps = ways[::-1], gap_count(low, high, distinct)
    out = parts[["part", "at"]].copy()
    out["before"], out["behind"] = [w[0] for w in live], [w[1] for w in live]
    out["tail"] = [0] * (len(live) - 1) + [tail]
    for name, x in zip(TOTALS, (gaps, blank, duplicate, truncated, illegal, cost), strict=True):
        out[name] = x
    return out


def rebuilt(stretch: DataFrame) -> DataFrame:
    """Audit and repaired lines of every stretch, from the states at its ends."""
    kinds = {f.name: f.dataType.simpleString() for f in stretch.schema}
    keep = ["conv_id", "part", "at", *TOTALS]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "audit string", "lines string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                x = b.select(["before", "behind", "tail", "turns", "roles", "texts", "copies", "seen"]).to_pylist()[0]
                s = Stretch(list(zip(x["turns"], x["roles"], x["texts"], x["copies"], x["seen"], strict=True)))
                audit, lines = s.repaired(layers_of(s.turns, x["before"]), x["behind"], x["tail"])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([audit], pa.string()), pa.array(["\n".join(lines) if lines else None], pa.string())], names=[*keep, "audit", "lines"])

    return stretch.mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """Sorted pieces of conversations to one row each; the digest runs over the pieces as they come, none is kept."""
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    names = ["conv_id", *TOTALS, "audit", "repaired_sha256"]
    schema = ", ".join([f"conv_id {kinds['conv_id']}", *(f"{c} bigint" for c in TOTALS), "audit string", "repaired_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit, digest, some = None, [], None, False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*head, pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=names)

        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                if head is None or not head[0].equals(b.column("conv_id")):
                    if head is not None:
                        yield out()
                    head, audit, digest, some = [b.column(c) for c in ("conv_id", *TOTALS)], [], hashlib.sha256(), False
                audit.append(b.column("audit")[0].as_py())
                lines = b.column("lines")[0].as_py()
                if lines is not None:
                    digest.update((("\n" if some else "") + lines).encode())
                    some = True
        if head is not None:
            yield out()

    return pieces.mapInArrow(run, schema)


def long_conversations(work: Workspace, raw: DataFrame, tasks: int) -> DataFrame:
    """Conversations of any length: equal turns aggregated before the shuffle, earlier ones found by a join, stretches dealt by range."""
    rows = raw.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = work.save(rows.withColumn("mark", F.unhex(F.sha2("text", 256))), "rows")
    firsts = rows.where("copies > 0").groupBy("conv_id", "role", "mark").agg(F.min(F.struct("turn")).alias("least"), F.count("*").alias("n")).where("n > 1")
    firsts = work.save(firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "least"), "firsts")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    seen = F.coalesce(F.struct("turn") > F.col("least"), F.lit(False))
    marked = rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"))
    dealt = marked.repartitionByRange(tasks, "conv_id", "turn", "role", F.substring("text", 1, PREFIX)).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = work.save(stretches(dealt), "stretches")
    schema = ", ".join(["part int, at int, before int, behind int, tail int", *(f"{c} bigint" for c in TOTALS)])
    ways = work.save(cut.select("conv_id", "part", "at", "matrix", "counts", "ends").groupBy("conv_id").applyInPandas(joined, schema), "ways")
    pieces = rebuilt(cut.drop("matrix", "counts", "ends").join(ways, ["part", "at"]))
    return digests(pieces.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", "at"))


def repair(spark: SparkSession, conversations: DataFrame, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text is one space. Turns go by number, nulls first; rows of one
    turn by role, then text. A null id is a conversation of its own. A role is
    kept by its first letter, s, u or a; any other role, the empty one too, is
    rewritten or deleted. A conversation of which nothing is left has zeros, an
    empty audit and the digest of the empty string; an empty table gives no rows.
    Other columns are not read. With ``damage``, rows are damaged first, by the
    checksum of their place.
    """
    work = Workspace(spark, "repair")
    rows = (damaged if damage else undamaged)(conversations, conv_col, turn_col, role_col, text_col)
    # the place of a row deals a long conversation, or many equal rows, to several tasks
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("conv_id", "place").drop("place").sortWithinPartitions("conv_id", "turn", "role", "text")
    first = work.save(whole_or_raw(dealt), "first")
    result = ["conv_id", *TOTALS, "audit", "repaired_sha256"]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = long_conversations(work, first.where("copies is not null").select("conv_id", "turn", "role", "text", "copies"), tasks)
    return first.where("copies is null").select(*result).unionByName(work.save(rest, "rest").select(*result))
