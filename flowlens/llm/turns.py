"""Conversation structure repair: turns are aligned to the grammar ``(s?(ua)+)?`` of role initials at the least cost of edits.

Edits, by initial: Keep a turn (0), give it the Role that is due (3), Delete it (4), Insert an empty turn of user or assistant (3). Blank
and duplicate turns have to be deleted; a truncated turn that stays adds 3. Of the cheapest audits (initials of the edits in order) the one least in ASCII wins.

A conversation is cut into pieces of at most ``PIECE`` turns in order, wherever they lie in a range partitioning, so that no conversation
is one task's alignment. A piece is aligned by Wagner-Fischer tables to each feasible length of the grammar string, from each role that
may have come before; tables have Ukkonen bands from the least cost known so far, and the backtraced audits are compared. Inserts
belong to the piece of the turn after them, so that of two audits of a piece neither is the start of the other, and the least
audits of the pieces make up the least audit of the whole. Pieces are then joined role by role.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import dropped, written

PIECE = 32
BLANKS = " \t\n\v\f\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: what has come before a turn: nothing, a system turn, a user turn, an assistant's turn
BEFORE = "nsua"
INFINITE = 1 << 60
OPTIONS = "array<struct<start:string,end:string,cost:long,audit:string>>"
#: output rows of a batch
ROWS = 2000


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32(conv_id:turn) % 20: dropped, emptied, without ends, repeated, given to the user.

    Null roles and texts, and nulls in the digested string, are one space; a null turn stays null in the order.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), act.alias("act")).where("act <> 0")
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("act") == 3, 2).otherwise(1).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): equal rows once with their number, and the first fault of the first of them.

    A later one of equal rows is blank or a duplicate. The first turn of a role and text comes from partial sums by their digest.
    """
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies")).withColumn("digest", F.sha2("text", 256))
    first = once.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"))
    both = once.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return both.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def aligned(codes: str, target: str, limit: int, last: bool) -> tuple[int, str] | None:
    """The least cost of turning the coded turns into target, and its least audit; None where that is over limit.

    A code is the role's initial (o: another), in upper case if truncated, or x if the turn has to go. Only in the last
    piece may inserts follow the last turn.
    """
    n, m = len(codes), len(target)
    apart = m - n
    least = INSERT * apart if apart > 0 else -DELETE * apart
    if least > limit:
        return None
    # each diagonal further out costs an insert and a deletion more
    slack = (limit - least) // (INSERT + DELETE)
    low, high = min(0, apart) - slack, max(0, apart) + slack
    table = [[INFINITE] * (m + 2) for _ in range(n + 1)]
    end = table[n]
    end[m] = 0
    if last:
        for j in range(m - 1, max(0, n + low) - 1, -1):
            end[j] = end[j + 1] + INSERT if target[j] != "s" else INFINITE
    for i in range(n - 1, -1, -1):
        row, below, code = table[i], table[i + 1], codes[i]
        role, extra = code.lower(), TRUNCATED if code.isupper() else 0
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = below[j] + DELETE
            if j < m:
                due = target[j]
                if due != "s":
                    best = min(best, row[j + 1] + INSERT)
                if role == due or due != "s" and role != "x":
                    best = min(best, below[j + 1] + extra + (0 if role == due else REROLE))
            row[j] = best
    if table[0][0] > limit:
        return None
    i = j = 0
    audit = []
    while i < n or j < m:
        cost = table[i][j]
        if i < n and table[i + 1][j] + DELETE == cost:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and table[i][j + 1] + INSERT == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if codes[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


@lru_cache(1 << 16)
def options(codes: str, start: str, last: bool) -> tuple[tuple[str, int, str], ...]:
    """(end, cost, audit) of a piece for each end that it can come to; a last piece ends where the grammar may, as '.'."""
    going = [c for c in codes if c == "x"]
    stay = len(codes) - len(going)
    best: dict[str, tuple[int, str]] = {}
    bound = lambda m: DELETE * len(going) + (INSERT * (m - stay) if m > stay else DELETE * (stay - m))
    for m in sorted(range(2 * len(codes) + 4), key=bound):
        forms = ["au" * m if start == "u" else "ua" * m]
        if start == "n" and m and any(c in "sS" for c in codes):
            forms.append("s" + "ua" * m)
        for form in forms:
            target = form[:m]
            end = target[-1:] or start
            if last:
                if end in "su":
                    continue
                end = "."
            known = best.get(end, (DELETE * len(codes) + INSERT * m, ""))
            if bound(m) <= known[0] and (found := aligned(codes, target, known[0], last)) and (end not in best or found < known):
                best[end] = found
    return tuple((end, *found) for end, found in sorted(best.items()))


def code_of() -> F.Column:
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)


def piece_rows(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, part, chunk, inner, closing): the options of each piece where another follows, and where none does."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, out = TaskContext.get().partitionId(), 0, []
        conv, held, first, fresh = None, "", True, True

        def closed(codes: str, follows: bool | None) -> None:
            nonlocal chunk, fresh
            # where the conversation begins isn't known of the partition's first, nor where it ends of its last
            starts = "n" if fresh and not first else BEFORE
            made = [[{"start": s, "end": e, "cost": c, "audit": a} for s in starts for e, c, a in options(codes, s, last)] if follows is not last else [] for last in (False, True)]
            out.append((conv, part, chunk, *made))
            chunk, fresh = chunk + 1, False

        def batch() -> pa.RecordBatch:
            table = spark_batch(out, schema)
            out.clear()
            return table

        schema = None
        for incoming in batches:
            schema = schema or pa.schema([("conv_id", incoming.schema.field("conv_id").type), ("part", pa.int32()), ("chunk", pa.int64()), ("inner", LISTED), ("closing", LISTED)])
            for c, code, copies in zip(*(incoming.column(x).to_pylist() for x in ("conv_id", "code", "copies")), strict=True):
                if c != conv or not held:
                    if held:
                        closed(held, False)
                        first, fresh = False, True
                    conv, held = c, ""
                held += code
                copies -= 1
                while len(held) + copies > piece:
                    fill = min(copies, max(0, piece - len(held)))
                    held, copies = held + "x" * fill, copies - fill
                    closed(held[:piece], True)
                    held = held[piece:]
                    if len(out) >= ROWS:
                        yield batch()
                held += "x" * copies
            if len(out) >= ROWS:
                yield batch()
        if held:
            closed(held, None)
        if out:
            yield batch()

    # the range needs no texts, which the driver would get samples of; within a turn rows are in one partition and its order
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", code_of().alias("code"), "copies").mapInArrow(cut, f"conv_id {kind}, part int, chunk long, inner {OPTIONS}, closing {OPTIONS}")


LISTED = pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def spark_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Joined:
    """The cheapest edits of a conversation from its pieces in order: a cost and a rank of audits for each role that may come last."""

    def __init__(self) -> None:
        self.now: dict[str, tuple[int, int]] = {"n": (0, 0)}
        self.trail: list[dict[str, tuple[str, str]]] = []
        self.held: tuple[list[dict], list[dict]] | None = None

    def step(self, choices: list[dict]) -> None:
        best: dict[str, tuple[int, int, str, str]] = {}
        for o in choices:
            if o["start"] in self.now:
                cost, rank = self.now[o["start"]]
                found = (cost + o["cost"], rank, o["audit"], o["start"])
                if o["end"] not in best or found < best[o["end"]]:
                    best[o["end"]] = found
        # audits of equally many turns differ before either ends, so that ranks order them
        places = {end: i for i, end in enumerate(sorted(best, key=lambda e: best[e][1:]))}
        self.now = {end: (f[0], places[end]) for end, f in best.items()}
        self.trail.append({end: (f[3], f[2]) for end, f in best.items()})

    def add(self, inner: list[dict], closing: list[dict]) -> None:
        if self.held:
            self.step(self.held[0])
        self.held = inner, closing

    def edits(self) -> tuple[int, str]:
        if not self.held:
            return 0, ""
        self.step(self.held[1])
        self.held = None
        audits, at = [], "."
        for states in reversed(self.trail):
            at, audit = states[at]
            audits.append(audit)
        return self.now["."][0], "".join(reversed(audits))


class Repair:
    """Follows a conversation's rows in order beside its audit: counts faults and gives the repaired turns."""

    def __init__(self) -> None:
        self.joined, self.audit, self.cost, self.at = Joined(), None, 0, 0
        self.due, self.before = "user", None
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def said(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        if role[:1] in ("u", "a"):
            self.due = "assistant" if role[:1] == "u" else "user"
        return role, text, edit

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.said(self.due, "", "I")

    def row(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> Iterator[tuple[str, str, str]]:
        if self.audit is None:
            self.cost, self.audit = self.joined.edits()
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        self.illegal += copies - 1 + (self.before is not None and self.before + role[:1] not in ("su", "ua", "au"))
        self.before = role[:1]
        if fault:
            self.faults[fault] += 1
        self.faults["blank" if fault == "blank" else "duplicate"] += copies - 1
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self.said(role if edit == "K" else self.due, text, edit)

    def rest(self) -> Iterator[tuple[str, str, str]]:
        if self.audit is None:
            self.cost, self.audit = self.joined.edits()
        yield from self.inserted()

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)


def followed(turns: DataFrame, rows: DataFrame, piece: int, fields: str, made: Callable[[], Callable]) -> DataFrame:
    """A streamed pass over conversations: each one's mark, its pieces, then its rows in order. made gives a function (conv_id, repair, turn or None at the end) -> rows."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    marks = turns.select("conv_id").distinct().withColumn("kind", F.lit(0))
    stream = marks.unionByName(piece_rows(rows, piece).withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(rows.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "chunk", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, out, take, schema = None, None, [], made(), None

        def batch() -> pa.RecordBatch:
            table = spark_batch(out, schema)
            out.clear()
            return table

        def ended() -> None:
            for said in repair.rest():
                out.extend(take(conv, repair, said))
            out.extend(take(conv, repair, None))

        for incoming in batches:
            schema = schema or pa.schema([("conv_id", incoming.schema.field("conv_id").type), *TYPES[fields]])
            for r in incoming.to_pylist():
                if r["kind"] == 0:
                    if repair:
                        ended()
                    conv, repair = r["conv_id"], Repair()
                elif r["kind"] == 1:
                    repair.joined.add(r["inner"], r["closing"])
                else:
                    for said in repair.row(r["turn"], r["role"], r["text"], r["copies"], r["fault"]):
                        out.extend(take(conv, repair, said))
                if len(out) >= ROWS:
                    yield batch()
        if repair:
            ended()
        if out:
            yield batch()

    return stream.mapInArrow(run, f"conv_id {kind}, {fields}")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string, edit string"
_ARROW = {"long": pa.int64(), "string": pa.string()}
TYPES = {f: [(x.split()[0], _ARROW[x.split()[1]]) for x in f.split(", ")] for f in (REPORT, TURNS)}


def reports() -> Callable:
    """A row for each conversation, with a running digest of its repaired turns."""
    digest, some = hashlib.sha256(), False

    def take(conv: object, repair: Repair, said: tuple[str, str, str] | None) -> list[tuple]:
        nonlocal digest, some
        if said:
            digest.update(("\n" * some + said[0] + ":" + said[1]).encode())
            some = True
            return []
        row = (conv, repair.gaps(), *repair.faults.values(), repair.illegal, repair.cost, repair.audit, digest.hexdigest())
        digest, some = hashlib.sha256(), False
        return [row]

    return take


def repaired_turns() -> Callable:
    """A row for each turn of the repaired conversations."""
    place = 0

    def take(conv: object, repair: Repair, said: tuple[str, str, str] | None) -> list[tuple]:
        nonlocal place
        place = place + 1 if said else 0
        return [(conv, place, *said)] if said else []

    return take


def repair_report(turns: DataFrame, rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of turns.

    rows are its turns as they came: (conv_id, turn, role, text, copies). They are taken by turn, nulls first, then by role and
    text, so that rows that tie are alike however they are stored. Each row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated (does not end in ``.!?``). A null conv_id is a conversation. One without rows has zeros, an empty audit
    and the digest of nothing; an empty table gives no rows. Other columns are ignored.

    Alignment is done piece by piece wherever the pieces lie; the digest of a conversation is a single chain over its
    texts, so a task passes over them in order, a row at a time, and holds no more than the audit.
    """
    return passed(turns, rows, piece, REPORT, reports)


def repaired(turns: DataFrame, rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired turns (edit K, R or I), under the same rules."""
    return passed(turns, rows, piece, TURNS, repaired_turns)


def passed(turns: DataFrame, rows: DataFrame, piece: int, fields: str, made: Callable[[], Callable]) -> DataFrame:
    faulty = written(with_faults(rows), "turns")
    out = written(followed(turns, faulty, piece, fields, made), "repaired")
    dropped(faulty)
    return out


def damaged_and_repaired(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    return repair_report(turns, damaged(turns), piece)
