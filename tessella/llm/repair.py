"""Conversation structure repair by depth-first branch-and-bound.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Each message
is kept (K), given another role (R) or deleted (D), and empty messages may be
inserted (I) anywhere. Of all edits that lead there the cheapest are wanted, of
those the ones whose initials are least in ASCII.

The search keeps an explicit stack. A node is a number of messages done and the
last role put out; a prefix of edits goes on only if it beats the node's entry
in the dominance table and its cost and a lower bound of the rest stay within
the incumbent. What is left when the stack is empty is optimal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from tessella.llm.common import WORD

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Last role put out: none, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that an inserted or rerolled message gets after each of them.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Role that a kept message may have after each of them, by code.
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
#: Alternating sound messages on either side that settle the one between them (see ``settled_edits``).
SETTLED = 4
#: Messages after which waiting nodes are taken up together.
WINDOW = 24
BATCH_ROWS = 2048
TEXT_BYTES = 1 << 20


class Prefix:
    """Edits so far, as a chain: the last one, what precedes it, how many, their cost."""

    __slots__ = ("before", "edit", "length", "cost")

    def __init__(self, before, edit, cost):
        self.before, self.edit, self.cost = before, edit, cost
        self.length = before.length + 1 if before else 0

    def tail(self, ancestor) -> str:
        found, at = [], self
        while at is not ancestor:
            found.append(at.edit)
            at = at.before
        return "".join(reversed(found))


def beats(a: Prefix, b: Prefix) -> bool:
    """Whether ``a`` is cheaper than ``b`` or as cheap and less in ASCII.

    Prefixes of one node and one cost are never one the start of the other,
    since the edits tell the cost, so what differs first decides, whatever follows.
    """
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y = a, b
    while x is not y:
        if x.length > y.length:
            x = x.before
        elif y.length > x.length:
            y = y.before
        else:
            x, y = x.before, y.before
    return a.tail(x) < b.tail(x)


def bounds(codes: str, goal: int | None) -> list[tuple[int, ...]]:
    """Lower bound of the cost of the messages from each place on, by last role put out.

    The relaxed problem forgets the role that an edited message gets: it suits
    any neighbours. What is left is a choice of messages that stay, each pair of
    neighbours that may not meet paying an insertion, and of edits at their price.
    The start and the end are neighbours too.
    """
    ends = (0, 0, 0, 0) if goal is not None else (0, 2 * INSERT, INSERT, 0)
    # By the role before (zero to three), then after an edited message.
    rest, out = (*ends, 0), [ends]
    for code in reversed(codes):
        cut = TRUNCATED if code.isupper() else 0
        edit = DELETE if code == "x" else min(REROLE + cut, DELETE)
        role = AFTER.get(code.lower())
        edited = edit + rest[4]
        if role is None:
            stays = (edited,) * 5
        else:
            keep = cut + rest[role]
            stays = (*(min(edited, keep + (0 if kept(q, code) else INSERT)) if role != SYSTEM or q == START else edited for q in range(4)), min(edited, keep))
        # A deleted message leaves the role before it as it is.
        rest = stays if code != "x" else tuple(DELETE + b for b in rest)
        out.append(rest[:4])
    return out[::-1]


def kept(last: int, code: str) -> int:
    """Role put out after ``last`` by keeping a message of this code; zero if it may not be kept."""
    role = AFTER.get(code.lower(), 0)
    return role if role == NEXT[last] or (role == SYSTEM and last == START) else 0


def moves(codes: str, i: int, last: int, goal: int | None) -> Iterator[tuple[str, int, int, int]]:
    """Edits that may follow after ``i`` messages: edit, messages done then, role then, cost."""
    n = len(codes)
    if goal is None or i < n:
        yield "I", i, NEXT[last], INSERT
    if i == n:
        return
    code, ends = codes[i], goal is not None and i == n - 1
    cut = TRUNCATED if code.isupper() else 0
    if kept(last, code):
        yield "K", i + 1, kept(last, code), cut
    if not ends:
        yield "D", i + 1, last, DELETE
        if code != "x":
            yield "R", i + 1, NEXT[last], REROLE + cut


@lru_cache(maxsize=1 << 16)
def cheapest_edits(codes: str, last: int = START, goal: int | None = None) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of messages given by codes, least in ASCII.

    A code is the role's initial (o: any other), in capitals if the message is
    truncated, or x if it must go. With ``goal`` the last message is kept and
    must leave that role; else the whole must be complete.

    The first dive takes the most promising edit at each node and gives the
    first incumbent. The stack then empties window by window: nodes at a
    window's end wait there, so that a better prefix found late is not followed
    to the end of a long conversation anew each time.
    """
    n, bound = len(codes), bounds(codes, goal)

    def accepted(i, q):
        return i == n and (q == goal if goal is not None else q in (START, ASSISTANT))

    def promising(i, q, cost):
        return sorted((cost + c + bound[j][r], e, j, r, cost + c) for e, j, r, c in moves(codes, i, q, goal))

    i, q, most, inserted = 0, last, 0, 0
    while not accepted(i, q):
        # Two insertions lead from any role to any; more would go round in circles.
        _, edit, i, q, most = next(m for m in promising(i, q, most) if m[1] != "I" or inserted < 2)
        inserted = inserted + 1 if edit == "I" else 0
    best: Prefix | None = None
    waiting = {last: Prefix(None, "", 0)}
    for end in [*range(WINDOW, n, WINDOW), n]:
        begin = max(0, end - WINDOW) if end < n else (n - 1) // WINDOW * WINDOW if n else 0
        table = {(begin, q): prefix for q, prefix in waiting.items()}
        stack = [(begin, q, prefix) for q, prefix in waiting.items()]
        while stack:
            i, q, prefix = stack.pop()
            if table[i, q] is not prefix or (i == end < n):
                continue
            if accepted(i, q):
                if best is None or beats(prefix, best):
                    best, most = prefix, prefix.cost
                continue
            # The most promising comes on top: the least bound, then the least initial.
            for value, edit, j, r, cost in reversed(promising(i, q, prefix.cost)):
                if value <= most:
                    one = Prefix(prefix, edit, cost)
                    if (j, r) not in table or beats(one, table[j, r]):
                        table[j, r] = one
                        stack.append((j, r, one))
        waiting = {q: table[end, q] for q in range(4) if (end, q) in table}
    return best.cost, best.tail(None)


def settled_edits(codes: Iterable[str]) -> Iterator[str]:
    """Initials of the cheapest edits of a conversation, stretch by stretch.

    A conversation is cut where every cheapest solution passes. Of ``SETTLED``
    sound alternating messages one is kept: to edit all costs 12 at least, while
    to keep all costs 10 at most (an insertion on either side and a system
    message behind them that would have to go). Between two kept ones of such a
    run all are kept, so the middle of a run of 2 * SETTLED + 1 is. Memory thus
    follows the longest stretch without such a run, not the conversation.
    """
    held, run, last = [], 0, START
    for code in codes:
        run = run + 1 if run and held[-1] + code in ("ua", "au") else int(code in "ua")
        held.append(code)
        if run > 2 * SETTLED:
            cut = len(held) - SETTLED
            goal = AFTER[held[cut - 1]]
            yield cheapest_edits("".join(held[:cut]), last, goal)[1]
            held, last = held[cut:], goal
    yield cheapest_edits("".join(held), last)[1]


def damage(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) after a reproducible damage; nulls of role and text become one space.

    By crc32 of ``conv_id:turn`` modulo 20: dropped (0), emptied (1), without
    its full stops (2), repeated (3), said by the user (4). Repeated rows are
    damaged alike; other columns are left out.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    own = messages.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def fault_of(role: Column, text: Column) -> Column:
    """First fault of a message in a window of its conversation: blank, duplicate, truncated or none."""
    own = W.partitionBy("conv_id").orderBy("role", "text", F.col("turn").asc_nulls_first())
    again = F.lag(role).over(own).eqNullSafe(role) & F.lag(text).over(own).eqNullSafe(text)
    ends = F.rlike(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    return F.when(~F.rlike(text, F.lit(WORD)), "blank").when(again, "duplicate").when(~ends, "truncated").otherwise("")


def repair_conversations(messages: DataFrame) -> DataFrame:
    """Edits of each conversation of ``messages`` (conv_id, turn, role, text) in their order.

    Returns conv_id, step, edit (K, R, D, I), turn, old_role, fault, role and
    text; an inserted message has no turn, old_role and fault, a deleted one no
    role and text. Messages follow by turn, nulls first, then role and text, so
    ties and repeated rows have one order. A null conv_id is a conversation, a
    null role or text counts as empty; blank and repeated messages must go, a
    truncated one costs 3 where it stays. An empty table gives none; other
    columns are left out.

    Every message passes twice: without its text, for the search, then with it,
    in the same sorted partition. So a task holds the roles of a conversation,
    a byte each, and no texts.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = messages.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    told = own.withColumn("fault", fault_of(F.col("role"), F.col("text"))).withColumn("_place", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    narrow = F.struct(F.lit(0).alias("pass"), code.alias("code"), F.lit(None).cast("string").alias("said"))
    wide = F.struct(F.lit(1).alias("pass"), code.alias("code"), F.col("text").alias("said"))
    twice = told.select("conv_id", "_place", "turn", "role", "fault", F.explode(F.array(narrow, wide)).alias("_p")).select("conv_id", "_p.pass", "_p.code", "turn", "role", "fault", "_p.said", "_place")
    ordered = twice.sortWithinPartitions("conv_id", "pass", "_place")
    schema = StructType.fromDDL(f"conv_id {kind}, step long, edit string, turn {messages.schema['turn'].dataType.simpleString()}, old_role string, fault string, role string, text string")
    arrow = to_arrow_schema(schema)

    def edited(conv, rows):
        parts = groupby(rows, lambda row: row[1])
        edits = "".join(settled_edits(row[2] for row in next(parts)[1]))
        step, last = 0, START
        for _, _, code, turn, name, fault, said in chain(next(parts)[1], [(None,) * 7]):
            while step < len(edits) and edits[step] == "I":
                last = NEXT[last]
                yield conv, step, "I", None, None, None, NAMES[last], ""
                step += 1
            if step == len(edits):
                return
            edit = edits[step]
            if edit == "D":
                yield conv, step, "D", turn, name, fault, None, None
            else:
                last = NEXT[last] if edit == "R" else kept(last, code)
                yield conv, step, edit, turn, name, fault, NAMES[last] if edit == "R" else name, said
            step += 1

    def run(batches):
        flat = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(7)]))
        made = (out for conv, rows in groupby(flat, lambda row: row[0]) for out in edited(conv, rows))
        yield from in_batches(made, arrow)

    return ordered.drop("_place").mapInArrow(run, schema)


def in_batches(rows: Iterator[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded rows and text (the last column)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "") if isinstance(row[-1], str) else 0
        if len(held) == BATCH_ROWS or size > TEXT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


def digest_repairs(edits: DataFrame) -> DataFrame:
    """One row per conversation of :func:`repair_conversations`, whose order it expects (no shuffle between).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    arrow = to_arrow_schema(schema)

    def digest(conv, rows):
        low = high = before = None
        distinct = illegal = cost = 0
        faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        audit, repaired, joint = [], hashlib.sha256(), b""
        for _, edit, turn, old, fault, role, text in rows:
            audit.append(edit)
            cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "D":
                repaired.update(joint + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                joint = b"\n"
            if edit == "I":
                continue
            if fault:
                faults[fault] += 1
            if before is not None:
                illegal += before + old[:1] not in LEGAL
            before = old[:1]
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
        gaps = high - low + 1 - distinct if distinct else 0
        return conv, gaps, *faults.values(), illegal, cost, "".join(audit), repaired.hexdigest()

    def run(batches):
        flat = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(8)]))
        yield from in_batches((digest(conv, (row[1:] for row in rows)) for conv, rows in groupby(flat, lambda row: row[0])), arrow)

    return edits.select("conv_id", "step", "edit", "turn", "old_role", "fault", "role", "text").mapInArrow(run, schema)
