"""Conversation repair: the cheapest edits that make a conversation's roles alternate.

Edits form a lattice of (rows read, state of the role pattern). Two Dijkstra searches, one from
each end, settle whole cost levels until no cheaper or equal crossing is left; the least audit
over all cheapest paths is then read off. The library has no dialogue records, so the operator is
general: conversation rows conv_id, turn, role, text.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import turn_order

# Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States of the role pattern (s?(ua)+)?: 0 nothing yet, 1 system, 2 user, 3 assistant. WANTED is
# the role that leads on from a state, AFTER the state it leads to, BEFORE the reverse.
WANTED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
BEFORE = ((), (), (0, 1, 3), (2,))
ENDS = (0, 3)
BLANKS = " \t\n\x0b\x0c\r"
AUDIT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
         "cost long, audit string")
Node = tuple[int, int]


def _edits(code: str, i: int, state: int) -> Iterator[tuple[str, Node, int]]:
    """Edits at a node with the node they lead to and their cost, letters ascending."""
    row = code[i] if i < len(code) else ""
    if row:
        yield "D", (i + 1, state), DELETE
    yield "I", (i, AFTER[state]), INSERT
    if row and row != "d":
        more = TRUNCATED if row.isupper() else 0
        role = row.lower()
        if role == WANTED[state][0]:
            yield "K", (i + 1, AFTER[state]), more
        elif role == "s" and state == 0:
            yield "K", (i + 1, 1), more
        yield "R", (i + 1, AFTER[state]), REROLE + more


def _edits_into(code: str, i: int, state: int) -> Iterator[tuple[Node, int]]:
    """Nodes whose edits lead to a node, with the cost."""
    for earlier in BEFORE[state]:
        yield (i, earlier), INSERT
    if i == 0:
        return
    row = code[i - 1]
    yield (i - 1, state), DELETE
    if row == "d":
        return
    more = TRUNCATED if row.isupper() else 0
    role = row.lower()
    if role == "s" and state == 1:
        yield (i - 1, 0), more
    for earlier in BEFORE[state]:
        yield (i - 1, earlier), more if role == WANTED[earlier][0] else REROLE + more


def _level(heap: list, known: dict, done: dict, other: dict, steps) -> int | None:
    """Settle all nodes of the least open cost; returns the best crossing seen."""
    cost, best = heap[0][0], None
    while heap and heap[0][0] == cost:
        node = heapq.heappop(heap)[1]
        if node in done:
            continue
        done[node] = cost
        if node in other and (best is None or cost + other[node] < best):
            best = cost + other[node]
        for there, price in steps(node):
            if cost + price < known.get(there, cost + price + 1):
                known[there] = cost + price
                heapq.heappush(heap, (cost + price, there))
    return best


def least_edits(code: str) -> tuple[int, str]:
    """Least cost and, among the cheapest edit scripts, the audit that is least in ASCII order.

    code holds one letter a row: s, u, a for the role's initial, x for another one, upper case
    where the row is truncated, d where it must be deleted. An audit fixes the path it takes, as
    inserted and changed roles are those the pattern wants.
    """
    n, best = len(code), None
    known, back = {(0, 0): 0}, {(n, state): 0 for state in ENDS}
    heap, rear = [(0, (0, 0))], [(0, node) for node in back]
    done: dict[Node, int] = {}
    met: dict[Node, int] = {}
    heapq.heapify(rear)
    while heap and rear and (not done or not met or best is None
                             or heap[0][0] + rear[0][0] <= best):
        if not done or met and heap[0][0] <= rear[0][0]:
            seen = _level(heap, known, done, back,
                          lambda at: ((v, w) for _, v, w in _edits(code, *at)))
        else:
            seen = _level(rear, back, met, known, lambda at: _edits_into(code, *at))
        if seen is not None and (best is None or seen < best):
            best = seen
    # Nodes of the forward side that lie on a cheapest path, from the crossings backwards.
    good: set[Node] = set()
    for node, cost in done.items():
        if cost + met.get(node, best + 1) == best or any(
                cost + w + met.get(v, best + 1) == best for _, v, w in _edits(code, *node)):
            good.add(node)
    open_nodes = list(good)
    while open_nodes:
        node = open_nodes.pop()
        for there, price in _edits_into(code, *node):
            if there not in good and done.get(there, best + 1) + price == done[node]:
                good.add(there)
                open_nodes.append(there)
    audit, node, spent = [], (0, 0), 0
    while spent < best or node[0] < n or node[1] not in ENDS:
        for letter, there, price in _edits(code, *node):
            if (there in good and done[there] == spent + price
                    or spent + price + met.get(there, best + 1) == best):
                audit.append(letter)
                node, spent = there, spent + price
                break
    return best, "".join(audit)


@lru_cache(maxsize=1 << 14)
def _short_edits(code: str) -> tuple[int, str]:
    return least_edits(code)


class _Conversation:
    """Counts and codes of the rows of one conversation, as they come in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.seen = conv_id, [], set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.before = None
        self.turns = 0

    def add(self, dated: bool, turn: int, digest: str, initial: str, last: str) -> None:
        if dated and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        code = initial if initial in ("s", "u", "a") else "x"
        if not last:
            self.blank += 1
            code = "d"
        elif digest in self.seen:
            self.duplicate += 1
            code = "d"
        elif last not in ".!?":
            self.truncated += 1
            code = code.upper()
        self.seen.add(digest)
        self.codes.append(code)

    def row(self) -> tuple:
        code = "".join(self.codes)
        cost, audit = _short_edits(code) if len(code) <= 64 else least_edits(code)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                audit)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)],
        names=[name for name, _ in fields])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: _Conversation | None = None
    for batch in batches:
        rows = []
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or conv_id != held.conv_id:
                if held is not None:
                    rows.append(held.row())
                held = _Conversation(conv_id)
            held.add(*row)
        yield _table(rows, AUDIT)
    if held is not None:
        yield _table([held.row()], AUDIT)


def _ordered(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", *turn_order(F.col("turn").cast("long"), role, text),
                        role.alias("role"), text.alias("text"))


ORDER = ["dated", "turn", "role_head", "text_head", "digest"]


def conversation_audits(turns: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first, ties by role and text; a null role or text counts as one
    space, rows without conv_id are a conversation of their own, other columns are left out. A
    row's first fault counts: blank (only ASCII white space), duplicate (role and text seen
    earlier) or truncated (its last other character none of . ! ?). illegal counts neighbours whose
    role initials are not su, ua or au; gaps the turn numbers missing between the least and the
    greatest. Edits are Keep, Rerole to user or assistant, Delete (required for blank and duplicate
    rows) and Insert of an empty user or assistant turn; audit is their initials, after which role
    initials read (s?(ua)+)?. No rows give no result.

    A task reads a conversation row by row and keeps a letter and a digest of each; texts stay
    where they are.
    """
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = _ordered(turns).select("conv_id", *ORDER, F.left("role", F.lit(1)).alias("initial"),
                                    last.alias("last"))
    return (narrow.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
            .select("conv_id", "dated", "turn", "digest", "initial", "last")
            .mapInArrow(_audited, AUDIT))


REPAIRED = "conv_id long, place long, role string, text string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow each conversation's audit, which comes before its rows."""
    conv_id, audit, at, place, state = None, "", 0, 0, 0

    def inserts() -> Iterator[tuple]:
        nonlocal at, place, state
        while audit[at:at + 1] == "I":
            yield conv_id, place, WANTED[state], ""
            at, place, state = at + 1, place + 1, AFTER[state]

    for batch in batches:
        rows: list[tuple] = []
        for key, script, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if script is not None:
                rows += inserts()
                conv_id, audit, at, place, state = key, script, 0, 0, 0
                continue
            rows += inserts()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            kept = role if edit == "K" else WANTED[state]
            rows.append((conv_id, place, kept, text))
            place, state = place + 1, 1 if kept[0] == "s" else AFTER[state]
        yield _table(rows, REPAIRED)
    yield _table(list(inserts()), REPAIRED)


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Turns after the edits of conversation_audits: conv_id, place (from 0), role, text.

    A conversation lies in one partition in the order of its places, each text passing through
    once; nothing of a conversation is held but its audit.
    """
    scripts = audits.select("conv_id", "audit")
    rows = _ordered(turns).withColumn("audit", F.lit(None).cast("string"))
    return (scripts.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER)
            .select("conv_id", "audit", "role", "text").mapInArrow(_applied, REPAIRED))


DIGEST = "conv_id long, repaired_sha256 string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, digest = None, None
    for batch in batches:
        rows = []
        for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                if digest is not None:
                    rows.append((held, digest.hexdigest()))
                held, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield _table(rows, DIGEST)
    if digest is not None:
        yield _table([(held, digest.hexdigest())], DIGEST)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the role:text lines of each conversation of repaired_turns, taken as they lie.

    Conversations without turns have no row.
    """
    return repaired.mapInArrow(_hashed, DIGEST)
