"""Repair of conversations: the cheapest edits that make the roles alternate.

Per row a conversation keeps one best way for each of four states: nothing kept yet, after a
system, a user or an assistant row. A way is a node of a tree that all ways share: each node
adds one edit to its parent's, and carries its length, a rolling hash of all its edits and
its ancestors at distances 1, 2, 4, ... Ways of equal cost are ordered by a search for their
longest common prefix, lengths halved with the ancestors and compared by hash; that what the
search calls equal is equal is verified edit by edit.

Two ways of one state and row with equal costs are never prefixes of each other (what one has
more would be insertions, which cost), so the smaller stays smaller however they go on.

Rows reach a task sorted by conversation and stream through: what all ways share is settled
and its rows leave, so a task holds the last rows of one conversation only, as far back as
its cheapest ways differ (in a long stretch of rows whose roles are neither user, assistant
nor system that is the stretch). The rows of a conversation do pass one task, for the digest
of the repaired text is a single stream of bytes.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
SETTLE = 512  # nodes after which settled rows leave; twice what is left, if that is more

_KEEPS = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a row can be made
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_BASE, _MODULUS = 911_382_323, (1 << 61) - 1
_BLANK = " \t\n\v\f\r"


class Ways:
    """Edit sequences as nodes of a tree; node 0 is the empty one."""

    def __init__(self, base: int = _BASE, modulus: int = _MODULUS):
        self.base, self.modulus = base, modulus
        self.parent, self.edit, self.size, self.hash, self.up = [0], [""], [0], [0], [()]

    def add(self, parent: int, edit: str) -> int:
        up, node = [parent], len(self.parent)
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.parent.append(parent)
        self.edit.append(edit)
        self.size.append(self.size[parent] + 1)
        self.hash.append((self.hash[parent] * self.base + ord(edit)) % self.modulus)
        self.up.append(tuple(up))
        return node

    def prefix(self, node: int, size: int) -> int:
        """The ancestor of node (or itself) that has `size` edits."""
        over = self.size[node] - size
        while over:
            step = over.bit_length() - 1
            node = self.up[node][step]
            over -= 1 << step
        return node

    def _same(self, x: int, y: int) -> bool:
        """Whether nodes of one size and hash are the same edits, which a hash can't prove."""
        while x != y:
            if self.edit[x] != self.edit[y]:
                return False
            x, y = self.parent[x], self.parent[y]
        return True

    def common(self, x: int, y: int) -> int:
        """Length of the longest common prefix."""
        low, high = 0, min(self.size[x], self.size[y])
        while low < high:
            middle = (low + high + 1) // 2
            a, b = self.prefix(x, middle), self.prefix(y, middle)
            if a == b or (self.hash[a] == self.hash[b] and self._same(a, b)):
                low = middle
            else:
                high = middle - 1
        return low

    def before(self, x: int, y: int) -> bool:
        """Whether the edits of x come first in ASCII order."""
        size = self.common(x, y)
        if size == self.size[x] or size == self.size[y]:
            return self.size[x] < self.size[y]
        return self.edit[self.prefix(x, size + 1)] < self.edit[self.prefix(y, size + 1)]

    def edits(self, node: int, above: int = 0) -> str:
        """The edits of node after those of its ancestor `above`."""
        found = []
        while node != above:
            found.append(self.edit[node])
            node = self.parent[node]
        return "".join(reversed(found))

    def shared(self, nodes: list[int]) -> int:
        """The last node that all of them go through."""
        shared = nodes[0]
        for node in nodes[1:]:
            size = min(self.size[shared], self.size[node])
            x, y = self.prefix(shared, size), self.prefix(node, size)
            if x != y:
                for step in reversed(range(len(self.up[x]))):
                    if step < len(self.up[x]) and self.up[x][step] != self.up[y][step]:
                        x, y = self.up[x][step], self.up[y][step]
                x = self.parent[x]
            shared = x
        return shared


def fault_of(text: str, duplicate: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none."""
    solid = text.rstrip(_BLANK)
    if not solid:
        return "blank"
    if duplicate:
        return "duplicate"
    return "" if solid[-1] in ".!?" else "truncated"


class Conversation:
    """One conversation row by row; `taken` are its repaired rows as they settle."""

    def __init__(self):
        self.ways, self.limit = Ways(), SETTLE
        self.best = {START: (0, 0)}  # state: (cost, node)
        self.waiting = deque()
        self.audit, self.state, self.taken = [], START, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None
        self.last = self.initial = None
        self._insert()

    def _better(self, best, state, cost, parent, edit):
        held = best.get(state)
        if held is None or cost < held[0]:
            best[state] = (cost, self.ways.add(parent, edit))
        elif cost == held[0]:
            node = self.ways.add(parent, edit)
            if self.ways.before(node, held[1]):
                best[state] = (cost, node)

    def _insert(self):
        """Ways that insert rows here, cheapest first; each has a positive cost, so three
        in a row reach whatever can be reached."""
        for _ in range(3):
            for state, (cost, node) in sorted(self.best.items(), key=lambda x: x[1][0]):
                self._better(self.best, _NEXT[state], cost + INSERT_COST, node, INSERT)

    def _drop(self):
        """Forget early states whose way costs more than a later state's way with whatever
        that takes to go on alike: past a first system row, or one more inserted row."""
        for state, sure in ((START, DELETE_COST), (SYSTEM, 0)):
            if state in self.best:
                cost = self.best[state][0]
                for other, more in ((ASSISTANT, 0), (USER, INSERT_COST)):
                    if other in self.best and cost > self.best[other][0] + more + sure:
                        self.best.pop(state, None)

    def row(self, turn, role: str, text: str, seen: bool):
        same = self.last == (turn, role, text)
        if turn is not None and (self.last is None or self.last[0] != turn):
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.last = (turn, role, text)
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        fault = fault_of(text, seen or same)
        if fault:
            self.counts[fault] += 1
        after, extra = {}, TRUNCATED_COST if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            self._better(after, state, cost + DELETE_COST, node, DELETE)
            if fault in ("blank", "duplicate"):
                continue
            kept = _KEEPS.get((state, role[:1]))
            if kept is not None:
                self._better(after, kept, cost + extra, node, KEEP)
            self._better(after, _NEXT[state], cost + REROLE_COST + extra, node, REROLE)
        self.best = after
        self._drop()
        self.waiting.append((turn, role, text))
        self._insert()
        if len(self.ways.parent) > self.limit:
            self._settle(self.ways.shared([n for _, n in self.best.values()]))

    def _settle(self, node: int):
        """Let the rows go whose edits all ways share, and start the tree anew from there."""
        edits = self.ways.edits(node)
        for edit in edits:
            if edit == INSERT:
                turn, role, text = None, _ROLES[_NEXT[self.state]], ""
            else:
                turn, role, text = self.waiting.popleft()
            if edit != DELETE:
                if edit == KEEP:
                    self.state = _KEEPS[self.state, role[:1]]
                else:
                    self.state = _NEXT[self.state]
                    role = _ROLES[self.state]
                self.taken.append((edit, turn, role, text))
        self.audit.append(edits)
        old, self.ways = self.ways, Ways(self.ways.base, self.ways.modulus)
        moved = {node: 0}
        for state, (cost, tip) in self.best.items():
            chain = []
            while tip not in moved:
                chain.append(tip)
                tip = old.parent[tip]
            for other in reversed(chain):
                moved[other] = self.ways.add(moved[old.parent[other]], old.edit[other])
            self.best[state] = (cost, moved[chain[0] if chain else tip])
        self.limit = max(SETTLE, 2 * len(self.ways.parent))

    def end(self) -> tuple[int, str]:
        """Settle everything: (cost, audit)."""
        state, (cost, node) = ASSISTANT, self.best[ASSISTANT]
        if START in self.best:
            empty, tip = self.best[START]
            if empty < cost or (empty == cost and self.ways.before(tip, node)):
                state = START
        cost, node = self.best[state]
        self.best = {state: (cost, node)}
        self._settle(node)
        return cost, "".join(self.audit)


class _Digest:
    """sha256 of `role:text` rows joined by newlines."""

    def __init__(self):
        self.sha, self.glue = hashlib.sha256(), b""

    def add(self, rows):
        for _, _, role, text in rows:
            self.sha.update(self.glue + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.glue = b"\n"


_SUMMARY = [
    ("conv_id", pa.int64()),
    *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()),
    ("repaired_sha256", pa.string()),
]
_ROWS = [
    ("conv_id", pa.int64()),
    ("place", pa.int64()),
    ("edit", pa.string()),
    ("turn", pa.int64()),
    ("role", pa.string()),
    ("text", pa.string()),
]


def _ddl(fields) -> str:
    names = {pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{n} {names[t]}" for n, t in fields)


def _repair(summary: bool):
    fields = _SUMMARY if summary else _ROWS

    def made(rows):
        columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

    def run(batches):
        conversation = key = digest = None
        place = 0

        def taken():
            nonlocal place
            rows, conversation.taken = conversation.taken, []
            if summary:
                digest.add(rows)
                return []
            place += len(rows)
            return [(key, place - len(rows) + k, *row) for k, row in enumerate(rows)]

        def ended():
            cost, audit = conversation.end()
            rows = taken()
            if not summary:
                return rows
            c = conversation
            gaps = 0 if c.low is None else c.high - c.low + 1 - c.turns
            return [(key, gaps, *c.counts.values(), c.illegal, cost, audit, digest.sha.hexdigest())]

        for batch in batches:
            out = []
            for conv, turn, role, text, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conversation is None or conv != key:
                    if conversation is not None:
                        out += ended()
                    conversation, key, digest, place = Conversation(), conv, _Digest(), 0
                conversation.row(turn, role, text, seen)
                if conversation.taken:
                    out += taken()
            yield made(out)
        if conversation is not None:
            yield made(ended())

    return run, _ddl(fields)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows in order, each with whether its role and text occur at an earlier turn."""
    said = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("_what", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    first = (
        said.groupBy("conv_id", "_what")
        .agg(F.min(turn).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(F.col("conv_id").alias("_c"), F.col("_what").alias("_w"), "_first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_what") == F.col("_w"))
    marked = said.join(first, same, "left").select(
        "conv_id", "turn", "role", "text", F.coalesce(turn > F.col("_first"), F.lit(False)).alias("seen")
    )
    return marked.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text"
    )


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, those of one turn by role and text. The first fault
    of each counts: blank, duplicate (same role and text earlier), truncated (last solid
    character not one of . ! ?). `gaps` are turns missing between the smallest and the
    largest, `illegal` neighbours whose role initials aren't su, ua or au. `audit` has the
    initials of the cheapest edits (Keep, Rerole, Delete, Insert) that make the role initials
    (s?(ua)+)?, ASCII-least among ties; the digest is that of the repaired `role:text` rows.
    Null roles and texts are one space; a role without letters can't be kept. Rows without
    conv_id are one conversation; without rows there is no conversation. Extra columns are
    not read. Repeated rows are duplicates of the first.
    """
    run, schema = _repair(True)
    return _sorted_rows(rows).mapInArrow(run, schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), edit, turn (null for
    inserted rows), role, text. Conversations of which nothing is kept have no rows."""
    run, schema = _repair(False)
    return _sorted_rows(rows).mapInArrow(run, schema)
