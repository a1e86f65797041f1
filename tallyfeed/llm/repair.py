"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation's role initials read ``(s?(ua)+)?``. Each turn may be kept
(0), given the role that is due (3) or deleted (4); an empty turn of the role that
is due may be inserted anywhere (3); a truncated turn that stays costs 3 more; blank
and duplicate turns must go. The edits are a path through the lattice of (turn,
state of the grammar), found by Dijkstra with the key (cost, audit), audit being the
edits' initials so far: among paths of equal cost the one of least audit is popped
first, and the search stops at the first accepting end node it pops. Two paths to a
node of equal cost are never prefixes of each other (what differs would be
insertions, which cost), so the least way to a node stays least when it goes on.

A conversation longer than ``CHUNK`` turns is searched chunk by chunk, from each
state that can be reached to each state; the best ways are composed as they come,
and ties look back no further than to where two ways part. A task streams over its
conversations and holds one's edits, a letter each; texts are not kept.

Defined cases: null roles and texts are one space (``damage``), else empty; a null conv_id is one conversation, null turns come first, turns of equal
number follow by role and text, repeated rows are one turn and its duplicates (they
are counted before they are shuffled). Roles beginning with none of s, u, a (also
empty ones) can't be kept. Conversations of ``ids`` without rows have an empty audit;
empty tables give no rows. Other columns of the input, of any name, are ignored.
A conversation's digest needs its texts in order: one task streams them.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Plain, materialize, produce

#: Turns that one search takes on; longer conversations are searched in such chunks.
CHUNK = 200
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
CUT_SHORT = 3
#: The grammar: (state, role initial) -> state; a state is the initial that came last, "" at the start.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
ACCEPTING = ("", "a")
ROLES = {"u": "user", "a": "assistant"}
#: The role that is due in a state: the only one that may be given or inserted there.
DUE = {state: initial for (state, initial) in NEXT if initial in ROLES}
_INT64 = (1 << 63) - 1
ROWS = "conv_id {id}, turn bigint, role string, text string, n bigint, fault string"
EDITS = "conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def steps(turn: tuple[str, bool, int], state: str):
    """(cost, letters, next state) of what may be done with a turn: (initial, truncated, 0), or (_, _, n) for n turns that must go."""
    initial, short, must_go = turn
    if must_go:
        yield COST[DELETE] * must_go, DELETE * must_go, state
        return
    yield COST[DELETE], DELETE, state
    if (state, initial) in NEXT:
        yield COST[KEEP] + CUT_SHORT * short, KEEP, NEXT[state, initial]
    yield COST[REROLE] + CUT_SHORT * short, REROLE, NEXT[state, DUE[state]]


def search(turns: list[tuple[str, bool, int]], start: str = "", whole: bool = True) -> dict[str, tuple[int, str]]:
    """End state -> (cost, audit) of its cheapest path; if ``whole``, of the first accepting end node popped alone."""
    heap, settled, ends = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == len(turns):
            if not whole:
                ends[state] = cost, audit
            elif state in ACCEPTING:
                return {state: (cost, audit)}
        else:
            for more, letters, to in steps(turns[i], state):
                heapq.heappush(heap, (cost + more, audit + letters, i + 1, to))
        heapq.heappush(heap, (cost + COST[INSERT], audit + INSERT, i, NEXT[state, DUE[state]]))
    return ends


class Edits:
    """The cheapest edits of one conversation whose turns come one after another."""

    def __init__(self):
        self.turns: list[tuple[str, bool, int]] = []
        # state -> (cost, way), a way being (way before, letters) or None at the start
        self.best: dict[str, tuple[int, tuple | None]] = {"": (0, None)}

    def add(self, turn: tuple[str, bool, int]) -> None:
        self.turns.append(turn)
        if len(self.turns) == CHUNK:
            self._advance()

    def _advance(self) -> None:
        found: dict[str, tuple[int, tuple]] = {}
        for state, (cost, way) in self.best.items():
            for to, (more, letters) in search(self.turns, state, whole=False).items():
                new = cost + more, (way, letters)
                if to not in found or new[0] < found[to][0] or (new[0] == found[to][0] and _before(new[1], found[to][1])):
                    found[to] = new
        self.best, self.turns = found, []

    def finish(self) -> tuple[int, str]:
        if self.best == {"": (0, None)}:
            return next(iter(search(self.turns).values()))
        self._advance()
        cost, way = None, None
        for state in ACCEPTING:
            if state in self.best and (way is None or self.best[state][0] < cost or (self.best[state][0] == cost and _before(self.best[state][1], way))):
                cost, way = self.best[state]
        pieces = []
        while way:
            way, letters = way
            pieces.append(letters)
        return cost, "".join(reversed(pieces))


def _before(a: tuple | None, b: tuple | None) -> bool:
    """Whether way a's audit is less than b's; both have as many pieces, and only those after they part are read."""
    x, y = [], []
    while a is not b:
        (a, p), (b, q) = a, b
        x.append(p)
        y.append(q)
    return "".join(reversed(x)) < "".join(reversed(y))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, damaged by crc32 of "conv_id:turn" modulo 20.

    0 drops a turn, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4 makes it a user's. Nulls are one space.
    """
    plain = Plain(conversations)
    kind = F.crc32(F.concat(*[F.coalesce(F.col(plain[c]).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])) % 20
    text, role = (F.coalesce(F.col(plain[c]), F.lit(" ")) for c in ("text", "role"))
    rows = plain.df.select(
        F.col(plain["conv_id"]).alias("conv_id"),
        F.col(plain["turn"]).alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def find_faults(conversations: DataFrame) -> DataFrame:
    """Distinct rows with how often each occurs (n) and its first one's fault: blank, duplicate, truncated or null."""
    plain = Plain(conversations)
    turns = plain.df.select(*[F.col(plain[c]).alias(c) for c in ("conv_id", "turn")], *[F.coalesce(F.col(plain[c]), F.lit("")).alias(c) for c in ("role", "text")])
    # copies meet on the map side, so that a turn repeated without end is a row a task
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    same = F.sha2(F.concat_ws("|", F.length("role").cast("string"), "role", "text"), 256)
    again = F.row_number().over(Window.partitionBy("conv_id", same).orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(again, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return rows.withColumn("fault", fault).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "n", "fault")


#: Nulls come first, as Spark sorts.
_ORDER = ["conv_id", "kind", "turn", "role", "text"]


def _by_conversation(b, *names):
    return zip(*[b.column(n).to_pylist() for n in names], strict=True)


def _judge(batches):
    """Rows in order (kind 0: the conversation is there; 1: a turn), to a row of counts, cost and audit a conversation."""
    out: dict[str, list] = {}

    def close():
        made["cost"], made["audit"] = edits.finish()
        for k, v in made.items():
            out.setdefault(k, []).append(v)
        # turn numbers may lie further apart than a bigint can say
        out.setdefault("gaps", []).append(min(last - first + 1 - distinct, _INT64) if distinct else 0)

    at, made, edits, before = None, {}, None, None
    first = last = distinct = 0
    for b in batches:
        for conv_id, kind, turn, initial, n, fault in _by_conversation(b, "conv_id", "kind", "turn", "initial", "n", "fault"):
            if not edits or conv_id != at:
                if edits:
                    close()
                at, edits, before = conv_id, Edits(), None
                first, last, distinct = None, None, 0
                made = {"conv_id": conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            if not kind:
                continue
            if turn is not None:
                distinct += turn != last
                first, last = turn if first is None else first, turn
            # a row's copies follow it: blank like it, or its duplicates
            if fault:
                made[fault] += n if fault != "truncated" else 1
            if fault not in ("blank", "duplicate"):
                made["duplicate"] += n - 1
                edits.add((initial, fault == "truncated", 0))
            if gone := n if fault in ("blank", "duplicate") else n - 1:
                edits.add(("", False, gone))
            made["illegal"] += n - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
            before = initial
        if len(out.get("audit", ())) >= 5000 or sum(map(len, out.get("audit", ()))) > 1 << 24:
            yield out
            out = {}
    if edits:
        close()
    if out:
        yield out


def find_edits(faults: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of the faults, and of ``ids``."""
    id_type = faults.schema["conv_id"].dataType.simpleString()
    rows = faults.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), "n", "fault")
    if ids is not None:
        there = ids.select(F.col(ids.columns[0]).alias("conv_id")).distinct()
        rows = rows.unionByName(there.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    placed = rows.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return produce(placed.select("conv_id", "kind", "turn", "initial", "n", "fault"), _judge, EDITS.format(id=id_type))


def _replay(batches):
    """Rows in order (kind 0: the audit; 1: a turn), to (conv_id, its first?, role, text, edit); the last of a conversation's rows have conv_id alone."""
    letters, at = "", 0

    def insertions():
        nonlocal at, state
        while at < len(letters) and letters[at] == INSERT:
            at, state = at + 1, NEXT[state, DUE[state]]
            yield now, ROLES[state], "", INSERT

    state, now, begun = "", None, False
    for b in batches:
        for conv_id, kind, role, text, n, audit in _by_conversation(b, "conv_id", "kind", "role", "text", "n", "audit"):
            if not kind:
                if begun:
                    yield from insertions()
                now, letters, at, state, begun = conv_id, audit, 0, "", True
                yield now, None, None, None
                continue
            left = n
            while left:
                if letters[at] == DELETE:  # copies go together, in one stride
                    run = left if letters.startswith(DELETE * left, at) else 1
                    at, left = at + run, left - run
                elif letters[at] == INSERT:
                    yield from insertions()
                else:
                    edit, at, left = letters[at], at + 1, left - 1
                    state = NEXT[state, role[:1] if edit == KEEP else DUE[state]]
                    yield now, role if edit == KEEP else ROLES[state], text, edit
    if begun:
        yield from insertions()


def _placed(faults: DataFrame, edits: DataFrame) -> DataFrame:
    rows = faults.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n").unionByName(edits.select("conv_id", F.lit(0).alias("kind"), "audit"), allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER).select("conv_id", "kind", "role", "text", "n", "audit")


def repaired_turns(faults: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K, R or I)."""

    def run(batches):
        out, position = {k: [] for k in ("conv_id", "position", "role", "text", "edit")}, 0
        for conv_id, role, text, edit in _replay(batches):
            if edit is None:
                position = 0
                continue
            for k, v in zip(out, (conv_id, position, role, text, edit), strict=True):
                out[k].append(v)
            position += 1
            if len(out["edit"]) >= 1000:
                yield out
                out = {k: [] for k in out}
        yield out

    return produce(_placed(faults, edits), run, f"conv_id {faults.schema['conv_id'].dataType.simpleString()}, position bigint, role string, text string, edit string")


def repaired_digests(faults: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired ``role:text``, newline-joined."""

    def run(batches):
        ids, hashes, digest, lead = [], [], None, b""
        for conv_id, role, text, edit in _replay(batches):
            if edit is None:
                if digest:
                    hashes.append(digest.hexdigest())
                if len(hashes) >= 5000:
                    yield {"conv_id": ids, "repaired_sha256": hashes}
                    ids, hashes = [], []
                digest, lead = hashlib.sha256(), b""
                ids.append(conv_id)
            else:
                digest.update(lead + f"{role}:{text}".encode())
                lead = b"\n"
        if digest:
            yield {"conv_id": ids, "repaired_sha256": [*hashes, digest.hexdigest()]}

    return produce(_placed(faults, edits), run, f"conv_id {faults.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(faults, edits), each written once: for ``repaired_turns`` and ``repaired_digests``."""
    faults = materialize(find_faults(conversations), "repair-faults")
    return faults, materialize(find_edits(faults, ids), "repair-edits")
