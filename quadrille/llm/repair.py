"""Repair of a conversation's structure by alignment to an alternating grammar.

The roles of a repaired conversation read ``(s?(ua)+)?``: nothing, or a system turn
or none, then user and assistant in turn. The turns are aligned to every feasible
length of such a string (Wagner-Fischer), each in a band that the cheapest
alignment so far leaves open (Ukkonen); of the alignments of least cost the one
whose audit, the initials of its edits in order, comes first in ASCII is traced back.

| Edit | Initial | Cost |
| --- | --- | --- |
| keep | K | 0, 1 if truncated |
| rerole to user or assistant | R | 2, 3 if truncated |
| delete (the only edit of a blank or duplicate turn) | D | 3 |
| insert an empty user or assistant turn | I | 2 |

A conversation longer than SEGMENT turns is aligned segment by segment, from each
state of the grammar to each other; the least costs are chained backwards and the
segments traced forwards. All but the last segment end with a turn, so no audit of
a segment begins another and comparing segments compares whole audits.

Two passes: the first sees no texts, only a digest, the role's initial and the fault
of each turn, and gives one row per conversation; the second streams the turns, in
order, behind their audit. An audit is as long as its conversation and belongs to
one row, so one task writes it, holding a few bytes per turn; repeats of a
role and text are found by an aggregate that is spread over all tasks.

Defined results: a null role or text is one space; null turns come first; equal turns
in the order of a digest of role and text; rows with a null conversation form one
of their own. Rows marked as dropped count only as proof that their
conversation exists. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrille.llm.common import bound_batches

# Characters that do not count as text (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
SEGMENT = 32
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
ROLES = {"u": "user", "a": "assistant"}
# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)

# Of a turn: its role's initial, whether it has to go, whether it is truncated.
Turn = tuple[str, bool, bool]


def gap_cost(surplus: int) -> int:
    """The least cost of a target that is ``surplus`` longer than the turns."""
    return INSERT * surplus if surplus > 0 else -DELETE * surplus


def targets(entry: int, out: int, longest: int) -> Iterator[str]:
    """The strings that lead from one state to another, the shortest first."""
    for n in range(longest + 1):
        if n == 0:
            if entry == out:
                yield ""
            continue
        for head in (("s", "") if entry == START else ("",)):
            body = n - len(head)
            first = "a" if entry == USER else "u"
            text = head + ("ua" * n if first == "u" else "au" * n)[:body]
            if {"s": SYSTEM, "u": USER, "a": ASSISTANT}[text[-1]] == out:
                yield text


def align(turns: list[Turn], target: str, limit: int, open_end: bool = True) -> tuple[int, str] | None:
    """The least cost, at most ``limit``, and its first audit. Without ``open_end`` the last edit is a turn's."""
    n, m = len(turns), len(target)
    slack = limit - gap_cost(m - n)
    if slack < 0:
        return None
    # A step out of the band has to be undone: one insertion and one deletion more.
    wide = slack // (INSERT + DELETE)
    low, high = min(0, m - n) - wide, max(0, m - n) + wide
    never = limit + 1
    rest = [[never] * (m + 1) for _ in range(n + 1)]
    rest[n][m] = 0
    if open_end:
        for j in range(m - 1, max(0, n + low) - 1, -1):
            rest[n][j] = rest[n][j + 1] + INSERT if target[j] != "s" else never
    for i in range(n - 1, -1, -1):
        initial, goes, cut = turns[i]
        here, below = rest[i], rest[i + 1]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = below[j] + DELETE
            if j < m:
                want = target[j]
                if want != "s":
                    best = min(best, here[j + 1] + INSERT)
                if not goes:
                    if initial == want:
                        best = min(best, below[j + 1] + cut * TRUNCATED)
                    elif want != "s":
                        best = min(best, below[j + 1] + REROLE + cut * TRUNCATED)
            here[j] = best
    if rest[0][0] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = rest[i][j]
        if i < n and rest[i + 1][j] + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or open_end) and rest[i][j + 1] + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i][0] == target[j] else "R")
            i += 1
            j += 1
    return rest[0][0], "".join(audit)


def cheapest(turns: list[Turn], entry: int, outs: tuple[int, ...], open_end: bool, limit: int | None = None) -> tuple[int, str] | None:
    """The best alignment over all feasible lengths: of least cost, then of the first audit."""
    n = len(turns)
    if limit is None:
        limit = DELETE * n + 3 * INSERT  # all turns deleted, the longest least string inserted
    longest = n + limit // INSERT
    feasible = [t for out in outs for t in targets(entry, out, longest)]
    alive = sum(not goes for _, goes, _ in turns)
    best = None
    for target in sorted(feasible, key=lambda t: (abs(len(t) - alive), t)):
        if gap_cost(len(target) - n) <= limit:
            found = align(turns, target, limit, open_end)
            if found and (best is None or found < best):
                best, limit = found, found[0]
    return best


def repair(turns: list[Turn]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(turns) <= SEGMENT:
        return cheapest(turns, START, FINAL, True)
    parts = [turns[i:i + SEGMENT] for i in range(0, len(turns), SEGMENT)]
    states = range(4)
    # Least cost from each state before a segment to the end.
    ahead = [[None] * 4 for _ in parts]
    tables: list[dict[tuple[int, int], int]] = []
    for part in parts[:-1]:
        found = {(a, b): cheapest(part, a, (b,), False) for a in states for b in states}
        tables.append({k: v[0] for k, v in found.items() if v})
    last = [cheapest(parts[-1], a, FINAL if a == START else (ASSISTANT,), True) for a in states]
    ahead[-1] = [x and x[0] for x in last]
    for t in range(len(parts) - 2, -1, -1):
        for a in states:
            costs = [tables[t][a, b] + ahead[t + 1][b] for b in states if (a, b) in tables[t] and ahead[t + 1][b] is not None]
            ahead[t][a] = min(costs, default=None)
    state, audits = START, []
    for t, part in enumerate(parts[:-1]):
        choices = []
        for b in states:
            cost = tables[t].get((state, b))
            if cost is not None and ahead[t + 1][b] is not None and cost + ahead[t + 1][b] == ahead[t][state]:
                choices.append((cheapest(part, state, (b,), False, cost)[1], b))
        audit, state = min(choices)
        audits.append(audit)
    return ahead[0][START], "".join([*audits, last[state][1]])


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits of an audit."""
    turn, after = iter(turns), START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turn)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if after == USER else "u"]
        after = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        yield role, text


SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its turns in order; needs no texts."""
    first, current = True, None
    state: dict = {}

    def reset() -> None:
        state.update(turns=[], before=None, last="", seen=0, low=None, high=None, faults=[0, 0, 0], illegal=0)

    def finish() -> tuple:
        cost, audit = repair(state["turns"])
        gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["seen"]
        return (current, gaps, *state["faults"], state["illegal"], cost, audit)

    for batch in batches:
        rows = []
        for conv, turn, digest, initial, again, blank, cut, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first or conv != current:
                if not first:
                    rows.append(finish())
                first, current = False, conv
                reset()
            if dropped:
                continue
            if turn is not None:
                state["seen"] += state["high"] != turn
                state["low"] = turn if state["low"] is None else state["low"]
                state["high"] = turn
            again = again or state["before"] == (turn, digest)
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                state["faults"][fault] += 1
            if state["turns"]:
                state["illegal"] += state["last"] + initial not in ("su", "ua", "au")
            state["before"], state["last"] = (turn, digest), initial
            state["turns"].append((initial, fault in (0, 1), fault == 2))
        if rows:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, batch.column(0).type if k == "conv_id" else pa.string() if k == "audit" else pa.int64())
                                              for k, v in zip(SUMMARY, zip(*rows, strict=True), strict=True)})
    if not first:
        kind = batch.column(0).type
        yield pa.RecordBatch.from_pydict({k: pa.array([v], kind if k == "conv_id" else pa.string() if k == "audit" else pa.int64())
                                          for k, v in zip(SUMMARY, finish(), strict=True)})


def digest(role: str | Column = "role", text: str | Column = "text") -> Column:
    """Tells turns of different roles or texts apart."""
    role, text = (F.col(c) if isinstance(c, str) else c for c in (role, text))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def _spaced(turns: DataFrame) -> DataFrame:
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dropped.alias("dropped"))


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, the repair's cost and audit.

    ``turns`` has conv_id, turn, role, text and, if wanted, dropped.
    """
    bound_batches(turns.sparkSession)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    rows = _spaced(turns).select("conv_id", "turn", digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), "dropped",
                                 (last == "").alias("blank"), (~last.isin(*ENDS)).alias("cut"))
    # What occurs in one turn only needs no partner: its repeats follow each other.
    seen = (rows.filter("NOT dropped").groupBy("conv_id", "digest")
            .agg(F.min(F.struct("turn")).alias("low"), F.max(F.struct("turn")).alias("high"))
            .filter("low <> high").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "low.turn", F.lit(True).alias("several"))
            .withColumnRenamed("turn", "first"))
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("several"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    ordered = (joined.select("conv_id", "turn", "digest", "initial", again.alias("again"), "blank", "cut", "dropped")
               .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_summaries, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _behind_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns in order, each conversation behind its row of ``found``."""
    values = [c for c in SUMMARY if c != "conv_id"]
    rows = _spaced(turns).filter("NOT dropped")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.struct(*values).alias("head"), F.lit(None).cast("long").alias("turn"),
                         F.lit("").alias("digest"), F.lit("").alias("role"), F.lit("").alias("text"))
    bodies = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "turn",
                         digest().alias("digest"), "role", "text")
    return (heads.unionByName(bodies).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "digest").select("conv_id", "head", "role", "text"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, head, its turns), the turns to be read before the next conversation."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        conv, head = held[:2]
        held = None

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal held
            for row in rows:
                if row[1] is not None:
                    held = row
                    return
                yield row[2], row[3]

        mine = turns()
        yield conv, head, mine
        for _ in mine:
            pass


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after the edits in ``found`` (from ``audits``): conv_id, position, role, text."""
    kind = turns.schema["conv_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            ids, places, roles, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, id_type), "position": pa.array(places, pa.int64()),
                                               "role": pa.array(roles, pa.string()), "text": pa.array(texts, pa.string())})

        out, held = [], 0
        for conv, head, own in _conversations(batches):
            for place, (role, text) in enumerate(repaired(head["audit"], own)):
                out.append((conv, place, role, text))
                held += len(text)
                if held > 1 << 22 or len(out) >= 10_000:
                    yield pack(out)
                    out, held = [], 0
        if out:
            yield pack(out)

    return _behind_audits(turns, found).mapInArrow(run, f"conv_id {kind.simpleString()}, position long, role string, text string")


def report(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the digest of each repaired conversation: its ``role:text``, joined by newlines, as the turns stream by."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    id_type = to_arrow_type(turns.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, heads, digests = [], [], []

        def pack() -> pa.RecordBatch:
            columns = {"conv_id": pa.array(ids, id_type)}
            for c in SUMMARY[1:]:
                columns[c] = pa.array([h[c] for h in heads], pa.string() if c == "audit" else pa.int64())
            columns["repaired_sha256"] = pa.array(digests, pa.string())
            return pa.RecordBatch.from_pydict(columns)

        for conv, head, own in _conversations(batches):
            whole = hashlib.sha256()
            for place, (role, text) in enumerate(repaired(head["audit"], own)):
                whole.update(("\n" * (place > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            ids.append(conv)
            heads.append(head)
            digests.append(whole.hexdigest())
            if len(ids) >= 5_000:
                yield pack()
                ids, heads, digests = [], [], []
        if ids:
            yield pack()

    return _behind_audits(turns, found).mapInArrow(
        run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults by a hash of conversation and turn: dropped, emptied, without ends of sentences, repeated, all users."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    bare = reduce(lambda t, end: F.replace(t, F.lit(end), F.lit("")), ENDS, text)
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, bare).otherwise(text).alias("text"), (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
