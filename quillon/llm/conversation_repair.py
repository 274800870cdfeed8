"""Repairs conversations to alternating turns at the least cost.

The edits of a conversation are the arcs of a graph without cycles of less than
their cost: a node is a row and a state of the expression ``(s?(ua)+)?`` over
role initials; keep, rerole and delete go to the next row, insert stays.

1. Forward least costs to each node and backward ones from it. An arc is tight,
   that is on some cheapest way, if cost before, of it and after sum to the whole.
2. A walk over tight arcs from the set of nodes reached so far takes the least
   edit letter that leaves any of them, and goes on from all nodes that it leads
   to: the ASCII-least of all cheapest edits, without listing them.

Conversations meet in one task each, sorted, and are read as a stream. One of
over ``most_rows`` rows or ``most_bytes`` is divided instead: ranges of its rows
in order are pieces, the costs of a piece from any state to any other are a 4 x 4
matrix, and least sums over products of matrices carry costs over the pieces from
both ends, then states from the first on. Only its digest, which by its nature
follows the rows one after the other, is a stream of one task, with bounded
memory.

Damage is part of the operator: it makes the faults that the repair is judged on.

Nulls: a null role or text is one space (so a null text is blank), a null
conversation one of its own; null turns come first and don't count for gaps.
Rows of one turn are ordered by role, then by the MD5 of their text; of equal
ones the first is kept. A role without an initial can't be kept. An empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import written

#: Characters that aren't text.
BLANKS = " \t\n\x0b\x0c\r"
#: The costs of edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of ``(s?(ua)+)?``: start, after s, u and a. NEXT[state] has where an initial leads; ENDS are accepted.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS, STATES, FAR = (0, 3), range(4), 1 << 40
ROLES = {"u": "user", "a": "assistant"}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Arc = tuple[int, str, int, int, str]  # state, letter, cost, next state, role initial if the edit sets one


@dataclass(frozen=True)
class Settings:
    most_rows: int = 100_000
    most_bytes: int = 64 << 20


def row_arcs(kind: tuple[str, bool, bool]) -> list[Arc]:
    """The arcs over a row of an initial, that must go, that is truncated."""
    initial, must_go, truncated = kind
    out: list[Arc] = [(p, "D", DELETE, p, "") for p in STATES]
    more = TRUNCATED * truncated
    for p in STATES if not must_go else ():
        if initial in NEXT[p]:
            out.append((p, "K", more, NEXT[p][initial], ""))
        out += [(p, "R", REROLE + more, NEXT[p][x], x) for x in ROLES if x in NEXT[p]]
    return out


INSERTS: list[Arc] = [(p, "I", INSERT, NEXT[p][x], x) for p in STATES for x in ROLES if x in NEXT[p]]


def matrix_of(arcs: list[Arc]) -> list[list[int]]:
    out = [[FAR] * 4 for _ in STATES]
    for p, _, cost, q, _ in arcs:
        out[p][q] = min(out[p][q], cost)
    return out


def times(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Least sums: from a state by ``a`` to any, on by ``b``."""
    return [[min(a[p][k] + b[k][q] for k in STATES) for q in STATES] for p in STATES]


NOTHING = [[0 if p == q else FAR for q in STATES] for p in STATES]
#: Any number of inserts: two at most are of use.
INSERTED = times(*[[[min(a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(NOTHING, matrix_of(INSERTS), strict=True)]] * 2)
START = [0, FAR, FAR, FAR]
FINISH = [min(INSERTED[p][q] for q in ENDS) for p in STATES]


class Rows(dict):
    """What is known of a kind of row: its arcs, and the costs over inserts and it."""

    def __missing__(self, kind: tuple[str, bool, bool]) -> tuple[list[Arc], list[list[int]], list[list[int]]]:
        arcs = row_arcs(kind)
        own = matrix_of(arcs)
        self[kind] = out = (arcs, own, times(INSERTED, own))
        return out


KINDS = Rows()


def forward(start: list[int], kinds: list) -> list[list[int]]:
    """Least costs to the nodes before each row, and after the last."""
    out = [[min(start[p] + INSERTED[p][q] for p in STATES) for q in STATES]]
    for kind in kinds:
        whole = times([out[-1]] * 4, KINDS[kind][1])[0]
        out.append([min(whole[p] + INSERTED[p][q] for p in STATES) for q in STATES])
    return out


def backward(end: list[int], kinds: list) -> list[list[int]]:
    """Least costs from the nodes before each row to the end, and ``end``."""
    out = [end]
    for kind in reversed(kinds):
        m = KINDS[kind][2]
        out.append([min(m[p][q] + out[-1][q] for q in STATES) for p in STATES])
    return out[::-1]


def walk(kinds: list, start: list[int], end: list[int], total: int, states: set[int], last: bool) -> tuple[list[tuple[str, int, str]], set[int]]:
    """Edits as (letter, row or -1, initial that is set), and the states after the rows (with the inserts after them if ``last``)."""
    ahead, back = forward(start, kinds), backward(end, kinds)
    out: list[tuple[str, int, str]] = []
    for i in range(len(kinds) + last):
        arcs = KINDS[kinds[i]][0] if i < len(kinds) else []
        while states:
            tight = [(a, False) for a in arcs if a[0] in states and ahead[i][a[0]] + a[2] + back[i + 1][a[3]] == total]
            tight += [(a, True) for a in INSERTS if a[0] in states and ahead[i][a[0]] + a[2] + back[i][a[3]] == total]
            if not tight:
                break
            letter = min(a[1] for a, _ in tight)
            chosen = [(a, stays) for a, stays in tight if a[1] == letter]
            states = {a[3] for a, _ in chosen}
            out.append((letter, -1 if letter == "I" else i, chosen[0][0][4]))
            if letter != "I":
                break
    return out, states


def whole(kinds: list) -> tuple[int, list[tuple[str, int, str]]]:
    """The least cost and the edits of a conversation."""
    cost = backward(FINISH, kinds)[0][0]
    return cost, walk(kinds, START, FINISH, cost, {0}, True)[0]


def kind_of(role: str, must_go: bool, truncated: bool) -> tuple[str, bool, bool]:
    return (role[:1] if role[:1] in "sua" else "", must_go, truncated and not must_go)


def illegal(before: str, after: str) -> bool:
    return before[:1] + after[:1] not in ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """(``g``, ``conv_id``, ``turn``, ``role``, ``text``, ``gone``, ``blank``, ``truncated``): rows after damage; dropped ones only tell that their conversation exists."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    gone = fault == 0
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("g"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), gone.alias("gone"),
        F.when(gone, "").when(fault == 4, "user").otherwise(name("role")).alias("role"), F.when(gone, "").otherwise(text).alias("text"), F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    )
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return rows.select("*", (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated"), F.md5("text").alias("digest")).drop("copy")


def digest_line(hashed, line: tuple[str, str], first: bool) -> None:
    hashed.update(("" if first else "\n").encode() + f"{line[0]}:{line[1]}".encode("utf-8", "surrogatepass"))


def repaired_in_tasks(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task, each whole in one."""
    names = ["g", "conv_id", "turn", "role", "text", "gone", "blank", "truncated"]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}

        def result(own: list[tuple]) -> tuple:
            there = [r for r in own if not r[5]]
            seen: set[tuple[str, str]] = set()
            kinds, duplicate = [], 0
            for _, _, _, role, text, _, blank, truncated in there:
                again = (role, text) in seen
                seen.add((role, text))
                duplicate += again and not blank
                kinds.append(kind_of(role, blank or again, truncated))
            key = tuple(kinds)
            if key not in known:
                if len(known) > 50_000:
                    known.clear()
                known[key] = whole(kinds)
            cost, edits = known[key]
            hashed, n = hashlib.sha256(), 0
            for letter, row, initial in edits:
                if letter != "D":
                    digest_line(hashed, (ROLES.get(initial) or there[row][3], "" if letter == "I" else there[row][4]), not n)
                    n += 1
            turns = {r[2] for r in there} - {None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            wrong = sum(illegal(a[3], b[3]) for a, b in zip(there, there[1:], strict=False))
            return own[0][1], gaps, sum(r[6] for r in there), duplicate, sum(k[2] for k in kinds), wrong, cost, "".join(e[0] for e in edits), hashed.hexdigest()

        def conversations() -> Iterator[list[tuple]]:
            own: list[tuple] = []
            for b in batches:
                for row in zip(*(b[c].to_pylist() for c in names), strict=True):
                    if own and own[0][0] != row[0]:
                        yield own
                        own = []
                    own.append(row)
            if own:
                yield own

        kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
        labels = [x.split()[0] for x in RESULT.split(", ")]
        out = []
        for own in conversations():
            out.append(result(own))
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=labels)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=labels)

    order = ["g", "turn", "role", "digest"]
    return rows.repartition("g").sortWithinPartitions(*order).select(*names).mapInArrow(repair, RESULT)


def repaired_in_pieces(rows: DataFrame, pieces: int) -> DataFrame:
    """Conversations of any size, in ``pieces`` ranges of rows."""
    ids = rows.groupBy("g").agg(F.first("conv_id").alias("conv_id"))
    rows = written(rows.where("not gone").withColumn("tie", F.monotonically_increasing_id()))
    firsts = rows.groupBy("g", "role", "digest").agg(F.min(F.struct("turn", "tie")).alias("m")).select(F.col("m.tie").alias("tie"), F.lit(True).alias("first"))
    order = ["turn", "role", "digest", "tie"]
    rows = rows.join(firsts, "tie", "left").withColumn("again", F.col("first").isNull())
    rows = written(rows.repartitionByRange(pieces, "g", *order).withColumn("piece", F.spark_partition_id()))
    facts = rows.select("g", "piece", *order, F.substring("role", 1, 1).alias("initial"), "blank", "again", "truncated")

    def kinds_of(own: pd.DataFrame) -> list:
        return [kind_of(r, bool(b or a), bool(t)) for r, b, a, t in zip(own["initial"], own["blank"], own["again"], own["truncated"], strict=True)]

    def sorted_rows(own: pd.DataFrame) -> pd.DataFrame:
        return own.sort_values(order, na_position="first", kind="stable")

    def summary(own: pd.DataFrame) -> pd.DataFrame:
        own = sorted_rows(own)
        kinds = kinds_of(own)
        m = NOTHING
        for kind in kinds:
            m = times(m, KINDS[kind][2])
        turns = own["turn"].dropna()
        initials = list(own["initial"])
        return pd.DataFrame([{
            "g": own["g"].iloc[0], "piece": own["piece"].iloc[0], "m": [x for row in m for x in row], "blank": int(own["blank"].sum()), "duplicate": int((own["again"] & ~own["blank"]).sum()), "truncated": sum(k[2] for k in kinds),
            "illegal": sum(illegal(a, b) for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0], "last": initials[-1],
            "low": None if turns.empty else int(turns.min()), "high": None if turns.empty else int(turns.max()), "turns": turns.nunique(),
        }])

    summaries = written(facts.groupBy("g", "piece").applyInPandas(summary, "g string, piece int, m array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"))

    def carried(own: pd.DataFrame) -> pd.DataFrame:
        """Costs before and after each piece of a conversation, and what its pieces sum to."""
        own = own.sort_values("piece")
        ms = [[list(m[4 * p : 4 * p + 4]) for p in STATES] for m in own["m"]]
        before, after = [START], [FINISH]
        for m in ms[:-1]:
            before.append([min(before[-1][p] + m[p][q] for p in STATES) for q in STATES])
        for m in reversed(ms):
            after.append([min(m[p][q] + after[-1][q] for q in STATES) for p in STATES])
        after = after[::-1]
        rows = own.dropna(subset=["low"])
        shared = sum(a == b for a, b in zip(rows["high"], rows["low"][1:], strict=False))
        gaps = 0 if rows.empty else int(rows["high"].max() - rows["low"].min() + 1 - (rows["turns"].sum() - shared))
        wrong = own["illegal"].sum() + sum(illegal(a, b) for a, b in zip(own["last"], own["first"][1:], strict=False))
        return pd.DataFrame({
            "g": own["g"], "piece": own["piece"], "before": before, "after": after[1:], "cost": after[0][0], "final": [k == len(ms) - 1 for k in range(len(ms))],
            "gaps": gaps, "blank": own["blank"].sum(), "duplicate": own["duplicate"].sum(), "truncated": own["truncated"].sum(), "illegal": wrong,
        })

    costs = written(summaries.groupBy("g").applyInPandas(carried, "g string, piece int, before array<long>, after array<long>, cost long, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long"))
    own_costs = costs.select("g", "piece", "before", "after", "cost", "final")

    def ends(own: pd.DataFrame) -> pd.DataFrame:
        """Where each state before the piece leads, -1 if no cheapest way passes it."""
        own = sorted_rows(own)
        kinds, r = kinds_of(own), own.iloc[0]
        reached = [next(iter(walk(kinds, list(r["before"]), list(r["after"]), r["cost"], {p}, False)[1]), -1) if r["before"][p] < FAR else -1 for p in STATES]
        return pd.DataFrame([{"g": r["g"], "piece": r["piece"], "ends": reached}])

    reached = facts.join(own_costs, ["g", "piece"]).groupBy("g", "piece").applyInPandas(ends, "g string, piece int, ends array<int>")

    def starts(own: pd.DataFrame) -> pd.DataFrame:
        own, at, out = own.sort_values("piece"), 0, []
        for e in own["ends"]:
            out.append(at)
            at = e[at]
        return pd.DataFrame({"g": own["g"], "piece": own["piece"], "state": out})

    states = written(reached.groupBy("g").applyInPandas(starts, "g string, piece int, state int"))

    def edit(own: pd.DataFrame) -> pd.DataFrame:
        own = sorted_rows(own)
        r = own.iloc[0]
        edits = walk(kinds_of(own), list(r["before"]), list(r["after"]), r["cost"], {r["state"]}, bool(r["final"]))[0]
        ties = list(own["tie"])
        return pd.DataFrame({"g": r["g"], "piece": r["piece"], "at": range(len(edits)), "letter": [e[0] for e in edits], "tie": pd.array([None if e[1] < 0 else ties[e[1]] for e in edits], "Int64"), "own_role": [ROLES.get(e[2]) for e in edits]})

    edits = facts.join(own_costs, ["g", "piece"]).join(states, ["g", "piece"]).groupBy("g", "piece").applyInPandas(edit, "g string, piece int, at long, letter string, tie long, own_role string")
    lines = edits.join(rows.select("tie", "role", "text"), "tie", "left").select("g", "piece", "at", "letter", F.coalesce("own_role", "role").alias("role"), F.when(F.col("letter") != "D", F.coalesce("text", F.lit(""))).alias("text"))

    def hash_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashed, audit, n = None, None, [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([own]), pa.array(["".join(audit)]), pa.array([hashed.hexdigest()])], names=["g", "audit", "repaired_sha256"])
        for b in batches:
            for g, letter, role, text in zip(*(b[c] for c in ("g", "letter", "role", "text")), strict=True):
                if g.as_py() != own:
                    if own is not None:
                        yield done()
                    own, hashed, audit, n = g.as_py(), hashlib.sha256(), [], 0
                audit.append(letter.as_py())
                if letter.as_py() != "D":
                    digest_line(hashed, (role.as_py(), text.as_py()), not n)
                    n += 1
        if own is not None:
            yield done()

    hashes = lines.repartition("g").sortWithinPartitions("g", "piece", "at").select("g", "letter", "role", "text").mapInArrow(hash_stream, "g string, audit string, repaired_sha256 string")
    sums = costs.where("final").select("g", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = ids.join(sums, "g", "left").join(hashes, "g", "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}).select(*[x.split()[0] for x in RESULT.split(", ")])


def repaired(conversations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Damages and repairs; a row per conversation with its faults, the least cost, the edits and the repaired text's SHA-256."""
    rows = damaged(conversations)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("g")
    large = conversations.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).where((F.col("n") > s.most_rows) | (F.col("size") > s.most_bytes))
    large = written(large)
    n = large.agg(F.sum(F.greatest(F.col("n") / s.most_rows, F.col("size") / s.most_bytes))).first()[0]
    if n is None:
        return repaired_in_tasks(rows)
    small = repaired_in_tasks(rows.join(large, "g", "left_anti"))
    return small.unionByName(repaired_in_pieces(rows.join(large.select("g"), "g", "left_semi"), 2 * int(n) + 2))
