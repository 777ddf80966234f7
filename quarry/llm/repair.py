"""Conversation structure repair: the cheapest edits that leave alternating turns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Workspace, shuffle_partitions

BLOCK_TURNS, BLOCK_CHARS = 1024, 1 << 20  #: of one block of a conversation
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  #: costs; a kept turn costs nothing, a truncated one that stays TRUNCATED more
START, SYSTEM, USER, ASSISTANT = range(4)  #: the role that was retained last
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Turns to insert between a retained role and the next retained one, by role pair; none may stand before a system turn.
BETWEEN = {
    SYSTEM: ((START, 0),),
    USER: ((START, 0), (SYSTEM, 0), (USER, 1), (ASSISTANT, 0)),
    ASSISTANT: ((START, 1), (SYSTEM, 1), (USER, 0), (ASSISTANT, 1)),
}
AT_END = (0, 2, 1, 0)  #: turns to insert after the last retained role
LEGAL = {"su", "ua", "au"}


def faults(turns: list[tuple[str, str]], first: set[int] | None = None) -> list[str]:
    """Each turn's first fault: blank, duplicate (role and text seen earlier; `first` has the places of first occurrences where earlier turns stand elsewhere), truncated, or none."""
    seen, out = set(), []
    for i, (role, text) in enumerate(turns):
        core = text.strip(SPACES)
        if not core:
            out.append("blank")
        elif (i not in first) if first is not None else (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if core[-1] in ".!?" else "truncated")
        if first is None:
            seen.add((role, text))
    return out


def cheapest(roles: list[str], found: list[str], entry: int = START) -> list[tuple[int, str] | None]:
    """For each role that may be retained last, the cost and audit of the cheapest edits of the turns that come after a retained `entry`; ties ASCII-least.

    Retained-subsequence dynamic programme: a turn that stays follows an earlier retained one, and all turns between are deleted. With prefix sums of deletion costs, the price of that gap is a
    difference, so that a running minimum for each retained role (cost less the sum) stands for all earlier turns; the role pair tells what has to be inserted. Audits of one cost that
    end alike are compared as text: both have a letter a turn and end in one, so that none is the other's beginning.
    """
    running: list[tuple[int, str, int] | None] = [None] * 4  # cost less deletions so far, audit, turns that the audit covers
    running[entry] = (0, "", 0)
    deleted = 0
    for i, (role, fault) in enumerate(zip(roles, found, strict=True)):
        new = []
        if fault not in ("blank", "duplicate"):
            own, more = INITIALS.get(role[:1]), TRUNCATED * (fault == "truncated")
            for to in (SYSTEM, USER, ASSISTANT):
                if to == SYSTEM and own != SYSTEM:
                    continue
                edit, letter = (0, "K") if to == own else (REROLE, "R")
                best = None
                for last, inserts in BETWEEN[to]:
                    if (was := running[last]) is None:
                        continue
                    cost = was[0] + deleted + INSERT * inserts
                    if best is None or cost <= best[0]:
                        audit = was[1] + "D" * (i - was[2]) + "I" * inserts
                        if best is None or (cost, audit) < best:
                            best = (cost, audit)
                if best is not None:
                    new.append((to, best[0] + edit + more, best[1] + letter))
        deleted += DELETE
        for to, cost, audit in new:
            was, value = running[to], cost - deleted
            if was is None or value < was[0] or value == was[0] and audit < was[1] + "D" * (i + 1 - was[2]):
                running[to] = (value, audit, i + 1)
    return [None if r is None else (r[0] + deleted, r[1] + "D" * (len(roles) - r[2])) for r in running]


def finished(by_last: list[tuple[int, str] | None]) -> tuple[int, str]:
    return min((c[0] + INSERT * n, c[1] + "I" * n) for c, n in zip(by_last, AT_END, strict=True) if c is not None)


def apply_audit(audit: str, turns: list[tuple[str, str]], last: int = START) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or are inserted. An inserted turn answers the one before; so does a reroled one."""
    out, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else turns[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            last = INITIALS[role[:1]]
        else:
            last = ASSISTANT if last == USER else USER
            role = NAMES[last]
        out.append((letter, role, text))
    return out


def _tally(turns: list[tuple[int | None, str, str]], found: list[str]) -> dict:
    numbers = [t for t, _, _ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    return {
        "n": len(turns), "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "first_initial": initials[0], "last_initial": initials[-1],
        "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None, "turns": len(set(numbers)),
    }


TALLY = "n int, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"
STAYED = "array<struct<edit:string,role:string,text:string>>"
DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def _record(schema: T.StructType, rows: list[dict]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], [f.name for f in arrow])


def _lines(stayed: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for _, role, text in stayed).encode()


def _cut(schema: T.StructType):
    """Sorted turns of a range of conversations: those that stand whole in one block are repaired here, the others leave as blocks of turns."""

    def run(batches):
        part = TaskContext.get().partitionId()
        state = {"conv": None, "own": [], "chars": 0, "seq": 0, "closed": 0, "begun": False, "first": True}
        out: list[dict] = []

        def close(whole: bool) -> None:
            own = state["own"]
            if not own:
                return
            row = {"conv": state["conv"], "part": part, "seq": state["seq"]}
            pairs = [(r, t) for _, r, t in own]
            if whole:
                found = faults(pairs)
                cost, audit = finished(cheapest([r for r, _ in pairs], found))
                stayed = apply_audit(audit, pairs)
                tally = _tally(own, found)
                digest = {"gaps": _gaps(tally["first_turn"], tally["last_turn"], tally["turns"]), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(_lines(stayed)).hexdigest()}
                out.append(row | {"whole": True} | {k: tally[k] for k in ("blank", "duplicate", "truncated", "illegal")} | digest | {"stayed": [dict(zip(("edit", "role", "text"), s, strict=True)) for s in stayed]})
            else:
                out.append(row | {"whole": False, "numbers": [n for n, _, _ in own], "roles": [r for r, _ in pairs], "texts": [t for _, t in pairs]})
            state.update(own=[], chars=0, seq=state["seq"] + 1, closed=state["closed"] + 1)

        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text")), strict=True):
                if state["begun"] and conv != state["conv"]:
                    # The first conversation of a range may have begun in the one before; a long one has given blocks already.
                    close(whole=not state["first"] and state["closed"] == 0)
                    state.update(closed=0, first=False)
                state.update(conv=conv, begun=True)
                state["own"].append((turn, role, text))
                state["chars"] += len(text) + len(role)
                if len(state["own"]) >= BLOCK_TURNS or state["chars"] >= BLOCK_CHARS:
                    close(whole=False)
            if out:
                yield _record(schema, out)
                out.clear()
        close(whole=False)  # the last one may go on in the next range
        if out:
            yield _record(schema, out)

    return run


def _solve(schema: T.StructType):
    """The cheapest edits of a block from each role that may have been retained before it to each that may be last, costs and audits' order."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                turns = list(zip(row["numbers"], row["roles"], row["texts"], strict=True))
                found = faults([t[1:] for t in turns], set(row["firsts"] or ()))
                grid = [c for entry in range(4) for c in cheapest(row["roles"], found, entry)]
                ranks = {a: k for k, a in enumerate(sorted({c[1] for c in grid if c}))}
                solved = {"costs": [c and c[0] for c in grid], "ranks": [c and ranks[c[1]] for c in grid], "audits": [c and c[1] for c in grid]}
                yield _record(schema, [row | _tally(turns, found) | solved])

    return run


def choose_path(costs: list[list[int | None]], ranks: list[list[int | None]]) -> tuple[list[tuple[int, int]], int]:
    """(role before, role after) of each block of a conversation on its cheapest path, ASCII-least among ties, and the turns to insert at the end.

    A block's audits have a letter a turn and end in one, so that two whole audits compare by their first blocks that differ: the order of paths so far, then the order of the block's audits.
    """
    now: dict[int, tuple[int, int]] = {START: (0, 0)}
    back: list[dict[int, int]] = []
    for cost, rank in zip(costs, ranks, strict=True):
        found = {}
        for last in range(4):
            paths = [(c + cost[4 * e + last], r, rank[4 * e + last], e) for e, (c, r) in now.items() if cost[4 * e + last] is not None]
            if paths:
                found[last] = min(paths)
        order = {key: k for k, key in enumerate(sorted({p[1:3] for p in found.values()}))}
        now = {last: (p[0], order[p[1:3]]) for last, p in found.items()}
        back.append({last: p[3] for last, p in found.items()})
    _, _, inserts, last = min((c + INSERT * AT_END[x], r, AT_END[x], x) for x, (c, r) in now.items())
    path = []
    for before in reversed(back):
        path.append((before[last], last))
        last = before[last]
    return path[::-1], inserts


CHOSEN = "part int, seq int, entry int, exit int, inserts int"


def _choose(table: pa.Table) -> pa.Table:
    table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
    path, inserts = choose_path(table.column("costs").to_pylist(), table.column("ranks").to_pylist())
    last = [0] * (len(path) - 1) + [inserts]
    cells = [table.column("part").to_pylist(), table.column("seq").to_pylist(), [e for e, _ in path], [x for _, x in path], last]
    return pa.Table.from_arrays([pa.array(c, pa.int32()) for c in cells], [f.split()[0] for f in CHOSEN.split(", ")])


def _block_audit(row: dict) -> tuple[int, str]:
    cell = 4 * row["entry"] + row["exit"]
    return row["costs"][cell] + INSERT * row["inserts"], row["audits"][cell] + "I" * row["inserts"]


def _block_turns(row: dict) -> list[tuple[str, str, str]]:
    return apply_audit(_block_audit(row)[1], list(zip(row["roles"], row["texts"], strict=True)), row["entry"])


def _stayed_in_blocks(schema: T.StructType):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield _record(schema, [row | {"stayed": [dict(zip(("edit", "role", "text"), s, strict=True)) for s in _block_turns(row)]}])

    return run


def _fold_blocks(schema: T.StructType):
    """Digests of conversations whose blocks come in order, one conversation after another; the text streams through the hash."""

    def run(batches):
        now: dict = {}

        def done() -> dict:
            return now["sums"] | {"conv": now["conv"], "gaps": _gaps(now["first_turn"], now["last_turn"], now["turns"]), "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

        for batch in batches:
            for row in batch.to_pylist():
                if not now or row["conv"] != now["conv"]:
                    if now:
                        yield _record(schema, [done()])
                    now = {"conv": row["conv"], "sums": dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), "first_turn": None, "last_turn": None, "turns": 0, "audit": [], "hash": hashlib.sha256(), "any": False, "initial": None}
                cost, audit = _block_audit(row)
                sums = now["sums"]
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    sums[k] += row[k]
                sums["cost"] += cost
                sums["illegal"] += now["initial"] is not None and now["initial"] + row["first_initial"] not in LEGAL
                if row["first_turn"] is not None:
                    now["turns"] += row["turns"] - (now["last_turn"] == row["first_turn"])
                    now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = row["last_turn"]
                stayed = _block_turns(row)
                if stayed:
                    now["hash"].update((b"\n" if now["any"] else b"") + _lines(stayed))
                    now["any"] = True
                now["audit"].append(audit)
                now["initial"] = row["last_initial"]
        if now:
            yield _record(schema, [done()])

    return run


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each conversation's faults and cheapest repair, and the repaired turns.

    Turns stand in the order of their number, nulls first, then of the md5 of `role:text`. A repair keeps turns (0), gives them the role user or assistant (REROLE), deletes them (DELETE; it has to for blank turns and
    repetitions) or inserts empty ones (INSERT), so that the role initials read (s?(ua)+)?; truncated turns that stay cost TRUNCATED. Of the cheapest edits the ASCII-least string of initials wins.

    The table is range-sorted by conversation and turn, so that a long conversation spreads over ranges. Conversations that stand whole inside a range and a block are repaired where they are
    read. Longer ones, and those at the ends of a range, leave blocks: their first occurrences of (role, text) are found by a grouping over hashes; each block is solved from
    every role that may stand before it; paths over blocks are chosen from a few numbers a block; and the chosen blocks stream in order through one SHA-256, which only a sequence can give.

    Null roles and texts count as one space. Null conversations are one conversation; repeated rows are turns of their own; other columns are ignored; an empty table gives none.
    Returns (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) and (conv, block, place, edit, role, text), the turns that stay in the order of block and place.
    """
    spark = turns.sparkSession
    ws = Workspace(spark, "repair")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    rows = rows.withColumn("tie", F.md5(F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8"))).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    order = ["conv", "turn", "tie", "salt"]  # nulls come first; the salt lets a turn that a third of all rows repeat spread over ranges
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    conv = rows.schema["conv"].dataType.simpleString()
    key = f"conv {conv}, part int, seq int"
    schema = lambda s: T._parse_datatype_string(s)
    cut = f"{key}, whole boolean, {DIGEST}, stayed {STAYED}, numbers array<long>, roles array<string>, texts array<string>"
    blocks = ws.save(ranged.mapInArrow(_cut(schema(cut)), cut), "blocks")
    names = [f.split()[0] for f in DIGEST.split(", ")]
    whole = blocks.filter("whole")
    parts = blocks.filter("NOT whole").select("conv", "part", "seq", "numbers", "roles", "texts")
    each = parts.select("conv", "part", "seq", F.posexplode(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.sha1(F.encode(F.concat(F.length(x["roles"]), F.lit(":"), x["roles"], x["texts"]), "UTF-8")))).alias("at", "hash"))
    firsts = each.groupBy("conv", "hash").agg(F.min(F.struct("part", "seq", "at")).alias("f")).groupBy("f.part", "f.seq").agg(F.collect_list("f.at").alias("firsts"))  # a block's turns at most
    solved_schema = f"{key}, roles array<string>, texts array<string>, {TALLY}, costs array<long>, ranks array<int>, audits array<string>"
    solved = ws.save(parts.join(firsts, ["part", "seq"], "left").mapInArrow(_solve(schema(solved_schema)), solved_schema), "solved")
    chosen = ws.save(solved.select("conv", "part", "seq", "costs", "ranks").groupBy("conv").applyInArrow(_choose, CHOSEN), "chosen")
    paths = solved.join(chosen, ["part", "seq"])
    digest = f"conv {conv}, {DIGEST}"
    folded = paths.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_fold_blocks(schema(digest)), digest)
    digests = whole.select("conv", *names).unionByName(folded).withColumnRenamed("conv", conv_col)
    kept = f"{key}, stayed {STAYED}"
    stayed = whole.select("conv", "part", "seq", "stayed").unionByName(paths.mapInArrow(_stayed_in_blocks(schema(kept)), kept))
    block = (F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq")).alias("block")
    repaired = stayed.select(F.col("conv").alias(conv_col), block, F.posexplode("stayed").alias("place", "t")).select(conv_col, "block", "place", F.col("t.edit").alias("edit"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    return digests, repaired


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The conversations with planted faults, chosen by the CRC-32 of `conversation:turn` modulo 20: 0 drops the turn, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it a user's. Nulls count as one space in all but the conversation and turn that are returned."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space(conv_col), F.lit(":"), space(turn_col)), "UTF-8")) % 20
    rows = turns.select(F.col(conv_col), F.col(turn_col), space(role_col).alias(role_col), space(text_col).alias(text_col), fault.alias("_fault"))
    return (
        rows.filter("_fault <> 0")
        .withColumn(text_col, F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col)))
        .withColumn(role_col, F.when(F.col("_fault") == 4, "user").otherwise(F.col(role_col)))
        .select(conv_col, turn_col, role_col, text_col, F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .drop("_copy")
    )


def digests_of_all(turns: DataFrame, original: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """repair_conversations' digests for every conversation of `original`; one without turns has zeros, an empty audit and the empty text's hash."""
    found, _ = repair_conversations(turns, conv_col)
    every = original.select(F.col(conv_col).alias("_conv")).distinct()
    joined = every.join(found, F.col("_conv").eqNullSafe(F.col(conv_col)), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        F.col("_conv").alias(conv_col), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
