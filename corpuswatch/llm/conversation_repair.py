"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

Roles are the tokens of a small grammar (``GRAMMAR``), from which LR item sets are built. A conversation's rows are read in turn; each may be
kept, given another role or deleted, and empty turns may be inserted before it. All edits are followed at once on a
graph-structured stack: cells (LR state, cell below) are shared, and of the ways that end in equal stacks only the one of least
(cost, audit) goes on, where the audit is the string of edits. What is left after a row is its frontier: one entry for each stack, in
the order of their audits. Costs in a frontier are relative, so few frontiers differ, and each step from one is worked out once.

Conversations of any length are spread: rows are sorted by range, cut into blocks of at most 4,096, and each block is parsed on its
own from every stack that may stand before it. A conversation's blocks are then joined by their costs alone, and each block
writes the edits of its part of the best way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm.tables import stored

#: A conversation is empty, or pairs of a user and an assistant turn, after a system turn if there is one.
GRAMMAR = (("chat", ()), ("chat", ("pairs",)), ("chat", ("s", "pairs")), ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a")))
END = "$"
#: Names of the roles that an edit may give.
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What one stack can gain on another from any row on, at most: a system turn that it may keep, and a pair to insert.
SLACK = DELETE + 2 * INSERT
BLOCK_BITS = 12
_NAMES = {name for name, _ in GRAMMAR}

Stack = int
Frontier = tuple[tuple[Stack, int], ...]


def _item_sets() -> tuple[list[frozenset], list[dict[str, int]]]:
    """LR(0) item sets (production, place of the dot) and their transitions."""

    def closed(items: set) -> frozenset:
        todo = list(items)
        while todo:
            production, dot = todo.pop()
            body = GRAMMAR[production][1]
            for k, (name, _) in enumerate(GRAMMAR):
                if dot < len(body) and body[dot] == name and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        return frozenset(items)

    states, moves = [closed({(k, 0) for k, (name, _) in enumerate(GRAMMAR) if name == GRAMMAR[0][0]})], []
    for state in states:  # grows as it is read
        row: dict[str, int] = {}
        for symbol in sorted({GRAMMAR[k][1][dot] for k, dot in state if dot < len(GRAMMAR[k][1])}):
            target = closed({(k, dot + 1) for k, dot in state if GRAMMAR[k][1][dot : dot + 1] == (symbol,)})
            if target not in states:
                states.append(target)
            row[symbol] = states.index(target)
        moves.append(row)
    return states, moves


def _follows() -> dict[str, set[str]]:
    """Tokens that may come after each name. No body but the first is empty, so a first token is that of the first symbol."""
    first = {name: set() for name in _NAMES}
    follow = {name: {END} if name == GRAMMAR[0][0] else set() for name in _NAMES}
    before = None
    while before != (before := str((sorted(map(sorted, first.values())), sorted(map(sorted, follow.values()))))):
        for name, body in GRAMMAR:
            for here, after in zip(body, [*body[1:], None], strict=False):
                if here in _NAMES:
                    follow[here] |= follow[name] if after is None else first.get(after, {after})
            if body:
                first[name] |= first.get(body[0], {body[0]})
    return follow


STATES, MOVES = _item_sets()
FOLLOW = _follows()
COMPLETE = [[k for k, dot in state if dot == len(GRAMMAR[k][1])] for state in STATES]
#: Cells of the graph-structured stack: (LR state, cell below). Cell 0 is the bottom.
CELLS: list[tuple[int, Stack]] = [(0, -1)]
_CELL_OF = {CELLS[0]: 0}


def _push(below: Stack, state: int) -> Stack:
    cell = (state, below)
    if cell not in _CELL_OF:
        _CELL_OF[cell] = len(CELLS)
        CELLS.append(cell)
    return _CELL_OF[cell]


def _reduced(stack: Stack, token: str) -> set[Stack | None]:
    """The stack and all that reductions before ``token`` make of it; None: the whole chat was read."""
    out: set[Stack | None] = set()
    todo = [stack]
    while todo:
        here = todo.pop()
        if here in out:
            continue
        out.add(here)
        for k in COMPLETE[CELLS[here][0]]:
            name, body = GRAMMAR[k]
            if token in FOLLOW[name]:
                base = here
                for _ in body:
                    base = CELLS[base][1]
                if name == GRAMMAR[0][0] and base == 0:
                    out.add(None)
                else:
                    todo.append(_push(base, MOVES[CELLS[base][0]][name]))
    return out


def _settled(stack: Stack) -> Stack:
    """Reductions that need no look at the next token: of states with nothing else to do."""
    while len(STATES[CELLS[stack][0]]) == 1 and COMPLETE[CELLS[stack][0]]:
        name, body = GRAMMAR[COMPLETE[CELLS[stack][0]][0]]
        base = stack
        for _ in body:
            base = CELLS[base][1]
        if name == GRAMMAR[0][0]:
            break
        stack = _push(base, MOVES[CELLS[base][0]][name])
    return stack


@lru_cache(maxsize=None)
def shifted(stack: Stack, token: str) -> tuple[Stack, ...]:
    """The stacks after one more token."""
    found = (here for here in _reduced(stack, token) if here is not None)
    return tuple(sorted(_settled(_push(here, MOVES[CELLS[here][0]][token])) for here in found if token in MOVES[CELLS[here][0]]))


@lru_cache(maxsize=None)
def accepted(stack: Stack) -> bool:
    return None in _reduced(stack, END)


@lru_cache(maxsize=None)
def _inserted(stack: Stack) -> tuple[tuple[Stack, str], ...]:
    """Stacks that insertions reach, each with the fewest inserted roles (least in order)."""
    found = {stack: ""}
    ring = [stack]
    while ring:
        ahead: dict[Stack, str] = {}
        for here in ring:
            for token in ROLES:
                for there in shifted(here, token):
                    if there not in found:
                        ahead[there] = min(ahead.get(there, found[here] + token), found[here] + token)
        found |= ahead
        ring = list(ahead)
    return tuple(found.items())


def _all_stacks() -> tuple[Stack, ...]:
    found = [0]
    for stack in found:  # grows as it is read
        found += sorted({there for token in ("s", *ROLES) for there in shifted(stack, token)} - set(found))
    return tuple(found)


#: Every stack that stands between two rows: few, since the grammar nests to a fixed depth.
STACKS = _all_stacks()


@lru_cache(maxsize=200_000)
def advanced(frontier: Frontier, row: str) -> tuple[int, Frontier, tuple[tuple[int, str, str], ...]]:
    """One row read: cost that all entries share, the next frontier, and each entry's (entry before, audit, roles).

    ``row``: ``x`` must be deleted; else the role's initial (``o``: another), as a capital if the text is truncated. Audits of
    a frontier end in the edit of the same row, so none begins another, and what comes later never changes their order.
    """
    best: dict[Stack, tuple[int, int, str, str]] = {}
    initial, extra = row.lower(), TRUNCATED if row.isupper() else 0
    for rank, (stack, cost) in enumerate(frontier):
        for there, roles in _inserted(stack):
            before, audit = cost + INSERT * len(roles), "I" * len(roles)
            ways = [(there, before + DELETE, "D", "-")]
            if row != "x":
                ways += [(s, before + KEEP + extra, "K", initial) for s in shifted(there, initial)]
                ways += [(s, before + REROLE + extra, "R", token) for token in ROLES if token != initial for s in shifted(there, token)]
            for s, total, edit, token in ways:
                way = (total, rank, audit + edit, roles + token)
                if s not in best or way < best[s]:
                    best[s] = way
    base = min(way[0] for way in best.values())
    rest = sorted(((way[1:], way[0] - base, s) for s, way in best.items() if way[0] - base <= SLACK))
    return base, tuple((s, cost) for _, cost, s in rest), tuple(way for way, _, _ in rest)


def parsed(rows: str, start: Stack = 0) -> tuple[int, Frontier, list]:
    """All rows read from one stack: shared cost, last frontier, and the way back, row by row."""
    cost, frontier, back = 0, ((start, 0),), []
    for row in rows:
        more, frontier, ways = advanced(frontier, row)
        cost += more
        back.append(ways)
    return cost, frontier, back


def traced(back: list, entry: int) -> tuple[list[str], list[str]]:
    """Audit and roles of each row on the way to an entry of the last frontier."""
    audits, roles = [], []
    for ways in reversed(back):
        entry, audit, given = ways[entry]
        audits.append(audit)
        roles.append(given)
    return audits[::-1], roles[::-1]


def _finished(entries: list[tuple[Stack, int]]) -> tuple[int, int, str]:
    """Least (cost, entry, roles inserted at the end) by which an entry becomes a whole conversation."""
    ways = [(cost + INSERT * len(roles), rank, roles) for rank, (stack, cost) in enumerate(entries) for there, roles in _inserted(stack) if accepted(there)]
    return min(ways, key=lambda w: (w[0], w[1], len(w[2]), w[2]))


def _block_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and each stack before it: the stacks after it, costs, and the order of their audits."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64())]))
    for batch in batches:
        out = []
        for rows, leads in zip(batch.column("rows").to_pylist(), batch.column("leads").to_pylist(), strict=True):
            ways = []
            for start in (0,) if leads else STACKS:
                cost, frontier, _ = parsed(rows, start)
                ways += [{"start": start, "stop": stack, "cost": cost + more} for stack, more in frontier]
            out.append(ways)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(out, kind)], ["conv", "block", "ways"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's blocks in turn: its least cost, and the stacks before and after each block on the way."""
    kind = pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("tail", pa.string())]))
    for batch in batches:
        costs, chosen = [], []
        for blocks in batch.column("blocks").to_pylist():
            entries, back = [(0, 0)], []
            for block in blocks:
                ranked: dict[int, list] = {}
                for order, way in enumerate(block["ways"]):
                    ranked.setdefault(way["start"], []).append((order, way))
                best: dict[Stack, tuple] = {}
                for rank, (stack, cost) in enumerate(entries):
                    for order, way in ranked[stack]:
                        reached = (cost + way["cost"], rank, order)
                        best[way["stop"]] = min(best.get(way["stop"], reached), reached)
                rest = sorted((rank, order, cost, stop) for stop, (cost, rank, order) in best.items())
                back.append((entries, rest))
                entries = [(stop, cost) for _, _, cost, stop in rest]
            total, entry, tail = _finished(entries)
            way = []
            for k in range(len(blocks) - 1, -1, -1):
                before, rest = back[k]
                rank, _, _, stop = rest[entry]
                way.append({"block": blocks[k]["block"], "start": before[rank][0], "stop": stop, "tail": tail if k == len(blocks) - 1 else ""})
                entry = rank
            costs.append(total)
            chosen.append(way)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(costs, pa.int64()), pa.array(chosen, kind)], ["conv", "cost", "way"])


def _block_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each row of a block on the chosen way."""
    for batch in batches:
        ids, audits, roles = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("ids", "rows", "start", "stop", "tail")]
        for at, rows, start, stop, tail in zip(*columns, strict=True):
            _, frontier, back = parsed(rows, start)
            audit, given = traced(back, [stack for stack, _ in frontier].index(stop))
            audit[-1] += "I" * len(tail)
            given[-1] += tail
            ids += at
            audits += audit
            roles += given
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(audits, pa.string()), pa.array(roles, pa.string())], ["id", "audit", "given"])


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(column).cast("string")), F.lit(""))


def faults(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, conv, turn, role, text, id, initial, fault), stored in order: by conversation, turn (nulls first), role, text.

    ``id`` grows in that order. ``fault`` is the first that a row has: blank (nothing but ASCII blanks), duplicate (role and text of an
    earlier row of the conversation), truncated (the last character that is no blank is not one of ``.!?``), else null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = conversations.select("conv_id", _key("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = stored(ordered.orderBy("conv", F.asc_nulls_first("turn"), "role", "text").withColumn("id", F.monotonically_increasing_id()), "turns")
    firsts = rows.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = (
        F.when(blank, "blank").when(F.col("first").isNull(), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    return rows.join(firsts, "id", "left").select(*rows.columns, F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks (conv, block, ids, rows, initials) of at most 4,096 rows of one conversation."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    members = F.sort_array(F.collect_list(F.struct("id", code.alias("code"), "initial")))
    blocks = rows.groupBy("conv", F.shiftright("id", BLOCK_BITS).alias("block")).agg(members.alias("members"))
    return blocks.select("conv", "block", F.col("members.id").alias("ids"), F.array_join("members.code", "").alias("rows"), F.array_join("members.initial", "").alias("initials"))


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of each row, and a report on each conversation, of ``conversations`` (conv_id, turn, role, text).

    Rows (conv_id, conv, turn, role, text, id, fault, audit, given): those of ``faults`` with the edits at each row in order (K keep,
    R rerole, D delete, I insert) and for each the role that stands there afterwards (initial; ``-``: none). Report: one row for each conversation
    that has rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost). Keeping costs 0, another role 2, deleting 3, inserting an
    empty turn 2; a truncated row that stays costs 1 more; blank rows and duplicates are deleted. Of equally cheap repairs the one
    of the least audit is taken. Roles count by their initial; any but s, u and a must be changed or deleted. Null roles and
    texts are empty; null turns come first; rows with a null conv_id are one conversation; rows that repeat are rows of their own. Texts are
    never cut. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(faults(conversations), "faults")
    blocks = stored(_blocks(rows), "blocks")
    leads = blocks.groupBy("conv").agg(F.min("block").alias("block")).withColumn("leads", F.lit(True))
    ways = blocks.join(leads, ["conv", "block"], "left").select("conv", "block", "rows", F.coalesce("leads", F.lit(False)).alias("leads")).mapInArrow(
        _block_ways, "conv string, block long, ways array<struct<start: int, stop: int, cost: long>>"
    )
    gathered = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "ways"))).alias("blocks"))
    chosen = stored(gathered.mapInArrow(_joined, "conv string, cost long, way array<struct<block: long, start: int, stop: int, tail: string>>"), "ways")
    steps = chosen.select("conv", F.inline("way")).join(blocks.select("conv", "block", "ids", "rows"), ["conv", "block"])
    edits = steps.select("ids", "rows", "start", "stop", "tail").mapInArrow(_block_edits, "id long, audit string, given string")
    edited = rows.drop("initial").join(edits, "id")

    pairs = F.expr("size(filter(sequence(1, length(initials) - 1), i -> substring(initials, i, 2) not in ('su', 'ua', 'au')))")
    border = F.struct("block", F.left("initials", F.lit(1)).alias("first"), F.right("initials", F.lit(1)).alias("last"))
    edges = blocks.groupBy("conv").agg(
        F.sum(F.when(F.length("initials") > 1, pairs).otherwise(0)).alias("inside"), F.sort_array(F.collect_list(border)).alias("borders"))
    across = F.expr("size(filter(sequence(1, greatest(size(borders) - 1, 1)), i -> i < size(borders) and concat(borders[i - 1].last, borders[i].first) not in ('su', 'ua', 'au')))")
    illegal = edges.select("conv", (F.col("inside") + across).cast("bigint").alias("illegal"))
    kinds = ("blank", "duplicate", "truncated")
    turns = rows.groupBy("conv", "turn").agg(F.first("conv_id").alias("conv_id"), *[F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in kinds])
    counts = turns.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(k).alias(k) for k in kinds],
    )
    report = counts.join(illegal, "conv").join(chosen.select("conv", "cost"), "conv").select("conv_id", "gaps", *kinds, "illegal", "cost")
    return edited, report


def repaired_turns(edited: DataFrame) -> DataFrame:
    """Rows (conv_id, id, place, role, text, edit) of the repaired conversations, in order of (id, place), from the edits of ``repaired``."""
    places = F.filter(F.sequence(F.lit(1), F.length("audit")), lambda i: F.substring("audit", i, F.lit(1)) != "D")
    placed = edited.withColumn("place", F.explode(places))
    edit, given = F.substring("audit", F.col("place"), F.lit(1)), F.substring("given", F.col("place"), F.lit(1))
    named = F.lit(None).cast("string")
    for initial, name in ROLES.items():
        named = F.when(given == initial, name).otherwise(named)
    return placed.select(
        "conv_id", "id", "place", F.when(edit == "K", F.col("role")).otherwise(named).alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"), edit.alias("edit")
    )


def digests(edited: DataFrame) -> DataFrame:
    """Rows (conv_id, audit, repaired_sha256): all edits of each conversation, and the hash of its repaired ``role:text`` lines.

    A hash is made in order, so a conversation's rows pass one task, as a stream that is sorted on disk; only the audit is held.
    """
    turns = repaired_turns(edited).withColumn("line", F.concat("role", F.lit(":"), "text"))
    lines = turns.select("conv_id", "id", "place", "line", F.lit(None).cast("string").alias("audit"))
    audits = edited.select("conv_id", "id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("line"), "audit")
    stream = lines.unionByName(audits).withColumn("conv", _key("conv_id")).repartition("conv").sortWithinPartitions("conv", "id", "place")
    kind = dict(edited.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audit, sha, begun = None, [], hashlib.sha256(), False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held, pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

        last = None
        for batch in batches:
            ids = batch.column("conv_id")
            for k, (conv, line, edits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv", "line", "audit")), strict=True)):
                if conv != last or held is None:
                    if held is not None:
                        yield out()
                    last, held, audit, sha, begun = conv, ids.slice(k, 1), [], hashlib.sha256(), False
                if edits is not None:
                    audit.append(edits)
                else:
                    sha.update(("\n" if begun else "").encode() + line.encode())
                    begun = True
        if held is not None:
            yield out()

    return stream.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")
