"""Repair of conversations into system?, (user, assistant)+ by lightest derivations.

The rows of a conversation, in order, are edited: Keep costs 0, Rerole to user or assistant 2, Delete 3
(blank and duplicate rows can only be deleted), Insert an empty user or assistant turn 2; a truncated
row that stays adds 1. Of the cheapest sequences of edits that give the form, or nothing at all, the
ASCII-least sequence of initials (D, I, K, R) counts.

Repairs are weighted deductions, popped from an agenda in the order (cost, rows read, initials). An item
says that some rows, entered in one state of the form, can be left in another one. A deduction adds an
edit before an item or joins the items of neighbouring stretches; its value never falls below those of
its parts, and of two values the smaller one stays smaller whatever is added, so an item is final when
it is popped. Rows are numbered by a range partitioning of (conversation, turn, text digest) and cut into
blocks of BLOCK rows, so that the rows of a long conversation are dealt over tasks; a block gives the
items of its pairs of states, and the agenda joins blocks until the goal item is final.

Null roles and texts are one space; null turns come first; null conversation ids are one conversation.
Rows with the same turn are ordered by a digest of role and text; repeated rows are duplicates. An
initial other than s, u or a (or an empty role) can't be kept. Extra columns are left out. An empty table
gives empty results. A conversation's initials are one cell, so it may have some hundred million rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import materialize

#: Rows of a block: 2 to the power of this.
BLOCK_BITS = 10
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the form: nothing so far, after system, after user, after assistant. The form may end in START or PAIR.
START, SYSTEM, ASKED, PAIR = range(4)
#: State before and after a user or an assistant turn.
SPOKEN = ((START, ASKED, "user"), (SYSTEM, ASKED, "user"), (PAIR, ASKED, "user"), (ASKED, PAIR, "assistant"))
#: For each symbol of a row: states that a kept row joins, the cost of truncation, and whether the row may stay.
_KEPT = {"s": ((START, SYSTEM),), "u": tuple(x[:2] for x in SPOKEN if x[2] == "user"), "a": ((ASKED, PAIR),), "o": ()}
SYMBOLS = {k.upper() if cut else k: (joins, TRUNCATED * cut, True) for k, joins in _KEPT.items() for cut in (0, 1)} | {"x": ((), 0, False)}

_WORDED = r"[^\x20\x09-\x0D]"
_ITEMS = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"


class Item(NamedTuple):
    """Rows can be read from state entry to state exit with these edits."""

    entry: int
    exit: int
    cost: int
    audit: str


@lru_cache(2048)
def block_items(symbols: str) -> tuple[Item, ...]:
    """The lightest item of every pair of states for a block of rows, given as one symbol each."""
    n = len(symbols)
    out = []
    for end in range(4):
        agenda = [(0, 0, "", end)]  # cost, rows read (from the last one back), initials, state
        final: dict[tuple[int, int], tuple[int, str]] = {}
        while agenda:
            cost, read, audit, state = heapq.heappop(agenda)
            if (read, state) in final:
                continue
            final[read, state] = cost, audit
            for before, after, _ in SPOKEN:
                if after == state and (read, before) not in final:
                    heapq.heappush(agenda, (cost + INSERT, read, "I" + audit, before))
            if read < n:
                joins, cut, stays = SYMBOLS[symbols[n - 1 - read]]
                heapq.heappush(agenda, (cost + DELETE, read + 1, "D" + audit, state))
                for before, after in joins:
                    if after == state:
                        heapq.heappush(agenda, (cost + KEEP + cut, read + 1, "K" + audit, before))
                for before, after, _ in SPOKEN if stays else ():
                    if after == state:
                        heapq.heappush(agenda, (cost + REROLE + cut, read + 1, "R" + audit, before))
        out += [Item(s, end, *final[n, s]) for s in range(4) if (n, s) in final]
    return tuple(out)


class Suffix:
    """Initials of a block followed by those of a later suffix; ordered as the whole strings are."""

    __slots__ = ("item", "rest")

    def __init__(self, item: Item | None, rest: Suffix | None):
        self.item, self.rest = item, rest

    def __lt__(self, other: Suffix) -> bool:
        a, b, x, y = self, other, "", ""
        while a is not b or x != y:
            while not x and a is not None and a.item is not None:
                x, a = a.item.audit, a.rest
            while not y and b is not None and b.item is not None:
                y, b = b.item.audit, b.rest
            if not x or not y:
                return bool(y)
            k = min(len(x), len(y))
            if x[:k] != y[:k]:
                return x[:k] < y[:k]
            x, y = x[k:], y[k:]
        return False


def joined_items(blocks: list[tuple[Item, ...]]) -> list[Item]:
    """The item of each block in the lightest derivation of the goal: all blocks read, from START to START or PAIR."""
    n, end = len(blocks), Suffix(None, None)
    agenda = [(0, 0, end, START), (0, 0, end, PAIR)]  # cost, blocks read (from the last one back), edits, state
    final = set()
    while True:
        cost, read, edits, state = heapq.heappop(agenda)
        if (read, state) in final:
            continue
        if read == n and state == START:
            break
        final.add((read, state))
        if read < n:
            for item in blocks[n - 1 - read]:
                if item.exit == state:
                    heapq.heappush(agenda, (cost + item.cost, read + 1, Suffix(item, edits), item.entry))
    out = []
    while edits.item is not None:
        out.append(edits.item)
        edits = edits.rest
    return out


def edits_of(symbols: str, item: Item) -> list[tuple[str, int | None, str | None]]:
    """Each edit of an item: its initial, the row that it reads, and the role that it gives."""
    out, row, state = [], 0, item.entry
    for e in item.audit:
        role = None
        if e in "IR":
            state, role = next((after, role) for before, after, role in SPOKEN if before == state)
        elif e == "K":
            state = next(after for before, after in SYMBOLS[symbols[row]][0] if before == state)
        out.append((e, None if e == "I" else row, role))
        row += e != "I"
    return out


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and pos of all rows, written down; pos follows the order of rows, gapless inside a partition."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.withColumn("digest", digest).withColumn("_salt", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "digest", "_salt"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(rows.withColumn("pos", F.monotonically_increasing_id()).drop("_salt"), "turns")


def faulty_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, pos, initial, fault of numbered_turns(): the first that holds of blank, duplicate, truncated, else null.

    Blank: no character besides white space. Duplicate: role and text seen earlier in the conversation.
    Truncated: the last such character is none of .!?
    """
    first = turns.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    cut = F.when(~F.col("text").rlike(_WORDED), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    rows = turns.select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), cut.alias("_cut")).join(first, "pos", "left")
    fault = F.when(F.col("_cut") == "blank", "blank").when(F.col("_first").isNull(), "duplicate").otherwise(F.col("_cut"))
    return rows.select("conv_id", "turn", "pos", "initial", fault.alias("fault"))


def _symbol() -> Column:
    kept = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kept)).otherwise(kept)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au") and len(a) == 1


def _block(rows: pa.Table) -> pa.Table:
    """One block of rows: for each conversation its symbols, the items, and how many neighbours break the form."""
    rows = rows.sort_by("pos").to_pylist()
    out = []
    for conv, turns in groupby(rows, key=lambda r: r["conv_id"]):
        turns = list(turns)
        symbols, initials = "".join(t["symbol"] for t in turns), [t["initial"] for t in turns]
        broken = sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
        items = [i._asdict() for i in block_items(symbols)]
        out.append({"conv_id": conv, "pos": turns[0]["pos"], "symbols": symbols, "first": initials[0], "last": initials[-1], "illegal": broken, "items": items})
    return pa.Table.from_pylist(out, _BLOCK)


_ITEM = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_BLOCK = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("symbols", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("items", _ITEM)])
_EDITS = pa.list_(pa.struct([("edit", pa.string()), ("row", pa.int32()), ("role", pa.string())]))
_PIECE = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("edits", _EDITS)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            yield from batch.slice(k, 1024).to_pylist()


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen item of each block; the blocks of a conversation follow one another."""
    out = []
    for conv, blocks in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        blocks = list(blocks)
        chosen = joined_items([tuple(Item(**i) for i in b["items"]) for b in blocks])
        last = None
        for b, item in zip(blocks, chosen, strict=True):
            edits = [{"edit": e, "row": r, "role": role} for e, r, role in edits_of(b["symbols"], item)]
            broken = b["illegal"] + (last is not None and not _legal(last, b["first"]))
            last = b["last"]
            out.append({"conv_id": conv, "pos": b["pos"], "cost": item.cost, "illegal": broken, "audit": item.audit, "edits": edits})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, _PIECE)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECE)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and a report of the conversations of rows (conv_id, turn, role, text).

    Turns: conv_id, pos and seq (their order), edit (K, R or I), role, text. Report: conv_id, gaps (turns missing between
    the least and the greatest), blank, duplicate, truncated (rows by their first fault), illegal (neighbouring rows
    whose initials are not su, ua or au), cost, audit.
    """
    turns = numbered_turns(rows)
    faults = materialize(faulty_turns(turns), "faults")
    symbols = faults.select("conv_id", "pos", "initial", _symbol().alias("symbol"), F.shiftright("pos", BLOCK_BITS).alias("block"))
    blocks = symbols.groupBy("block").applyInArrow(_block, f"conv_id long, pos long, symbols string, first string, last string, illegal long, items {_ITEMS}")
    pieces = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_join_blocks, "conv_id long, pos long, cost long, illegal long, audit string, edits array<struct<edit:string,row:int,role:string>>")
    pieces = materialize(pieces, "pieces")
    edits = pieces.select("conv_id", F.col("pos").alias("_from"), F.posexplode("edits").alias("seq", "e"))
    edits = edits.select("conv_id", (F.col("_from") + F.col("e.row")).alias("pos"), "_from", "seq", F.col("e.edit").alias("edit"), F.col("e.role").alias("_role"))
    stays = edits.where("edit in ('K', 'R')").join(turns.select("pos", "role", "text"), "pos").select("conv_id", F.col("_from").alias("pos"), "seq", "edit", F.coalesce("_role", "role").alias("role"), "text")
    added = edits.where("edit = 'I'").select("conv_id", F.col("_from").alias("pos"), "seq", "edit", F.col("_role").alias("role"), F.lit("").alias("text"))
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    report = faults.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).alias("gaps"), *[count(f) for f in ("blank", "duplicate", "truncated")])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "audit"))), lambda p: p["audit"])
    whole = pieces.groupBy(F.col("conv_id").alias("_c")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(ordered, "").alias("audit"))
    return stays.unionByName(added), report.join(whole, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 (lowercase hex) of its repaired turns as role:text lines; turns are streamed through the hash, which has to read a conversation from start to end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, lines in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            h, between = sha256(), b""
            for x in lines:
                h.update(between + f"{x['role']}:{x['text']}".encode())
                between = b"\n"
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": h.hexdigest()}], pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "seq").select("conv_id", "role", "text").mapInArrow(work, "conv_id long, repaired_sha256 string")
