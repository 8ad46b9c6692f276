"""Conversation structure repair: the cheapest edits that give ``(system? (user assistant)+)?``, found in linear space.

Four states are enough: nothing said yet, a system turn stands, a user turn waits, a reply stands. A turn is kept,
given another role or deleted, and empty turns may be inserted before it; each kind of turn (role initial and fault) is
thus a fixed 4 x 4 table of the cheapest letters from state to state. Hirschberg's divide and conquer finds the edits of
a stretch of turns between two known states: a forward vector of four costs from its begin and a backward vector from
its end meet in the middle, the crossing with the least sum is chosen, and both halves are solved alike. Only vectors
and the letters found are ever held. The forward vector also ranks its states by their least letters; two states never
have equal letters and none's letters begin another's, as each ends with the turn's own letter. So the rank decides which
optimal crossing belongs to the ASCII-least edits.

Turns are cut into blocks (a conversation's turns in one range of the sorted table), so a conversation of any length is
dealt over the cluster: a block's own 4 x 4 table is computed by itself, the same divide and conquer over the blocks of a
conversation gives the states at their ends, and each block is solved between its two states. A block's turns are one
letter each there; texts stay in the table and meet their edits in the end.

Defined results: a null role or text is one space; turns stand by (turn with nulls first, role, text); repeated rows are
turns of their own, counted before they are moved; null ids are one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.storage import stored

# What edits cost, the roles by initial, and white space.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, REPLY = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): REPLY, (REPLY, "u"): USER}
TURN = {START: "u", SYSTEM: "u", USER: "a", REPLY: "u"}  #: what may be inserted, or become of a turn
NEVER = 1 << 60
INITIALS = "sua?"  #: ? is every other initial
SOUND, EMPTY, DOUBLE, CUT_OFF = range(4)  #: faults
END = "z"

Table = tuple[tuple[tuple[int, int], ...], ...]  #: by state before and after: cost, rank of the letters among those from the same state


def kind(initial: int, fault: int) -> str:
    return chr(65 + 4 * fault + initial)


def letters_of_turn(code: str) -> list[dict[int, tuple[int, str]]]:
    """From each state, the cheapest and then least letters into each other state."""
    out = []
    for begin in range(4):
        found: dict[int, tuple[int, str]] = {}

        def add(state: int, cost: int, letters: str, found=found) -> None:
            if (cost, letters) < found.get(state, (NEVER, "")):
                found[state] = (cost, letters)

        state = begin
        for n in range(3):  # three inserted turns and more give nothing that one or two do not
            cost, before = INSERT * n, "I" * n
            if code == END:
                if state in (START, REPLY):
                    add(START, cost, before)
            else:
                fault, initial = divmod(ord(code) - 65, 4)
                add(state, cost + DELETE, before + "D")
                if fault in (SOUND, CUT_OFF):
                    more = TRUNCATED if fault == CUT_OFF else 0
                    if (state, INITIALS[initial]) in AFTER:
                        add(AFTER[state, INITIALS[initial]], cost + more + KEEP, before + "K")
                    add(AFTER[state, TURN[state]], cost + more + REROLE, before + "R")
            state = AFTER[state, TURN[state]]
        out.append(found)
    return out


LETTERS = {code: letters_of_turn(code) for code in [kind(i, f) for i in range(4) for f in range(4)] + [END]}


def ranked(found: list[dict[int, tuple[int, str]]]) -> Table:
    rows = []
    for row in found:
        order = {s: i for i, s in enumerate(sorted(row, key=lambda s: row[s][1]))}
        rows.append(tuple((row[s][0], order[s]) if s in row else (NEVER, 9) for s in range(4)))
    return tuple(rows)


TABLES: dict[str, Table] = {code: ranked(found) for code, found in LETTERS.items()}


def forward(tables: list[Table], vector: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(cost, rank of the least letters) of each state after the tables."""
    for table in tables:
        found = []
        for after in range(4):
            best = (NEVER, 9, 9)
            for before in range(4):
                cost, rank = vector[before]
                if cost < NEVER and table[before][after][0] < NEVER:
                    best = min(best, (cost + table[before][after][0], rank, table[before][after][1]))
            found.append(best)
        order = sorted(set(x[1:] for x in found))
        vector = [(x[0], order.index(x[1:])) if x[0] < NEVER else (NEVER, 9) for x in found]
    return vector


def backward(tables: list[Table], vector: list[int]) -> list[int]:
    """Cost from each state before the tables to the end of them."""
    for table in reversed(tables):
        vector = [min(min(table[s][t][0] + vector[t] for t in range(4)), NEVER) for s in range(4)]
    return vector


def crossings(tables: list[Table], begin: int, end: int) -> list[int]:
    """The state after each table on the cheapest, then least way from ``begin`` to ``end``."""
    if len(tables) == 1:
        return [end]
    half = len(tables) // 2
    ahead = forward(tables[:half], [(0, 0) if s == begin else (NEVER, 9) for s in range(4)])
    behind = backward(tables[half:], [0 if s == end else NEVER for s in range(4)])
    middle = min(range(4), key=lambda s: (min(ahead[s][0] + behind[s], NEVER), ahead[s][1]))
    return crossings(tables[:half], begin, middle) + crossings(tables[half:], middle, end)


def solve(kinds: str, begin: int, end: int) -> tuple[str, ...]:
    """The letters of each turn of a stretch between two states."""
    states = crossings([TABLES[k] for k in kinds], begin, end) if kinds else []
    return tuple(LETTERS[k][a][b][1] for k, a, b in zip(kinds, [begin, *states], states, strict=False))


def summarize(kinds: str) -> tuple[int, ...]:
    """The stretch's own table, as 32 numbers: costs and ranks by state before and after."""
    rows = [forward([TABLES[k] for k in kinds], [(0, 0) if s == begin else (NEVER, 9) for s in range(4)]) for begin in range(4)]
    return tuple(x for row in rows for pair in row for x in pair)


short_solve, short_summarize = lru_cache(100_000)(solve), lru_cache(100_000)(summarize)
SHORT = 32  #: stretches of up to so many turns recur, and are solved once in a process


def solved(kinds: str, begin: int, end: int) -> tuple[str, ...]:
    return (short_solve if len(kinds) <= SHORT else solve)(kinds, begin, end)


def summary(kinds: str) -> tuple[int, ...]:
    return (short_summarize if len(kinds) <= SHORT else summarize)(kinds)


def as_table(numbers) -> Table:
    return tuple(tuple((int(numbers[8 * s + 2 * t]), int(numbers[8 * s + 2 * t + 1])) for t in range(4)) for s in range(4))


def plan_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """For each conversation (one row with its blocks' tables in order): states at the ends of its blocks, cost, inserts at the end."""
    begins, ends, costs, tails = [], [], [], []
    for tables in blocks["tables"]:
        own = [as_table(t) for t in tables] + [TABLES[END]]
        states = crossings(own, START, START)
        begins.append([START, *states[:-2]])
        ends.append(states[:-1])
        costs.append(forward(own, [(0, 0)] + [(NEVER, 9)] * 3)[START][0])
        tails.append(LETTERS[END][states[-2]][START][1])
    return blocks.drop(columns="tables").assign(begins=begins, ends=ends, cost=costs, tail=tails)


def edits_of(kinds: str, begin: int, end: int) -> tuple[list[str], list[list[str]], list[str | None]]:
    """For each turn of a stretch: its letters, the roles inserted before it, and its role (None: deleted, '': its own)."""
    letters, inserted, roles, state = solved(kinds, begin, end), [], [], begin
    for code, own in zip(kinds, letters, strict=True):
        new = []
        for letter in own:
            if letter == "I":
                new.append(ROLES[TURN[state]])
                state = AFTER[state, TURN[state]]
            elif letter == "R":
                roles.append(ROLES[TURN[state]])
                state = AFTER[state, TURN[state]]
            elif letter == "K":
                roles.append("")
                state = AFTER[state, INITIALS[(ord(code) - 65) % 4]]
            else:
                roles.append(None)
        inserted.append(new)
    return list(letters), inserted, roles


def conversation_key(conv: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def sorted_turns(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with their number of copies, in order: ``at`` grows with (conversation, turn, role, text)."""
    space = F.lit(" ")
    named = rows.select(
        conversation_key(F.col(key)).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    counted = named.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    order = ["conv", "turn", "role", "text"]
    last = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    fault = F.when(last == "", EMPTY).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    laid = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(laid.select(*order, "copies", fault.alias("fault"), F.monotonically_increasing_id().alias("at")), "repair-turns")


def kinds_of(turns: DataFrame) -> DataFrame:
    """(conv, block, at, kinds): a letter for each copy of each turn; texts are told apart by a hash of 256 bits."""
    narrow = turns.select("conv", "at", "copies", "fault", F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("said"), F.substring("role", 1, 1).alias("initial"))
    first = narrow.groupBy("conv", "said").agg(F.min("at").alias("first"))
    initial = F.instr(F.lit("sua"), F.col("initial")) - 1
    initial = F.when((F.col("initial") == "") | (initial < 0), 3).otherwise(initial)
    again = F.when(F.col("fault") == EMPTY, EMPTY).otherwise(DOUBLE)
    own = F.when(F.col("at") > F.col("first"), again).otherwise(F.col("fault"))

    def code(fault: Column) -> Column:
        return F.char(F.lit(65) + 4 * fault + initial)

    return narrow.join(first, ["conv", "said"]).select(
        "conv", F.shiftright("at", 33).alias("block"), "at",
        F.concat(code(own), F.repeat(code(again), F.col("copies").cast("int") - 1)).alias("kinds"),
    )


EDITS = "conv string, at long, letters string, inserted array<string>, role string"


def find_edits(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits of each turn, facts of each block and the plan of each conversation."""
    kinds = F.array_sort(F.collect_list(F.struct("at", "kinds")))
    blocks = stored(kinds_of(turns).groupBy("conv", "block").agg(kinds.alias("turns")), "repair-blocks")

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(table=[list(summary(k)) for k in frame["kinds"]])

    joined = F.array_join("turns.kinds", "").alias("kinds")
    summed = blocks.select("conv", "block", joined).mapInPandas(tables, "conv string, block long, kinds string, table array<long>")
    by_block = F.array_sort(F.collect_list(F.struct("block", "table")))
    gathered = summed.groupBy("conv").agg(by_block.alias("b")).select("conv", F.col("b.block").alias("blocks"), F.col("b.table").alias("tables"))

    def plans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield plan_blocks(frame)

    planned = stored(
        gathered.mapInPandas(plans, "conv string, blocks array<long>, begins array<int>, ends array<int>, cost long, tail string"), "repair-plans"
    )
    states = planned.select("conv", F.explode(F.arrays_zip("blocks", "begins", "ends")).alias("s")).select("conv", "s.blocks", "s.begins", "s.ends")

    def edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for conv, turns_, begin, end in zip(frame["conv"], frame["turns"], frame["begins"], frame["ends"], strict=True):
                letters, inserted, roles = edits_of("".join(t["kinds"] for t in turns_), int(begin), int(end))
                i = 0
                for t in turns_:  # copies of a turn are always deleted, and an insert before a deleted turn is never least
                    n = len(t["kinds"])
                    rows.append((conv, t["at"], "".join(letters[i : i + n]), sum(inserted[i : i + n], []), roles[i]))
                    i += n
            yield pd.DataFrame(rows, columns=["conv", "at", "letters", "inserted", "role"])

    solved_rows = blocks.withColumnRenamed("block", "blocks").join(states, ["conv", "blocks"]).select("conv", "turns", "begins", "ends")
    return solved_rows.mapInPandas(edits, EDITS), blocks.select("conv", "block", joined), planned


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The repaired turns (conv, at, place, role, text), by (at, place) in order, and a report for each conversation.

    The report has conv, gaps, blank, duplicate, truncated, illegal, cost and audit. ``conv`` is ``conversation_key``.
    """
    turns = sorted_turns(rows, key, turn, role, text)
    found, blocks, planned = find_edits(turns)
    found = stored(found, "repair-edits")
    own = F.when(F.col("edit.role").isNotNull(), F.struct(F.coalesce(F.nullif("edit.role", F.lit("")), "turns.role").alias("role"), F.col("turns.text").alias("text")))
    new = F.transform("edit.inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    lines = F.concat(new, F.filter(F.array(own), lambda x: x.isNotNull()))
    kept = found.where(F.col("role").isNotNull() | (F.size("inserted") > 0))
    fixed = turns.alias("turns").join(kept.alias("edit"), ["conv", "at"]).select("conv", "at", F.posexplode(lines).alias("place", "line"))
    after = planned.where("tail <> ''").select("conv", F.lit((1 << 63) - 1).alias("at"), F.posexplode(inserted_after()).alias("place", "line"))
    repaired = fixed.unionByName(after).select("conv", "at", "place", "line.role", "line.text")
    return repaired, report(turns, blocks, planned, found)


def inserted_after() -> Column:
    """Turns inserted behind the last one: they always end with a reply."""
    roles = F.when(F.col("tail") == "I", F.array(F.lit("assistant"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    return F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))


def report(turns: DataFrame, blocks: DataFrame, planned: DataFrame, found: DataFrame) -> DataFrame:
    """Faults, cost and letters of each conversation; a block sends its counts and its first and last initial."""
    codes = F.col("kinds")
    legal = [kind(0, f) + kind(1, g) for f in range(4) for g in range(4)] + [kind(a, f) + kind(b, g) for a, b in ((1, 2), (2, 1)) for f in range(4) for g in range(4)]

    def count(chars: str) -> Column:
        return (F.length(codes) - F.length(F.regexp_replace(codes, f"[{chars}]", ""))).cast("long")

    pairs = F.transform(F.sequence(F.lit(1), F.length(codes) - 1), lambda i: F.substring(codes, i, F.lit(2)))
    wrong = F.when(F.length(codes) < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin(legal))))
    facts = blocks.select(
        "conv", "block", wrong.cast("long").alias("illegal"), F.substring(codes, 1, 1).alias("head"), F.substring(codes, -1, 1).alias("tail_kind"),
        *[count("".join(kind(i, f) for i in range(4))).alias(n) for n, f in (("blank", EMPTY), ("duplicate", DOUBLE), ("truncated", CUT_OFF))],
    )
    ends = F.array_sort(F.collect_list(F.struct("block", "head", "tail_kind")))
    sums = facts.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], ends.alias("ends"))
    meets = F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends")), lambda a, b: F.concat(a["tail_kind"], b["head"]))
    between = F.when(F.size("ends") < 2, 0).otherwise(F.size(F.filter(meets, lambda p: ~p.isin(legal))))
    numbers = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    letters = F.array_sort(F.collect_list(F.struct("at", "letters")))
    audits = found.groupBy("conv").agg(F.array_join(F.transform(letters, lambda x: x["letters"]), "").alias("letters"))
    return (
        planned.select("conv", "cost", "tail").join(sums, "conv").join(numbers, "conv").join(audits, "conv")
        .select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
                (F.col("illegal") + between).alias("illegal"), "cost", F.concat("letters", "tail").alias("audit"))
    )


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): hash of the repaired ``role:text``, joined by line feeds.

    A hash of one text needs its lines in order, so they pass through one task, one line at a time; nothing is gathered.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, done = None, None, []

        def batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["conv", "repaired_sha256"])

        for some in batches:
            for conv, line in zip(some.column("conv").to_pylist(), some.column("line").to_pylist(), strict=True):
                if conv != current:
                    if sha is not None:
                        done.append((current, sha.hexdigest()))
                    current, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode())
            if len(done) > 10_000:
                yield batch(done)
                done = []
        if sha is not None:
            done.append((current, sha.hexdigest()))
        if done:
            yield batch(done)

    lines = repaired.select("conv", "at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "at", "place").select("conv", "line").mapInArrow(stream, "conv string, repaired_sha256 string")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The contract's damage: (key, turn, role, text) with rows dropped, emptied, cut off, repeated or given to the user."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    hit = F.crc32(named) % 20
    said, by = F.coalesce(F.col(text).cast("string"), space), F.coalesce(F.col(role).cast("string"), space)
    marks = rows.select(F.col(key).alias(key), F.col(turn).alias(turn), by.alias(role), said.alias(text), hit.alias("_hit")).where("_hit <> 0")
    changed = marks.select(
        key, turn, F.when(F.col("_hit") == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)).alias(text),
        F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return changed.drop("_copy")


def repair_report(rows: DataFrame, damaged: DataFrame, key: str = "conv_id") -> DataFrame:
    """The contract's row for every conversation of ``rows``, also those without a damaged turn left."""
    repaired, facts = repair(damaged, key=key)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    ids = rows.select(F.col(key).alias("conv_id")).distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(facts, "conv", "left").join(digests(repaired), "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
