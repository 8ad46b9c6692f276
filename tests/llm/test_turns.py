"""Turn repair and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillstone.llm import prefix_trie, turn_repair
from quillstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
STATES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """(cost, letters) by keeping the best letters of every state; letters that end with a turn never begin others."""

    def with_inserts(best):
        out, edge = dict(best), best
        for _ in range(3):
            new = {}
            for s, (cost, letters) in edge.items():
                x = (cost + 5, letters + "I")
                if x < out.get(NEXT[s], (10**9,)):
                    out[NEXT[s]] = new[NEXT[s]] = x
            edge = new
        return out

    best = {"": (0, "")}
    for initial, fault in turns:
        now = {}

        def add(s, x, now=now):
            if x < now.get(s, (10**9,)):
                now[s] = x

        sources = [(s, c + 5 * k, a + "I" * k) for s0, (c, a) in best.items() for k, s in enumerate(chain(s0))]
        for s, cost, letters in sources:
            add(s, (cost + 2, letters + "D"))
            if fault in ("", "truncated"):
                cost += 5 * (fault == "truncated")
                if (s, initial) in STATES:
                    add(STATES[s, initial], (cost, letters + "K"))
                add(NEXT[s], (cost + 1, letters + "R"))
        best = now
    ends = with_inserts(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def chain(s):
    return [s, NEXT[s], NEXT[NEXT[s]]]


def every_way(turns):
    """(cost, letters) among all letters with up to two inserts before each turn and at the end."""
    found = []

    def go(i, s, cost, letters):
        if cost > 2 * len(turns):
            return
        for k, state in enumerate(chain(s)):
            c, a = cost + 5 * k, letters + "I" * k
            if i == len(turns):
                if state in ("", "a"):
                    found.append((c, a))
                continue
            initial, fault = turns[i]
            go(i + 1, state, c + 2, a + "D")
            if fault in ("", "truncated"):
                c += 5 * (fault == "truncated")
                if (state, initial) in STATES:
                    go(i + 1, STATES[state, initial], c, a + "K")
                go(i + 1, NEXT[state], c + 1, a + "R")

    go(0, "", 0, "")
    return min(found)


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        kept = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role[:1] if role[:1] in set("sua") else "?", fault))
    return out


def damaged(rows):
    """Turns of each conversation after the damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        own = out.setdefault(conv, [])
        if hit == 1:
            text = ""
        elif hit == 2:
            text = re.sub("[.!?]", "", text)
        elif hit == 4:
            role = "user"
        if hit:
            own.extend([((turn is not None, turn or 0), role, text)] * (2 if hit == 3 else 1))
    return {c: sorted(v) for c, v in out.items()}


def repaired(turns, letters):
    lines, state, i = [], "", 0
    for letter in letters:
        if letter == "D":
            i += 1
            continue
        role = turns[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[NEXT[state]]
        lines.append(f"{role}:{'' if letter == 'I' else turns[i][2]}")
        i += letter != "I"
        state = STATES[state, role[0]]
    return "\n".join(lines)


def expected_reports(rows):
    out = []
    for conv, turns in damaged(rows).items():
        kinds = faults(turns)
        numbers = [t[1] for t, _, _ in turns if t[0]]
        cost, letters = cheapest(kinds)
        counts = [sum(f == n for _, f in kinds) for n in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *counts, illegal, cost, letters, hashlib.sha256(repaired(turns, letters).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(seed=1):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", "  \n", None, "é. ", "x ", "long " * 4000 + "."]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c - 20, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "User", "tool"]), rng.choice(texts)))
    rows += [rows[3], rows[3], (None, 0, "user", "Hi."), (None, None, "assistant", "Ok.")]
    rows += [(900, t, "user", "Same words here.") for t in range(2000)] + [(901, 5, "user", "Copy.")] * 1500
    rows += [(902, t, ("user", "assistant")[rng.random() < 0.5], f"{t}.") for t in range(3000)]
    rng.shuffle(rows)
    return rows


def test_hirschberg_is_least_among_all_ways():
    rng = random.Random(1)
    kinds = ["", "blank", "duplicate", "truncated"]
    for n in range(700):
        turns = [(rng.choice("sua?" if rng.random() < 0.3 else "ua"), rng.choice(["", "", "", *kinds])) for _ in range(rng.randint(0, 6) if n < 350 else rng.randint(1, 60))]
        code = "".join(turn_repair.kind("sua?".index(i), kinds.index(f)) for i, f in turns)
        tables = [turn_repair.TABLES[k] for k in code + turn_repair.END]
        states = [0, *turn_repair.crossings(tables, 0, 0)]
        letters = "".join(turn_repair.LETTERS[k][a][b][1] for k, a, b in zip(code + turn_repair.END, states, states[1:], strict=False))
        cost = turn_repair.forward(tables, [(0, 0)] + [(turn_repair.NEVER, 9)] * 3)[0][0]
        assert (cost, letters) == (every_way(turns) if n < 350 else cheapest(turns))
        cuts = [0, *sorted(rng.sample(range(1, len(turns)), min(3, len(turns) - 1))), len(turns)] if turns else []
        blocks = [code[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        if blocks:  # blocks solved by themselves give the same letters
            ends = turn_repair.crossings([turn_repair.as_table(turn_repair.summary(b)) for b in blocks] + [turn_repair.TABLES[turn_repair.END]], 0, 0)
            parts = ["".join(turn_repair.solved(b, x, y)) for b, x, y in zip(blocks, [0, *ends], ends, strict=False)]
            assert "".join(parts) + turn_repair.LETTERS[turn_repair.END][ends[-2]][0][1] == letters


@pytest.mark.parametrize("parts", [3, 40])
def test_repair_of_odd_rows(spark, parts):
    """Nulls, blanks, ties, copies, a long conversation over several blocks, extra columns."""
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS + ", at int, conv string, copies string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in turn_repair.repair_report(frame, turn_repair.damage(frame)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == expected_reports(rows)


def test_repair_query_and_turns(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_hirschberg_repair"](spark, SF).collect()), key=str) == expected_reports(rows)
    fixed, _ = turn_repair.repair(spark.createDataFrame([(1, 0, "assistant", "Hm."), (1, 1, "user", "A?"), (1, 2, "user", "A?")], TURNS))
    assert [(r.role, r.text) for r in fixed.orderBy("at", "place").collect()] == [("user", "Hm."), ("assistant", "A?")]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_report(none, turn_repair.damage(none)).count() == 0
    gone = spark.createDataFrame([(c, t, "user", "x.") for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0], TURNS)
    out = turn_repair.repair_report(gone, turn_repair.damage(gone)).collect()
    assert out and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in out)


def trie_of(rows, rebuilt=True):
    """Nodes by plain dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def order(t):
        return (*t[:3], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()[:32])

    own = {c: [t[2:] for t in sorted(v, key=order)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        paths[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    members, children = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [sums[k] for k in children.get(node, [])]
        sums[node] = (saved + sum(b[0] for b in below), sum(b[1] for b in below) or 1)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node))))
        above = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), above, len(convs), len(children.get(node, [])), sums[node][1], sums[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_parentheses():
    rng = random.Random(3)
    for _ in range(150):
        bits, depth, left = [], 0, rng.randint(1, 500)
        while left or depth:
            up = bool(left) and (depth == 0 or rng.random() < 0.55)
            bits.append(int(up))
            depth, left = depth + (1 if up else -1), left - up
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = np.flatnonzero(np.array(bits))
        assert prefix_trie.Parentheses(np.array(bits, np.int8)).find_close(opens, 17).tolist() == [close[i] for i in opens]


def odd_conversations(seed):
    """Shared beginnings, one conversation copied often, ties, nulls, a long one."""
    rng = random.Random(seed)
    rows = []
    for c in range(-20, 240):
        alike = rng.random() < 0.4
        if rng.random() < 0.9:
            for t in range(rng.randint(1, 14)):
                said = "x" if alike else rng.choice(["a", "é", "", None])
                rows.append((c, None if rng.random() < 0.03 else t, "user" if alike else rng.choice(["user", "assistant", None]), said))
    rows += [(1000 + c, t, "user", "same") for c in range(300) for t in range(3)] + [(2000, t, "user", str(t)) for t in range(4000)]
    rows += [(None, 0, "user", "q"), (7, 1, "user", "z"), (7, 1, "user", "z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie_of_odd_rows(spark, seed, rebuilt):
    rows = odd_conversations(seed)
    frame = spark.createDataFrame([(*r, 1, b"x", "y") for r in rows], TURNS + ", depth int, path binary, hash string").repartition(5)
    got = sorted((tuple(r) for r in prefix_trie.conversation_trie(frame, rebuilt=rebuilt).collect()), key=str)
    assert got == trie_of(rows, rebuilt)


def test_trie_query_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_parentheses_trie"](spark, SF).collect()), key=str) == trie_of(rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS), rebuilt=True).count() == 0
