"""Conversation prefix trie: who shares which first turns, and how many bytes one copy of them would save.

Conversations become paths of turn hashes (128 bits each), equal paths one row with their number. The paths are
range-partitioned by their bytes; each shard's sorted paths are written as balanced parentheses, a node opening before
its subtree and closing after it. The excess of opened over closed is kept with the minimum and maximum of every block
and a tree of minima over the blocks: ``find_close`` is the first place behind an opening where the excess falls below it,
so it delimits the subtree. Leaf pairs ``()`` are counted by rank, savings and members by cumulative arrays over the
openings, the smallest member by minima over ranges of them.

Only nodes on the first or last path of a shard can be in other shards, too: the spines. They are left out of the shard's
sums and merged by the hash of their path: counts are added, and what spine nodes themselves save is summed along each
spine from its end, once for each node, then added at every spine that passes it. All else is final in its shard.

Texts stay behind: a turn is its hash and its length. Equal conversations are one path, so a group of copies is one row
wherever it is sorted; only the ids of one path's members, which one hash needs in order, pass through one task, one at a
time. A conversation is one row of 20 bytes a turn, as it is one path.

Defined results: turns stand by (turn with nulls first, role, hash of the text); a null role or text is empty; rows
without an id belong to no conversation and are left out; repeated rows are turns of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.storage import stored

WIDTH = 16  #: bytes of a turn's hash
BLOCK = 64  #: places in a block of the excess
SHARD = 200_000  #: turns of a shard's paths, about
NODES = (
    "spine boolean, lane long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
)


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with its excess in blocks and a tree of minima and maxima over the blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        blocks = 1 << max(0, int(np.ceil(np.log2(max(1, -(-len(bits) // BLOCK))))))
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max // 2, np.int32)
        padded[: len(bits)] = self.excess
        self.cells = padded.reshape(blocks, BLOCK)
        self.low, self.high = [self.cells.min(axis=1)], [np.where(self.cells < padded.max(initial=0), self.cells, -1).max(axis=1)]
        while len(self.low[-1]) > 1:
            self.low.append(self.low[-1].reshape(-1, 2).min(axis=1))
            self.high.append(self.high[-1].reshape(-1, 2).max(axis=1))

    def find_close(self, opens: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
        """Where each opening is closed: the first place behind it with a lower excess than its own."""
        out = [self._find(opens[i : i + at_once]) for i in range(0, len(opens), at_once)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _find(self, opens: np.ndarray) -> np.ndarray:
        below = self.excess[opens] - 1
        block, inside = np.divmod(opens, BLOCK)
        place, here = self._first(block, below, inside)
        far = np.flatnonzero(~here)
        if len(far):
            node, level, want = block[far], np.zeros(len(far), np.int64), below[far]
            climbing = np.ones(len(far), bool)
            for up in range(len(self.low)):  # to the nearest subtree on the right that falls as low
                now = np.flatnonzero(climbing)
                right = node[now] + 1
                met = (node[now] % 2 == 0) & (right < len(self.low[up]))
                met[met] = self.low[up][right[met]] <= want[now][met]
                node[now[met]], level[now[met]], climbing[now[met]] = right[met], up, False
                node[now[~met]] //= 2
            for down in range(len(self.low) - 1, 0, -1):  # then to the leftmost block in it that does
                now = np.flatnonzero(level == down)
                left = 2 * node[now]
                node[now] = np.where(self.low[down - 1][left] <= want[now], left, left + 1)
                level[now] = down - 1
            place[far] = self._first(node, want, np.full(len(far), -1))[0]
        return place

    def _first(self, block: np.ndarray, below: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = (self.cells[block] <= below[:, None]) & (np.arange(BLOCK)[None, :] > behind[:, None])
        return block * BLOCK + fits.argmax(axis=1), fits.any(axis=1)

    def leaf_rank(self) -> np.ndarray:
        """Leaf pairs that begin before each place."""
        pair = np.zeros(len(self.bits) + 1, np.int64)
        pair[1:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        return np.cumsum(pair)


def range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Smallest value of each range, by two overlapping ranges of a power of two."""
    out = np.empty(len(start), values.dtype)
    power = np.frexp((stop - start).astype(float))[1] - 1
    table, width = values, 1
    for k in range(int(power.max(initial=0)) + 1):
        mine = np.flatnonzero(power == k)
        out[mine] = np.minimum(table[start[mine]], table[stop[mine] - width])
        if 2 * width <= len(values):
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths share."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    same = np.frombuffer(a, f"V{WIDTH}", n) == np.frombuffer(b, f"V{WIDTH}", n)
    return int(np.argmin(same))


def path_keys(path: bytes) -> list[bytes]:
    """A key for each beginning of a path, the empty one first."""
    grown = hashlib.sha256()
    out = [grown.digest()]
    for i in range(0, len(path), WIDTH):
        grown.update(path[i : i + WIDTH])
        out.append(grown.digest())
    return out


def shard_nodes(shard: int, paths: list[bytes], sizes: list[list[int]], members: np.ndarray, least: np.ndarray, ends: list[str]) -> dict[str, list]:
    """Nodes of a shard's sorted, distinct paths. Spine nodes have two lanes, the first path and the last one."""
    bits: list[int] = []
    depth, size, parent, end_at = [0], [0], [-1], []
    stack, before = [0], b""
    bits.append(1)
    for i, path in enumerate(paths):
        shared = common_turns(before, path) if i else 0
        bits.extend([0] * (len(stack) - 1 - shared))
        del stack[shared + 1 :]
        for d in range(shared, len(path) // WIDTH):
            parent.append(stack[-1])
            stack.append(len(depth))
            depth.append(d + 1)
            size.append(sizes[i][d])
            bits.append(1)
        end_at.append(stack[-1])
        if i == 0:
            left = list(stack)
        before = path
    right = list(stack)
    bits.extend([0] * len(stack))
    tree = Parentheses(np.array(bits, np.int8))
    n = len(depth)
    opens = np.flatnonzero(tree.bits)
    close = tree.find_close(opens)
    stop = np.arange(n) + (close - opens + 1) // 2  # behind the subtree, in order of opening
    spine = np.zeros(n, bool)
    spine[left] = spine[right] = True

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[stop] - total[np.arange(n)]

    own_members, own_least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    own_members[end_at], own_least[end_at] = members, least
    convs = below(own_members)
    smallest = range_minima(own_least, np.arange(n), stop)
    up = np.array(parent)
    children = np.bincount(up[1:][~spine[1:]], minlength=n)  # those on a spine are counted when spines merge
    rank = tree.leaf_rank()
    leaf = (rank[opens + 1] - rank[opens]).astype(bool)
    leaves = rank[close] - rank[opens] - below((leaf & spine).astype(np.int64))
    saved = below(np.where(spine, 0, (convs - 1) * np.array(size, np.int64)))
    ended = [""] * n
    for at, sha in zip(end_at, ends, strict=True):
        ended[at] = sha
    keys = {**dict(zip(left, path_keys(paths[0]), strict=True)), **dict(zip(right, path_keys(paths[-1]), strict=True))}
    out: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}

    def add(i: int, lane: int | None, again: bool) -> None:
        on = lane is not None
        above = int(up[i])
        parent_on = above >= 0 and bool(spine[above])
        row = (
            on, lane, keys.get(i), keys[above] if parent_on else None, None if again else int(smallest[i]), depth[i],
            int(smallest[above]) if above >= 0 and not parent_on else None, 0 if again else int(convs[i]), 0 if again else int(children[i]),
            0 if again else int(leaves[i]), 0 if again else int(saved[i]), size[i], ended[i] or None,
        )
        for c, v in zip(out, row, strict=True):
            out[c].append(v)

    for i in range(n):
        if not spine[i]:
            add(i, None, False)
    for i in left:
        add(i, 2 * shard, False)
    told = set(left)
    for i in right:
        add(i, 2 * shard + 1, i in told)
    return out


def paths_of(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (hash, bytes of text)."""
    by, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)
    order = F.struct(F.col(turn).isNotNull().alias("given"), F.col(turn).cast("long").alias("turn"), by.alias("role"))
    narrow = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), order.alias("order"), F.substring(own, 1, 2 * WIDTH).alias("hash"), F.octet_length(said).alias("bytes")
    )
    sorted_turns = F.sort_array(F.collect_list(F.struct("order", "hash", "bytes")))
    turns = F.transform(sorted_turns, lambda t: F.struct(t["hash"].alias("hash"), t["bytes"].alias("bytes")))
    return narrow.groupBy("conv_id").agg(turns.alias("turns"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % 5, then c's own turns after its first h."""
    heads = conversations.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    asked = conversations.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    empty = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return asked.join(heads, "base", "left").select("conv_id", turns.alias("turns"))


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(path, sizes, members, least, ends_sha256): equal conversations as one row."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), ""))
    flat = stored(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")), "trie-paths")
    named = flat.withColumn("name", F.sha2("path", 256))
    groups = named.groupBy("name").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("members"), F.min("conv_id").alias("least"))
    return groups.join(member_hashes(named.select("name", "conv_id")), "name").select("path", "sizes", "members", "least", "ends_sha256")


def member_hashes(members: DataFrame) -> DataFrame:
    """(name, ends_sha256): hash of each group's ids in order, joined by commas, read as a stream."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, done = None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["name", "ends_sha256"])

        for some in batches:
            for name, conv in zip(some.column("name").to_pylist(), some.column("conv_id").to_pylist(), strict=True):
                if name != current:
                    if sha is not None:
                        done.append((current, sha.hexdigest()))
                    current, sha = name, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            if len(done) > 10_000:
                yield batch()
                done = []
        if sha is not None:
            done.append((current, sha.hexdigest()))
        if done:
            yield batch()

    return members.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(stream, "name string, ends_sha256 string")


def encode_shards(paths: DataFrame) -> DataFrame:
    """Nodes of every shard, spine nodes marked."""

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        columns = {c: [x for f in parts for x in f[c]] for c in ("path", "sizes", "ends_sha256")}
        members, least = (np.concatenate([f[c].to_numpy(np.int64) for f in parts]) for c in ("members", "least"))
        nodes = shard_nodes(TaskContext.get().partitionId(), [bytes(p) for p in columns["path"]], columns["sizes"], members, least, columns["ends_sha256"])
        whole = ("lane", "conv_id", "parent_conv_id")
        for i in range(0, len(nodes["depth"]), 50_000):
            part = {c: v[i : i + 50_000] for c, v in nodes.items()}
            yield pd.DataFrame({c: pd.array(v, "Int64") if c in whole else v for c, v in part.items()})

    turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD))
    return stored(paths.repartitionByRange(shards, "path").sortWithinPartitions("path").mapInPandas(shard, NODES), "trie-nodes")


def merge_spines(nodes: DataFrame) -> DataFrame:
    """Every node once: those of the spines with what all shards know, the others as they are."""
    spines = nodes.where("spine")
    merged = spines.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"), F.min("lane").alias("lane"),
    )
    kids = merged.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    merged = stored(merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))), "trie-spines")
    own = merged.select(
        "key", F.col("lane").alias("of"), ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"), (F.col("n_children") == 0).cast("long").alias("own_leaf")
    )
    counted = spines.select("key", "lane", "depth").join(own, "key")
    along = W.partitionBy("lane").orderBy(F.desc("depth"))
    mine = F.col("lane") == F.col("of")
    summed = counted.select("key", *[F.sum(F.when(mine, F.col(c)).otherwise(0)).over(along).alias(c) for c in ("own_saved", "own_leaf")])
    passed = summed.groupBy("key").agg(F.sum("own_saved").alias("own_saved"), F.sum("own_leaf").alias("own_leaf"))
    whole = merged.join(passed, "key").select(
        "key", "parent_key", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("own_leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own_saved")).alias("saved_tokens"), "ends_sha256",
    )
    every = nodes.where("not spine").select(*whole.columns).unionByName(whole)
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("spine_conv"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(above, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "spine_conv").alias("parent_conv_id"),
        *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the conversations (conv_id, turns of (hash, bytes))."""
    return merge_spines(encode_shards(stored(distinct_paths(conversations), "trie-distinct")))


def conversation_trie(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuilt: bool = False) -> DataFrame:
    """Nodes of the conversations in the rows; ``rebuilt`` joins them with another conversation's first turns before."""
    conversations = paths_of(rows, key, turn, role, text)
    return prefix_trie(rebuild(stored(conversations, "trie-turns")) if rebuilt else conversations)
