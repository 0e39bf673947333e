"""Prefix trie of conversations by range minima over sorted LCPs.

A conversation is the path of its turns' digests (128 bits of role and text).
Distinct paths are sorted; ``lcp[i]`` is the number of leading turns that rows
i - 1 and i share.  A sparse table holds the minima of all runs of 2^k LCPs,
and every candidate prefix (row, depth) finds how far its members reach to the
left and to the right by its own two binary searches over that table, with no
stack and no order between candidates.  A candidate that starts its interval is
a node; nodes in (row, depth) order are in preorder, so what a subtree sums is
a difference of running sums.

At scale the sorted paths are cut into blocks by a range partitioning (paths are
distinct, so none is hot).  A node whose interval touches neither end of its
block is final there.  Open nodes are prefixes of the block's first or last
path, so these two rows go on to the next round with what hangs under their
prefixes, until one block is left.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import record_batch, shipped, small, stage

#: Hexadecimal digits of a turn's digest.
DIGEST = 32
#: Turns, and at least rows, of a block.
BLOCK_TURNS = 250_000
BLOCK_LEAST_ROWS = 16
#: Most turns that a conversation takes over from the head of its group.
GROUP, HEADS = 5, 9
_FAR = np.iinfo(np.int64).max
_NOTHING = hashlib.sha256(b"").hexdigest()
_HUNG = "depth int, convs long, low long, kids long, leaves long, saved long, ends string"
_SUMS = ("convs", "kids", "leaves", "saved")
_NODE = ("key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string")


class RangeMin:
    """Sparse table: minima of all runs of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minima of values[begin:end], each not empty."""
        k = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), self.levels[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            row = self.levels[level]
            out[at] = np.minimum(row[begin[at]], row[end[at] - (1 << int(level))])
        return out

    def reach_right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Per candidate the largest r with values[at + 1 .. r] all >= depth."""
        at, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            row, step = self.levels[k], 1 << k
            fits = at + step < n
            at[fits & (row[np.where(fits, at + 1, 0)] >= depth)] += step
        return at

    def reach_left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Per candidate the smallest l with values[l + 1 .. at] all >= depth."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            row, step = self.levels[k], 1 << k
            fits = at >= step
            at[fits & (row[np.where(fits, at - step + 1, 0)] >= depth)] -= step
        return at


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for every size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def adjacent_lcp(turns: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Leading turns that each row shares with the row before it."""
    lcp = np.zeros(len(lengths), np.int64)
    lcp[1:] = np.minimum(lengths[1:], lengths[:-1])
    j, row = _ramp(lcp), np.repeat(np.arange(len(lcp)), lcp)
    parted = np.flatnonzero(turns[offsets[row] + j] != turns[offsets[row - 1] + j])
    np.minimum.at(lcp, row[parted], j[parted])
    return lcp


class Block:
    """The trie over sorted distinct paths with what hangs under their prefixes."""

    def __init__(self, paths: pa.StringArray, sizes: pa.ListArray, hung: pa.ListArray):
        data = "".join(paths.to_pylist()).encode()
        self.turns = np.frombuffer(data, f"S{DIGEST}")
        self.lengths = np.asarray(sizes.value_lengths(), np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        table = RangeMin(adjacent_lcp(self.turns, self.offsets, self.lengths))
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        depth = _ramp(self.lengths) + 1
        left, right = table.reach_left(row, depth), table.reach_right(row, depth)
        start = self.offsets[left] + depth - 1
        self.at = np.flatnonzero(start == np.arange(len(start)))          # candidates that start their interval
        number = np.cumsum(left == row) - 1
        self.node_of = number[start]
        self.depth, self.left, self.right = depth[self.at], left[self.at], right[self.at]
        self.end = number[(self.offsets + self.lengths)[self.right] - 1] + 1   # behind the subtree in preorder
        self.parent = np.where(self.depth > 1, self.node_of[self.at - 1], -1)
        self._hang(hung)
        self._sum()

    def _hang(self, hung: pa.ListArray) -> None:
        rows = np.repeat(np.arange(len(self.lengths)), np.asarray(hung.value_lengths(), np.int64))
        flat = hung.flatten()
        node = self.node_of[self.offsets[rows] + flat.field("depth").to_numpy() - 1]
        self.own = {}
        for name in _SUMS:
            self.own[name] = np.zeros(len(self.at), np.int64)
            np.add.at(self.own[name], node, flat.field(name).to_numpy())
        self.own["low"] = np.full(len(self.at), _FAR)
        np.minimum.at(self.own["low"], node, flat.field("low").to_numpy())
        self.ends = np.full(len(self.at), None, object)
        texts = flat.field("ends").to_numpy(zero_copy_only=False)
        given = np.array([t is not None for t in texts], bool)
        self.ends[node[given]] = texts[given]

    def _subtree(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.end] - total[:-1]

    def _sum(self) -> None:
        inner = self.parent >= 0
        self.children = self.own["kids"] + np.bincount(self.parent[inner], minlength=len(self.at))
        self.convs = self._subtree(self.own["convs"])
        self.leaves = self._subtree(self.own["leaves"] + (self.children == 0))
        self.saved = self._subtree(self.own["saved"] + (self.convs - 1) * self.bytes[self.at])
        self.low = RangeMin(self.own["low"]).least(np.arange(len(self.at)), self.end) if len(self.at) else self.own["low"]

    def open_nodes(self) -> np.ndarray:
        return (self.left == 0) | (self.right == len(self.lengths) - 1)

    def keys(self, wanted: np.ndarray) -> list:
        """Chained digests of the wanted nodes, whose parents must be wanted too."""
        out = [None] * len(self.at)
        for i in np.flatnonzero(wanted):
            above = out[self.parent[i]] if self.parent[i] >= 0 else ""
            out[i] = hashlib.sha256(above.encode() + self.turns[self.at[i]]).hexdigest()[:DIGEST]
        return out

    def nodes(self, final: np.ndarray, keys: list, keyed: bool) -> list:
        """Columns of the final nodes.  A parent that is still open is named by its key."""
        pick = np.flatnonzero(final)
        parents = self.parent[pick]
        known = np.array([p >= 0 and bool(final[p]) for p in parents], bool)
        return [[keys[i] if keyed else None for i in pick],
                [None if p < 0 or k else keys[p] for p, k in zip(parents, known, strict=True)],
                self.low[pick], self.depth[pick],
                pa.array(self.low[np.maximum(parents, 0)], pa.int64(), mask=~known),
                self.convs[pick], self.children[pick], self.leaves[pick], self.saved[pick],
                [e if e is not None else _NOTHING for e in self.ends[pick]]]

    def edges(self, opened: np.ndarray) -> list[tuple]:
        """(row, [(depth, convs, low, kids, leaves, saved, ends)]) of the first and the last path: what is known
        to hang directly under each of their prefixes, final subtrees included."""
        mine = {k: v.copy() for k, v in self.own.items()}
        under = np.flatnonzero(~opened & (self.parent >= 0))
        under = under[opened[self.parent[under]]]
        to = self.parent[under]
        for name, total in (("convs", self.convs), ("leaves", self.leaves), ("saved", self.saved)):
            np.add.at(mine[name], to, total[under])
        np.add.at(mine["kids"], to, 1)
        np.minimum.at(mine["low"], to, self.low[under])
        out = []
        for row in sorted({0, len(self.lengths) - 1}):
            held = [int(i) for i in self.node_of[self.offsets[row]:self.offsets[row] + self.lengths[row]]
                    if row == 0 or self.left[i] > 0]
            out.append((row, [(int(self.depth[i]), int(mine["convs"][i]), int(mine["low"][i]), int(mine["kids"][i]),
                               int(mine["leaves"][i]), int(mine["saved"][i]), self.ends[i]) for i in held]))
        return out


def _round(batches, last: bool, keyed: bool, schema: pa.Schema):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    paths, sizes, hung = (table.column(c).combine_chunks() for c in ("path", "sizes", "hung"))
    block = Block(paths, sizes, hung)
    opened = np.zeros(len(block.at), bool) if last else block.open_nodes()
    keys = block.keys(np.ones(len(block.at), bool) if keyed else opened)
    columns = block.nodes(~opened, keys, keyed)
    n = len(columns[0])
    for i in range(0, n, 50_000):
        part = [c[i:i + 50_000] for c in columns]
        yield record_batch(schema, [*part, *([[None] * len(part[0])] * 3)])
    if not last:
        for row, held in block.edges(opened):
            names = ("depth", "convs", "low", "kids", "leaves", "saved", "ends")
            yield record_batch(schema, [*([[None]] * 10), [paths[row].as_py()], [sizes[row].as_py()],
                                        [[dict(zip(names, h, strict=True)) for h in held]]])


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(","))])


def trie(paths: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Nodes of depth 1 and more of distinct ``paths`` (path: the turns' digests
    of ``DIGEST`` characters in a row, not empty; sizes: a number per turn; hung:
    what is at its prefixes), as in ``conversation_trie``; the parents of depth 1
    are null."""
    schema = pa.schema([*_arrow(_NODE), ("path", pa.string()), ("sizes", pa.list_(pa.int64())),
                        ("hung", pa.list_(pa.struct(list(_arrow(_HUNG)))))])
    ddl = f"{_NODE}, path string, sizes array<long>, hung array<struct<{_HUNG.replace(' ', ': ').replace(',:', ',')}>>"
    found, keyed = None, False
    while True:
        size = paths.agg(F.count("*").alias("n"), F.sum(F.size("sizes").cast("long")).alias("turns")).first()
        parts = min(-(-(size.turns or 0) // block_turns), -(-size.n // BLOCK_LEAST_ROWS))
        last = parts <= 1
        sorted_ = (paths.coalesce(1) if last else paths.repartitionByRange(parts, "path")).sortWithinPartitions("path")
        done = stage(sorted_.mapInArrow(partial(_round, last=last, keyed=keyed, schema=schema), ddl), "trie-round")
        nodes = done.where("depth is not null").drop("path", "sizes", "hung")
        found = nodes if found is None else found.unionByName(nodes)
        if last:
            break
        paths, keyed = done.where("path is not null").select("path", "sizes", "hung"), True
    if keyed:
        above = stage(found.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_low")),
                      "trie-open")
        found = found.join(small(above), "parent_key", "left").withColumn(
            "parent_conv_id", F.coalesce("parent_conv_id", "open_low"))
    return found.drop("key", "parent_key", "open_low")


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, path, sizes): each conversation's first h turns are those of
    conversation c - c % group, h = crc32 of c's digits modulo ``heads``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)
    one = F.struct(F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    whole = stage(conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
                  .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "trie-conversations")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    # A head is read by at most 2 * group - 1 conversations, and at most heads - 1 of its turns are.
    first = (whole.where(F.col("conv_id") % group == 0)
             .select(F.col("conv_id").alias("head"), F.slice("turns", 1, heads - 1).alias("first")))
    both = whole.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(first, "head", "left")
    turns = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(whole.schema["turns"].dataType)),
                     F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return both.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.array_join(F.col("turns.digest"), "").alias("path"), F.col("turns.size").alias("sizes"))


def _members(batches, schema: pa.Schema):
    """Rows (path_key, conv_id) in order -> one row per path_key; ids stream through the hash."""
    key, low, n, digest = None, None, 0, None
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, low, n, digest.hexdigest()))
                key, low, n, digest = k, c, 0, hashlib.sha256()
            digest.update(f",{c}".encode() if n else str(c).encode())
            n += 1
        if out:
            yield record_batch(schema, list(zip(*out, strict=True)))
    if key is not None:
        yield record_batch(schema, [[key], [low], [n], [digest.hexdigest()]])


def conversation_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS,
                      block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over its subtree the bytes of last texts that members after
    the first repeat) and ends_sha256.

    Turns are ordered by turn, null first; turns of one number by the digest of
    role and text; repeated rows are turns of their own.  Null roles and texts
    are empty; rows without a conv_id take no part; other columns are ignored.
    An empty table has no conversation and gives no rows, not even a root.  A
    text is hashed where it is read and never leaves its task; a conversation is
    one row of about 40 bytes a turn.  The members of one full path (a group of
    copies) stream through one hash, since ends_sha256 is one hash over them.
    """
    all_ = stage(rebuilt(shipped(conversations), group, heads).withColumn("path_key", F.sha2("path", 256)), "trie-paths")
    schema = _arrow("path_key string, low long, n long, ends string")
    members = stage(all_.select("path_key", "conv_id").repartition("path_key").sortWithinPartitions("path_key", "conv_id")
                    .mapInArrow(partial(_members, schema=schema), "path_key string, low long, n long, ends string"),
                    "trie-members")
    zero = F.lit(0).cast("long")
    ended = F.struct(F.size("sizes").alias("depth"), F.col("n").alias("convs"), F.col("low"), zero.alias("kids"),
                     zero.alias("leaves"), zero.alias("saved"), F.col("ends"))
    distinct = stage(all_.join(members.select("path_key", F.col("low").alias("conv_id"), "low", "n", "ends"),
                               ["path_key", "conv_id"])
                     .select("path", "sizes", F.array(ended).alias("hung")), "trie-distinct")
    nodes = stage(trie(distinct.where("path <> ''"), block_turns), "trie-nodes")

    tops = nodes.where("depth = 1").select(F.col("conv_id").alias("low"), F.col("n_convs").alias("n"), F.lit(1).alias("kid"),
                                           "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    turnless = distinct.where("path = ''").select(
        F.get("hung", F.lit(0))["low"].alias("low"), F.get("hung", F.lit(0))["convs"].alias("n"), F.lit(0).alias("kid"),
        zero.alias("n_leaves"), zero.alias("saved_tokens"), F.get("hung", F.lit(0))["ends"].alias("ends"))
    root = stage(tops.unionByName(turnless).agg(
        F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("kid").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.lit(_NOTHING)).alias("ends_sha256")).where("n_convs is not null"), "trie-root")
    lowest = root.first()
    out = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(lowest.conv_id if lowest else None).cast("long"))
                           .otherwise(F.col("parent_conv_id")))
    root = root.withColumn("depth", zero).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return out.unionByName(root.select(out.columns))
