"""Prefix trie of conversations: shared prefixes, their subtrees and what storing them once saves.

Every distinct sequence of the first d turns is a node. A node is told by its depth and two 64-bit lanes, the exclusive or
of position-tagged turn hashes, so it is known from running values along a conversation; a long conversation is taken in
chunks. Counts, least members and children are aggregates over nodes.

Sums over subtrees come from balanced parentheses. Stretches of a path where all nodes have the same members are one
chain, so a path is the list of its chains. One path stands for each distinct conversation; paths are range-partitioned, so
those with a common beginning lie together, and cut into shards. A shard writes its trie as a sequence of parentheses. Over
the excess of open ones, a range min-max tree by blocks finds the parenthesis that closes a node; the rank of leaf pairs "()"
between the two counts its leaves, and cumulative arrays give its savings. A chain that several shards hold (the spine
between them) is merged by adding up: a leaf and a chain's own weight are counted in one shard only, that of the least member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passledger.llm.common import cut
from passledger.operators.ranking import ordinal

CHUNK = 4096
NODE = ["depth", "x1", "x2"]


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with a range min-max tree over its excess by blocks."""

    def __init__(self, bits: np.ndarray, block: int = 64) -> None:
        self.bits, self.block = bits, block
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        blocks = -(-len(bits) // block)
        self.leaves = 1 << max(0, int(blocks - 1).bit_length())
        padded = np.full(self.leaves * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.low = np.empty(2 * self.leaves, dtype=np.int64)
        self.low[self.leaves :] = padded.reshape(self.leaves, block).min(axis=1)
        at = self.leaves
        while at > 1:
            self.low[at // 2 : at] = self.low[at : 2 * at].reshape(-1, 2).min(axis=1)
            at //= 2
        self.opened = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.pair = np.append((bits[:-1] == 1) & (bits[1:] == 0), False)

    def rank_pairs(self, counts: np.ndarray) -> np.ndarray:
        """Leaf pairs "()" that begin before each place, where counts (one per opened parenthesis) says which of them are to count."""
        at = np.flatnonzero(self.bits)
        pairs = np.zeros(len(self.bits) + 1, dtype=np.int64)
        pairs[at + 1] = np.where(self.pair[at], counts, 0)
        return np.cumsum(pairs)

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The places that close the parentheses opened at the places `at`: the first ones behind with less excess."""
        want = self.excess[at] - 1
        found = self._in_block(at + 1, want)
        rest = np.flatnonzero(found < 0)
        blocks = self._block_behind((at[rest] + 1) // self.block, want[rest])
        found[rest] = self._in_block(blocks * self.block, want[rest])
        return found

    def _in_block(self, start: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place of the wanted excess from `start` to the end of its block, or -1."""
        found = np.full(len(start), -1)
        end = np.minimum((start // self.block + 1) * self.block, len(self.excess))
        left = np.flatnonzero(start < end)
        for step in range(self.block):
            if len(left) == 0:
                break
            here = start[left] + step
            hit = self.excess[here] == want[left]
            found[left[hit]] = here[hit]
            left = left[~hit & (here + 1 < end[left])]
        return found

    def _block_behind(self, block: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first block behind `block` whose least excess is low enough: up to a sibling on the right that has it, then down."""
        node = block + self.leaves
        climbs = np.ones(len(node), dtype=bool)
        while climbs.any():
            beside = np.where(climbs & (node % 2 == 0), node + 1, 0)
            hit = (beside > 0) & (self.low[beside] <= want)
            node = np.where(hit, beside, np.where(climbs, node // 2, node))
            climbs &= ~hit
        while (inner := node < self.leaves).any():
            left = np.where(inner, node * 2, 0)
            node = np.where(inner, left + (self.low[left] > want), node)
        return node - self.leaves


def shard_sums(paths: list[list[tuple[int, int]]], weights: list[list[int]], leaf: list[bool]) -> dict[str, np.ndarray]:
    """Of each chain of a shard's trie: its key, its leaves, and the savings below it. Paths come in order.

    weights: of each chain of a path the savings that this path is the one to count, else 0. leaf: does the path end at a node without children?
    """
    bits, keys, own, counted = bytearray(), [], [], []
    before: list[tuple[int, int]] = []
    place: list[int] = []
    for path, weight, ends in zip(paths, weights, leaf, strict=True):
        same = 0
        for a, b in zip(before, path, strict=False):
            if a != b:
                break
            same += 1
        bits += b"\0" * (len(before) - same)
        bits += b"\1" * (len(path) - same)
        place = place[:same] + list(range(len(keys), len(keys) + len(path) - same))
        keys += path[same:]
        own += [0] * (len(path) - same)
        counted += [0] * (len(path) - same)
        for k, w in zip(place, weight, strict=True):
            own[k] += w
        counted[place[-1]] += ends
        before = path
    bits += b"\0" * len(before)
    trie = Parentheses(np.frombuffer(bytes(bits), dtype=np.uint8))
    at = np.flatnonzero(trie.bits)
    close = trie.find_close(at)
    # a conversation that ends at an inner node may look like a leaf of this shard: only pairs of true leaves are ranked
    pairs = trie.rank_pairs(np.array(counted, dtype=np.int64))
    weight = np.concatenate([[0], np.cumsum(np.array(own, dtype=np.int64))])
    return {
        "members": np.array([-m for m, _ in keys], dtype=np.int64), "label": np.array([c for _, c in keys], dtype=np.int64),
        "leaves": pairs[close + 1] - pairs[at], "below": weight[trie.opened[close]] - weight[trie.opened[at] + 1],
    }


def rebuilt_turns(conversations: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: turns (conv_id, depth, c1, c2, bytes), and all conv_ids.

    Turns stand in order of turn (null first), then role and the text's md5; null role and text are empty. Conversation c
    begins with the first h turns of conversation c - c % `share`, h = crc32(c) % `most`, and goes on with its own turns
    after its first h. Rows without conv_id belong to no conversation. c1 and c2 are hashes of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("digest"),
        F.xxhash64(role, text).alias("c1"), F.xxhash64(F.lit(11), text, role).alias("c2"), F.octet_length(text).cast("long").alias("bytes"))
    placed = cut(ordinal(turns, ["conv_id"], ["turn", "role", "digest"], "k").select("conv_id", "k", "c1", "c2", "bytes"))
    lengths = placed.groupBy("conv_id").agg(F.max("k").alias("n"))
    ids = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % share).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = cut(ids.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head")))
    heads = (
        plan.where("head > 0").select("conv_id", "base", "head")
        .join(placed.where(F.col("k") < most).withColumnRenamed("conv_id", "base"), "base").where("k <= head")
        .select("conv_id", F.col("k").alias("depth"), "c1", "c2", "bytes")
    )
    own = placed.join(plan.select("conv_id", "h", "head"), "conv_id").where("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("head")).alias("depth"), "c1", "c2", "bytes")
    return heads.unionByName(own), plan.select("conv_id")


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2 (the node), p1, p2 (its parent's lanes), bytes, upto (bytes to here): running values by chunks."""
    tagged = turns.withColumns({"t1": F.xxhash64("depth", "c1"), "t2": F.xxhash64("c2", "depth"), "chunk": F.floor((F.col("depth") - 1) / CHUNK)})
    tagged = cut(tagged.select("conv_id", "chunk", "depth", "t1", "t2", "bytes"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy("conv_id", "chunk").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"), F.sum("bytes").alias("s"))
        .select("conv_id", "chunk", *(F.coalesce(F.expr(f).over(earlier), F.lit(0)).alias(a) for f, a in (("bit_xor(s1)", "s1"), ("bit_xor(s2)", "s2"), ("sum(s)", "s"))))
    )
    here = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = tagged.withColumns({"r1": F.expr("bit_xor(t1)").over(here), "r2": F.expr("bit_xor(t2)").over(here), "r": F.sum("bytes").over(here)})
    x1, x2 = F.col("r1").bitwiseXOR(F.col("s1")), F.col("r2").bitwiseXOR(F.col("s2"))
    return run.join(starts, ["conv_id", "chunk"]).select(
        "conv_id", "depth", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("t1")).alias("p1"), x2.bitwiseXOR(F.col("t2")).alias("p2"), "bytes", (F.col("r") + F.col("s")).alias("upto"))


def _ends(ends: DataFrame, ids_per_row: int = 20_000) -> DataFrame:
    """NODE, ends_sha256: of the conversations that end at a node, ids in order, joined by commas.

    The ids are joined to long pieces over all tasks first; one task then only hashes a node's pieces one after another.
    """
    order = [*NODE, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [batch.column(c).to_numpy() for c in NODE]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            firsts = np.unique(np.concatenate([[0], new, np.arange(0, batch.num_rows, ids_per_row)]))
            ids = batch.column("conv_id").to_pylist()
            joined = [",".join(map(str, ids[a:b])) for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[firsts]) for c in cols), pa.array(batch.column("conv_id").to_numpy()[firsts]), pa.array(joined)], [*order, "part"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in last), pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])

        for batch in batches:
            for *node, part in zip(*(batch.column(c).to_pylist() for c in (*NODE, "part")), strict=True):
                if node == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        yield row()
                    last, digest = node, hashlib.sha256()
                digest.update(part.encode())
        if last is not None:
            yield row()

    key = "depth long, x1 long, x2 long"
    long = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, f"{key}, conv_id long, part string")
    return long.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, f"{key}, ends_sha256 string")


def _subtrees(paths: DataFrame, shard_chains: int) -> DataFrame:
    """label, members, leaves, below of every chain, from paths (key: array of (-members, label); weight; leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        n = 0
        for batch in batches:
            for key, weight, leaf in zip(*(batch.column(c).to_pylist() for c in ("key", "weight", "leaf")), strict=True):
                for box, x in zip(held, ([(e["m"], e["label"]) for e in key], weight, leaf), strict=True):
                    box.append(x)
                n += len(key)
                if n >= shard_chains:
                    yield pa.RecordBatch.from_pydict(shard_sums(*held))
                    held, n = ([], [], []), 0
        if n:
            yield pa.RecordBatch.from_pydict(shard_sums(*held))

    ordered = paths.repartitionByRange("key").sortWithinPartitions("key")
    sums = ordered.select("key", "weight", "leaf").mapInArrow(run, "members long, label long, leaves long, below long")
    return sums.groupBy("label", "members").agg(F.sum("leaves").alias("n_leaves"), F.sum("below").alias("below"))


def prefix_trie(turns: DataFrame, ids: DataFrame, shard_chains: int = 300_000) -> DataFrame:
    """One row per node of the trie of `turns` (as of `rebuilt_turns`; depth gapless from 1); `ids`: all conv_ids, turnless ones too.

    conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Without conversations there is no node, not even the root.
    """
    rows = cut(_prefixes(turns))
    all_ = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    stops = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x1", "x2"), "depth").alias("at"))
    zero = F.lit(0).cast("long")
    ends = cut(ids.join(stops, "conv_id", "left").select("conv_id", *(F.coalesce(f"at.{c}", zero).alias(c) for c in NODE)))
    inner = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("label"), *(F.first(c).alias(c) for c in ("bytes", "upto", "p1", "p2")))
    root = turns.sparkSession.range(1 if all_.n else 0).select(
        *(zero.alias(c) for c in NODE), F.lit(all_.n).alias("members"), F.lit(all_.least).cast("long").alias("label"), *(zero.alias(c) for c in ("bytes", "upto", "p1", "p2")))
    plain = cut(inner.unionByName(root))
    below = plain.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(plain.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    known = nodes.select(*NODE, "members", "label")
    chains = (
        rows.select("conv_id", *NODE, "bytes", "upto").join(known, NODE).select("conv_id", "members", "label", "bytes", "upto")
        .unionByName(ids.select("conv_id", F.lit(all_.n).alias("members"), F.lit(all_.least).cast("long").alias("label"), zero.alias("bytes"), zero.alias("upto")))
        .groupBy("conv_id", "members", "label").agg(((F.col("members") - 1) * (F.max("upto") - F.min(F.col("upto") - F.col("bytes")))).alias("weight"))
        .withColumn("weight", F.when(F.col("label") == F.col("conv_id"), F.col("weight")).otherwise(0))
    )
    steps = chains.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("members")).alias("m"), "label", "weight"))).alias("steps"))
    distinct = ends.join(nodes.select(*NODE, "label", (F.col("n_children") == 0).alias("leaf")), NODE).where("conv_id = label").select("conv_id", "leaf")
    paths = cut(steps.join(distinct, "conv_id").select(
        F.transform("steps", lambda s: F.struct(s["m"].alias("m"), s["label"].alias("label"))).alias("key"), F.col("steps.weight").alias("weight"), "leaf"))
    subtrees = _subtrees(paths, shard_chains)
    tops = nodes.groupBy("label", "members").agg(F.max("upto").alias("top"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("label").alias("parent_conv_id"))
    saved = F.col("below") + (F.col("members") - 1) * (F.col("top") - F.col("upto") + F.col("bytes"))
    return (
        nodes.join(parents, ["depth", "p1", "p2"], "left").join(_ends(ends), NODE, "left").join(cut(subtrees.join(tops, ["label", "members"])), ["label", "members"])
        .select(F.col("label").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"), "n_leaves",
                saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(*rebuilt_turns(conversations))
