"""The trie of conversation prefixes, from vertical bitmaps.

Conversations are dealt into shards of neighbouring ids. A shard indexes each (position, turn) by the
bitset of its conversations that have this turn there. From the root's bitset of all, depth first, a
node's children are the intersections of its bitset with the postings of the next position; their
popcounts, smallest members and the members that end are the shard's share in a node. Shares are
then summed over shards by a 128-bit hash of the prefix, so a prefix that very many conversations
share is a row of each shard, and no task has one alone.

What a node sums over its subtree is put down to members. A node belongs to its smallest member, so
a conversation owns the nodes from some depth on, or none if it is a copy. A text counts as saved
for every member but the owner: a member adds to the node at depth d its texts from there to where
its own nodes begin. It adds a leaf if it owns its last node and that has no child. A second walk over
the shards sums these.

Turns are known by 128 bits of hash and their length; texts are not shuffled but to group a
conversation's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quaestor.llm.common import map_arrow, small, written

#: Conversations and turns of a shard; the latter may be more for a single conversation.
SHARD_ROWS, SHARD_TURNS = 1024, 65_536
#: Children of a node in a task where they look their parent up.
DEGREE = 256

TURNS = "array<struct<key: binary, n_chars: bigint>>"
ROOT = bytes(16)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its `turns` (hash of role and text, code points of the text), in order.

    Turns are ordered by `turn`, null first; ties by that hash. Null roles and texts are empty. Rows
    that repeat are turns of their own. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", key.alias("key"), F.length(text).cast("long").alias("n_chars")
    )
    grouped = turns.filter("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("ts")
    )
    return grouped.select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["key"].alias("key"), t["n_chars"].alias("n_chars"))).alias("turns")
    )


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of neighbouring rows, whose turns are lists of keys and of lengths."""
    for batch in batches:
        turns = batch.column("turns")
        offsets = turns.offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            end = start + 1
            while end < min(batch.num_rows, start + SHARD_ROWS) and offsets[end + 1] - offsets[start] <= SHARD_TURNS:
                end += 1
            part = batch.slice(start, end - start)
            lists = part.column("turns").to_pylist()
            rows = {n: part.column(n).to_pylist() for n in part.schema.names if n != "turns"}
            rows["keys"] = [[t["key"] for t in ts] for ts in lists]
            rows["chars"] = [[t["n_chars"] for t in ts] for ts in lists]
            yield rows
            start = end


def members(bits: int) -> Iterator[int]:
    """The set bits, smallest first."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(keys: list[list[bytes]]) -> Iterator[tuple[bytes, bytes | None, int, int, int]]:
    """prefix hash, its parent's, depth, bitset of members and of those that end, of each node."""
    postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, keys), default=0))]
    ends: dict[int, int] = {}
    for i, sequence in enumerate(keys):
        for position, key in enumerate(sequence):
            postings[position][key] = postings[position].get(key, 0) | 1 << i
        ends[len(sequence)] = ends.get(len(sequence), 0) | 1 << i
    stack = [(ROOT, None, 0, (1 << len(keys)) - 1)]
    while stack:
        node, parent, depth, bits = stack.pop()
        ended = bits & ends.get(depth, 0)
        yield node, parent, depth, bits, ended
        rest = bits ^ ended
        while rest:
            key = keys[(rest & -rest).bit_length() - 1][depth]
            child = bits & postings[depth][key]
            stack.append((hashlib.blake2b(node + key, digest_size=16).digest(), node, depth + 1, child))
            rest &= ~child


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
        ("n", pa.int64()), ("ends", pa.list_(pa.int64())),
    ])
    for rows in shards(batches):
        ids = rows["conv_id"]
        found = [
            (node, parent, depth, ids[(bits & -bits).bit_length() - 1], bits.bit_count(), [ids[i] for i in members(ended)])
            for node, parent, depth, bits, ended in walk(rows["keys"])
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _subtree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in shards(batches):
        saved = []
        for chars, first in zip(rows["chars"], rows["first_own"], strict=True):
            # the sum of texts at depths d to first - 1; copies own nothing
            shared = chars if first is None else chars[: max(first - 1, 0)]
            sums = [0] * (len(chars) + 2)
            for d in range(len(shared), 0, -1):
                sums[d] = sums[d + 1] + shared[d - 1]
            sums[0] = sums[1]
            saved.append(sums)
        leaves = sum(1 << i for i, leaf in enumerate(rows["leaf"]) if leaf)
        found = [
            (node, sum(saved[i][depth] for i in members(bits)), (bits & leaves).bit_count())
            for node, _, depth, bits, _ in walk(rows["keys"])
        ]
        nodes, sums, counts = zip(*found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())],
            names=["node", "saved_tokens", "n_leaves"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's ids, comma-joined, are hashed as its rows stream by in order."""
    node, digest, done = None, None, []

    def batch_of(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
            names=["node", "ends_sha256"],
        )

    for batch in batches:
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            text = ",".join(map(str, ids)).encode()
            if key == node:
                digest.update(b"," + text)
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(text)
        yield batch_of(done)
        done = []
    if node is not None:
        yield batch_of([(node, digest.hexdigest())])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of the sequences of turns, of frame (conv_id, turns), as `sequences` gives.

    conv_id is the smallest member and depth the number of turns: together they name the node.
    parent_conv_id is the parent's conv_id, null at the root. n_convs counts members, n_children
    the next turns, n_leaves childless nodes of the subtree. saved_tokens sums over the subtree what a
    cache saves: (members - 1) times the code points of the node's last text. ends_sha256 is the
    SHA-256 of the ids of members that end there, ascending and comma-joined.

    conv_id must be unique and not null. A conversation without turns is a member of the root; an empty
    frame has no node. Other columns are ignored. One conversation's turns, at some 30 bytes each,
    are held by one task; one node's ending members pass through one task as a stream.
    """
    conversations = written(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turns"))
    in_order = conversations.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    shares = written(map_arrow(
        in_order, _shares, "node binary, parent binary, depth long, conv_id long, n long, ends array<long>"
    ))
    nodes = written(shares.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs")))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    owners = written(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("first_own"), (F.max_by("n_children", "depth") == 0).alias("leaf")
    ))
    sums = map_arrow(
        conversations.join(owners, "conv_id", "left"), _subtree_sums, "node binary, saved_tokens long, n_leaves long"
    ).groupBy("node").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = shares.filter(F.size("ends") > 0).select("node", F.get("ends", F.lit(0)).alias("first"), "ends")
    digests = map_arrow(
        ends.repartition("node").sortWithinPartitions("node", "first").select("node", "ends"), _digests,
        "node binary, ends_sha256 string",
    )
    found = nodes.join(sums, "node").join(digests, "node", "left").join(_parents(nodes, owners), "node", "left")
    return found.select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def _parents(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """node, parent_conv_id, of nodes whose parent another conversation owns: the first that each owns.

    Children of a node with many are dealt over tasks, to each of which the node's row is copied.
    """
    tops = nodes.filter("depth > 0").join(owners, "conv_id").filter("depth = first_own").select("node", "parent")
    parts = F.ceil(F.col("n_children") / DEGREE).cast("int")
    busy = small(written(nodes.filter(F.col("n_children") > DEGREE).select(F.col("node").alias("parent"), parts.alias("parts"))))
    dealt = tops.join(busy, "parent", "left").select(
        "node", "parent", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    )
    own = nodes.filter("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
    )
    return dealt.join(own, ["parent", "part"]).select("node", "parent_conv_id")
