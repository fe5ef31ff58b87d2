"""Trie of conversations that open with the same turns.

Conversations are range-sorted by their turns into shards. In a shard the turns become a padded matrix of turn ids;
a lexsort puts conversations with equal openings side by side, and the OR of the column changes up to a depth marks
where the nodes of that depth start, so one reduceat a depth gives their members. Wide matrices are taken some columns at
a time. Only the nodes on the paths of a shard's first and last conversation can go on in other shards: their shares are
added up by the digest of their turns, and what lies below them is carried up along those paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lapsekit.llm.common import buffers, cut_table, ragged

#: Bytes of turn digests and sizes in a shard.
SHARD = 64 << 20
#: Columns of the matrix at a time.
WIDTH = 32
TURN = 16  # bytes of a turn's digest
#: Ids in a row of members that end at a node of several shards.
ENDS = 500
NO_ENDS = hashlib.sha256(b"").hexdigest()

SHARD_SCHEMA = ("kind string, shard int, chain int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, "
                "parent_chain int, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, size long, "
                "part long, ends string")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (array of digest and size in UTF-8 bytes), in order of turn, null first.

    A turn is known by a 128-bit digest of role and text; null ones count as empty. Turns with equal numbers are
    ordered by digest, equal ones all stay. Rows without a conversation id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))


def with_openings(conversations: DataFrame, group: int = 5, lengths: int = 9) -> DataFrame:
    """Conversation c of ``sequences`` with its first h turns taken from conversation ``c - c % group``, where
    ``h = crc32(c) % lengths``; all of those if there are fewer, none if that conversation is absent."""
    heads = conversations.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, lengths - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % lengths).cast("int")
    rows = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("turns"))


class _Level:
    """Nodes of one depth in a shard."""

    def __init__(self, conv, parent, n_convs, n_ends, size, ends):
        self.conv, self.parent, self.n_convs, self.n_ends, self.size = conv, parent, n_convs, n_ends, size
        self.ends = ends  # members that end here, node after node, ascending
        self.children, self.leaves, self.saved = (np.zeros(len(conv), np.int64) for _ in range(3))
        self.edges = np.full(2, -1, np.int64)  # nodes of the shard's first and last conversation


def _levels(conv: np.ndarray, ids: np.ndarray, first: np.ndarray, lens: np.ndarray, sizes: np.ndarray, ends: list[int]) -> list[_Level]:
    """Nodes of every depth, from the root down; ``ends`` are the shard's first and last conversation."""
    root = _Level(conv.min(keepdims=True), np.full(1, -1), np.array([len(conv)]), np.array([(lens == 0).sum()]), np.zeros(1, np.int64),
                  np.sort(conv[lens == 0]))
    root.edges[:] = 0
    levels, node = [root], np.zeros(len(conv), np.int64)
    for left in range(0, int(lens.max(initial=0)), WIDTH):
        rows = np.flatnonzero(lens > left)
        many = np.minimum(lens[rows] - left, WIDTH)
        matrix = np.full((len(rows), int(many.max())), -1, np.int32)
        column = ragged(np.zeros(len(rows), np.int64), many)
        matrix[np.repeat(np.arange(len(rows)), many), column] = ids[ragged(first[rows] + left, many)]
        order = np.lexsort((conv[rows], *matrix.T[::-1], node[rows]))
        rows, matrix = rows[order], matrix[order]
        change = np.ones((len(rows), matrix.shape[1] + 1), bool)
        change[1:, 0] = node[rows[1:]] != node[rows[:-1]]
        change[1:, 1:] = matrix[1:] != matrix[:-1]
        starts = np.logical_or.accumulate(change, axis=1)[:, 1:]
        for j in range(matrix.shape[1]):
            depth = left + j + 1
            here = np.flatnonzero(matrix[:, j] >= 0)
            start = np.flatnonzero(starts[here, j])
            own = rows[here]
            ending = lens[own] == depth
            top = own[start]
            level = _Level(np.minimum.reduceat(conv[own], start), node[top], np.diff(np.append(start, len(own))),
                           np.add.reduceat(ending.astype(np.int64), start), sizes[first[top] + depth - 1], conv[own[ending]])
            node[own] = np.cumsum(starts[here, j]) - 1
            for side, row in enumerate(ends):
                if lens[row] >= depth:
                    level.edges[side] = node[row]
            levels.append(level)
    return levels


def _inner(level: _Level) -> np.ndarray:
    """Nodes that lie in this shard alone."""
    inner = np.ones(len(level.conv), bool)
    inner[level.edges[level.edges >= 0]] = False
    return inner


def _carry_up(levels: list[_Level]) -> None:
    """Children, leaves and saved bytes below every node, of nodes that lie in this shard alone."""
    for depth in range(len(levels) - 1, -1, -1):
        level, inner = levels[depth], _inner(levels[depth])
        level.saved += np.where(inner, (level.n_convs - 1) * level.size, 0)
        level.leaves += inner & (level.n_ends == level.n_convs)
        if depth:
            above = levels[depth - 1]
            np.add.at(above.children, level.parent, inner.astype(np.int64))
            np.add.at(above.leaves, level.parent, level.leaves)
            np.add.at(above.saved, level.parent, level.saved)


def _batch(kind: str, shard: int, n: int, **columns) -> pa.RecordBatch:
    types = dict(f.split() for f in SHARD_SCHEMA.split(", "))
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns |= {"kind": [kind] * n, "shard": np.full(n, shard)}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], arrow[t]) if c in columns else pa.nulls(n, arrow[t]) for c, t in types.items()],
                                      names=list(types))


def _members(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    shard = TaskContext.get().partitionId()
    conv = rows.column("conv_id").to_numpy()
    data, offsets = buffers(rows.column("seq"))
    pair = np.frombuffer(data.tobytes(), ">u8").reshape(-1, 2)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    ids = np.empty(len(order), np.int32)
    ids[order] = np.cumsum(np.concatenate([[0], (np.diff(pair[order].astype(np.uint64), axis=0) != 0).any(axis=1)])[:len(order)])
    sizes = rows.column("sizes").combine_chunks().flatten().to_numpy()
    raw = data.tobytes()
    text = lambda i: raw[offsets[i]:offsets[i + 1]]
    by = lambda i: (text(i), conv[i])
    ends = [min(range(len(conv)), key=by), max(range(len(conv)), key=by)]
    levels = _levels(conv, ids, offsets[:-1] // TURN, np.diff(offsets) // TURN, sizes, ends)
    _carry_up(levels)
    keys: list[list[bytes]] = []
    for row in ends:  # digests of the turns down to every node of the two paths
        path, turns = hashlib.sha256(), text(row)
        keys.append([path.digest()[:TURN]])
        for i in range(0, len(turns), TURN):
            path.update(turns[i:i + TURN])
            keys[-1].append(path.digest()[:TURN])
    for depth, level in enumerate(levels):
        last = np.cumsum(level.n_ends)
        at = np.flatnonzero(_inner(level))
        if len(at):
            above = levels[depth - 1]
            parent = level.parent[at]
            chain = np.where(parent == above.edges[0], 0, np.where(parent == above.edges[1], 1, -1))
            sha = [hashlib.sha256(_members(level.ends[b - n:b]).encode()).hexdigest() if n else NO_ENDS
                   for n, b in zip(level.n_ends[at].tolist(), last[at].tolist())]
            yield _batch("node", shard, len(at), depth=np.full(len(at), depth), conv_id=level.conv[at],
                         parent_conv_id=pa.array(above.conv[parent], mask=chain >= 0), parent_chain=pa.array(chain, mask=chain < 0),
                         n_convs=level.n_convs[at], n_children=level.children[at], n_leaves=level.leaves[at],
                         saved_tokens=level.saved[at], ends=sha)
        for chain, i in enumerate(level.edges.tolist()):
            if i < 0:
                continue
            share = 0 if chain and i == level.edges[0] else 1  # a node of both paths gives its share once
            above_key = [keys[chain][depth - 1]] if depth else None
            yield _batch("edge", shard, 1, chain=[chain], depth=[depth], key=[keys[chain][depth]],
                         **({"parent_key": above_key} if depth else {}), conv_id=[int(level.conv[i])], size=[int(level.size[i])],
                         n_convs=[share * int(level.n_convs[i])], n_children=[share * int(level.children[i])],
                         n_leaves=[share * int(level.leaves[i])], saved_tokens=[share * int(level.saved[i])], n_ends=[share * int(level.n_ends[i])])
            members = level.ends[last[i] - level.n_ends[i]:last[i]]
            parts = range(0, share * len(members), ENDS)
            if len(parts):
                yield _batch("ends", shard, len(parts), depth=np.full(len(parts), depth), key=[keys[chain][depth]] * len(parts),
                             part=np.array(parts), ends=[_members(members[x:x + ENDS]) for x in parts])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the members of each node, whose parts come one after the other."""
    own, path = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]]), pa.array([path.hexdigest()])],
                                              names=["depth", "key", "ends_sha256"])
    for batch in batches:
        for depth, key, text in zip(batch.column("depth").to_pylist(), batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if own != (depth, key):
                if own:
                    yield done()
                own, path = (depth, key), hashlib.sha256(text.encode())
            else:
                path.update(b"," + text.encode())
    if own:
        yield done()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conversations`` (conv_id, turns as ``sequences`` gives them): one row per distinct opening.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (nodes
    without children at or below), saved_tokens (at or below: members but one times the bytes of the last turn),
    ends_sha256 (of the ids of the members that end there, ascending, with commas). Conversations without turns are
    members of the root alone; an empty table has no nodes. Ids must be unique and not null, as ``sequences`` makes them.
    """
    spark = conversations.sparkSession
    hexes = F.array_join(F.transform("turns", lambda t: t.digest), "")
    rows = cut_table(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(hexes).alias("seq"),
                                          F.transform("turns", lambda t: t["size"]).alias("sizes")))
    size = rows.agg(F.sum(F.octet_length("seq") + 8 * F.size("sizes") + 16)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    out = cut_table(rows.repartitionByRange(shards, "seq", "conv_id").mapInArrow(_shard, SHARD_SCHEMA))
    nodes, edges = out.filter("kind = 'node'"), out.filter("kind = 'edge'")
    parts = out.filter("kind = 'ends'").select("depth", "key", "shard", "part", "ends")
    hashes = parts.repartition("depth", "key").sortWithinPartitions("depth", "key", "shard", "part").mapInArrow(
        _hash_ends, "depth long, key binary, ends_sha256 string")
    whole = edges.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"), F.first("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")],
        F.min(F.struct("shard", "chain")).alias("owner"))
    whole = cut_table(whole)
    # every node that several shards may share is counted on one path, and from there up for all nodes of the path
    paths = edges.select("shard", "chain", "depth", "key").join(
        whole.select("depth", "key", "owner", F.col("conv_id").alias("node_conv_id"), ((F.col("n_convs") - 1) * F.col("size")).alias("value"),
                     (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf")), ["depth", "key"])
    paths = cut_table(paths.withColumn("own", (F.col("owner") == F.struct("shard", "chain")).cast("long")))
    below = Window.partitionBy("shard", "chain").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    shares = paths.select("depth", "key", F.sum(F.col("own") * F.col("value")).over(below).alias("v"),
                          F.sum(F.col("own") * F.col("leaf")).over(below).alias("l"))
    shares = shares.groupBy("depth", "key").agg(F.sum("v").alias("path_saved"), F.sum("l").alias("path_leaves"))
    above = whole.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key")).agg(
        F.count("*").alias("path_children"))
    parents = whole.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    edge_nodes = (whole.join(shares, ["depth", "key"]).join(above, ["depth", "key"], "left").join(hashes, ["depth", "key"], "left")
                  .join(parents, ["depth", "parent_key"], "left"))
    edge_nodes = edge_nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.coalesce("path_children", F.lit(0))).alias("n_children"),
        (F.col("n_leaves") + F.col("path_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("path_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    near = nodes.filter("parent_chain is null").withColumnRenamed("ends", "ends_sha256").select(*RESULT)
    links = paths.select("shard", F.col("chain").alias("parent_chain"), (F.col("depth") + 1).alias("depth"), "node_conv_id")
    far = nodes.filter("parent_chain is not null").join(links, ["shard", "parent_chain", "depth"]).drop("parent_conv_id")
    far = far.withColumnRenamed("node_conv_id", "parent_conv_id").withColumnRenamed("ends", "ends_sha256").select(*RESULT)
    return edge_nodes.unionByName(near).unionByName(far)
