"""Prefix trie of conversations by an LCP-aware mergesort.

A conversation is the sequence of its turns; a turn is 128 bits of its role and
text, so texts are read once and never shuffled. Tasks sort bounded runs of
sequences and give every row its longest common prefix (LCP) with the row before,
in turns. Spark deals the runs out by ranges of (sequence, conv_id), so that even
copies of one conversation are split over tasks, and stores them. Each task merges
its pieces of runs with a loser tree: a match between two rows is settled by their LCPs with the last
row that was put out wherever these differ, and turns are compared only from there
on. The merged stream drives a stack of the open path: a row closes all nodes below
its LCP with the row before, and a closed node is finished and put out.

Nodes on the paths of a task's first and last row may go on in other tasks. They
are put out as parts, under a hash of their path, and summed; what lies below such a node is
summed by running sums along those paths, each node counting on one of them. Their
number is that of the tasks times the depth. A last join by the path's hash
gives each node its parent's smallest member.

Defined results: rows without conv_id belong to no conversation; turns are ordered
by turn (null first), then by 128 bits of role and text; a null role or text is
empty; remainders of negative ids have the sign of the id; rows that repeat are
turns of their own; an empty table gives an empty result; other columns are ignored.
A conversation travels as one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.types as T
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.scratch import materialize, release

#: Bytes of a turn's code; rows and bytes of a sorted run; bytes of sequences that one task merges.
CODE, RUN_ROWS, RUN_BYTES, TASK_BYTES = 16, 100_000, 32 << 20, 32 << 20
#: A conversation takes its first turns, fewer than HEADS of them, from the one whose id ends in zeros (a multiple of BLOCK).
HEADS, BLOCK = 6, 100


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the ordered (code, n_chars) of every conversation of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    coded = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), code.alias("code"), F.char_length(text).alias("n")).alias("x"))
    ordered = F.sort_array(F.collect_list("x"))
    return coded.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["code"].alias("code"), x["n"].alias("n"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first of its block."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = turns.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, HEADS - 1).alias("first"))
    own = turns.select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("head"), h.cast("int").alias("h"), "turns")
    taken = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", F.lit(1), F.lit(0)))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "head", "left").select("conv_id", F.concat(taken, rest).alias("turns"))


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two sequences of codes have in common at their beginnings, of which ``start`` are known."""
    most = min(len(a), len(b)) // CODE
    while start < most and a[start * CODE : (start + 1) * CODE] == b[start * CODE : (start + 1) * CODE]:
        start += 1
    return start


def sorted_runs(convs: DataFrame) -> DataFrame:
    """(run, at, lcp, seq, lens, conv_id): each task's conversations in sorted runs; lcp is with the row before in the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            held.sort()
            lcps = [0] * len(held)
            for i in range(1, len(held)):
                lcps[i] = common(held[i - 1][0], held[i][0])
            number = (part << 32) + made
            cols = [pa.array([number] * len(held), pa.int64()), pa.array(range(len(held)), pa.int32()), pa.array(lcps, pa.int32())]
            cols += [pa.array(c, t) for c, t in zip(([r[0] for r in held], [r[2] for r in held], [r[1] for r in held]), (pa.binary(), pa.list_(pa.int32()), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(cols, ["run", "at", "lcp", "seq", "lens", "conv_id"])

        for batch in batches:
            for conv, codes, lens in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((b"".join(codes), conv, lens))
                size += len(held[-1][0]) + 64
                if len(held) >= RUN_ROWS or size >= RUN_BYTES:
                    yield flush()
                    made, held, size = made + 1, [], 0
        if held:
            yield flush()

    flat = convs.select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.n").alias("lens"))
    return flat.mapInArrow(run, "run long, at int, lcp int, seq binary, lens array<int>, conv_id long")


class Piece:
    """The rows of one run that fell to a task, in order; ``lcp`` of the row at hand is with the last row put out by the merge."""

    __slots__ = ("rows", "at", "lcp", "seq", "conv")

    def __init__(self, rows: list[tuple]):
        self.rows, self.at = rows, -1
        self.step()

    def step(self) -> bool:
        self.at += 1
        if self.at >= len(self.rows):
            self.seq = None
            return False
        # The row before of the same run has just been put out, or nothing has.
        self.lcp, self.seq, _, self.conv = self.rows[self.at]
        if not self.at:
            self.lcp = 0
        return True


def _first(x: Piece, y: Piece) -> tuple[Piece, Piece]:
    """Winner and loser; the loser's LCP is brought up to date with the winner where they were compared."""
    if x.seq is None or y.seq is None:
        return (x, y) if y.seq is None else (y, x)
    if x.lcp != y.lcp:
        return (x, y) if x.lcp > y.lcp else (y, x)
    both = common(x.seq, y.seq, x.lcp)
    a, b = x.seq[both * CODE : (both + 1) * CODE], y.seq[both * CODE : (both + 1) * CODE]
    win, lose = (x, y) if (a, x.conv) <= (b, y.conv) else (y, x)
    lose.lcp = both
    return win, lose


def merged(pieces: list[Piece]) -> Iterator[tuple[int, bytes, list[int], int]]:
    """(lcp with the row before, seq, lens, conv_id) of all pieces in order, by a loser tree."""
    width = 1
    while width < len(pieces):
        width *= 2
    leaves = [*pieces, *(Piece([]) for _ in range(width - len(pieces)))]
    tree, up = [None] * width, leaves
    # The losers of the first matches, level by level; ``up`` has the winners.
    while len(up) > 1:
        level = [_first(up[i], up[i + 1]) for i in range(0, len(up), 2)]
        for i, (_, lose) in enumerate(level):
            tree[len(level) + i] = lose
        up = [win for win, _ in level]
    place = {id(p): i for i, p in enumerate(leaves)}
    top = up[0]
    while top.seq is not None:
        yield top.lcp, top.seq, top.rows[top.at][2], top.conv
        node = (place[id(top)] + width) // 2
        top.step()
        while node:
            top, tree[node] = _first(top, tree[node])
            node //= 2


_NODE = T.StructType().add("path", T.BinaryType()).add("parent", T.BinaryType()).add("depth", T.LongType()).add("conv_id", T.LongType()).add("n_convs", T.LongType()).add("n_children", T.LongType()).add("n_leaves", T.LongType()).add("saved_tokens", T.LongType()).add("ends", T.StringType()).add("ends_from", T.LongType()).add("n_chars", T.LongType()).add("side", T.LongType())
_ARROW = pa.schema([("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("ends_from", pa.int64()), ("n_chars", pa.int64()), ("side", pa.int64())])


class Node:
    """A node of the open path. ``fixed``: on the path of the task's first row, so that other tasks may have parts of it."""

    __slots__ = ("path", "parent", "conv", "n", "children", "leaves", "saved", "ends", "chars", "fixed")

    def __init__(self, path: bytes, parent: bytes | None, chars: int, fixed: bool):
        self.path, self.parent, self.chars, self.fixed = path, parent, chars, fixed
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, []

    def taken(self, conv: int, n: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(conv, self.conv)


def trie_nodes(rows: Iterator[tuple[int, bytes, list[int], int]], part: int) -> Iterator[tuple]:
    """Rows of _NODE from a sorted stream: finished nodes, with the hash of the ids that end there, and parts with ``side`` and those ids."""
    stack: list[Node] = []
    sides = 2 * part

    def shared(node: Node, depth: int, side: int) -> tuple:
        ids = ",".join(map(str, node.ends))
        return node.path, node.parent, depth, node.conv, node.n, node.children, node.leaves, node.saved, ids if node.ends else None, node.ends[0] if node.ends else None, node.chars, side

    def close() -> tuple | None:
        """The deepest node leaves the path; it hands its sums on."""
        node, depth = stack.pop(), len(stack)
        if stack:
            stack[-1].taken(node.conv, node.n)
        if node.fixed:
            return shared(node, depth, sides)
        node.leaves += not node.children
        node.saved += (node.n - 1) * node.chars
        above = stack[-1]
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        digest = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        return node.path, node.parent, depth, node.conv, node.n, node.children, node.leaves, node.saved, digest, None, None, None

    for lcp, seq, lens, conv in rows:
        first = not stack
        if first:
            stack.append(Node(bytes(CODE), None, 0, True))
        while len(stack) > lcp + 1:
            yield close()
        for d in range(len(stack) - 1, len(lens)):
            above = stack[-1].path
            stack.append(Node(xxhash.xxh3_128_digest(above + seq[d * CODE : (d + 1) * CODE]), above, lens[d], first))
        stack[-1].taken(conv, 1)
        stack[-1].ends.append(conv)
    # What is open now may go on in the next task.
    while stack:
        node, depth = stack.pop(), len(stack)
        if stack:
            stack[-1].taken(node.conv, node.n)
        yield shared(node, depth, sides if node.fixed else sides + 1)


def _parts(runs: DataFrame, tasks: int) -> DataFrame:
    """_NODE rows of all tasks."""
    dealt = runs.repartitionByRange(tasks, "seq", "conv_id").sortWithinPartitions("run", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple]] = {}
        for batch in batches:
            number, lcp, seq, lens, conv = (batch.column(i).to_pylist() for i in range(5))
            for i, r in enumerate(number):
                own.setdefault(r, []).append((lcp[i], seq[i], lens[i], conv[i]))
        held: list[tuple] = []
        pieces = [Piece(rows) for rows in own.values()]
        for row in trie_nodes(merged(pieces), TaskContext.get().partitionId()) if pieces else ():
            held.append(row)
            if len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return dealt.select("run", "lcp", "seq", "lens", "conv_id").mapInArrow(run, _NODE)


def _digests(parts: DataFrame) -> DataFrame:
    """(path, ends_sha256) of the ids of each path, which parts have in pieces that follow one another; they are hashed as a stream."""
    pieces = parts.where("ends is not null").select("path", "ends_from", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != path:
                    if path is not None:
                        out.append((path, state.hexdigest()))
                    path, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["path", "ends_sha256"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], ["path", "ends_sha256"])

    return pieces.repartition("path").sortWithinPartitions("path", "ends_from").mapInArrow(run, "path binary, ends_sha256 string")


def _joined_parts(parts: DataFrame) -> DataFrame:
    """The nodes that tasks have parts of, finished."""
    sums = parts.groupBy("path", "parent", "depth", "n_chars").agg(F.min("conv_id").alias("conv_id"), F.min("side").alias("own"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    inner = sums.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("open_children"))
    totals = sums.join(inner, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    totals = totals.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_chars"))
    totals = materialize(totals.drop("open_children"), "trie-totals")
    # Every side of a task is a path from the root down; a node counts on the smallest side that has it.
    low = parts.groupBy("side", F.shiftright("side", 1).alias("task")).agg(F.min("depth").alias("from"))
    both = parts.select("path", "depth", "side").join(low, "side")
    above = parts.select(F.col("path").alias("p"), F.col("depth").alias("d"), F.col("side").alias("s"))
    paths = both.select("path", "depth", "side").unionByName(low.where("side % 2 = 1").join(above, (F.col("s") == F.col("side") - 1) & (F.col("d") < F.col("from"))).select(F.col("p").alias("path"), F.col("d").alias("depth"), "side"))
    counted = paths.join(totals.select("path", "own", "n_leaves", "saved_tokens"), "path")
    below = Window.partitionBy("side").orderBy(F.desc("depth"))
    mine = lambda c: F.sum(F.when(F.col("own") == F.col("side"), F.col(c)).otherwise(0)).over(below).alias(c)
    trees = counted.select("path", mine("n_leaves"), mine("saved_tokens")).groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return totals.drop("n_leaves", "saved_tokens", "own", "n_chars").join(trees, "path").join(_digests(parts), "path", "left")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(turns_of(rows), "trie-turns")
    runs = materialize(sorted_runs(rebuilt(turns)), "trie-runs")
    release(turns)
    size = runs.agg(F.sum(F.octet_length("seq") + 64)).first()[0] or 0
    parts = materialize(_parts(runs, max(1, -(-int(size) // TASK_BYTES), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "trie-parts")
    release(runs)
    shared = _joined_parts(parts.where("side is not null"))
    names = ["path", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = parts.where("side is null").withColumnRenamed("ends", "ends_sha256").select(*names)
    nodes = materialize(closed.unionByName(shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).select(*names)), "trie-nodes")
    parents = nodes.where("n_children > 0").select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
