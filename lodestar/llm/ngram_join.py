"""N-gram Jaccard self-join by a MinHash LSH forest, verified exactly.

Texts are sets of hashed word 5-grams. Texts with equal sets form one class and
only its representative goes on. Each of TREES trees is a trie of labels, the
representatives' sequences of DEPTH min-hashes. Of every tree only the branches
below the shortest prefix that is ever needed, and that at least two documents
share, are kept. They are searched from the longest prefix to shorter ones, and
prefixes are shortened until TREES trees find a pair at the threshold with the
target recall. At each length a branch whose documents are already in one
component needs no more work, so dense groups of copies are settled by their
long prefixes (first through a branch's hubs, its smallest and largest document,
aggregated before the shuffle). In a branch that is not settled every two
documents of different components are compared by their sketches, in square tiles,
and a tile returns no more links than it has documents: no partner is capped and
no pair of a group becomes a row. Documents whose sketches are not clearly too
different join components, and inside a component all pairs are compared
exactly, again in tiles of at most TILE x TILE documents: a tile returns each
document's number of links and its root.

Defined results: a text of one to four words is one shingle of all its words; a
null text, or one without words, has no shingles and is a class of its own;
repeated rows and equal ids are rows of their own; class_id is the smallest
doc_id of the group and null only if all are null; long texts are compared
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.components import connected_components
from lodestar.plans.scratch import free_shuffles, materialize, release

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Trees, min-hashes of a label, and bytes of each.
TREES, DEPTH, CODE = 24, 12, 2
#: Prefixes are shortened by so many min-hashes at a time.
STEP = 3
#: Bytes of the sketch that tells clearly different candidates apart, and how far below the threshold its estimate may be (5 standard errors).
SKETCH, MARGIN = 128, 0.18
#: Documents on a tile's side.
TILE = 768

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-gram hashes, computed on whole arrays of characters."""

    _own: Shingler | None = None

    def __init__(self):
        self.word = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)
        self._grow(1 << 12)

    @classmethod
    def own(cls) -> Shingler:
        cls._own = cls._own or cls()
        return cls._own

    def _grow(self, n: int) -> None:
        up, down = np.full(n, _P, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def words(self, text: str) -> np.ndarray:
        """A 64-bit hash of each word of the lower-cased text, in order."""
        chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        if len(chars) > len(self.up):
            self._grow(2 * len(chars))
        inside = np.zeros(len(chars) + 2, np.int8)
        inside[1:-1] = self.word[chars]
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_mixed(chars.astype(np.uint64) + np.uint64(_P)) * self.up[: len(chars)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])

    def shingles(self, text: str | None, n: int = WORDS) -> np.ndarray:
        """The sorted distinct n-gram hashes."""
        words = self.words(text or "")
        if not len(words):
            return words
        n = min(n, len(words))
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(_P) + words[k : len(words) - n + 1 + k]
        return np.unique(_mixed(out + np.uint64(n)))


_SEEDS = _mixed(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(_P)).reshape(2, -1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH min-hashes of 32 bits."""
    low = np.full(_SEEDS.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        mixed = (shingles[k : k + 512, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        np.minimum(low, mixed.min(0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def recall_at(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    """The share of pairs at the threshold that have a prefix of this length in common in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_lengths(threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """The lengths that are searched, from the whole label down to the first one with the target recall (or 1)."""
    last = next((d for d in range(DEPTH, 0, -1) if recall_at(d, threshold) >= recall), 1)
    return sorted({*range(DEPTH, last, -STEP), last}, reverse=True)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """rid (a number of the row's own), doc_id, text_hash, c1 and c2 (128 bits of its shingle set), size, sketch and the labels of all trees in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler.own()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            rows = []
            for doc, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingler.shingles(text)
                if not len(own):
                    rows.append((doc, digest, None, None, 0, None, None))
                    continue
                c = xxhash.xxh3_128_intdigest(own.tobytes())
                sig = signature(own).reshape(TREES, -1)
                rows.append((doc, digest, (c >> 64) - (1 << 63), (c & (1 << 64) - 1) - (1 << 63), len(own), sig.ravel()[:SKETCH].astype(np.uint8).tobytes(), (sig >> 16).astype(f">u{CODE}").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "text_hash", "c1", "c2", "size", "sketch", "labels"])

    done = _rows(docs).mapInArrow(run, "doc_id long, text_hash long, c1 long, c2 long, size int, sketch binary, labels binary")
    return materialize(done.select(F.monotonically_increasing_id().alias("rid"), "*"), "signatures")


def forest(reps: DataFrame, last: int) -> DataFrame:
    """(branch, rid, label) of the documents that share a prefix of ``last`` min-hashes with another; branch numbers the tree and that prefix."""
    size = DEPTH * CODE
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("labels", t * size + 1, F.lit(size)).alias("label")))
    own = reps.select("rid", F.explode(trees).alias("x")).select("rid", F.xxhash64("x.tree", F.substring("x.label", 1, last * CODE)).alias("branch"), "x.label")
    shared = own.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("branch")
    return materialize(own.join(shared.hint("merge"), "branch"), "ngram-forest")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal bytes of every two sketches."""
    return np.stack([(row == y).sum(1) for row in x]) / SKETCH if len(x) else np.zeros((0, len(y)))


def hub_links(branches: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): documents and the hubs of their branches (key, rid) whose sketches do not rule out the threshold."""
    hubs = branches.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high")
    met = branches.join(hubs, "key").select("rid", F.explode(F.array("low", "high")).alias("hub")).where("rid <> hub")
    pairs = met.select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct()
    of = reps.select("rid", "sketch")
    both = pairs.join(of.toDF("a", "sa"), "a").join(of.toDF("b", "sb"), "b")

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((p == q).mean(1))

    return materialize(both.where(alike("sa", "sb") >= threshold - MARGIN).select("a", "b"), "ngram-hubs")


def rooted(near: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, from a symmetric matrix of links."""
    root = np.arange(len(near))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(near)).min(1, initial=len(near)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def branch_links(open_branches: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all documents of a branch (key, rid, comp, n) that are of different components and alike, a spanning forest of each tile."""
    blocks = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    tiled = open_branches.join(reps.select("rid", "sketch"), "rid").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    total = open_branches.count()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in rows.groupby("key"):
            rid, comp, block = (own[c].to_numpy() for c in ("rid", "comp", "block"))
            sketch = np.frombuffer(b"".join(own["sketch"]), np.uint8).reshape(len(own), -1)
            near = (_alike(sketch, sketch) >= threshold - MARGIN) & (comp[:, None] != comp[None, :])
            if own["i"].iloc[0] != own["j"].iloc[0]:
                near &= block[:, None] != block[None, :]
            root = rooted(near)
            some = root != np.arange(len(root))
            out.append(pd.DataFrame({"a": rid[root[some]], "b": rid[some]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    dealt = tiled.select("key", "rid", "comp", "sketch", "block", _part(F.col("key"), total), F.explode(_tiles()).alias("tile")).select("*", "tile.i", "tile.j").drop("tile")
    return materialize(dealt.groupBy("part", "i", "j").applyInPandas(compare, "a long, b long"), "ngram-branches")


def _tiles():
    """The pairs of blocks that a document of ``block``, of ``blocks``, takes part in; one pair if there is one block."""
    return F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    )


def _part(key, total: int):
    """Groups of one block share a task with others; a larger one is dealt over its pairs of blocks."""
    return F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(key), F.lit(max(1, total // 1024)))).otherwise(key).alias("part")


def linked(reps: DataFrame, threshold: float, lengths: list[int]) -> DataFrame:
    """(node, root): components of the documents that share a prefix of one of the lengths (in descending order) and are not clearly too different."""
    spark = reps.sparkSession
    trie, edges, comps = forest(reps, lengths[-1]), None, None
    for depth in lengths:
        branches = trie.select(F.xxhash64("branch", F.substring("label", 1, depth * CODE)).alias("key"), "rid")
        if edges is None:
            edges = hub_links(branches, reps, threshold)
            comps = materialize(connected_components(edges), "ngram-components")
        placed = branches.join(comps.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("comp"))
        placed = materialize(placed, "ngram-placed")
        unsettled = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "n")
        found = branch_links(materialize(placed.join(materialize(unsettled, "ngram-unsettled").hint("merge"), "key"), "ngram-open"), reps, threshold)
        release(placed)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            comps = materialize(connected_components(edges), "ngram-components")
        free_shuffles(spark)
    return comps


def tile_links(rids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and root (a member's rid) of each document of a tile; documents of unlike sides are compared, or all if there is one side."""
    sizes = np.array([len(s) for s in sets], np.int64)
    codes, seen = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(seen, minlength=len(codes)) > 1
    keep = shared[seen]
    rows, cols = rows[keep], (np.cumsum(shared) - 1)[seen[keep]]
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for start in range(0, int(shared.sum()), 8192):
        some = slice(*np.searchsorted(cols, [start, start + 8192]))
        r, c = rows[some], cols[some] - start
        m = np.zeros((len(sets), min(8192, int(shared.sum()) - start)), np.float32)
        m[r, c] = 1
        both += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    near = both >= threshold * union - 1e-6
    near &= left[:, None] != right[None, :]
    links = np.zeros(len(sets), np.int64)
    links[left] += near.sum(1)
    if side.min() != side.max():
        links[right] += near.sum(0)
    every = np.zeros((len(sets), len(sets)), bool)
    every[np.ix_(left, right)] = near
    return links, rids[rooted(every | every.T)]


def exact_links(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(rid, root, links) by tile, for members (rid, doc_id, text_hash, comp, size of the component)."""
    total = members.count()
    blocks = F.ceil(F.col("comp_size") / F.lit(TILE)).cast("int")
    keys = members.select("rid", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("block"))
    rows = _rows(docs)
    # Shuffled at every size; of rows that repeat an id and a text one is enough.
    wanted = rows.join(keys.hint("merge"), rows["doc_id"].eqNullSafe(keys["_doc"]) & (rows["text_hash"] == keys["_hash"])).dropDuplicates(["rid"])
    dealt = wanted.select("rid", "text", "comp", "block", _part(F.col("comp"), total), F.explode(_tiles()).alias("tile")).select("*", "tile.i", "tile.j").drop("tile")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        shingler, out = Shingler.own(), []
        for _, own in rows.sort_values("rid").groupby("comp"):
            if len(own) > 1:
                rids = own["rid"].to_numpy(np.int64)
                side = own["block"].to_numpy() if own["i"].iloc[0] != own["j"].iloc[0] else np.zeros(len(own), np.int64)
                links, roots = tile_links(rids, side, [shingler.shingles(t) for t in own["text"]], threshold)
                out.append(pd.DataFrame({"rid": rids, "root": roots, "links": links}))
        return pd.concat(out) if out else pd.DataFrame({"rid": [], "root": [], "links": []}, dtype="int64")

    return materialize(dealt.groupBy("part", "i", "j").applyInPandas(compare, "rid long, root long, links long"), "ngram-links")


def grouped(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: rid, doc_id, text_hash, rep (its class's rid), root (its group's), copies of its class and links of its class to others."""
    spark = docs.sparkSession
    sigs = signatures(docs)
    some = sigs.where("size > 0")
    # Stored, so that the join on classes, of which one may hold a third of all rows, can be split.
    classes = materialize(some.groupBy("c1", "c2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "ngram-sets")
    classed = materialize(sigs.select("rid", "doc_id", "text_hash", "c1", "c2").join(classes.hint("merge"), ["c1", "c2"], "left").select("rid", "doc_id", "text_hash", F.coalesce("rep", "rid").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "ngram-classes")
    reps = materialize(some.join(classes.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi").select("rid", "doc_id", "text_hash", "sketch", "labels"), "ngram-reps")
    release(sigs)
    free_shuffles(spark)
    comps = linked(reps, threshold, prefix_lengths(threshold))
    sizes = materialize(comps.groupBy("root").agg(F.count(F.lit(1)).alias("comp_size")), "ngram-sizes")
    placed = comps.join(sizes.hint("merge"), "root").select(F.col("node").alias("rid"), F.col("root").alias("comp"), "comp_size")
    members = materialize(reps.select("rid", "doc_id", "text_hash").join(placed, "rid"), "ngram-members")
    links = exact_links(docs, members, threshold)
    free_shuffles(spark)
    roots = connected_components(links.where("rid <> root"), "rid", "root").select(F.col("node").alias("rep"), F.col("root").alias("top"))
    counts = links.groupBy(F.col("rid").alias("rep")).agg(F.sum("links").alias("links"))
    info = roots.join(counts, "rep", "left")
    out = classed.join(info, "rep", "left").select("rid", "doc_id", "text_hash", "rep", F.coalesce("top", "rep").alias("root"), "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return materialize(out, "ngram-groups")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group), copy_id (of the texts with the same shingles), n_copies, n_links (classes linked to its own)."""
    rows = grouped(docs, threshold)
    # Each step is stored, so that the joins on large groups can be split.
    least = materialize(rows.groupBy("root", "rep").agg(F.min("doc_id").alias("copy_id")), "ngram-least")
    top = materialize(least.groupBy("root").agg(F.min("copy_id").alias("class_id")), "ngram-top")
    named = materialize(least.join(top.hint("merge"), "root").select("rep", "copy_id", "class_id"), "ngram-named")
    return rows.join(named.hint("merge"), "rep").select("doc_id", "class_id", "copy_id", F.col("copies").alias("n_copies"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of smallest doc_id (nulls last) of every group, with all their columns."""
    rows = grouped(docs, threshold)
    order = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    first = rows.select("root", order.alias("at")).groupBy("root").agg(F.min("at").alias("at"))
    kept = rows.select("root", "rid", "doc_id", "text_hash", order.alias("at")).join(first, ["root", "at"]).groupBy("root").agg(F.min("rid").alias("rid"))
    keys = rows.join(kept, "rid", "left_semi").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    matched = own.join(keys.distinct(), own["_id"].eqNullSafe(keys["_doc"]) & (own["_text"] == keys["_hash"]), "left_semi")
    return matched.dropDuplicates(["_id", "_text"]).select("_row.*") if _repeats(rows) else matched.select("_row.*")


def _repeats(rows: DataFrame) -> bool:
    """Whether an id and text occur in more than one row."""
    return not rows.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
