"""Near-duplicate groups by an inverted join of MinHash signatures.

Words of the lower-cased text (A-Z) are split at white space; a document is its set of
hashed word 5-grams, and documents of equal sets are one class with one
representative. A representative is posted under each of COORDS (coordinate, value)
pairs of its signature. Two documents at the threshold agree on at least MATCHES
coordinates (all but 3 pairs in 100,000 do; nearer ones practically always), so:

* postings that nobody shares go, and with them documents with fewer than MATCHES shared ones;
* of the others only a prefix is joined: two documents that agree on MATCHES of their
  s shared coordinates have one of their s - MATCHES + 1 rarest in common;
* lists of documents that are already linked are skipped; in the others collisions are counted.

Links are confirmed on full sets. First, twice, every document meets the best of the
hubs of its posting lists: groups of copies, however large, are settled in linear
work, one hub beside a stream of its documents. Then the lists that still hold
documents of different groups are counted in square tiles, where a tile returns no
more rows than it has documents, and what agrees on enough coordinates is
compared exactly in tiles of bounded sets, never within one group. No list is
capped, no pair of a group becomes a row, and what a task holds is bounded. Documents that
agree on that many coordinates and are not linked cost quadratic work, not rows.

Defined results: fewer than five words are one shingle of all; a null text, or one
without words, has size 0 and is linked with nothing; component_id is the smallest
doc_id of the group and null only if all are null; kept holds for null ids if
component_id is null; rows of equal doc_id are documents of their own; long texts are
compared whole; an empty table gives an empty result; other columns are ignored. Sets
are of 64-bit hashes of the shingles.
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
from lodestar.plans.scratch import materialize, release

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDS, MATCHES = 64, 42
#: Rounds of hubs; documents on a tile's side while collisions are counted; shingles of a block of the exact step, and of a chunk beside a hub.
ROUNDS, TILE, BLOCK, CHUNK = 2, 1024, 400_000, 2_000_000

_GOLDEN = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed((_LOWER + np.uint64(1)) * np.uint64(_GOLDEN))
_SEEDS = _mixed(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(_GOLDEN)).reshape(2, -1)
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, kept in each worker."""
    if _POWERS["n"] < n:
        for name, base in (("up", _GOLDEN), ("down", pow(_GOLDEN, -1, 1 << 64))):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
        _POWERS["n"] = 2 * n
    return _POWERS["up"], _POWERS["down"]


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the word 5-grams of a text in UTF-8."""
    raw = np.frombuffer(text or b"", np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(_GOLDEN) + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(out))


def signature(own: np.ndarray) -> np.ndarray:
    """32 bits of the least hash of the set in each coordinate."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 512):
        np.minimum(low, ((own[k : k + 512, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(0), out=low)
    return _mixed(low).astype("<u4")


def linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b shingles that share so many are linked."""
    return 100 * shared >= PERCENT * (a + b - shared)


def signatures(docs: DataFrame) -> DataFrame:
    """rid (a number of the row's own), doc_id, text_hash, size, c1 and c2 (128 bits of the set) and sig."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "size": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "sig": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, digest, text in zip(*batch.columns, strict=True):
                own = shingles(text.as_py())
                c = xxhash.xxh3_128_intdigest(own.tobytes())
                out.append((doc.as_py(), digest.as_py(), len(own), (c >> 64) - (1 << 63), (c & (1 << 64) - 1) - (1 << 63), signature(own).tobytes() if len(own) else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], list(kinds))

    done = rows.mapInArrow(run, "doc_id long, text_hash long, size long, c1 long, c2 long, sig binary")
    return materialize(done.select(F.monotonically_increasing_id().alias("rid"), "*"), "minhash-signatures")


def prefixes(reps: DataFrame) -> DataFrame:
    """(key, rid): the postings that are joined."""
    coords = F.transform(F.sequence(F.lit(0), F.lit(COORDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * 4 + 1, F.lit(4))))
    posted = reps.select("rid", F.explode(coords).alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = posted.join(shared.hint("merge"), "key").groupBy("rid").agg(F.collect_list(F.struct("n", "key")).alias("held")).where(F.size("held") >= MATCHES)
    rare = F.slice(F.sort_array("held"), F.lit(1), F.size("held") - (MATCHES - 1))
    return materialize(held.select("rid", F.explode(rare).alias("x")).select("x.key", "rid"), "minhash-prefixes")


def _matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of every two signatures the coordinates on which they agree."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(COORDS):
        out += x[:, k, None] == y[None, :, k]
    return out


def _codes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(len(column), COORDS)


def _placed(postings: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(key, rid, comp) of the lists that hold documents of different groups."""
    if comps is None:
        placed = postings.withColumn("comp", F.col("rid"))
    else:
        placed = postings.join(comps.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("comp"))
    placed = materialize(placed, "minhash-placed")
    unsettled = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    out = materialize(placed.join(unsettled.hint("merge"), "key"), "minhash-open")
    release(placed)
    return out


def hub_pairs(opened: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): each document and the hub of its lists (documents of the smallest and the largest group) that agrees with it best, if it does often enough."""
    at = F.struct("comp", "rid")
    hubs = opened.groupBy("key").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    met = opened.select("key", "rid", "comp").join(hubs, "key").select("rid", "comp", F.explode(F.array("low", "high")).alias("hub"))
    pairs = met.where("comp <> hub.comp").select(F.col("rid").alias("a"), F.col("hub.rid").alias("b")).distinct()
    sigs = reps.select("rid", "sig")
    both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((_codes(x) == _codes(y)).sum(1).astype(np.int32))

    scored = both.select("a", "b", agree("sa", "sb").alias("n")).where(F.col("n") >= MATCHES)
    return scored.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("less"))).alias("x")).select("a", (-F.col("x.less")).alias("b"))


def hub_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets are linked. A hub's set is held beside a stream of documents; those of a hot hub are dealt over chunks."""
    pairs = materialize(pairs, "minhash-pairs")
    sized = pairs.join(texts.select(F.col("rid").alias("a"), "size"), "a").groupBy("b").agg(F.ceil(F.sum("size") / F.lit(CHUNK)).cast("int").alias("chunks"))
    members = pairs.join(sized, "b").select("b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), F.col("a").alias("rid"))
    hubs = sized.select("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("b").alias("rid"))
    rows = members.unionByName(hubs).join(texts.select("rid", "text"), "rid").repartition("b", "chunk").sortWithinPartitions("b", "chunk", "role").select("role", "rid", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            out = []
            for role, rid, b, text in zip(*batch.columns, strict=True):
                own = shingles(text.as_py())
                if role.as_py() == 0:
                    hub = own
                elif linked(len(np.intersect1d(own, hub, assume_unique=True)), len(own), len(hub)):
                    out.append((rid.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    out = materialize(rows.mapInArrow(run, "a long, b long"), "minhash-links")
    release(pairs)
    return out


def spanned(near: np.ndarray, rids: np.ndarray) -> pd.DataFrame:
    """(a, b): links that join what a symmetric matrix of links joins, fewer than there are rows."""
    root = np.arange(len(near))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(near)).min(1, initial=len(near)))
        least = least[least]
        if (least == root).all():
            break
        root = least
    some = root != np.arange(len(root))
    return pd.DataFrame({"a": rids[root[some]], "b": rids[some]})


def _frames(found: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def collisions(opened: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links that join the documents of different groups in a list that agree often enough, counted in tiles."""
    n = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    dealt = opened.join(reps.select("rid", "sig"), "rid").withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    # Small lists share a task.
    part = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(max(1, opened.count() // TILE)))).otherwise(F.col("key"))
    dealt = dealt.select("key", "rid", "comp", "sig", "block", "blocks", F.explode(tiles).alias("t")).select("key", "rid", "comp", "sig", "block", part.alias("part"), "t.i", "t.j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in rows.groupby("key"):
            comp, block, codes = own["comp"].to_numpy(), own["block"].to_numpy(), _codes(own["sig"])
            near = (_matches(codes, codes) >= MATCHES) & (comp[:, None] != comp[None, :])
            if own["i"].iloc[0] != own["j"].iloc[0]:
                near &= block[:, None] != block[None, :]
            found.append(spanned(near, own["rid"].to_numpy()))
        return _frames(found)

    return materialize(dealt.groupBy("part", "i", "j").applyInPandas(compare, "a long, b long"), "minhash-collisions")


def exact_links(comps: DataFrame | None, crossing: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links that join the linked documents of different groups, compared exactly inside the components of ``crossing``.

    A component is cut into blocks of bounded sets. A large group has blocks of its own, which never meet one another.
    """
    nodes = connected_components(crossing).withColumnRenamed("node", "rid").withColumnRenamed("root", "crowd")
    if comps is not None:
        nodes = nodes.join(comps.withColumnRenamed("node", "rid").withColumnRenamed("root", "comp"), "rid", "left")
    else:
        nodes = nodes.withColumn("comp", F.lit(None).cast("long"))
    nodes = materialize(nodes.join(texts.select("rid", "size"), "rid").select("rid", "crowd", F.coalesce("comp", "rid").alias("comp"), "size"), "minhash-crowds")
    count = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    groups = nodes.groupBy("crowd", "comp").agg(F.sum("size").alias("group_size"))
    whole = groups.groupBy("crowd").agg(F.sum("group_size").alias("crowd_size"))
    shares = materialize(groups.join(whole, "crowd").select("crowd", "comp", F.when(F.col("group_size") > BLOCK, F.col("comp")).alias("pure"), F.when(F.col("group_size") > BLOCK, count("group_size")).otherwise(count("crowd_size")).alias("blocks"), (F.col("crowd_size") <= BLOCK).alias("small")), "minhash-shares")
    placed = nodes.join(shares, ["crowd", "comp"]).withColumn("block", F.xxhash64("pure", F.pmod(F.xxhash64("rid"), F.col("blocks"))))
    placed = materialize(placed.select("rid", "crowd", "comp", "size", "pure", "block", "small"), "minhash-blocks")
    blocks = placed.select("crowd", F.col("block").alias("other"), F.col("pure").alias("other_pure")).distinct()
    pairs = placed.join(blocks, "crowd").where("pure is null or other_pure is null or pure <> other_pure").withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    total = placed.agg(F.sum("size")).first()[0] or 0
    part = F.when(F.col("small"), F.pmod(F.xxhash64("crowd"), F.lit(1 + total // BLOCK))).otherwise(F.col("crowd"))
    at = lambda c: F.when(F.col("small"), F.lit(0)).otherwise(F.col(c)).alias(c)
    dealt = pairs.select("rid", "crowd", "comp", "block", (F.col("i") == F.col("j")).alias("alone"), part.alias("part"), at("i"), at("j")).join(texts.select("rid", "text"), "rid").join(reps.select("rid", "sig"), "rid")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in rows.groupby("crowd"):
            comp, block, codes, rids = own["comp"].to_numpy(), own["block"].to_numpy(), _codes(own["sig"]), own["rid"].to_numpy()
            asked = (_matches(codes, codes) >= MATCHES) & (comp[:, None] != comp[None, :])
            if not own["alone"].iloc[0]:
                asked &= block[:, None] != block[None, :]
            if not asked.any():
                continue
            sets = [shingles(t) for t in own["text"]]
            sizes = np.array([len(s) for s in sets])
            names, places = np.unique(np.concatenate(sets), return_inverse=True)
            starts, mark = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.zeros(len(names), np.int32)
            near = np.zeros(asked.shape, bool)
            for x in np.flatnonzero(np.triu(asked).any(1)):
                mine = places[starts[x] : starts[x] + sizes[x]]
                mark[mine] = 1
                near[x] = asked[x] & linked(np.add.reduceat(mark[places], starts), sizes[x], sizes)
                mark[mine] = 0
            found.append(spanned(near | near.T, rids))
        return _frames(found)

    return materialize(dealt.groupBy("part", "i", "j").applyInPandas(compare, "a long, b long"), "minhash-exact")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sigs = signatures(docs)
    some = sigs.where("size > 0")
    # Tables of classes are stored, so that joins on a class that holds a third of all rows can be split.
    classes = materialize(some.groupBy("c1", "c2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least")), "minhash-classes")
    reps = materialize(some.join(classes.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi").select("rid", "doc_id", "text_hash", "size", "sig"), "minhash-reps")
    postings = prefixes(reps)
    live = postings.select("rid").distinct()
    wanted = reps.join(live, "rid", "left_semi").select("rid", "size", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text"))
    matched = rows.join(wanted.hint("merge"), rows["doc_id"].eqNullSafe(wanted["_doc"]) & (rows["text_hash"] == wanted["_hash"]))
    texts = materialize(matched.dropDuplicates(["rid"]).select("rid", "size", "text"), "minhash-texts")

    edges = comps = None
    for _ in range(ROUNDS):
        opened = _placed(postings, comps)
        found = hub_links(hub_pairs(opened, reps), texts)
        release(opened)
        edges = found if edges is None else edges.unionByName(found)
        comps = materialize(connected_components(edges), "minhash-components")
    opened = _placed(postings, comps)
    crossing = collisions(opened, reps)
    edges = edges.unionByName(exact_links(comps, crossing, texts, reps))
    release(opened, crossing, texts, postings)
    comps = materialize(connected_components(edges), "minhash-components")

    placed = materialize(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", "least", F.coalesce("root", "rep").alias("root")), "minhash-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = materialize(placed.join(least.hint("merge"), "root").select("c1", "c2", "component"), "minhash-named")
    out = sigs.select("doc_id", "size", "c1", "c2").join(named.hint("merge"), ["c1", "c2"], "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
