"""SimHash near-duplicates: fingerprints of word shingles, linked through a Gray-ordered hierarchical index.

Two fingerprints within `RADIUS` = 3 differing bits agree in at least one of four 16-bit blocks, so each
fingerprint goes to the four groups named by a block and its value: the shared masked pattern that is the top node of a
subtree. Inside a group the fingerprints are sorted by Gray rank. The sorted order makes every shared prefix a
run, so the levels below, of four bits each, are nodes over runs. Pairs of nodes are walked down from the top;
each carries the differences counted so far and is dropped, with all below it, once they exceed the radius. Nodes
whose members are already in one component are dropped too, so a dense group of copies costs no walk over all pairs.

Only the links of a spanning forest leave a task. The components of all links are found by star contraction on
tables written to the shared folder; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, split_join, stored

RADIUS = 3
SEED = 42
#: A group of more fingerprints than this is dealt out as pairs of its parts.
SPLIT = 100_000
#: Pairs of nodes walked down at a time, and index entries that are gathered before whole groups of them are linked.
WALK, GATHER = 1_000_000, 200_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text's word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), dtype="<u8", count=len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of `hashes`."""
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        part = np.ascontiguousarray(hashes[at : at + 16384], dtype="<u8")
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash (64 bits of the text, for rows that share an id) and fingerprint (signed) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                values = np.array([fingerprint(x, shingle) for x in byte_texts(part.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(values.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each 64-bit number in the order in which neighbours differ by one bit."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Components of numbered members, merged by arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
                while True:
                    up = self.root[self.root]
                    if np.array_equal(up, self.root):
                        break
                    self.root = up


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, counts[i] times i, and beside it 0 .. counts[i] - 1."""
    who = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return who, np.arange(len(who)) - first[who]


def link_groups(block: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) fingerprints of a spanning forest of all links within groups that agree in a block.

    block: 0 to 3 for each entry; fps: uint64. Entries of one block with equal bits there form a group."""
    members, member = np.unique(fps, return_inverse=True)
    shift = (np.uint64(16) * block.astype(np.uint64)) & np.uint64(63)
    turned = np.where(shift > 0, (fps << shift) | (fps >> ((np.uint64(64) - shift) & np.uint64(63))), fps)
    order = np.lexsort((gray_rank(turned), block))
    block, turned, member = block[order], turned[order], member[order]
    keep = np.ones(len(turned), dtype=bool)
    keep[1:] = (turned[1:] != turned[:-1]) | (block[1:] != block[:-1])
    block, turned, member = block[keep], turned[keep], member[keep]
    n = len(turned)
    forest = Forest(len(members))
    for lag in range(1, 9):  # neighbours in Gray order
        if n > lag:
            near = np.flatnonzero((block[lag:] == block[:-lag]) & (np.bitwise_count(turned[lag:] ^ turned[:-lag]) <= radius))
            forest.link(member[near], member[near + lag])

    # starts[k]: where the nodes of level k begin; a node of level k shares the first 16 + 4k bits.
    starts = []
    for level in range(13):
        prefix = turned >> np.uint64(64 - 16 - 4 * level)
        new = np.ones(n, dtype=bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (block[1:] != block[:-1])
        starts.append(np.append(np.flatnonzero(new), n))

    def uniform(level: int) -> np.ndarray:
        """For each node its component, or -1 if it has several."""
        roots, at = forest.root[member], starts[level][:-1]
        low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
        return np.where(low == high, low, -1)

    tops = np.flatnonzero(np.diff(starts[0]) > 1)
    walk = [(0, tops[i : i + WALK], tops[i : i + WALK], np.zeros(len(tops[i : i + WALK]), dtype=np.int64)) for i in range(0, len(tops), WALK)]
    while walk:
        level, a, b, apart = walk.pop()
        one = uniform(level)
        done = (one[a] >= 0) & (one[a] == one[b])
        a, b, apart = a[~done], b[~done], apart[~done]
        at = starts[level]
        single = (at[a + 1] - at[a] == 1) & (at[b + 1] - at[b] == 1)
        x, y = at[a[single]], at[b[single]]
        near = np.bitwise_count(turned[x] ^ turned[y]) <= radius
        forest.link(member[x[near]], member[y[near]])
        a, b, apart = a[~single], b[~single], apart[~single]
        if not len(a) or level == 12:
            continue
        below = np.searchsorted(starts[level + 1], at)  # the first child of each node
        wide, high = below[a + 1] - below[a], below[b + 1] - below[b]
        total = wide * high
        if len(a) > 1 and total.sum() > 4 * WALK:
            half = len(a) // 2
            walk += [(level, a[:half], b[:half], apart[:half]), (level, a[half:], b[half:], apart[half:])]
            continue
        pair, k = _spread(total)
        left, right = below[a][pair] + k // high[pair], below[b][pair] + k % high[pair]
        bits = turned[starts[level + 1][:-1]] >> np.uint64(64 - 16 - 4 * (level + 1)) & np.uint64(15)
        apart = apart[pair] + np.bitwise_count(bits[left] ^ bits[right])
        keep = (apart <= radius) & (left <= right)
        left, right, apart = left[keep], right[keep], apart[keep]
        for i in range(0, len(left), WALK):
            walk.append((level + 1, left[i : i + WALK], right[i : i + WALK], apart[i : i + WALK]))
    linked = np.flatnonzero(forest.root != np.arange(len(members)))
    return members[linked], members[forest.root[linked]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a forest with the components of all pairs of `prints` (distinct, column fp) within `radius` <= 3 bits."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find pairs of at most 3 differing bits")
    spark = prints.sparkSession
    by_block = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("bits")) for i in range(4)])).alias("k")).select("fp", "k.*")
    # At most 4 x 65536 groups exist, so the table of large ones has a proven bound.
    large = by_block.groupBy("block", "bits").count().where(F.col("count") > SPLIT).select("block", "bits", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts"))
    rows = by_block.join(F.broadcast(large), ["block", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.select("fp", "block", "bits", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))).alias("deal"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, which follow each other, at least GATHER entries at a time: a group has at most about 2 * SPLIT."""
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "block", "fp")]))
            if sum(x.shape[1] for x in held) < GATHER:
                continue
            rows = np.concatenate(held, axis=1)
            done = int(np.searchsorted(rows[0], rows[0, -1]))  # where the last group, which may go on, begins
            held = [rows[:, done:]]
            if done:
                yield linked(rows[:, :done])
        if held and held[0].shape[1]:
            yield linked(np.concatenate(held, axis=1))

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        a, b = link_groups(rows[1].astype(np.int8), rows[2].view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    group = F.xxhash64("block", "bits", "deal")
    dealt = rows.withColumn("group", group).repartition(parts, "group").sortWithinPartitions("group", "block", "bits", "deal")
    return dealt.select("group", "block", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b), root being its component's least node; alternating star contraction."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        # A centre has an edge for each member of its component: its edges meet the centre's row by split joins.
        both = now.union(now.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("edges")).select("u", F.least("u", "m").alias("m"), "edges"), "least")
        large = stored(split_join(both.where("v > u").select("u", "v"), least, "u", "edges").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        down = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")), "down")
        small = split_join(large, down, "u", "edges").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = stored(small, "stars")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 lower-case hex digits), component_id and group of each row of `docs` (doc_id, text).

    component_id is the least doc_id reachable over fingerprints at most `radius` bits apart, the row's own
    included. A null or empty text, or one of white space, has fingerprint zero and is linked like any other. Rows
    that repeat share a fingerprint and so a component. A null doc_id is never a component's name unless
    the component has no other; group, its least fingerprint, names it in any case. Other columns are ignored; no rows give no rows."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "prints")
    roots = components(links(prints.select("fp"), radius))
    named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    linked = named.where("root <> fp")
    # The names are aggregates, and a large component's members meet its name by broadcast.
    names = linked.groupBy("root").agg(F.min("least").alias("others"), F.count("*").alias("members"))
    names = stored(names.join(prints, names.root == prints.fp).select("root", F.least("others", "least").alias("component_id"), "members"), "names")
    of_linked = split_join(linked.select("fp", "copies", "root"), names, "root", "members").select("fp", "copies", "component_id", "root")
    of_roots = names.select(F.col("root").alias("fp"), "component_id").join(prints.select("fp", "copies"), "fp").select("fp", "copies", "component_id", F.col("fp").alias("root"))
    alone = named.where("root = fp").join(names.select(F.col("root").alias("fp")), "fp", "left_anti").select("fp", "copies", F.col("least").alias("component_id"), "root")
    members = of_linked.unionByName(of_roots).unionByName(alone)
    found = split_join(rows, stored(members, "members"), "fp", "copies")
    return found.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.lower(F.lpad(F.hex("root"), 16, "0")).alias("group"))
