"""The hierarchical Pitman-Yor model with a restaurant for each whole word before, and language-model scores by it.

`lm` seats the same customers in 256 classes of contexts; here no two words share a restaurant. The tables of all restaurants are
customers of one parent, whose base is even over the known words and one class of unknown ones. A pair (word before, word) that was counted
once sits at one table in every sweep, so only pairs of more customers move.

The work is done in steps. Blocks of texts, parts of the words and parts of the pairs are each dealt out by a hash, so that a frequent word's pairs are
spread over all parts; a step gathers what was sent to each of them as packed arrays and sends packed arrays on (`_step`). Parts of words number
their words. Parts of pairs hold the pairs and their tables; parts of words add up what the restaurants have, and answer each part of pairs in the order
of the words that it once named, so no word is sent again. Each step is stored, and what it replaces is removed.

Words go by 64 bits of XXH64. Every word of the corpus is held against a second hash of 64 bits; where two words share the first, all is counted
again with another seed, so that no two words are taken for one. Random numbers are hashes of pair, sample, sweep and customer, so
results don't depend on partitions. Nothing that grows with the corpus is held by the driver or by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, removed, stored_at
from .lm import HOT, ROUNDS, SAMPLES, SCORED, STRENGTH, SWEEPS, Totals, held_out, mixed, seat, tokens  # noqa: F401

#: Unused since no word or pair is broadcast, as are HOT and SCORED; tests that vary the layout set them.
HOT_PAIRS = 1 << 18
#: Bytes of text in a block.
COUNTED = 8_000_000
#: Bytes of text for each part of words and of pairs; at least spark.sql.shuffle.partitions parts are made.
PART = 48_000_000
MESSAGES = "side string, to long, kind int, source long, data binary"
#: Kinds of what a block, a part of words and a part of pairs gets.
TOKENS, IDS, SCORES = range(3)
SPELLED, KNOWN, LISTS, UP, MORE = range(5)
FOUND, PAIRS, MOVED, VALUES = range(4)
HEAD = struct.Struct("<2sqq")

Held = dict[int, list[tuple[int, list[np.ndarray]]]]
Message = tuple[str, int, int, int, bytes]


def word_keys(words: pa.Array, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in words.to_pylist()), np.uint64, len(words)).view(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, the first bytes of all numbers before the second, so that small numbers take little room."""
    out, codec = [], pa.Codec("zstd", compression_level=1)
    for x in arrays:
        x = np.ascontiguousarray(x)
        body = codec.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), asbytes=True) if len(x) else b""
        out += HEAD.pack(x.dtype.str[1:].encode(), len(x), len(body)), body
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, codec, at = [], pa.Codec("zstd"), 0
    while at < len(data):
        kind, n, size = HEAD.unpack_from(data, at)
        at += HEAD.size
        kind = np.dtype(kind.decode())
        raw = np.frombuffer(codec.decompress(data[at : at + size], n * kind.itemsize, asbytes=True) if n else b"", dtype=np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += size
    return out


def _rising(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences."""
    return np.diff(x.astype(np.int64), prepend=0)


def _halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs, to be packed: differences of the words before, and the words."""
    return _rising(pairs >> np.uint64(32)), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _whole(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.cumsum(before).astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def _dealt(home: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by home, where each of the n homes begins in it, and the end)."""
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(n + 1).astype(home.dtype))


def _named(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids by their part of words, the place there of each of `ids`, where each part begins)."""
    found, at = np.unique(ids, return_inverse=True)
    order, starts = _dealt(found % np.uint64(parts), parts)
    place = np.empty(len(found), dtype=np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[at], starts


def _message(rows: list[Message]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["side", "to", "kind", "source", "data"])


def _step(inputs: list[DataFrame], parts: int, run: Callable[[int, Held], Iterator], schema: str = MESSAGES) -> DataFrame:
    """What `run` makes of all messages to each receiver, by kind, each kind in the order of its senders. It yields messages, or batches of another schema."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                rows = list(run(last, held))
                if rows and isinstance(rows[0], pa.RecordBatch):
                    yield from rows
                for at in range(0, len(rows), 256) if rows and isinstance(rows[0], tuple) else ():
                    yield _message(rows[at : at + 256])
                pa.default_memory_pool().release_unused()

        last, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                to, kind, source, data = (batch.column(x)[i].as_py() for x in ("to", "kind", "source", "data"))
                if to != last:
                    yield from ended()
                    last, held = to, {}
                held.setdefault(kind, []).append((source, unpack(data)))
        yield from ended()

    rows = reduce(DataFrame.unionAll, [x.select("to", "kind", "source", "data") for x in inputs])
    return rows.repartition(parts, "to").sortWithinPartitions("to", "kind", "source").mapInArrow(each, schema)


class Tables:
    """The stored messages of the steps."""

    def __init__(self, spark):
        self.spark, self.at = spark, {}

    def store(self, name: str, df: DataFrame) -> None:
        """`df` stored under `name`; what had that name is removed. The shuffles that made it are removed with it where Spark can."""
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(clean, None)
        self.spark.conf.set(clean, "true")
        try:
            new = stored_at(df, name)
        finally:
            self.spark.conf.unset(clean) if was is None else self.spark.conf.set(clean, was)
        self.remove(name)
        self.at[name] = new

    def of(self, name: str, side: str) -> DataFrame:
        return self.at[name][0].where(F.col("side") == side)

    def sums(self, name: str) -> np.ndarray:
        """The sum of the numbers that each receiver sent to the driver."""
        return sum((unpack(bytes(r["data"]))[0] for r in self.of(name, "sum").select("data").collect()), np.zeros(1))

    def remove(self, *names: str) -> None:
        for name in names:
            if name in self.at:
                removed(self.spark, self.at.pop(name)[1])


def _cut(seed: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The tokens of each block of texts, as places in its list of words; and to each part of words what the block has of it: keys, second hashes, training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch, most=COUNTED):
                found, m = tokens(part.column("text")), part.num_rows
                keys, others = (word_keys(found.words, x).view(np.uint64) for x in (seed, ~seed & 0xFFFFFFFF))
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                c = np.bincount(found.word[~held[found.doc]], minlength=len(keys)).astype(np.int64)
                order, starts = _dealt(keys % np.uint64(parts), parts)
                place = np.empty(len(keys), dtype=np.uint32)
                place[order] = np.arange(len(keys))
                ids = part.column("doc_id")
                sizes = np.bincount(found.doc, minlength=m).astype(np.int64)
                rows = [("block", block, TOKENS, 0, pack(place[found.word], sizes, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), held))]
                for w in np.flatnonzero(np.diff(starts)).tolist():
                    at = order[starts[w] : starts[w + 1]]
                    rows.append(("word", w, SPELLED, block, pack(keys[at], others[at], c[at])))
                yield _message(rows)
                block += 1
            pa.default_memory_pool().release_unused()

    return run


def _number(parts: int) -> Callable[[int, Held], Iterator[Message]]:
    """Numbers of the words of a part, frequent ones first, and their training tokens, told to the blocks that have them."""

    def run(w: int, held: Held) -> Iterator[Message]:
        keys, others, c = (np.concatenate([x[i] for _, x in held[SPELLED]]) for i in range(3))
        found, first, at = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, at, c)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(found), dtype=np.int64)
        rank[order] = np.arange(len(found))
        ids = rank * parts + w
        if ids.max() >> 32:
            raise ValueError("a corpus of more than 2^32 distinct words needs wider numbers of words")
        yield "word", w, KNOWN, 0, pack(found[order], total[order])
        yield "sum", 0, 0, w, pack(np.array([(others != others[first][at]).sum(), total.sum(), (total > 0).sum()]))
        ends = np.cumsum([len(x[0]) for _, x in held[SPELLED]])
        for (block, x), end in zip(held[SPELLED], ends, strict=True):
            own = at[end - len(x[0]) : end]
            yield "block", block, IDS, w, pack(ids[own].astype(np.uint32), total[own])

    return run


def _block_pairs(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs of a block's tokens, which of them each token ends, their order by part, where each part begins). Before the first is an end, as the last is."""
    words = words.astype(np.uint64)
    pairs, at = np.unique(np.append(words[-1:], words[:-1]) << np.uint64(32) | words, return_inverse=True)
    return pairs, at, *_dealt(mixed(pairs) % np.uint64(parts), parts)


def _pair(parts: int, floor: float) -> Callable[[int, Held], Iterator[Message]]:
    """A block's tokens by the numbers of words, with what doesn't ask for pairs: known tokens and base scores; to each part of pairs, the block's and their counts in training texts."""

    def run(block: int, held: Held) -> Iterator[Message]:
        tokens, sizes, ids, valid, out = held[TOKENS][0][1]
        of, c = (np.concatenate([x[i] for _, x in held[IDS]]) for i in range(2))
        doc, words = np.repeat(np.arange(len(sizes)), sizes), of[tokens]
        known = np.bincount(doc, c[tokens] > 0, len(sizes)).astype(np.int64)
        base = np.bincount(doc, (np.log10(c + 1.0) - floor)[tokens], len(sizes))
        yield "block", block, TOKENS, 0, pack(words, sizes, ids, valid, out, known, base)
        pairs, at, order, starts = _block_pairs(words, parts)
        n = np.bincount(at[~out[doc]], minlength=len(pairs)).astype(np.int64)
        for p in np.flatnonzero(np.diff(starts)).tolist():
            own = order[starts[p] : starts[p + 1]]
            yield "part", p, FOUND, block, pack(*_halves(pairs[own]), n[own])

    return run


def _merge(parts: int) -> Callable[[int, Held], Iterator[Message]]:
    """The pairs of a part and their counts; to each part of words the ranks of words before and of words, in how many pairs of training texts, and whether some of them move."""

    def run(p: int, held: Held) -> Iterator[Message]:
        found = [(_whole(x[0], x[1]), x[2]) for _, x in held[FOUND]]
        pairs, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        c = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(c, at, np.concatenate([x for _, x in found]))
        yield "part", p, PAIRS, 0, pack(*_halves(pairs), c)
        yield "sum", 0, 0, p, pack(np.array([(c == 1).sum(), (c == 2).sum()]))
        sides = []
        for ids in (pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)):
            names, at, starts = _named(ids, parts)
            often, moves = (np.bincount(at[x], minlength=len(names)) for x in (c > 0, c > 1))
            sides.append((names // np.uint64(parts), often, moves > 0, starts))
        for w in range(parts):
            own = [[x[s[w] : s[w + 1]] for x in (names, often, moves)] for names, often, moves, s in sides]
            if len(own[0][0]) + len(own[1][0]):
                yield "word", w, LISTS, p, pack(*(y for names, often, moves in own for y in (_rising(names), often, moves)))

    return run


def _words(held: Held) -> dict:
    """What a part of words knows of them: keys, c, wide, many, and by part of pairs (ranks before, which move; ranks of words, which move); more: tables that came."""
    keys, c = held[KNOWN][0][1]
    wide, many, lists = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64), {}
    for p, (before, often, moves, word, times, move) in held.get(LISTS, ()):
        before, word = np.cumsum(before), np.cumsum(word)
        wide[before] += often
        many[word] += times
        lists[p] = before, moves, word, move
    tables, m = (np.repeat(x[:, None], SAMPLES, axis=1) for x in (wide, many))
    for p, more in held.get(MORE, ()):
        before, moves, word, move = lists[p]
        tables[before[moves]] += np.stack(more[:SAMPLES], axis=1)
        m[word[move]] += np.stack(more[SAMPLES:], axis=1)
    up = np.stack(held[UP][0][1], axis=1) if UP in held else np.repeat((many > 0)[:, None], SAMPLES, axis=1).astype(np.int64)
    return {"keys": keys, "c": c, "many": many, "tables": tables, "m": m, "up": up, "lists": lists}


def _add_up(sweep: int, last: Totals | None, all_names: bool, told: bool) -> Callable[[int, Held], Iterator[Message]]:
    """A part of words after a sweep: its customers in the parent seated anew, and tables, m and up of the words that each part of pairs named, of those in pairs that move or of all.

    Before the first sweep, -1, nothing is seated. With all names, customers are added; keys where they are told."""

    def run(w: int, held: Held) -> Iterator[Message]:
        x = _words(held)
        keys, c, tables, m, up = (x[k] for k in ("keys", "c", "tables", "m", "up"))
        if sweep >= 0:
            for s in range(SAMPLES):
                turn = np.uint64((1 + sweep * SAMPLES + s) << 33)
                up[:, s] = seat(m[:, s], np.full(len(keys), 1 / (last.known + 1)), np.maximum(last.parent[s] - up[:, s], 0), last.discounts[1], mixed(keys + turn)).astype(np.int64)
        yield "word", w, UP, 0, pack(*up.T)
        yield "sum", 0, 0, w, pack(np.concatenate([m.sum(axis=0), up.sum(axis=0), [(x["many"] == 1).sum(), (x["many"] == 2).sum()]]))
        for p, (before, moves, word, move) in x["lists"].items():
            b, o = (before, word) if all_names else (before[moves], word[move])
            yield "part", p, VALUES, w, pack(*tables[b].T, *m[o].T, *up[o].T, *([c[b]] if all_names else []), *([keys[b], keys[o]] if told else []))

    return run


def _values(held: Held, n: int) -> list[np.ndarray]:
    return [np.concatenate([x[i] for _, x in held[VALUES]]) for i in range(n)]


def _seat_pairs(last: Totals, sweep: int, parts: int) -> Callable[[int, Held], Iterator[Message]]:
    """A part of pairs after all customers of each pair that moves have been seated anew, given the tables of all others; the tables beyond one, added up, to the parts of words.

    After the last sweep only the tables are kept."""

    def run(p: int, held: Held) -> Iterator[Message]:
        if sweep:
            before, word, c, entry, *t = held[MOVED][0][1]
            pairs = _whole(before, word)
        else:
            before, word, c = held[PAIRS][0][1]
            pairs, c = _whole(before, word)[c > 1], c[c > 1]
            t = [np.ones(len(c), dtype=np.int64)] * SAMPLES
        sides = [_named(x, parts) for x in (pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF))]
        b, o = sides[0][1], sides[1][1]
        values = _values(held, 3 * SAMPLES + 2 * (not sweep))
        if not sweep:
            entry = mixed(values[-1][o] ^ mixed(values[-2][b] + np.uint64(1)))
        more, after = [[], []], []
        for s in range(SAMPLES):
            tables, m, up = (values[i * SAMPLES + s][at] for i, at in enumerate((b, o, o)))
            left = m - t[s]  # customers of the parent when those of the pair have left
            share = last.share(left, np.minimum(up, left), s)
            after.append(seat(c, share, np.maximum(tables - t[s], 0), last.discounts[0], mixed(entry + np.uint64((1 + sweep * SAMPLES + s) << 32))).astype(np.int64))
            for i, (names, at, _) in enumerate(sides):
                more[i].append(np.bincount(at, after[-1] - 1, len(names)).astype(np.int64))
        yield "part", p, MOVED, 0, pack(*after) if sweep == ROUNDS * SWEEPS - 1 else pack(*_halves(pairs), c, entry, *after)
        for w in range(parts):
            (b0, b1), (o0, o1) = (x[2][w : w + 2] for x in sides)
            if b1 > b0 or o1 > o0:
                yield "word", w, MORE, p, pack(*(x[b0:b1] for x in more[0]), *(x[o0:o1] for x in more[1]))

    return run


def _tables(held: Held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of a part, c, tables in each sample) after the sweeps."""
    before, word, c = held[PAIRS][0][1]
    t = np.repeat((c > 0)[:, None], SAMPLES, axis=1).astype(np.int64)
    t[c > 1] = np.stack(held[MOVED][0][1], axis=1)
    return _whole(before, word), c, t


def _score_pairs(last: Totals, parts: int) -> Callable[[int, Held], Iterator[Message]]:
    """log10 probabilities of each block's pairs, in the order in which it named them, as floats of 32 bits."""

    def run(p: int, held: Held) -> Iterator[Message]:
        pairs, c, t = _tables(held)
        (_, b, _), (_, o, _) = (_named(x, parts) for x in (pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)))
        values = _values(held, 3 * SAMPLES + 1)
        total = np.zeros(len(pairs))
        for s in range(SAMPLES):
            share = last.share(values[SAMPLES + s], values[2 * SAMPLES + s], s)[o]
            total += np.maximum(c - last.discounts[0] * t[:, s], 0) + (STRENGTH + last.discounts[0] * values[s])[b] * share
        logs = np.log10(total / SAMPLES / (STRENGTH + values[-1][b])).astype(np.float32)
        for block, x in held[FOUND]:
            yield "block", block, SCORES, p, pack(logs[np.searchsorted(pairs, _whole(x[0], x[1]))])

    return run


def _score_texts(parts: int) -> Callable[[int, Held], Iterator[pa.RecordBatch]]:
    def run(block: int, held: Held) -> Iterator[pa.RecordBatch]:
        words, sizes, ids, valid, out, known, base = held[TOKENS][0][1]
        score = np.zeros(len(sizes))
        if SCORES in held:
            pairs, at, order, _ = _block_pairs(words, parts)
            logs = np.empty(len(pairs))
            logs[order] = np.concatenate([x[0] for _, x in held[SCORES]])
            score = np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs[at], len(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(out), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


@dataclass
class Pairs:
    """All pairs of the words of some texts, counted: the stored steps, the number of parts, training tokens, known words."""

    tables: Tables
    parts: int
    n: int
    known: int


def count_pairs(texts: DataFrame, first: int = 42) -> tuple[Pairs, int]:
    """All pairs of `texts` (text, held_out, and doc_id if there is one), counted in those that aren't held out; and the seed by which no two words share a key."""
    spark, seed = texts.sparkSession, first
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART + 1)
    texts = texts.select(F.col("doc_id") if "doc_id" in texts.columns else F.lit(None).cast("long").alias("doc_id"), "text", "held_out")
    tables = Tables(spark)
    while True:
        tables.store("cut", texts.mapInArrow(_cut(seed, parts), MESSAGES))
        tables.store("known", _step([tables.of("cut", "word")], parts, _number(parts)))
        clashes, n, known = [int(x) for x in np.resize(tables.sums("known"), 3)]
        if not clashes:
            break
        seed += 1
    floor = float(np.log10(n + known + 1))
    tables.store("blocks", _step([tables.of("cut", "block"), tables.of("known", "block")], parts, _pair(parts, floor)))
    tables.remove("cut")
    return Pairs(tables, parts, n, known), seed


def _seating(pairs: Pairs, told: bool = False) -> Totals | None:
    """The totals after all sweeps, whose tables are stored under "seated" and "added", with keys where they are told; None without training texts."""
    x, parts, sweeps = pairs.tables, pairs.parts, ROUNDS * SWEEPS
    if not pairs.known:
        return None
    x.store("merged", _step([x.of("blocks", "part")], parts, _merge(parts)))
    known = [x.of("known", "word"), x.of("merged", "word")]
    x.store("added", _step(known, parts, _add_up(-1, None, False, True)))
    of = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5
    sums = x.sums("added")
    discounts = of(*x.sums("merged")), of(*sums[2 * SAMPLES :])
    for sweep in range(sweeps):
        last = Totals(np.array([pairs.n]), sums[None, :SAMPLES], sums[SAMPLES : 2 * SAMPLES], discounts, pairs.known)
        held = x.of("seated", "part") if sweep else x.of("merged", "part")
        x.store("seated", _step([held, x.of("added", "part")], parts, _seat_pairs(last, sweep, parts)))
        final = sweep == sweeps - 1
        x.store("added", _step([*known, x.of("added", "word"), x.of("seated", "word")], parts, _add_up(sweep, last, final, final and told)))
        sums = x.sums("added")
    return Totals(np.array([pairs.n]), sums[None, :SAMPLES], sums[SAMPLES : 2 * SAMPLES], discounts, pairs.known)


def sample_seating(pairs: Pairs) -> tuple[DataFrame, DataFrame, Totals] | None:
    """(pairs of training texts with c and t, their tables in each sample; words; totals) after all sweeps, None without training texts.

    The words' table: key; c, which are also the customers of the word's own restaurant; tables, of that restaurant; m, up, the word's customers
    and tables in the parent. Of the totals, tables has one row with the customers of the parent."""
    last = _seating(pairs, told=True)
    if last is None:
        return None
    x, parts = pairs.tables, pairs.parts
    lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a, dtype=float).ravel()), SAMPLES).cast(pa.list_(pa.float64()))

    def seen(p: int, held: Held) -> Iterator[pa.RecordBatch]:
        ids, c, t = _tables(held)
        (_, b, _), (_, o, _) = (_named(y, parts) for y in (ids >> np.uint64(32), ids & np.uint64(0xFFFFFFFF)))
        *_, before, word = _values(held, 3 * SAMPLES + 3)
        yield pa.RecordBatch.from_arrays([pa.array(before[b].view(np.int64)[c > 0]), pa.array(word[o].view(np.int64)[c > 0]), pa.array(c[c > 0]), lists(t[c > 0])], ["before", "word", "c", "t"])

    def words(w: int, held: Held) -> Iterator[pa.RecordBatch]:
        y = _words(held)
        own = y["c"] > 0
        yield pa.RecordBatch.from_arrays([pa.array(y["keys"].view(np.int64)[own]), pa.array(y["c"][own]), *(lists(y[k][own]) for k in ("tables", "m", "up"))], ["key", "c", "tables", "m", "up"])

    numbers = "array<double>"
    pairs_seen = _step([x.of("merged", "part"), x.of("seated", "part"), x.of("added", "part")], parts, seen, f"before long, word long, c long, t {numbers}")
    words_seen = _step([x.of("known", "word"), x.of("merged", "word"), x.of("added", "word"), x.of("seated", "word")], parts, words, f"key long, c long, tables {numbers}, m {numbers}, up {numbers}")
    return pairs_seen, words_seen, last


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of `docs` (doc_id, text).

    Learnt from the rows that aren't held out (crc32 of doc_id mod 7 is 2). A null or empty text is its end alone. After a word that training
    texts lack, words have their probability in the parent; an unknown word has that of the one class of unknown words, as in the base score.
    Without training rows both scores are 0, the log of 1. Rows that repeat score alike and count each in training. Other columns are ignored; no rows give no rows."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    pairs, _ = count_pairs(rows)
    x, parts, last = pairs.tables, pairs.parts, _seating(pairs)
    inputs = [x.of("blocks", "block")]
    if last is not None:
        x.remove("known")
        x.store("scores", _step([x.of("blocks", "part"), x.of("merged", "part"), x.of("seated", "part"), x.of("added", "part")], parts, _score_pairs(last, parts)))
        inputs.append(x.of("scores", "block"))
    x.remove("known", "merged", "seated", "added")
    out = _step(inputs, parts, _score_texts(parts), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(pairs.n).cast("long").alias("train_tokens"), "base_score", "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
