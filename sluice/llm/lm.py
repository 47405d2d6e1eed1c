"""Language-model scores by a hierarchical Pitman-Yor model whose seating is sampled.

Training tokens sit in context restaurants, one for each of 256 classes of the word before (by its last two bytes). Their
tables are customers of one restaurant of all words, the parent that the contexts share; its own tables draw words evenly
from the V known words and one more, which stands for every unknown word. Seating is sampled by Gibbs sweeps: in turn all
customers of a word leave a restaurant and are seated again by the Chinese-restaurant rule, given the tables of all others; then
those of the parent. Words meet only in the numbers of tables of whole restaurants, which are summed over all words between
rounds of sweeps, so each word is seated where it lies. Every random number is a hash of the word, its context, sample, sweep
and customer, so results don't depend on partitions. Probabilities are averaged over several samples and, after any
context, add up to one.

Customers are seated one at a time up to SINGLE; beyond, in blocks of a GROWTH-th of those seated, whose new tables are one
binomial draw at the middle of the block. A test holds the mean number of tables that this gives within one per cent of seating one at a time.

All counts are made by distributed aggregation and grow with the corpus. The driver holds the numbers of tables of
restaurants; the scores of at most HOT words are broadcast; all other words meet the documents that use them in a hashed join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, stored

#: Independent chains that are averaged; rounds between which tables are summed over all words; sweeps in a round.
SAMPLES, ROUNDS, SWEEPS = 3, 2, 2
#: Classes of the word before; a class is one byte.
CONTEXTS = 256
#: Words, the most frequent, whose scores after every context each task holds.
HOT = 1 << 15
#: Bytes of text that a task counts and scores at a time, and bytes of packed counts that it seats at a time.
COUNTED, SCORED, SEATED = 16_000_000, 4_000_000, 2_000_000
SINGLE, GROWTH = 64, 64
STRENGTH = 1.0
PACKED = np.dtype([("context", "u1"), ("n", "<i8")])


def _classes() -> np.ndarray:
    """For each byte its class of 6 bits: letters apart from each other, the rest in groups."""
    fine = np.zeros(256, dtype=np.int64)
    for b in range(256):
        if 0x61 <= b <= 0x7A:
            fine[b] = b - 0x60
        elif b >= 0x80:
            fine[b] = (32 if b < 0xC0 else 48) + b % 16
        else:
            fine[b] = 27 if 0x30 <= b <= 0x39 else 28 + b % 4
    return fine


FINE = _classes()


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of each number, scrambled by multiplications and shifts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """The draw-th number of each key, between 0 and 1, neither included."""
    step = np.uint64(draw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return ((mixed(key + step) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial numbers made of uniform u and v: by inversion where the mean is under 25, else from the normal law."""
    mean = n * p
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    out = np.clip(np.round(mean + z * np.sqrt(mean * (1 - p))), 0, n)
    at = np.flatnonzero(mean < 25)
    n, odds, left = n[at], (p / (1 - p))[at], u[at]
    mass, k = np.exp(n * np.log1p(-p[at])), 0
    out[at] = 0
    while len(at) and k < 200:
        more = left > mass
        at, n, odds, left, mass = at[more], n[more], odds[more], left[more] - mass[more], mass[more]
        mass = mass * (n - k) / (k + 1) * odds
        k += 1
        out[at] = np.minimum(k, n)
    return out


def seat(customers: np.ndarray, share: np.ndarray, others: np.ndarray, discount: float, key: np.ndarray, single: int = SINGLE) -> np.ndarray:
    """Tables after seating each dish's customers anew.

    share: the parent's probability of the dish; others: tables of other dishes in the restaurant; key: of the random numbers."""
    tables = np.minimum(customers, 1).astype(float)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(-customers[order], kind="stable")]
    counts, share, others, key = customers[order].astype(np.int64), share[order], others[order], key[order]
    falling, t = -counts, np.ones(len(order))
    i, top = 1, int(counts[0]) if len(counts) else 0
    while i < top:
        n = int(np.searchsorted(falling, -i, side="left"))  # dishes with more than i customers
        block = 1 if i < single else max(1, i // GROWTH)
        many = np.minimum(block, counts[:n] - i)
        new = (STRENGTH + discount * (others[:n] + t[:n])) * share[:n]
        old = np.maximum(i + (many - 1) / 2 - discount * t[:n], 1e-12)
        u = uniform(key[:n], 2 * i)
        t[:n] += u * (new + old) < new if block == 1 else binomial(many, new / (new + old), u, uniform(key[:n], 2 * i + 1))
        i += block
    tables[order] = t
    return tables


def held_out(doc_id: Column, mod: int = 7, rest: int = 2) -> Column:
    """Whether crc32 of the id's text leaves `rest`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(mod)) == rest


@dataclass
class Tokens:
    """The tokens of some texts: doc, the text's number, of each token; word, its place in `words`; context, of the token before.

    Every text ends with the end, b'', which is the last of `words`."""

    words: pa.Array
    doc: np.ndarray
    word: np.ndarray
    context: np.ndarray


def contexts_of(words: pa.Array) -> np.ndarray:
    """The context of what follows each word, by its last two bytes; 0 after b''."""
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1 + words.offset)[words.offset :].astype(np.int64)
    flat = np.append(np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), 0)
    size = np.diff(ends)
    last, before = flat[np.maximum(ends[1:] - 1, 0)], flat[np.maximum(ends[1:] - 2, 0)]
    return np.where(size > 0, (37 * FINE[last] + np.where(size > 1, 101 * FINE[before], 0)) & (CONTEXTS - 1), 0).astype(np.int32)


def tokens(texts: pa.Array) -> Tokens:
    """Cut by Arrow, A-Z lower-cased, on runs of ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts.cast(pa.string())), ""))
    flat, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    words = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
    n, end = len(texts), len(words) - 1
    at = np.arange(len(doc)) + doc  # one place more for each text before
    out = np.full(len(doc) + n, end, dtype=np.int64)
    out[at] = coded.indices.to_numpy()
    owner = np.repeat(np.arange(n, dtype=np.int32), np.bincount(doc, minlength=n) + 1)
    after = contexts_of(words)
    return Tokens(words, owner, out, np.append(np.int32(0), after[out[:-1]]))


def _packed(who: np.ndarray, contexts: np.ndarray, n: np.ndarray, rows: int) -> pa.Array:
    """A binary value for each of `rows` words: the contexts and counts of its entries, which are in the words' order."""
    values = np.empty(len(who), dtype=PACKED)
    values["context"], values["n"] = contexts, n
    ends = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=rows)))) * PACKED.itemsize
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(who, context, n) of the entries of packed counts."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=PACKED)
    who = np.repeat(np.arange(len(column)), pc.binary_length(column).to_numpy() // PACKED.itemsize)
    return who, flat["context"].astype(np.int64), flat["n"].astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, counts): how often each word and the end, b'', stand after each context in some training texts."""
    for batch in batches:
        for part in blocks(batch, most=COUNTED):
            found = tokens(part.column("text"))
            keys, n = np.unique(found.word * CONTEXTS + found.context, return_counts=True)
            used, who = np.unique(keys // CONTEXTS, return_inverse=True)
            yield pa.RecordBatch.from_arrays([found.words.take(pa.array(used)), _packed(who, keys % CONTEXTS, n, len(used))], ["word", "counts"])
        pa.default_memory_pool().release_unused()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c, counts) of each word, of rows sorted by word; the counts of a word that a batch may not end are held, packed, for the next."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        words, counts = batch.column("word").cast(pa.binary()), batch.column("counts").cast(pa.binary())
        if held:
            words, counts = pa.concat_arrays([held[0], words]), pa.concat_arrays([held[1], counts])
        run = np.concatenate(([0], np.cumsum(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))))
        first = np.flatnonzero(np.diff(run, prepend=-1))
        who, context, n = _unpacked(counts)
        keys, at = np.unique(run[who] * CONTEXTS + context, return_inverse=True)
        sums = np.zeros(len(keys), dtype=np.int64)
        np.add.at(sums, at, n)
        words, counts = words.take(pa.array(first)), _packed(keys // CONTEXTS, keys % CONTEXTS, sums, len(first))
        total = np.bincount(keys // CONTEXTS, sums, len(first)).astype(np.int64)
        held = words[-1:], pa.array([counts[-1].as_py()], pa.binary()), total[-1:]
        yield pa.RecordBatch.from_arrays([words[:-1], pa.array(total[:-1]), counts[:-1]], ["word", "c", "counts"])
    if held:
        yield pa.RecordBatch.from_arrays([held[0], pa.array(held[2]), held[1]], ["word", "c", "counts"])


def count_words(texts: DataFrame) -> DataFrame:
    """The table of words of `texts` (text): word, c, counts (packed, by context), and a hash of the word."""
    parts = texts.select("text").mapInArrow(_count_words, "word binary, counts binary")
    words = parts.repartition("word").sortWithinPartitions("word").mapInArrow(_merged, "word binary, c long, counts binary")
    return stored(words.select("word", "c", "counts", F.xxhash64("word").alias("hash")), "words")


@dataclass
class Totals:
    """Customers by context; for each sample, tables of the contexts (a row each) and of their parent; discounts of both; known words."""

    customers: np.ndarray
    tables: np.ndarray
    parent: np.ndarray
    discounts: tuple[float, float]
    known: int

    def rest(self) -> np.ndarray:
        """What a context leaves to its parent, a row for each context."""
        return (STRENGTH + self.discounts[0] * self.tables) / (STRENGTH + self.customers)[:, None]

    def share(self, m: np.ndarray, t: np.ndarray, s: int) -> np.ndarray:
        """The parent's probability of words with m customers at t tables, in sample s; of an unknown word with none."""
        even = (STRENGTH + self.discounts[1] * self.parent[s]) / (self.known + 1)
        return (np.maximum(m - self.discounts[1] * t, 0) + even) / (STRENGTH + self.tables[:, s].sum())


def seated(hashes: np.ndarray, who: np.ndarray, contexts: np.ndarray, c: np.ndarray, rounds: list[Totals]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables of each word after each context, customers and tables of each word in the parent), a column for each sample, after the sweeps of `rounds`.

    The words start with a table in each context and one in the parent; those of a round see the totals before it."""
    t, m, up = np.zeros((len(c), SAMPLES)), np.zeros((len(hashes), SAMPLES)), np.zeros((len(hashes), SAMPLES))
    entry = mixed(hashes[who] ^ mixed(contexts.astype(np.uint64) + np.uint64(1)))
    for s in range(SAMPLES):
        own, above, tables = np.ones(len(c)), np.bincount(who, minlength=len(hashes)).astype(float), np.ones(len(hashes))
        for sweep, totals in enumerate(x for x in rounds for _ in range(SWEEPS)):
            turn = np.uint64((1 + sweep * SAMPLES + s) << 32)
            left = above[who] - own  # customers of the parent when those of the context have left
            share = totals.share(left, np.minimum(tables[who], left), s)
            own = seat(c, share, np.maximum(totals.tables[contexts, s] - own, 0), totals.discounts[0], mixed(entry + turn))
            above = np.bincount(who, own, len(hashes))
            even = np.full(len(hashes), 1 / (totals.known + 1))
            tables = seat(above, even, np.maximum(totals.parent[s] - tables, 0), totals.discounts[1], mixed(hashes + (turn << np.uint64(1))))
        t[:, s], m[:, s], up[:, s] = own, above, tables
    return t, m, up


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches of words put together until they have `most` bytes of packed counts, and larger ones cut."""
    held, n = [], 0
    for batch in batches:
        for part in blocks(batch, "counts", most):
            held.append(part)
            n += part.column("counts").nbytes
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word; who, context, n of each entry)."""
    return table["hash"].to_numpy().view(np.uint64), *_unpacked(table["counts"].combine_chunks().cast(pa.binary()))


def _summed(words: DataFrame, sums) -> np.ndarray:
    """The sum, over all batches of words, of the vectors that `sums` makes of (hashes, who, contexts, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for table in _gathered(batches, SEATED):
            more = sums(*_entries(table))
            total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["t"])

    found = words.select("counts", "hash").mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("i", "t")).groupBy("i").agg(F.sum("t").alias("t"))
    return np.array([r["t"] for r in found.orderBy("i").collect()])


def sample_seating(words: DataFrame) -> list[Totals]:
    """The totals before each round of sweeps, and after the last. Empty without words."""

    def counted(hashes: np.ndarray, who: np.ndarray, contexts: np.ndarray, c: np.ndarray) -> np.ndarray:
        wide = np.bincount(who, minlength=len(hashes))
        few = [(c == 1).sum(), (c == 2).sum(), (wide == 1).sum(), (wide == 2).sum(), len(hashes)]
        return np.concatenate([np.bincount(contexts, c, CONTEXTS), np.bincount(contexts, minlength=CONTEXTS), few])

    found = _summed(words, counted)
    if not len(found):
        return []
    customers, tables, (n1, n2, w1, w2, known) = found[:CONTEXTS], found[CONTEXTS : 2 * CONTEXTS], found[2 * CONTEXTS :]
    of = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5
    discounts = of(n1, n2), of(w1, w2)
    rounds = [Totals(customers, np.repeat(tables[:, None], SAMPLES, axis=1), np.full(SAMPLES, known), discounts, int(known))]
    for _ in range(ROUNDS):

        def tables_of(hashes: np.ndarray, who: np.ndarray, contexts: np.ndarray, c: np.ndarray, before: tuple[Totals, ...] = tuple(rounds)) -> np.ndarray:
            t, _, up = seated(hashes, who, contexts, c, list(before))
            return np.concatenate([*(np.bincount(contexts, t[:, s], CONTEXTS) for s in range(SAMPLES)), up.sum(axis=0)])

        sums = _summed(words, tables_of)
        rounds.append(Totals(customers, sums[: CONTEXTS * SAMPLES].reshape(SAMPLES, CONTEXTS).T, sums[CONTEXTS * SAMPLES :], discounts, int(known)))
    return rounds


SCORES = "word binary, c long, contexts array<int>, logs array<float>, parent array<double>"


def word_scores(words: DataFrame, rounds: list[Totals]) -> DataFrame:
    """word, c, contexts and logs (log10 probability after each context in which it was seen), parent (its probability there in each sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = rounds[-1]
        rest = last.rest()
        for table in _gathered(batches, SEATED):
            hashes, who, contexts, c = _entries(table)
            k = len(hashes)
            t, m, up = seated(hashes, who, contexts, c, rounds[:-1])
            shares = np.stack([last.share(m[:, s], up[:, s], s) for s in range(SAMPLES)], axis=1)
            p = sum(np.maximum(c - last.discounts[0] * t[:, s], 0) / (STRENGTH + last.customers[contexts]) + rest[contexts, s] * shares[who, s] for s in range(SAMPLES)) / SAMPLES
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(who, minlength=k)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (contexts.astype(np.int32), np.log10(p).astype(np.float32))]
            parent = pa.FixedSizeListArray.from_arrays(pa.array(shares.ravel()), SAMPLES).cast(pa.list_(pa.float64()))
            yield from pa.Table.from_arrays([table["word"].combine_chunks(), table["c"].combine_chunks(), *lists, parent], ["word", "c", "contexts", "logs", "parent"]).to_batches()

    return stored(words.mapInArrow(run, SCORES), "word-scores")


def _frequent(found: DataFrame) -> Column:
    """Whether a word is one of the most frequent, HOT at most: those over a count that a histogram by powers of 2^(1/16) gives, and the end."""
    step = F.floor(F.log2(F.col("c") + 1) * 16)
    cut, n = None, 0
    for r in found.where("word <> X''").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        n += r["count"]
        if n > HOT:
            break
        cut = r["step"]
    end = F.expr("word = X''")
    return end if cut is None else end | (step >= cut)


def _hot(top: DataFrame, last: Totals) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, counts, log10 probability after each context) of at most HOT words and the end."""
    top = top.toArrow().combine_chunks()
    logs = np.zeros((top.num_rows, CONTEXTS), dtype=np.float32)
    parent = np.array(top["parent"].to_pylist()).reshape(top.num_rows, SAMPLES)
    logs[:] = np.log10(parent @ last.rest().T / SAMPLES)
    lists = top["contexts"].combine_chunks()
    who = np.repeat(np.arange(top.num_rows), pc.list_value_length(lists).to_numpy())
    logs[who, lists.flatten().to_numpy()] = top["logs"].combine_chunks().flatten().to_numpy()
    return top["word"].combine_chunks().cast(pa.binary()), top["c"].to_numpy(), logs


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of `docs` (doc_id, text).

    Learnt from the rows that aren't held out (crc32 of doc_id mod 7 is 2). A null or empty text is its end alone. An unknown word
    has the probability of the one class of unknown words, as in the base score. Without training rows both scores are 0, the log
    of 1. Rows that repeat score alike and count each in training. Other columns are ignored; no rows give no rows."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"))
    words = count_words(rows.where("not held_out"))
    rounds = sample_seating(words)
    if rounds:
        found, last = word_scores(words, rounds), rounds[-1]
    else:
        found, last = words.sparkSession.createDataFrame([], SCORES), Totals(np.zeros(CONTEXTS), np.zeros((CONTEXTS, SAMPLES)), np.zeros(SAMPLES), (0.5, 0.5), 0)
    n = int(last.customers.sum())
    floor = float(np.log10(n + last.known + 1))
    frequent = _frequent(found)
    shared = docs.sparkSession.sparkContext.broadcast(_hot(found.where(frequent), last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, logs = shared.value
        bases = np.log10(counts + 1.0) - floor
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in blocks(batch, most=SCORED):
                found, m = tokens(part.column("text")), part.num_rows
                place = pc.fill_null(pc.index_in(found.words, names), -1).to_numpy()[found.word]
                hit = place >= 0
                doc, at = found.doc[hit], place[hit]
                added = lambda x: np.bincount(doc, x, minlength=m)  # noqa: B023, E731
                key = (found.doc[~hit].astype(np.int64) * len(found.words) + found.word[~hit]) * CONTEXTS + found.context[~hit]
                key, times = np.unique(key, return_counts=True)
                left, k = key // CONTEXTS, len(key)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([row + np.arange(m), row + left // len(found.words)]), pa.int64()), pa.concat_arrays([part.column("doc_id"), none]), pa.concat_arrays([part.column("held_out"), pa.nulls(k, pa.bool_())]),
                    *(pa.concat_arrays([pa.array(x.astype(np.int64)), none]) for x in (np.bincount(found.doc, minlength=m), np.bincount(doc, minlength=m))),
                    *(pa.concat_arrays([pa.array(x), pa.nulls(k, pa.float64())]) for x in (added(bases[at]), added(logs[at, found.context[hit]]))),
                    pa.concat_arrays([pa.nulls(m, pa.binary()), found.words.take(pa.array(left % len(found.words)))]), pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array((key % CONTEXTS).astype(np.int32))]), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(times.astype(np.int64))]),
                ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "context", "n"])
                row += m
            pa.default_memory_pool().release_unused()

    parts = stored(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, context int, n long"), "parts")
    rare = parts.where("word is not null").select("row", "word", "context", "n").join(found.where(~frequent), "word", "left")
    logp = F.lit(0.0)
    if rounds:
        rest = last.rest()
        left = [F.get(F.array(*[F.lit(float(x)) for x in rest[:, s]]), F.col("context")) for s in range(SAMPLES)]
        unknown = [float(last.share(np.zeros(1), np.zeros(1), s)[0]) for s in range(SAMPLES)]
        unseen = F.log10(sum((left[s] * F.coalesce(F.get("parent", F.lit(s)), F.lit(unknown[s])) for s in range(SAMPLES)), F.lit(0.0)) / SAMPLES)
        logp = F.coalesce(F.get("logs", F.array_position("contexts", F.col("context")).cast("int") - 1), unseen)
    base = F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(floor)
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * logp).alias("s"))
    whole = parts.where("word is null").drop("word", "context", "n").join(rare, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = whole.select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "s"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
