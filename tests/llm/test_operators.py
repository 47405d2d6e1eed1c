"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import binascii
import hashlib
import random
import re
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import bigrams, decontamination, language, licenses, lm, mixing, quality, sharding, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=2 + i % 7)) for i in range(300)]


def texts(n: int, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n)]


def rows(n: int = 60, seed: int = 0) -> list[tuple]:
    """Documents with nulls everywhere, empty and long texts, copies, near copies and rows that repeat."""
    rng = random.Random(seed)
    found = [(i, x, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(x)) for i, x in enumerate(texts(n, seed))]
    found += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n ", "en", "b", 3), (None, "no id here", "en", "a", 10), (n + 3, "É ß 漢字 😀 Ünï", "de", "c", 9)]
    found += [(n + 4, found[0][1], "en", "a", 1), (n + 5, found[0][1] + " tail", "en", "a", 1), (n + 6, " ".join(texts(400, seed + 1)), "en", "a", 1), found[3], found[3]]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that have the names of results and of inner columns."""
    found = spark.createDataFrame(rows(), SCHEMA)
    return found.withColumns({c: F.lit("x") for c in ("size", "score", "fp", "word", "hash", "shard", "taken", "key", "window", "n_words", "root")}).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(x: str) -> str:
    return x.translate({c: c + 32 for c in range(65, 91)})


# --- 1


def contaminated(text: str | None, items: list[tuple], width: int = 10) -> tuple:
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(x or ""))
    own = cut(text)
    hit, found = set(), set()
    for item, content in items:
        words = cut(content)
        for window in [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []:
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark, docs):
    items = [(1, " ".join(texts(1)[0].split()[:14])), (2, texts(3)[2]), (10, WORDS[5]), (3, f"{WORDS[1]} {WORDS[2]}"), (4, None), (5, "..."), (None, texts(5)[4]), (7, "É ß"), (2, texts(3)[1][:40])]
    got = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    wanted = sorted((str(r[0]), *contaminated(r[1], items)) for r in rows())
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == wanted
    assert any(r.n_hit for r in got)


def test_contamination_without_rows_or_items(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(nothing, none).count() == 0
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0


def near(text: str | None, items: list[tuple], width: int, slop: int) -> set:
    """Items with an id of which all different words of a window stand within its length plus slop words."""
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(x or ""))
    own, found = cut(text), set()
    for item, content in items:
        words = cut(content)
        for window in [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []:
            if item is not None and any(set(window) <= set(own[s : s + len(window) + slop]) for s in range(len(own))):
                found.add(str(item))
    return found


@pytest.mark.parametrize(("width", "slop"), [(3, 0), (10, 5)])
def test_proximity_equals_brute_force(spark, docs, width, slop):
    items = [(1, " ".join(texts(1)[0].split()[:14])), (2, " ".join(sorted(texts(3)[2].split()[:12]))), (10, WORDS[5]), (3, f"{WORDS[1]} {WORDS[2]} {WORDS[1]}"), (4, None), (None, texts(5)[4]), (7, f"{WORDS[9]} {WORDS[9]}")]
    items += [(20 + i, " ".join(random.Random(i).sample(x.split()[:9], k=4))) for i, x in enumerate(texts(40)) if len(x.split()) > 9]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.proximity_matches(docs, table, width, slop).collect()
    wanted = [near(r[1], items, width, slop) for r in rows()]
    assert sorted((str(r.doc_id), r.item) for r in got) == sorted((str(r[0]), i) for r, found in zip(rows(), wanted, strict=True) for i in found)
    counts = decontamination.contamination(docs, table, width, slop).collect()
    assert sorted((str(r.doc_id), r.n_near) for r in counts) == sorted((str(r[0]), len(found)) for r, found in zip(rows(), wanted, strict=True))
    assert any(wanted)


def test_proximity(spark):
    found = spark.createDataFrame([(1, "one x two y three"), (2, "three two one"), (3, "one two " + "z " * 20 + "three"), (4, "one two"), (5, None)], "doc_id long, text string")
    got = decontamination.proximity_matches(found, spark.createDataFrame([(9, "one two three")], "item_id long, text string"), slop=2)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]
    places = decontamination.phrase_matches(found, spark.createDataFrame([(9, "two three"), (8, "one")], "item_id long, text string"), 2)
    assert sorted((r.doc_id, r.start, r.len, r.item) for r in places.collect()) == [(1, 0, 1, "8"), (2, 2, 1, "8"), (3, 0, 1, "8"), (4, 0, 1, "8")]


# --- 2


def test_toxicity_learns_and_leaves_clean_texts_alone(spark):
    rng = random.Random(4)
    bad = ["vilest", "grubworm", "scoundrel"]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(WORDS, k=60)
        toxic = i % 6 == 0
        if toxic:
            for w in rng.choices(bad, k=4):
                words.insert(rng.randrange(60), w)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "grubworm vilest")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(9))
    marks = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame, marks).collect()}
    assert len(got) == 603
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values() if r.doc_id is not None)
    assert len(held) > 80 and all(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert got[1000].predicted == got[1001].predicted == 0 and got[1000].score == got[1001].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_without_labels(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, none).where("predicted = 1").count() == 0
    assert toxicity.toxicity(nothing, none).count() == 0


def test_label_model_finds_accuracies_and_dependences():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = (y & (rng.random(4000) < 0.8)) | (~y & (rng.random(4000) < 0.02))
    other = (y & (rng.random(4000) < 0.6)) | (~y & (rng.random(4000) < 0.05))
    third = (y & (rng.random(4000) < 0.7)) | (~y & (rng.random(4000) < 0.04))
    votes = np.stack([good, good, other, third], axis=1).astype(float)
    given = y ^ (rng.random(4000) < np.where(y, 0.25, 0.03))
    found = toxicity.label_model(votes, 0.1 + 0.8 * given, known=given.astype(float))
    assert abs(found.rates[0, 1] - 0.8) < 0.05 and abs(found.rates[2, 1] - 0.6) < 0.05 and (found.rates[:, 0] < 0.1).all()
    assert abs(found.label_rates[1] - 0.75) < 0.1 and abs(found.label_rates[0] - 0.03) < 0.02  # estimated, not believed
    assert found.parents[1] == 0 or found.parents[0] == 1  # the copy
    assert ((found.post > 0.5) == y).mean() > 0.96
    assert ((found.post > 0.5) == y).mean() > (given == y).mean()


def test_samples_are_bounded(spark):
    """Many rows of one labelled id, equal or not, don't make a sample larger."""
    frame = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.sample(frame, marks, 100).collect()
    assert 50 < len(got) < 150 and all(r.toxic == 1 for r in got)


# --- 3


def test_shards(spark, docs, nothing):
    got = sharding.shard(docs, 7).collect()
    wanted = rows()
    sizes = sorted((str(r[0]), len((r[1] or "").encode()) + 16, binascii.crc32((r[1] or "").encode())) for r in wanted)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sizes
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    ends = [(min(r.hilbert for r in by[i]), max(r.hilbert for r in by[i])) for i in range(7)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert all(r.grown_shard is None and r.law == "rows" for r in got)
    assert sharding.shard(nothing).count() == 0
    assert sharding.shard(spark.createDataFrame(rows()[:3], SCHEMA), 40).agg(F.countDistinct("shard")).first()[0] == 3


def many_without_id(spark):
    """20 000 rows without an id, half of them with one text, among few others."""
    ids = F.when(F.col("id") >= 20_000, F.col("id"))
    text = F.when(F.col("id") % 2 == 0, F.lit("one and the same")).otherwise(F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")))
    return spark.range(20_300).select(ids.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "s").alias("source"))


def test_many_rows_without_an_id(spark, monkeypatch):
    """Rows that share id and text are one weighted row, dealt out in parts at the end; laws and budgets hold."""
    from sluice.llm import common

    monkeypatch.setattr(common.copies, "__defaults__", (1000,))
    frame = many_without_id(spark)
    got = sharding.shard(frame, 7).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in got) == 20_300 and max(r.n for r in got) - min(r.n for r in got) <= 1
    assert all(r.slots == r.n == r["last"] + 1 for r in got)
    mixed = mixing.mix(frame)
    by = mixed.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("words"), F.first("source_size").alias("all")).collect()
    assert sum(r.n for r in by) == 20_300 and all(abs(r.taken - r.target) <= 0.5 and r.words == r["all"] for r in by)
    rows = mixed.groupBy(*mixed.columns).count()
    assert rows.exceptAll(mixing.mix(frame.repartition(7)).groupBy(*mixed.columns).count()).isEmpty()


def test_quantiles_of_columns(spark):
    frame = spark.createDataFrame([(x,) for x in [*"abcdefgh", None, "a", "é"]], "x string")
    cells = {r.x: r.c for r in frame.select("x", sharding._cell(frame, "x", 5).alias("c")).collect()}
    order = [*"abcdefgh", "é", None]
    assert [cells[x] for x in order] == [i * 5 // 10 for i in range(10)]


def test_quantiles_of_more_values_than_a_sample(spark):
    """Cuts are those of all 9 001 distinct values, most of them in few rows, the first and last cells as full as the others."""
    names = [f"{i * 7919 % 9_000:05d}.example" for i in range(9_000)]
    frame = spark.createDataFrame([(x,) for x in [*names, *names[:500], *[names[0]] * 700, None]], "x string").repartition(5)
    order = [*sorted(names), None]
    cells = {r.x: r.c for r in frame.select("x", sharding._cell(frame, "x", 8).alias("c")).distinct().collect()}
    assert [cells[x] for x in order] == [i * 8 // 9_001 for i in range(9_001)]


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_hilbert_neighbours_touch(dims):
    table, bits = sharding.transitions(dims), 3
    place = {}
    for cell in np.ndindex(*[1 << bits] * dims):
        state = at = 0
        for level in range(bits):
            corner = sum((c >> (bits - 1 - level) & 1) << i for i, c in enumerate(cell))
            entry = table[(state << dims) + corner]
            state, at = entry >> dims, (at << dims) + (entry & ((1 << dims) - 1))
        place[at] = cell
    assert len(place) == 1 << bits * dims
    assert all(sum(abs(a - b) for a, b in zip(place[i], place[i + 1], strict=True)) == 1 for i in range(len(place) - 1))


def test_hilbert_columns_follow_the_table(spark):
    cells = spark.range(64).select(F.expr("int(id % 8)").alias("x"), F.expr("int(id div 8)").alias("y"))
    got = {r.h: (r.x, r.y) for r in cells.select("x", "y", sharding.hilbert([F.col("x"), F.col("y")]).alias("h")).collect()}
    assert sorted(got) == list(range(64))
    assert all(abs(got[i][0] - got[i + 1][0]) + abs(got[i][1] - got[i + 1][1]) == 1 for i in range(63))


# --- 4


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, prints: list[int]) -> dict:
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, i in zip(group, ids, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return {(i, p): least.get(g) for g, i, p in zip(group, ids, prints, strict=True)}


def test_near_duplicates_equal_brute_force(spark, docs, nothing):
    got = simhash.near_duplicates(docs).collect()
    own = rows()
    prints = [fingerprint(r[1]) for r in own]
    wanted = components([r[0] for r in own], prints)
    assert len(got) == len(own)
    assert all(wanted[(r.doc_id, int(r.fingerprint, 16))] == r.component_id for r in got)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_of_close_numbers(spark, monkeypatch, seed):
    """Chains and dense groups, with large groups dealt out in parts."""
    monkeypatch.setattr(simhash, "SPLIT", 40)
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(25)]
    found = set(centres)
    for c in centres:
        x = c
        for _ in range(30):
            x ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))})
            found.add(x)
            found.add(c ^ 1 << rng.randrange(64))
    found = sorted(found)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in found], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    got = {}
    for x in found:
        signed = int(np.uint64(x).view(np.int64))
        got.setdefault(roots.get(signed, signed), set()).add(x)
    wanted = {}
    for (i, _), c in components(found, found).items():
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


# --- 5


def repeated(words: list[str]) -> int:
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = repeated(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, n, len(words) < 20 or 100 * n > 30 * len(words)


def test_quality(spark, nothing):
    rng = random.Random(2)
    line = lambda k=9: " ".join(rng.choices(WORDS, k=k)).capitalize() + "."
    good = ["\n".join(line() for _ in range(8)) for _ in range(60)]
    junk = ["\n".join(f"## {rng.choice(WORDS)} | {rng.choice(WORDS)} $$ {rng.choice(WORDS)} %%" for _ in range(8)) for _ in range(60)]
    odd = [None, "", " \n ", "a\na\nb c\n\n\na", "x " * 40, "one two three four five six seven eight nine " * 6, "\x0b".join(WORDS[:30]), "é ß\n" * 20]
    own = list(enumerate(good + junk + odd + good[:1]))
    frame = spark.createDataFrame(own, "doc_id long, text string").withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(frame, labels).collect()}
    for i, text in own:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), text
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 120))
    assert not got[120].kept and got[120].content_share is None
    assert quality.quality(nothing, labels).count() == 0
    assert quality.quality(frame, labels.limit(0)).where("kept = base_failed").count() == 0


def test_viterbi_equals_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    for _ in range(20):
        field = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
        masks = rng.integers(0, 1 << len(quality.FEATURES), 6).tolist()
        emit = field.emissions(np.array(masks))
        worth = lambda y: sum(emit[i, y[i]] for i in range(6)) + sum(field.moves[y[i], y[i + 1]] for i in range(5))  # noqa: B023, E731
        best = max(([k >> i & 1 for i in range(6)] for k in range(64)), key=worth)
        assert field.decode(masks).tolist() == best


def test_the_field_learns_where_lines_change():
    """Boilerplate lines at the end of good texts are labelled and decoded as such, though their texts are good; long texts are trained in chains."""
    rng = np.random.default_rng(5)
    content, junk = 1 << quality.FEATURES.index("15 or more words") | 1 << quality.FEATURES.index("ends a sentence"), 1 << quality.FEATURES.index("web or legal words")
    texts = [[content] * int(rng.integers(4, 12)) + [junk] * 2 for _ in range(80)] + [[junk] * int(rng.integers(3, 9)) for _ in range(80)] + [[content] * 700]
    good = np.array([1] * 80 + [0] * 80 + [1])
    marks = quality.line_labels(texts, good)
    assert [len(x) for x in marks] == [len(x) for x in texts] and marks[0].tolist() == [1] * (len(texts[0]) - 2) + [0, 0] and not marks[100].any()
    field = quality.train(texts, good)
    assert field.decode(texts[0]).tolist() == marks[0].tolist()
    assert field.moves[0, 1] != field.moves[0, 0] and field.share(texts[0], [1] * len(texts[0])) < 1


def test_gradients_equal_those_of_all_labellings():
    """Expected labels and moves of chains of different lengths, against sums over all labellings."""
    rng = np.random.default_rng(2)
    emit, moves = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    chains = sorted(((rng.integers(0, 5, n), None, w) for n, w in ((4, 0.3), (1, 0.5), (3, 0.2))), key=lambda c: -len(c[0]))
    got, got_moves = np.zeros((5, 2)), np.zeros((2, 2))
    quality._expect(*quality._grid(chains), emit, moves, got, got_moves)
    want, want_moves = np.zeros((5, 2)), np.zeros((2, 2))
    for ids, _, w in chains:
        n = len(ids)
        every = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        p = np.exp([sum(emit[ids[i], y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)) for y in every])
        for y, share in zip(every, w * p / p.sum(), strict=True):
            for i in range(n):
                want[ids[i], y[i]] += share
            for i in range(n - 1):
                want_moves[y[i], y[i + 1]] += share
    assert np.allclose(got, want) and np.allclose(got_moves, want_moves)


# --- 6


def test_language_model(spark, docs, nothing):
    got = lm.score(docs).collect()
    own = rows()
    held = lambda i: binascii.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    cut = lambda x: [*re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(x or "")), None]
    counts: dict = {}
    for r in own:
        if not held(r[0]):
            for w in cut(r[1]):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(r[0]), held(r[0]), len(cut(r[1])), sum(w in counts for w in cut(r[1])), n, round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in cut(r[1])), 6)) for r in own)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == wanted
    assert all(r.score < 0 and r.perplexity > 1 for r in got)
    assert lm.score(nothing).count() == 0


def test_language_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(8)
    made = [["".join(rng.choices(part, k=rng.randint(1, 4))) for _ in range(900)] for part in (["tion", "men", "eau", "ar"], ["ist", "on", "le", "qui"])]
    frame = spark.createDataFrame([(i, " ".join(rng.choices(made[i % 2], [1 / (k + 1) for k in range(900)], k=150))) for i in range(300)], "doc_id long, text string")
    r = lm.score(frame).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_scores_are_the_same_in_any_layout(spark, docs, monkeypatch):
    """Seating depends on words alone: neither on partitions nor on what is counted and seated together."""
    one = lm.score(docs).collect()
    monkeypatch.setattr(lm, "SEATED", 900)
    monkeypatch.setattr(lm, "COUNTED", 2_000)
    monkeypatch.setattr(lm, "HOT", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = lm.score(docs.repartition(5, "text")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = lambda found: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in found)
    assert len(one) == len(other)
    assert all(a[:4] == b[:4] and abs(a[4] - b[4]) < 2e-3 for a, b in zip(order(one), order(other), strict=True))


def test_word_probabilities_add_up_to_one(spark, docs):
    """After every context: all known words, the end, and the class of unknown words."""
    words = lm.count_words(docs.select("text"))
    rounds = lm.sample_seating(words)
    last = rounds[-1]
    assert len(rounds) == lm.ROUNDS + 1 and any(not np.array_equal(a.tables, b.tables) for a, b in zip(rounds, rounds[1:], strict=False))
    rest = last.rest()
    unknown = np.array([last.share(np.zeros(1), np.zeros(1), s)[0] for s in range(lm.SAMPLES)])
    total, known = rest @ unknown / lm.SAMPLES, 0
    for r in lm.word_scores(words, rounds).collect():
        p = rest @ np.array(r.parent) / lm.SAMPLES
        p[r.contexts] = 10.0 ** np.array(r.logs)
        total, known = total + p, known + 1
    assert known == last.known and np.allclose(total, 1, atol=1e-5)


def test_scores_equal_those_of_single_tokens(spark, docs):
    """A text's score is the sum over its tokens, one by one, of what the model says after the token before; unknown words share one class."""
    import pyarrow as pa

    held = lambda i: binascii.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lm.count_words(docs.where(~lm.held_out(F.col("doc_id"))).select("text"))
    rounds = lm.sample_seating(words)
    last, known = rounds[-1], {bytes(r.word): r for r in lm.word_scores(words, rounds).collect()}
    rest = last.rest()
    unknown = np.array([last.share(np.zeros(1), np.zeros(1), s)[0] for s in range(lm.SAMPLES)])

    def logp(word: bytes, before: bytes) -> float:
        context = int(lm.contexts_of(pa.array([before], pa.binary()))[0])
        r = known.get(word)
        if r is not None and context in r.contexts:
            return r.logs[list(r.contexts).index(context)]
        return float(np.log10(rest[context] @ (unknown if r is None else np.array(r.parent)) / lm.SAMPLES))

    wanted = []
    for i, text, *_ in rows():
        cut = [*(x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))), b""]
        wanted.append((str(i), len(cut), sum(logp(w, b) for w, b in zip(cut, [b"", *cut], strict=False))))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(docs).collect())
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 * max(1, -b[2]) for a, b in zip(got, sorted(wanted), strict=True))
    assert any(held(r[0]) for r in rows())


def test_every_word_before_has_its_own_restaurant(spark):
    """Words that end alike, and so share one of the classes, are contexts apart; classes give what follows them one probability."""
    texts = ["red bag " * 20, "wed sky " * 20] * 40
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, "red bag", "red sky", "wed sky", "wed bag"])], "doc_id long, text string")
    got = {r.doc_id - 80: r.score for r in bigrams.score(frame).where("doc_id >= 80").collect()}
    assert got[0] > got[1] + 0.5 and got[2] > got[3] + 0.5


def brute(spark, docs):
    """(training pairs, words, totals, log10 probability of a word after another) of the sampled seating, one by one."""
    pairs, seed = bigrams.count_pairs(docs.select("text", lm.held_out(F.col("doc_id")).alias("held_out")))
    seen, words, last = bigrams.sample_seating(pairs)
    of = {(r.before, r.word): r for r in seen.collect()}
    by = {r.key: r for r in words.collect()}

    def p(word: bytes, before: bytes) -> float:
        w, u = (xxhash.xxh64(x, seed).intdigest() for x in (word, before))
        w, u = (x - (1 << 64) if x >> 63 else x for x in (w, u))
        total = 0.0
        for s in range(lm.SAMPLES):
            share = last.share(np.array([by[w].m[s] if w in by else 0.0]), np.array([by[w].up[s] if w in by else 0.0]), s)[0]
            own = max(of[u, w].c - last.discounts[0] * of[u, w].t[s], 0) if (u, w) in of else 0
            customers, tables = (by[u].c, by[u].tables[s]) if u in by else (0, 0)
            total += (own + (lm.STRENGTH + last.discounts[0] * tables) * share) / (lm.STRENGTH + customers) / lm.SAMPLES
        return total

    return of, by, last, p


def test_pairs_of_words_against_brute_force(spark, docs, nothing):
    """Counts, sums of tables, base columns, scores token by token, and probabilities that add up to one after any word."""
    held = lambda i: binascii.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    cut = lambda x: [*(w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(x or ""))), b""]
    of, by, last, p = brute(spark, docs)
    counts: dict = {}
    for r in rows():
        if not held(r[0]):
            for pair in zip([b"", *cut(r[1])], cut(r[1]), strict=False):
                counts[pair] = counts.get(pair, 0) + 1
    assert sorted(counts.values()) == sorted(r.c for r in of.values())
    for s in range(lm.SAMPLES):
        assert all(1 <= r.t[s] <= r.c for r in of.values()) and all(1 <= r.up[s] <= r.m[s] for r in by.values())
        for side, name in ((0, "tables"), (1, "m")):
            sums: dict = {}
            for pair, r in of.items():
                sums[pair[side]] = sums.get(pair[side], 0) + r.t[s]
            assert sums == {k: r[name][s] for k, r in by.items()}
    assert any(r.t[0] > 1 for r in of.values()) and any(r.up[0] > 1 for r in by.values())
    known = {w for _, w in counts}
    for before in [b"", b"never seen", WORDS[3].encode(), WORDS[7].encode()]:
        assert abs(sum(p(w, before) for w in known) + p(b"never seen", before) - 1) < 1e-9
    single: dict = {}
    wanted = sorted((str(r[0]), len(cut(r[1])), sum(w in known for w in cut(r[1])), sum(np.log10(single.setdefault((u, w), p(w, u))) for u, w in zip([b"", *cut(r[1])], cut(r[1]), strict=False))) for r in rows())
    got = bigrams.score(docs).collect()
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * max(1, -b[3]) for a, b in zip(sorted((str(r.doc_id), r.n_tokens, r.n_known, r.score) for r in got), wanted, strict=True))
    order = lambda found: sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert order(got) == order(lm.score(docs).collect())
    assert bigrams.score(nothing).count() == 0 and bigrams.score(docs.where(lm.held_out(F.col("doc_id")))).agg(F.max(F.abs("score"))).first()[0] == 0


def test_scores_of_pairs_are_the_same_in_any_layout(spark, docs, monkeypatch):
    """With few broadcast words and pairs, small blocks and other partitions; and where two words share a key, by another seed."""
    one = bigrams.score(docs).collect()
    monkeypatch.setattr(bigrams, "COUNTED", 2_000)
    monkeypatch.setattr(bigrams, "SCORED", 1_500)
    monkeypatch.setattr(bigrams, "HOT", 5)
    monkeypatch.setattr(bigrams, "HOT_PAIRS", 5)
    other = bigrams.score(docs.repartition(5, "text")).collect()
    order = lambda found: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in found)
    assert all(a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-9) for a, b in zip(order(one), order(other), strict=True))
    keys = bigrams.word_keys
    monkeypatch.setattr(bigrams, "word_keys", lambda words, seed: keys(words, seed) // ((1 << 56) if seed == 42 else 1))
    assert bigrams.count_pairs(docs.select("text", F.lit(False).alias("held_out")))[1] == 43


def test_pairs_go_as_packed_arrays_and_spent_tables_are_removed(spark):
    """What scoring leaves in the shared folder: a few bytes for each token, and none of the tables of the sweeps."""
    import pathlib
    from urllib.parse import urlparse

    from sluice.llm.common import shared_dir

    rng = random.Random(5)
    made = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    frame = spark.createDataFrame([(i, " ".join(rng.choices(made, [1 / (k + 1) for k in range(3000)], k=200))) for i in range(400)], "doc_id long, text string")
    top = pathlib.Path(urlparse(shared_dir(spark)).path)
    before = {x.name for x in top.iterdir()}
    n = bigrams.score(frame).agg(F.sum("n_tokens")).first()[0]
    new = [x for x in top.iterdir() if x.name not in before]
    assert n == 400 * 201 and len(new) <= 2
    assert sum(f.stat().st_size for x in new for f in x.rglob("part-*")) < 16 * n


def test_blocks_seat_like_single_customers():
    """The mean number of tables of large counts is within one per cent of that of seating one at a time."""
    for count, share in ((3000, 0.02), (20_000, 0.001), (20_000, 0.3)):
        many, key = np.full(400, count), lm.mixed(np.arange(400, dtype=np.uint64))
        means = [lm.seat(many, np.full(400, share), np.full(400, 5000.0), 0.7, key, single).mean() for single in (lm.SINGLE, 1 << 40)]
        assert abs(means[0] / means[1] - 1) < 0.01, (count, share, means)


def test_binomial_numbers():
    u, v = (lm.uniform(lm.mixed(np.arange(200_000, dtype=np.uint64)), i) for i in (1, 2))
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u, v)[0, 1]) < 0.01
    for n, p in ((1, 0.3), (40, 0.02), (900, 0.01), (900, 0.2), (5, 0.99)):
        found = lm.binomial(np.full(len(u), n), np.full(len(u), p), u, v)
        assert abs(found.mean() - n * p) < 0.02 * max(1, n * p) and abs(found.var() / (n * p * (1 - p)) - 1) < 0.03 and found.max() <= n


# --- 7


def test_mix(spark, docs, nothing):
    got = mixing.mix(docs).collect()
    own = rows()
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(r[0]), str(r[3]), size(r[1])) for r in own)
    sums: dict = {}
    for r in own:
        sums[r[3]] = sums.get(r[3], 0) + size(r[1])
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), 1.5 * sum(sums.values())
    while True:
        level = budget / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 2 * sums[s]}
        if not full:
            target |= {s: level * weights[s] for s in free}
            break
        target |= {s: 2 * sums[s] for s in full}
        budget -= sum(2 * sums[s] for s in full)
        free -= full
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sums[s] for r in mine)
        assert sum(r.taken for r in mine) == round(target[s])
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(nothing).count() == 0
    whole = mixing.mix(docs, whole=True).collect()
    assert all(r.taken % max(1, r["size"]) == 0 for r in whole)


# --- 8


def vocabulary() -> str:
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_token_counts_equal_the_library(spark, docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    odd = ["don't I'll we've 'sxyz !'s a'b", "naïve café Straße ΣΑΣ İstanbul ﬁ", "漢字かな 한국어 123４５", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "é \x1c x\x85y z", "😀😀 🏳️‍🌈 ½²", "\x00\x01", "ŉ ǅ ẞ", "MiXeD ÀÉÎ ÿ ɏ", "_a-b__c", "ªºµ ¹²³"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    own = {i: x for i, x in enumerate(odd)}
    for r in tokens.token_counts(frame, vocabulary(), limit=50).collect():
        options = [x for i, x, *_ in rows() if i == r.doc_id] + ([own[r.doc_id]] if r.doc_id in own else [])
        counts = [(len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for x in options]
        assert (r.n_bytes, r.n_tokens) in counts and r.over_limit == (r.n_tokens > 50)
    assert tokens.token_counts(nothing, vocabulary()).count() == 0


def test_every_remembered_path_agrees(monkeypatch):
    """Counts don't depend on what a worker remembers, nor on how a text is cut."""
    from pathlib import Path

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    count = tokens.Counting(Path(vocabulary()).read_text(encoding="utf-8"), tokens.whole_tokens(library))
    rng = random.Random(5)
    letters = string.ascii_letters + "éüñÀß 0123456789'!?.,;-_\n\t漢 "
    some = ["".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(300)]
    assert count(some) == [len(library.encode(x, add_special_tokens=False).ids) for x in some]


def test_letters_beside_the_plain_ones():
    """Every code point of the fast path, alone and beside quotes, digits and letters, counts as the library counts it; some lower-case beyond it."""
    from pathlib import Path

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    count = tokens.Counting(Path(vocabulary()).read_text(encoding="utf-8"), tokens.whole_tokens(library))
    letters = [chr(c) for c in range(1, 0x260)]
    some = [p.format(c) for c in letters for p in ("{}", "{}'S", "a{}", "{}b", "1{}2", "'{}", "{0}{0}", "{} {}".replace("{}", "{0}"), "x'll{}", "!{}?")]
    rng = random.Random(3)
    some += ["".join(rng.choices(letters, k=rng.randint(2, 30))) for _ in range(2_000)]
    some += [chr(c) for c in range(0x260, 0x1200)]
    got, wanted = count(some), [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert [x for x, a, b in zip(some, got, wanted, strict=True) if a != b] == []


# --- 9


def test_licenses(spark, nothing):
    files = [
        ("a", "repo/LICENSE", "Apache License\nVersion 2.0, January 2004\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
        ("b", "repo/src/x.py", "import os"), ("c", "repo/src/vendor/COPYING.txt", "GNU General Public License version 3, 29 June 2007"), ("d", "repo/src/vendor/deep/y.c", "int main;"),
        ("e", "repo/src/z.py", "# Released under the MIT License.\nprint(1)"), ("f", "other/w", "plain words"), ("g", None, "Licensed under CC BY-NC 4.0."), ("h", "repo/q", None), ("i", "repo//src//v", ""),
        ("j", "other/u", "The license of the driver was expired, so the officer took the licence plate and left without any further ado about it all"),
        ("k", "other/t", "<p>This work is licensed under the GNU General Public License, version 3.</p><p>x</p>"), ("b", "repo/src/x.py", "import os"),
    ]
    got = {r.file: r for r in licenses.scan(spark.createDataFrame(files, "file string, path string, text string").withColumn("word", F.lit(1))).collect()}
    wanted = {"a": "Apache-2.0", "b": "Apache-2.0", "c": "GPL-3.0", "d": "GPL-3.0", "e": "MIT", "f": None, "g": "CC-BY-NC-4.0", "h": "Apache-2.0", "i": "Apache-2.0", "j": None, "k": "GPL-3.0"}
    assert {k: r.license for k, r in got.items()} == wanted
    assert got["b"].inherited_from == "repo/LICENSE" and got["b"].depth == 1 and got["d"].depth == 1 and got["h"].depth == 0 and got["e"].own_license == "MIT"
    assert licenses.scan(spark.createDataFrame([], "file string, path string, text string")).count() == 0


# --- 10


def test_languages(spark, docs, nothing):
    rng = random.Random(6)
    made = {"xx": "aeiou", "yy": "bcdfgaeo", "zz": "äöüßst"}
    own = []
    for i in range(240):
        lang = sorted(made)[i % 3]
        own.append((i, " ".join("".join(rng.choices(made[lang], k=rng.randint(2, 8))) for _ in range(40)), lang, "s", 0))
    own += [(500, None, "xx", "s", 0), (501, "", "xx", "s", 0), (502, "123 !!", "yy", "s", 0), (503, "aeiou iou", None, "s", 0), (None, "bcd fgb", "yy", "s", 0)]
    got = {r.doc_id: r for r in language.languages(spark.createDataFrame(own, SCHEMA).withColumn("score", F.lit(1))).collect()}
    held = [i for i in range(240) if binascii.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(got[i].lang_pred == sorted(made)[i % 3] for i in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502)) and got[503].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.languages(nothing).count() == 0
    assert language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_classes_stay_toxic_and_clean_beside_a_strong_other_split():
    """Two languages whose toxic texts share no voter, and many voters of one of them that say nothing of toxicity in the other."""
    rng = np.random.default_rng(1)
    n = 3000
    other, toxic = rng.random(n) < 0.4, rng.random(n) < 0.12
    votes = np.zeros((n, 60))
    votes[:, :10] = (toxic & ~other)[:, None] & (rng.random((n, 10)) < 0.4)
    votes[:, 10:] = (toxic & other)[:, None] & (rng.random((n, 50)) < 0.5)
    post = toxicity.label_model(votes, 0.05 + 0.9 * toxic, known=toxic.astype(float)).post
    fired = votes.any(axis=1)
    assert ((post > 0.5) == toxic)[fired | ~toxic].all()
    w = toxicity.linear(votes, post)
    z = votes @ w[:-1] + w[-1]
    assert (((z - toxicity._cut(z, post > 0.5)) > 0) == toxic)[fired | ~toxic].mean() > 0.995


def test_licenses_weigh_words_by_whole_texts(spark):
    """A word's document frequency counts all files, so common words beside a notice weigh little however large the corpus."""
    prose = [(f"p{i}", f"x/{i}", f"<b>this</b> software, see the file: it is for all of us, item {i}") for i in range(400)]
    files = [("a", "y/a", "This software is released under the MIT License, see the LICENSE file."), ("c", "y/c", "See this file for all of us: it is software released under the MIT License."), *prose, prose[0], ("n", "y/n", None)]
    df = spark.createDataFrame(files, "file string, path string, text string")
    found = {r.word: r.df for r in licenses.frequencies(df).collect()}
    assert found["this"] == found["see"] == 403 and found["7"] == 1 and found["license"] == 2 and "b" not in found
    got = {r.file: r.own_license for r in licenses.scan(df).where("file in ('a', 'c', 'p3', 'n')").collect()}
    assert got == {"a": "MIT", "c": "MIT", "p3": None, "n": None}


def test_license_cosines_equal_brute_force(spark):
    """Every run of every template's length, without cues, against the scan: notices in prose, at ends, changed, cut, doubled; rows that share a file."""
    rng = random.Random(1)
    notes = [x for texts in licenses.TEMPLATES.values() for x in texts]
    own = []
    for i in range(150):
        words = rng.choices(WORDS, k=rng.randint(0, 30))
        note = rng.choice(notes).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            note[rng.randrange(len(note))] = rng.choice([*WORDS[:20], "the", "license", "under"])
        note = note[: rng.choice([len(note), len(note), 3])]
        at = rng.randint(0, len(words))
        own.append(" ".join(words[:at] + (note if i % 3 else []) + words[at:]))
    own += ["Copyright 2020 Foo Inc. Released under the MIT License.", "All code in this repository is licensed under the Apache License, Version 2.0.", "This article and all its figures are licensed under CC BY-NC 4.0.", "the license of the driver", "MIT", ""]
    files = [(f"f{i // 2}", f"x/{i}", x) for i, x in enumerate(own)]
    got = {r.path: (r.own_license, r.own_cosine) for r in licenses.scan(spark.createDataFrame(files, "file string, path string, text string")).collect()}
    cut = [licenses.words_of(x) for x in own]
    df: dict = {}
    for words in cut:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    weigh = lambda w: licenses.idf(df.get(w, 0), len(own))
    for i, words in enumerate(cut):
        best = []
        for t in licenses.weighted(df, len(own)):
            for s in range(len(words)):
                run = words[s : s + t.size]
                vector = {w: (1 + np.log(run.count(w))) * weigh(w) for w in set(run)}
                cosine = sum(x * t.weights.get(w, 0) for w, x in vector.items()) / sum(x * x for x in vector.values()) ** 0.5
                if round(cosine, 9) >= t.threshold:
                    best.append((-round(cosine, 9), t.license))
        wanted = (min(best)[1], -min(best)[0]) if best else (None, None)
        assert got[f"x/{i}"][0] == wanted[0] and (wanted[1] is None or abs(got[f"x/{i}"][1] - wanted[1]) < 1e-6), (own[i], got[f"x/{i}"], wanted)
    assert [got[f"x/{i}"][0] for i in range(150, 156)] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0", None, None, None]
    assert len({v for v, _ in got.values()}) > 8


def test_shouting_reads_the_whole_text():
    """Capitals count wherever they stand: a calm head hides no shouting, and a loud head makes none."""
    assert toxicity.patterns("a" * 2500 + "A" * 5000)[0] and not toxicity.patterns("A" * 1500 + "a" * 8000)[0]
    assert toxicity.patterns("AAa")[0] and not toxicity.patterns("")[0]


def test_more_labels_than_languages(spark, monkeypatch):
    """The labels with the most rows are learnt; of equal numbers the first in order."""
    monkeypatch.setattr(language, "LANGUAGES", 2)
    own = [("abc abd", "x")] * 3 + [("xyz xyy", "y")] * 2 + [("klm kll", "b"), ("opq oqq", "z"), ("opq oqq", "z")]
    assert language.fit(spark.createDataFrame(own, "text string, lang string")).languages == ["x", "y"]


def test_languages_equal_brute_force(spark):
    """Prototypes and cosines from trigram vectors that are multiplied, turned and added one by one."""
    rng = random.Random(3)
    made = {"xx": "aeiou", "yy": "bcdfgaeo", "zz": "äöüßst"}
    own = [(i, " ".join("".join(rng.choices(made[x], k=rng.randint(1, 7))) for _ in range(rng.randint(1, 12))), x) for i in range(60) for x in [rng.choice(sorted(made))]]
    own += [(60, "Aé, b'c! 漢字 12 x", "xx"), (61, "ß", None), (62, "- 7", "yy")]

    def vector(text: str) -> np.ndarray:
        total, n = np.zeros(language.DIMS), 0
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            codes = [0, *map(ord, word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                total += np.roll(language.letter(a), 2).astype(float) * np.roll(language.letter(b), 1) * language.letter(c)
                n += 1
        return total / max(1, n)

    unit = lambda x: x / max(1e-9, np.linalg.norm(x))
    learnt = [(t, x) for i, t, x in own if x and binascii.crc32(str(i).encode()) % 4 != 2]
    names = sorted({x for _, x in learnt})
    sums = np.stack([unit(sum(vector(t) for t, x in learnt if x == name)) for name in names])
    centre = sums.mean(axis=0)
    got = {r.doc_id: r for r in language.languages(spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in own], SCHEMA)).collect()}
    for i, text, _ in own:
        if not re.search(r"[^\W\d_]", text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = [unit(unit(vector(text)) - centre) @ unit(x - centre) for x in sums]
        assert got[i].lang_pred == names[int(np.argmax(cosines))] and abs(got[i].score - (1 + max(cosines)) / 2) < 1e-3


def test_slices_of_texts():
    """Every text once, in order; long texts stand alone, and no list holds many bytes otherwise."""
    import pyarrow as pa

    from sluice.llm import common

    own = ["a" * n for n in (1, 0, 5000, 10, 9000, 3, 4)] + [None, "é"] + ["xy"] * 40
    found = list(common.slices(pa.array(own), 16, 4000))
    assert [x for part in found for x in part] == [x or "" for x in own]
    assert all(len(part) <= 16 and (len(part) == 1 or sum(map(len, part)) <= 4000) for part in found)
    assert list(common.slices(pa.array([], pa.string()))) == []
