"""Quality rules: exact counts over a text, and a linear-chain conditional random field over its lines.

Each line becomes a set of yes/no features. The field scores a line as content or boilerplate from its features and from the label of
the line before; Viterbi decoding gives the best labelling of all lines of a text, and the share of its words that
stand in content lines decides whether it is kept. The field is trained here by maximum likelihood on weak labels of lines: what
lines of the same features say (how much more often they stand in good texts than in bad ones) and the quality label
of the text, so one text may have lines of both kinds and the field sees where they change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, labelled_sample, slices

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30
#: Train on at most about this many labelled texts, by a hash of doc_id.
FIT_ROWS = 3_000
#: Lines of a chain in training; evidence, in lines, of single features; how many times as frequent in the other class lines must be that aren't labelled as their text.
SEGMENT, SMOOTHED, OVERRULED = 256, 4.0, 4.0
FEATURES = ("one word", "2 to 4 words", "5 to 14 words", "15 or more words", "ends a sentence", "repeated line", "many symbols", "bars", "shouting", "exclaiming", "digits", "web or legal words", "long words", "short words", "repeated words")
WEB = re.compile(r"https?:|www\.|@|©|\b(?:cookies?|privacy|copyright|log ?in|sign ?up|subscribe|click|javascript|terms of (?:use|service)|all rights reserved|share this|read more)\b", re.I).search
DIGITS = re.compile(r"\d").findall


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that stand twice or more in the text, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    if len(number) == len(words):
        return 0
    key = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n] + np.uint64(1)
        key ^= key >> np.uint64(29)
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    if not len(twice):
        return 0
    views = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    if not np.array_equal(views[twice], views[first[back[twice]]]):  # two windows of one key: compare the windows themselves
        _, back, count = np.unique(views, axis=0, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[back.reshape(-1)] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def line_features(line: str, words: list[str], repeated: bool) -> int:
    """FEATURES of a line, as bits."""
    n, chars = len(words), max(1, len(line))
    letters = max(1, sum(map(len, words)))
    on = (
        n == 1, 2 <= n <= 4, 5 <= n <= 14, n >= 15, line.rstrip(SPACE)[-1:] in (".", "?", "!", "…", "。", ":"), repeated,
        sum(map(line.count, SYMBOLS)) > 0.06 * chars, "|" in line, line.upper() == line != line.lower(), line.count("!") > 0.05 * letters,
        len(DIGITS(line)) > 0.2 * letters, WEB(line) is not None, letters > 12 * n, letters < 2.5 * n, n >= 6 and len(set(words)) < 0.5 * n,
    )
    return sum(1 << i for i, x in enumerate(on) if x)


def examine(text: str) -> tuple[tuple[int, ...], list[int], list[int]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features, words of each line with a word)."""
    raw = text.encode("utf-8").split()
    word_chars = len(text) - sum(map(text.count, SPACE))
    seen: set[str] = set()
    masks, sizes, dup = [], [], 0
    for line in text.split("\n"):
        words = line.translate(_TO_SPACE).split(" ")
        words = [w for w in words if w]
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            masks.append(line_features(line, words, again))
            sizes.append(len(words))
    return (len(raw), word_chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(raw)), masks, sizes


_TO_SPACE = dict.fromkeys(map(ord, SPACE), " ")


@dataclass
class Field:
    """Scores of each feature (row) for boilerplate and content, of a line as such, and of content or boilerplate next to either."""

    features: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    threshold: float = 0.5

    def emissions(self, masks: np.ndarray) -> np.ndarray:
        return _bits(masks) @ self.features + self.bias

    def decode(self, masks: list[int]) -> np.ndarray:
        """The best labels, 1 for content, of a text's lines."""
        used, at = np.unique(np.asarray(masks, dtype=np.int64), return_inverse=True)
        score = self.emissions(used)[at].tolist()
        (aa, ab), (ba, bb) = self.moves.tolist()
        a, b = score[0]
        back = []
        for ea, eb in score[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
            back.append((from_a, from_b))
            a, b = (a + aa if from_a else b + ba) + ea, (a + ab if from_b else b + bb) + eb
        labels = [int(b > a)]
        for from_a, from_b in reversed(back):
            labels.append(int(not (from_b if labels[-1] else from_a)))
        return np.array(labels[::-1])

    def share(self, masks: list[int], sizes: list[int]) -> float | None:
        """The share of the words in content lines; None without words."""
        return float(self.decode(masks) @ np.asarray(sizes) / sum(sizes)) if masks else None


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)


def line_labels(texts: list[list[int]], good: np.ndarray) -> list[np.ndarray]:
    """Weak labels, 1 for content, of the lines of each text.

    Lines of equal features are counted in good and in bad texts, each class weighing the same, and smoothed by what their single features say;
    a line's label is that of its text unless lines like it are OVERRULED times as frequent in the other class."""
    used, at = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in texts]), return_inverse=True)
    lengths = np.array([len(x) for x in texts])
    kind = np.repeat(good, lengths)
    seen = np.stack([np.bincount(at[kind == y], minlength=len(used)) for y in (0, 1)]).astype(float)
    size = np.maximum(seen.sum(axis=1, keepdims=True), 1)
    bits = _bits(used)
    rate = (seen @ bits + 0.5) / (size + 1)
    single = bits @ np.log(rate[1] / rate[0]) + (1 - bits) @ np.log((1 - rate[1]) / (1 - rate[0]))
    prior = 1 / (1 + np.exp(-np.clip(single, -3, 3)))  # of so many lines of either class
    log_odds = np.log((seen[1] / size[1] * size.mean() + SMOOTHED * prior) / (seen[0] / size[0] * size.mean() + SMOOTHED * (1 - prior)))
    label = (log_odds[at] + np.where(kind == 1, 1, -1) * np.log(OVERRULED) > 0).astype(np.int64)
    return np.split(label, np.cumsum(lengths)[:-1])


def train(texts: list[list[int]], good: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> Field:
    """A field of maximum likelihood by gradient ascent with forward and backward sums over many texts at once.

    texts: line features; good: 1 for texts of good quality, whose lines' labels are those of `line_labels`. Both classes of texts weigh the
    same. Longer texts are chains of SEGMENT lines, and chains of like lengths are summed together, so a grid has at most
    twice as many places as there are lines."""
    weight = np.where(good == 1, 0.5 / max(1, (good == 1).sum()), 0.5 / max(1, (good == 0).sum())) / np.array([len(x) for x in texts])
    used, at = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in texts]), return_inverse=True)
    chains, start = [], 0
    for x, y, w in zip(texts, line_labels(texts, good), weight, strict=True):
        ids = at[start : start + len(x)]
        chains += [(ids[i : i + SEGMENT], y[i : i + SEGMENT], w) for i in range(0, len(x), SEGMENT)]
        start += len(x)
    bits = _bits(used)
    by_size: dict[int, list] = {}
    for chain in chains:
        by_size.setdefault(len(chain[0]).bit_length(), []).append(chain)
    grids = [_grid(sorted(x, key=lambda c: -len(c[0]))) for x in by_size.values()]
    wanted, wanted_moves = np.zeros((len(used), 2)), np.zeros((2, 2))
    for ids, y, w in chains:
        np.add.at(wanted, (ids, y), w)
        np.add.at(wanted_moves, (y[:-1], y[1:]), w)
    params = np.zeros((len(FEATURES) + 3, 2))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        emit, moves = bits @ params[:-3] + params[-3], params[-2:]
        got, got_moves = np.zeros_like(wanted), np.zeros((2, 2))
        for grid in grids:
            _expect(*grid, emit, moves, got, got_moves)
        gap = wanted - got
        slope = np.vstack([bits.T @ gap, gap.sum(axis=0), wanted_moves - got_moves]) - ridge * params
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        params = params + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(params[:-3], params[-3], params[-2:])


def _grid(chains: list[tuple]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(feature sets, a column for each chain, the longest first; chains alive at each line; weights)."""
    lengths = np.array([len(ids) for ids, _, _ in chains])
    grid = np.full((lengths[0], len(chains)), -1)
    for i, (ids, _, _) in enumerate(chains):
        grid[: len(ids), i] = ids
    return grid, [int((lengths > t).sum()) for t in range(lengths[0])], np.array([w for _, _, w in chains])


def _expect(grid: np.ndarray, alive: list[int], weight: np.ndarray, emit: np.ndarray, moves: np.ndarray, got: np.ndarray, got_moves: np.ndarray) -> None:
    """Adds the expected labels of feature sets and moves of the chains of a grid to `got` and `got_moves`."""
    forward = [emit[grid[0]]]
    for t in range(1, len(alive)):
        n = alive[t]
        forward.append(np.logaddexp(forward[-1][:n, :1] + moves[0], forward[-1][:n, 1:] + moves[1]) + emit[grid[t, :n]])
    back = np.zeros((0, 2))
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        after = np.zeros((n, 2))
        if len(back):
            m = len(back)
            ahead = back + emit[grid[t + 1, :m]]
            after[:m] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            pair = forward[t][:m, :, None] + moves + ahead[:, None, :]
            pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
            got_moves += (pair / pair.sum(axis=(1, 2), keepdims=True) * weight[:m, None, None]).sum(axis=0)
        both = forward[t] + after
        p = np.exp(both - both.max(axis=1, keepdims=True))
        np.add.at(got, grid[t, :n], p / p.sum(axis=1, keepdims=True) * weight[:n, None])
        back = after


def fit(labelled: DataFrame) -> Field | None:
    """A field from `labelled` (doc_id, text, quality), a sample, so the driver's share is bounded.

    The least content share of a kept text is the one that parts the two classes best. None unless both classes occur."""
    rows = labelled.where("quality is not null and text is not null").select(F.col("doc_id").cast("long"), "text", (F.col("quality") > 0).cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                seen = [examine(x) for x in part.column("text").to_pylist()]
                failed = [base_failed(c) for c, _, _ in seen]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(failed), pa.array([m for _, m, _ in seen], pa.list_(pa.int32())), pa.array([s for _, _, s in seen], pa.list_(pa.int32()))], ["doc_id", "quality", "failed", "masks", "sizes"])

    found = rows.mapInArrow(run, "doc_id long, quality int, failed boolean, masks array<int>, sizes array<int>").where("size(masks) > 0").toArrow().sort_by("doc_id")
    quality, masks, sizes = found["quality"].to_numpy(), found["masks"].to_pylist(), found["sizes"].to_pylist()
    if len(set(quality.tolist())) < 2:
        return None
    field = train(masks, quality)
    passed = ~found["failed"].to_numpy(zero_copy_only=False)
    shares = np.array([field.share(m, s) for m, s in zip(masks, sizes, strict=True)])[passed]
    good = quality[passed] == 1
    cuts = np.arange(1, 10) / 10
    if good.any() and not good.all():
        right = [((shares >= c) & good).sum() / good.sum() + ((shares < c) & ~good).sum() / (~good).sum() for c in cuts]
        best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
        field.threshold = float(cuts[best[len(best) // 2]])
    return field


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]


def sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, quality of at most about `most` labelled rows, by hashes; labels that repeat are averaged, equal rows taken once."""
    return labelled_sample(docs, labels, "quality", most)


def quality(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_share of each row of `docs` (doc_id, text), trained with `labels` (doc_id, quality).

    A null, empty or blank text has no words, fails the base rules and has a null content share; without labels of both classes the base
    rules decide alone. A text of any length is read whole; rows that repeat are judged alike. Other columns are ignored; no rows
    give no rows."""
    field = fit(sample(docs, labels, most))
    kind = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,content_share:double>"
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share"]

    @F.arrow_udf(kind)
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for part in slices(texts):
            for text in part:
                counts, masks, sizes = examine(text)
                share = field.share(masks, sizes) if field else (1.0 if masks else None)
                rows.append((*counts, base_failed(counts), share))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.bool_(), pa.float64()], strict=True)], names)

    rows = docs.select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")
    kept = ~F.col("base_failed") & F.coalesce(F.col("content_share") >= (field.threshold if field else 0.0), F.lit(False))
    return rows.select("doc_id", *names[:-1], kept.alias("kept"), "content_share")
