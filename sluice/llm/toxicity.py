"""Toxicity by weak supervision: voters, a generative model of their votes, a linear classifier on its posteriors.

Voters are a fixed lexicon of insults, a few fixed patterns, and words and word beginnings mined from labelled rows (those that stand
in toxic rows far more often than chance allows, in whatever language). A two-class model of their votes and of the given labels, which
are one more voter, is fitted by expectation maximisation: it estimates how often each fires in either class, given the vote of the voter that it
depends on most. These dependences are a tree, of the largest mutual information inside the classes, so voters that repeat each other or
belong to one language count once together. Its posteriors are the labels of a logistic regression over the same
features, which is what scores texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, labelled_sample

LETTERS = re.compile(r"[^\W\d_]+")
#: Fit on at most this many labelled rows, taken by a hash of doc_id.
FIT_ROWS = 8_000
#: At most so many mined voters, each in so many rows at least and so many standard deviations above chance.
VOTERS, SUPPORT, SIGMAS = 600, 5, 6.0
#: What is believed of the given labels before they are seen: rows they mark as toxic of ROWS clean and of ROWS toxic ones.
BELIEVED, ROWS = (1.0, 90.0), 100.0
#: Dependences of voters of a smaller statistic are within chance (twice the rows times the mutual information).
DEPENDENT = 30.0
PATTERNS = ("shouting", "exclaiming", "symbols")
#: Common insults in English, German, French and Spanish, without accents and endings that vary.
LEXICON = """idiot idiots moron morons imbecile stupid dumb loser losers scum trash garbage filth vermin worthless pathetic disgusting clown fool fools
trottel dummkopf abschaum widerlich wertlos versager idioten dreck erbärmlich
crétin imbécile abruti ordure minable débile idiote pourri
idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil payaso""".split()


def features(text: str) -> set[str]:
    """Words as =word and beginnings of 3 to 5 letters as ^abc, of the lower-cased text."""
    words = set(LETTERS.findall(text.lower()))
    out = {"^" + w[:n] for n in (3, 4, 5) for w in words if len(w) >= n}
    out.update("=" + w for w in words)
    return out


def patterns(text: str) -> list[bool]:
    """Whether each of PATTERNS holds: mostly capitals, many exclamation marks, many symbols."""
    n = max(1, len(text))
    return [sum(map(str.isupper, text)) > 0.5 * n, text.count("!") > 0.02 * n, sum(text.count(c) for c in "#*$%&|<>") > 0.03 * n]


@dataclass
class Model:
    """Weights of the features, and what the label model found: how often each voter fires in either class."""

    weights: dict[str, float] = field(default_factory=dict)
    pattern_weights: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))
    bias: float = -4.0
    rates: dict[str, tuple[float, float]] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)
    label_rates: tuple[float, float] = (0.0, 0.0)
    prior: float = 0.0

    def __post_init__(self) -> None:
        self.stems = {k[1:]: v for k, v in self.weights.items() if k[0] == "^"}
        self.words = {k[1:]: v for k, v in self.weights.items() if k[0] == "="}

    def score(self, text: str) -> float:
        words = set(LETTERS.findall(text.lower()))
        total = self.bias + sum(w for w, on in zip(self.pattern_weights, patterns(text), strict=True) if on)
        for w in words & self.words.keys():
            total += self.words[w]
        for n in (3, 4, 5):
            for w in {x[:n] for x in words if len(x) >= n} & self.stems.keys():
                total += self.stems[w]
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


@dataclass
class Labels:
    """What a label model found: the posterior of each row, rates (by voter and class), the voter that each depends on (-1: none), rates of the given labels, prior."""

    post: np.ndarray
    rates: np.ndarray
    parents: np.ndarray
    label_rates: tuple[float, float]
    prior: float


def tree(both: list[np.ndarray], ones: list[np.ndarray], sizes: list[float]) -> np.ndarray:
    """For each voter the voter that it depends on, or -1: a forest of the largest mutual information given the class, without chance links.

    both[y]: rows of class y in which two voters fire; ones[y]: in which one fires; sizes[y]: all."""
    k, n = len(ones[0]), sum(sizes)
    info = np.zeros((k, k))
    for y in (0, 1):
        size = sizes[y] + 1.0
        p = (both[y] + 0.25) / size
        a, b = ((ones[y] + 0.5) / size)[:, None], ((ones[y] + 0.5) / size)[None, :]
        for joint, left, right in ((p, a, b), (a - p, a, 1 - b), (b - p, 1 - a, b), (1 - a - b + p, 1 - a, 1 - b)):
            joint = np.maximum(joint, 1e-9)
            info += sizes[y] / n * joint * np.log(joint / (left * right))
    info[2 * n * info < DEPENDENT] = 0
    np.fill_diagonal(info, 0)
    parents, best, source, out = np.full(k, -1), np.full(k, -1.0), np.full(k, -1), np.ones(k, dtype=bool)
    for _ in range(k):
        i = int(np.argmax(np.where(out, best, -2.0)))
        parents[i] = source[i] if best[i] > 0 else -1
        out[i] = False
        nearer = out & (info[i] > best)
        best[nearer], source[nearer] = info[i][nearer], i
    return parents


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25, known: np.ndarray | None = None) -> Labels:
    """A two-class model of 0/1 votes, one row a document, from first guesses `start`, and of given labels `known`, if any.

    A voter fires at a rate of its own for each class and vote of the voter that it depends on. The labels' rates are estimated as the voters'
    are, from BELIEVED on, so that the classes don't turn into something else than toxic and clean, such as languages."""
    post = start.astype(float)
    k = votes.shape[1]
    parents, joined = np.full(k, -1), np.zeros_like(votes)
    rates, prior, given = np.zeros((k, 2)), 0.5, (0.0, 0.0)
    for turn in range(rounds):
        prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        shares = (1 - post, post)
        ones, sizes = [w @ votes for w in shares], [float(w.sum()) for w in shares]
        rates = np.stack([(ones[y] + 0.1) / (sizes[y] + 1.0) for y in (0, 1)], axis=1)
        if turn % 5 == 0:
            both = [votes.T @ (w[:, None] * votes) for w in shares]
            parents = tree(both, ones, sizes)
            joined = votes * votes[:, parents] * (parents >= 0)
        # log P(vote | parent's vote, class 1) - log P(vote | parent's vote, class 0), as a constant and weights of votes and of both.
        alone, above, together, base = np.zeros(k), np.zeros(k), np.zeros(k), 0.0
        for y, sign in ((0, -1), (1, 1)):
            fired, of_parent = shares[y] @ joined, ones[y][parents] * (parents >= 0)
            on = (fired + 2 * rates[:, y]) / (of_parent + 2)
            off = (ones[y] - fired + 2 * rates[:, y]) / (sizes[y] - of_parent + 2)
            on, off = np.clip(on, 1e-6, 1 - 1e-6), np.clip(off, 1e-6, 1 - 1e-6)
            base += sign * np.log(1 - off).sum()
            alone += sign * (np.log(off) - np.log(1 - off))
            above += sign * (np.log(1 - on) - np.log(1 - off)) * (parents >= 0)
            together += sign * (np.log(on) - np.log(1 - on) - np.log(off) + np.log(1 - off)) * (parents >= 0)
        weight = alone.copy()
        np.add.at(weight, parents[parents >= 0], above[parents >= 0])
        logit = np.log(prior / (1 - prior)) + base + votes @ weight + joined @ together
        if known is not None:
            given = tuple(float((shares[y] @ known + BELIEVED[y]) / (sizes[y] + ROWS)) for y in (0, 1))
            logit += np.where(known > 0.5, np.log(given[1] / given[0]), np.log((1 - given[1]) / (1 - given[0])))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return Labels(post, rates, parents, given, prior)


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 400) -> np.ndarray:
    """Weights, and the bias last, of a logistic regression on soft labels, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, last = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = np.where(y > 0.5, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    step = 4.0 / max(1.0, np.linalg.norm(x.T * weight @ x / len(x), 2))
    for t in range(rounds):
        look = w + (t / (t + 3)) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        slope = x.T @ (weight * (p - y)) / len(x) + ridge * np.append(look[:-1], 0) / 100
        last, w = w, look - step * slope
    return w


def _cut(logits: np.ndarray, positive: np.ndarray) -> float:
    """The logit that parts the classes best by F1, in the middle of the gap that it lies in."""
    order = np.argsort(-logits)
    z, hit = logits[order], np.cumsum(positive[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + positive.sum())
    f1[:-1][z[:-1] - z[1:] < 1e-9] = -1  # equal logits can't be parted
    best = int(np.argmax(f1))
    return float(z[best] - 1.0 if best + 1 == len(z) else (z[best] + z[best + 1]) / 2)


def fit(labelled: DataFrame) -> Model:
    """A model from `labelled` (doc_id, text, toxic). Rows without a label are ignored; with one class only, nothing is toxic.

    `labelled` is a sample, so the driver holds a bounded matrix of votes whatever the size of the input."""
    rows = labelled.where("toxic is not null").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = rows.agg(F.count("*"), F.sum("toxic")).first()
    n, n_toxic = counts[0] or 0, counts[1] or 0
    if not n_toxic or n_toxic == n:
        return Model()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for part in blocks(batch):
                for text, y in zip(byte_texts(part.column("text")), part.column("toxic").to_pylist(), strict=True):
                    seen[y].update(features(text.decode("utf-8")))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], ["feature", "toxic", "clean"])

    counted = rows.mapInArrow(tally, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    clean = n - n_toxic
    rate = (F.col("b") + 0.5) / (clean + 1.0)
    lift = F.log((F.col("a") + 0.5) / (n_toxic + 1.0) / rate)
    sigmas = (F.col("a") - n_toxic * rate) / F.sqrt(n_toxic * rate)
    mined = counted.where((F.col("a") >= SUPPORT) & (sigmas > SIGMAS) & (lift > 1.5)).orderBy((F.col("a") * lift).desc(), "feature").limit(VOTERS).select("feature").collect()
    names = sorted({r[0] for r in mined} | {"=" + x for x in LEXICON})
    place = {x: i for i, x in enumerate(names)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                texts = [x.decode("utf-8") for x in byte_texts(part.column("text"))]
                fired = [sorted(place[f] for f in features(x) & place.keys()) + [len(names) + i for i, on in enumerate(patterns(x)) if on] for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fired, pa.list_(pa.int32())), part.column("toxic")], ["doc_id", "fired", "toxic"])

    table = rows.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(vote, "doc_id long, fired array<int>, toxic int").toArrow().sort_by("doc_id")
    votes = np.zeros((table.num_rows, len(names) + len(PATTERNS)))
    for i, fired in enumerate(table["fired"].to_pylist()):
        votes[i, fired] = 1
    known = table["toxic"].to_numpy().astype(float)
    found = label_model(votes, 0.05 + 0.9 * known, known=known)
    w = linear(votes, found.post)
    w[-1] -= _cut(votes @ w[:-1] + w[-1], found.post > 0.5)
    both = [*names, *PATTERNS]
    depend = {both[i]: both[j] for i, j in enumerate(found.parents.tolist()) if j >= 0}
    return Model(dict(zip(names, w.tolist(), strict=False)), w[len(names) : -1].tolist(), float(w[-1]), {x: tuple(r) for x, r in zip(both, found.rates.tolist(), strict=True)}, depend, found.label_rates, found.prior)


def sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most about `most` labelled rows, by hashes; labels that repeat are averaged, equal rows taken once."""
    return labelled_sample(docs, labels, "toxic", most)


def held_out(doc_id: Column, mod: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the id's text leaves `rest`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(mod)) == rest


def scorer(model: Model):
    """A column function: a text's score by `model`, null scored as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py() or "") for x in texts], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs` (doc_id, text), learnt from `labels` (doc_id, toxic).

    Held-out rows (crc32 of doc_id mod 5 is 0) are never learnt from, and a score sees nothing but the text. A null text is
    scored as an empty one; rows that repeat score alike; without labels of both classes every score is low.
    Other columns are ignored; no rows give no rows."""
    model = fit(sample(docs, labels.where(~held_out(F.col("doc_id"))), most))
    score = scorer(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
