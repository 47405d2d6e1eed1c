"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, the first rotated
twice and the second once; a text is the sum of its trigrams' vectors, a language the sum of its texts'.
A text gets the language whose prototype has the largest cosine with it, after the mean of all prototypes, which is what
languages share, is taken from both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, slices

DIMS = 1024
SEED = 11
#: Of more labels than this, those with the most rows are learnt (equal numbers: the first in order); no set of languages has as many.
LANGUAGES = 4096
#: Trigram vectors held at a time.
HELD = 16_384


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=20_000)
def letter(code: int) -> np.ndarray:
    """The vector of a code point, or of a word's edge, 0."""
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1


def trigrams(text: str) -> np.ndarray:
    """The letter trigrams of a text with edges of words, as numbers of 63 bits; the middle is always a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.concatenate(([0], np.where(_is_letter()[codes], codes, 0), [0])).astype(np.uint64)
    codes = codes[(codes != 0) | np.append(codes[1:] != 0, True) | np.insert(codes[:-1] != 0, 0, True)]
    here = codes[1:-1] != 0
    return (codes[:-2][here] << np.uint64(42)) | (codes[1:-1][here] << np.uint64(21)) | codes[2:][here]


def _vectors(grams: np.ndarray) -> np.ndarray:
    """A row for each trigram."""
    part = [(grams >> np.uint64(s)).astype(np.int64) & 0x1FFFFF for s in (42, 21, 0)]
    out = None
    for turn, codes in zip((2, 1, 0), part, strict=True):
        used, at = np.unique(codes, return_inverse=True)
        table = np.stack([np.roll(letter(int(c)), turn) for c in used])
        out = table[at] if out is None else out * table[at]
    return out.astype(np.float32)


def bundle(groups: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum of weighted trigram vectors of each (trigrams, weights)."""
    out = np.zeros((len(groups), DIMS), dtype=np.float32)
    if not groups:
        return out
    used = np.unique(np.concatenate([g for g, _ in groups]))
    for at in range(0, len(used), HELD):
        held = used[at : at + HELD]
        table = _vectors(held)
        for i, (grams, weights) in enumerate(groups):
            low, high = np.searchsorted(grams, (held[0], held[-1] + np.uint64(1)))
            if low < high:
                out[i] += weights[low:high] @ table[np.searchsorted(held, grams[low:high])]
    return out


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a text, sorted, and their shares."""
    grams, counts = np.unique(trigrams(text), return_counts=True)
    return grams, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """Languages in order and their prototypes, centred and of length one."""

    languages: list[str]
    centre: np.ndarray
    prototypes: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        profiles = [profile(x) for x in texts]
        rows = bundle(profiles)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        rows = rows - self.centre
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        cosines = rows @ self.prototypes.T
        best = cosines.argmax(axis=1)
        has = [len(g) > 0 for g, _ in profiles]
        score = np.clip((1 + cosines[np.arange(len(texts)), best]) / 2, 0, 1)
        return [self.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)]


def fit(labelled: DataFrame) -> Model:
    """Prototypes from every row of `labelled` (text, lang) that has both; a text weighs the same whatever its length.

    Each task sends one vector for each language it met, in whole numbers, so the sums don't depend on their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in blocks(batch):
                by: dict[str, list] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(profile(text))
                groups = []
                for lang in by:
                    grams, at = np.unique(np.concatenate([g for g, _ in by[lang]]), return_inverse=True)
                    groups.append((grams, np.bincount(at, np.concatenate([w for _, w in by[lang]]), len(grams)).astype(np.float32)))
                for lang, vector in zip(by, bundle(groups), strict=True):
                    sums[lang] = sums.get(lang, 0) + np.round(vector * 1e4).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vector"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    labels = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    sums = rows.join(F.broadcast(labels), "lang", "left_semi").select("text", "lang").mapInArrow(run, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector")).orderBy("lang").collect()
    if not found:
        return Model([], np.zeros(DIMS), np.zeros((0, DIMS)))
    rows_ = np.array([r["vector"] for r in found], dtype=np.float64)
    rows_ /= np.maximum(np.linalg.norm(rows_, axis=1, keepdims=True), 1e-9)
    centre = rows_.mean(axis=0) if len(rows_) > 1 else np.zeros(DIMS)
    rows_ = rows_ - centre
    rows_ /= np.maximum(np.linalg.norm(rows_, axis=1, keepdims=True), 1e-9)
    return Model([r["lang"] for r in found], centre.astype(np.float32), rows_.astype(np.float32))


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    """Whether crc32 of the id's text leaves `rest`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(mod)) == rest


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of `docs` (doc_id, text, lang).

    Learnt from the rows that aren't held out (crc32 of doc_id mod 4 is 2) and have a language. lang_pred is a learnt
    language (one of the LANGUAGES with the most rows), or `und` with score 0 for a null text, one without letters, or if nothing could be learnt; equal
    cosines go to the first language in order. score is (1 + cosine) / 2. Rows that repeat are predicted alike. Other columns are
    ignored; no rows give no rows."""
    held = held_out(F.col("doc_id"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held)))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in slices(texts, 2048):
            a, b = model.value.predict(part)
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.select("doc_id", held.alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
