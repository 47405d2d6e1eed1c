"""Token counts of a word-end byte-pair vocabulary, by a whole-token shortcut.

Offline, each vocabulary string that ends a word is encoded alone; those that come out as one token are proven whole.
A text is cut into pre-tokens as the library cuts it; pre-tokens that are proven whole count one each without a merge, and only
the others go through the library, each different one once while it is remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices

#: Texts of these characters alone, before and after lower-casing, are cut here: the library's normal form of them is plain lower case.
PLAIN = re.compile("[\t-\r -~ -ɏ]*").fullmatch
#: The vocabulary's own pattern, over those characters. Letters and numbers up to U+024F.
_L = "a-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+").findall
#: Pre-tokens remembered by a worker at most.
REMEMBERED = 300_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The pre-tokens that the tokenizer encodes alone as one token, proven by encoding every vocabulary string."""
    letters, found = _byte_letters(), []
    for word in tokenizer.get_vocab(with_added_tokens=False):
        if word.endswith("</w>"):
            raw = bytes(letters[c] for c in word[:-4] if c in letters)
            try:
                found.append(raw.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    found = [x for x in found if x and pieces_of(tokenizer, x) == [x]]
    return frozenset(x for x, e in zip(found, tokenizer.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


def pieces_of(tokenizer: Tokenizer, text: str) -> list[str]:
    """The pre-tokens of a text without special strings, as text again."""
    if PLAIN(text) and PLAIN(low := text.lower()):
        return PIECES(low)
    letters = _byte_letters()
    cut = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
    return [bytes(letters[c] for c in piece).decode("utf-8") for piece, _ in cut]


class Counting:
    """Counts of tokens by a tokenizer file's text; `whole` holds the proven pre-tokens."""

    def __init__(self, model: str, whole: frozenset[str]) -> None:
        self.tokenizer = Tokenizer.from_str(model)
        self.whole = whole
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.at_special = re.compile("|".join(map(re.escape, self.special))).split if self.special else lambda x: [x]
        self.known: dict[str, int] = {}

    def merged(self, pieces: set[str]) -> None:
        """Remembers the counts of pre-tokens that aren't whole. The length is that of the merges of the piece alone."""
        new = [x for x in pieces if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        self.known.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        out = []
        for at in range(0, len(texts), 256):
            cut = [self.at_special(x) for x in texts[at : at + 256]]
            counts = [Counter(chain.from_iterable(pieces_of(self.tokenizer, x) for x in parts)) for parts in cut]
            self.merged(set().union(*(c.keys() for c in counts)) - self.whole)
            whole, known = self.whole, self.known
            out += [len(parts) - 1 + sum(n if x in whole else n * known[x] for x, n in c.items()) for parts, c in zip(cut, counts, strict=True)]
        return out


@lru_cache(maxsize=4)
def _counting(model: str, whole: frozenset[str]) -> Counting:
    return Counting(model, whole)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of `docs` (doc_id, text); `vocabulary` is a tokenizer's .json file.

    Counts equal those of the library without begin and end: special strings inside a text are single tokens, as is its
    default. A null or empty text has no bytes and no tokens; a text of any length is read whole; rows that repeat
    count alike. Other columns are ignored; no rows give no rows. The file is read on the driver; workers get its text."""
    model = Path(vocabulary).read_text(encoding="utf-8")
    shared = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(Tokenizer.from_str(model))))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        run, out = _counting(*shared.value), []
        for part in slices(texts):
            out += run(part)
        return pa.array(out, pa.int64())

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return rows.select("*", (F.col("n_tokens") > limit).alias("over_limit"))

