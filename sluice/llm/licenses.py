"""License scans: sparse TF-IDF cosine of notices and licence files to templates, then inheritance from the nearest directory.

Each template is compared with every run of as many words, anywhere in a text. Runs that can't reach the threshold aren't looked at: the most
frequent words of a template, together too light for it, are left aside, and by Cauchy and Schwarz a run without any of the
others, the template's cues, stays below. So texts are searched for cues, and only the words around a cue are weighed, by their
document frequencies over the whole texts of all files. A file without a licence of its own takes that of the
nearest directory above it that holds a licence file, found by joining paths.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, split_join, stored

#: The notices by which files are usually marked, after the licences' own words.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The MIT License"),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSD 3-Clause License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", "GNU General Public License version 3, 29 June 2007"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal public domain dedication.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
#: Base names of licence files.
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][a-z0-9.-]*)?$"
#: A run must reach the cosine beside the first number that its template's words are at least: few words say little.
THRESHOLDS = ((8, 0.6), (4, 0.75), (0, 0.9))


def _words(text: Column) -> Column:
    """The words of a text without tags and entities, lower-cased; none for null."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>\r\n]*>|&[a-z]+;", " ")
    return F.regexp_extract_all(F.lower(clean), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))


def words_of(text: str) -> list[str]:
    """The words of a template, cut as those of files."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+(?:\.[0-9]+)*", text.lower())


def frequencies(files: DataFrame) -> DataFrame:
    """word, df: in how many rows of `files` (text) the whole text has the word."""
    return files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


@dataclass
class Template:
    """A licence's notice: its words' weights, of length one, how many words it has, what cosine a run must reach."""

    license: str
    weights: dict[str, float]
    size: int
    threshold: float

    def cues(self) -> set[str]:
        """The words of which a run must have one to reach the threshold: all but the lightest that together stay below it."""
        left, out = 0.0, set()
        for word, w in sorted(self.weights.items(), key=lambda x: (x[1], x[0])):
            left += w * w
            if left >= self.threshold**2 - 1e-9:
                out.add(word)
        return out


def idf(df: int, rows: int) -> float:
    """The weight of a word of `df` files out of `rows`; one that no file has counts as one of one file."""
    return math.log((rows + 1.0) / (max(df, 1) + 1.0)) + 1.0


def damped(n: int) -> float:
    """What a word that stands n times in a run counts."""
    return 1.0 + math.log(n) if n else 0.0


def weighted(df: dict[str, int], rows: int) -> list[Template]:
    """TEMPLATES with the weights that document frequencies give."""
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            weights = {w: damped(n) * idf(df.get(w, 0), rows) for w, n in Counter(words).items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            out.append(Template(name, {w: x / norm for w, x in weights.items()}, len(words), next(t for n, t in THRESHOLDS if len(words) >= n)))
    return out


def best_run(template: Template, words: list[str], weights: list[float], at: int) -> float:
    """The largest cosine of the template with a run of its length that has the word at `at`; runs end with the text.

    Sums are those of the words that come and go while the run moves on."""
    size, best, dot, square = template.size, 0.0, 0.0, 0.0
    counts: dict[str, int] = {}
    first = max(0, at - size + 1)
    last = first
    for start in range(first, at + 1):
        end = min(len(words), start + size)
        for i, more in [(i, 1) for i in range(last, end)] + [(i, -1) for i in range(max(first, start - 1), start)]:
            word = words[i]
            n = counts.get(word, 0)
            counts[word] = n + more
            was, now = weights[i] * damped(n), weights[i] * damped(n + more)
            dot += (now - was) * template.weights.get(word, 0.0)
            square += now * now - was * was
        last = end
        best = max(best, dot / math.sqrt(max(square, 1e-12)))
    return round(best, 9)


def surroundings(files: DataFrame, templates: list[Template]) -> DataFrame:
    """row, file, path and, for each cue in a text, its word, the words around it (`words`) and its place among them (`at`); one more row, without words, of each of `files`.

    row names a row of `files` in this table, whose rows of one row of `files` are written by one task."""
    reach: dict[str, int] = {}
    for t in templates:
        for cue in t.cues():
            reach[cue] = max(reach.get(cue, 0), t.size)
    span = F.create_map(*[x for cue, n in sorted(reach.items()) for x in (F.lit(cue), F.lit(n))])[F.col("cue")]
    rows = files.select(F.monotonically_increasing_id().alias("row"), "file", F.regexp_replace("path", "/+", "/").alias("path"), _words(F.col("text")).alias("all"))
    rows = rows.select("*", F.posexplode(F.concat("all", F.array(F.lit("")))).alias("pos", "cue")).where(F.col("cue").isin("", *reach))
    start = F.greatest(F.lit(0), F.col("pos") - span + 1)
    found = F.when(F.col("cue") != "", F.slice("all", start + 1, F.col("pos") + span - start))
    return stored(rows.select("row", "file", "path", "cue", found.alias("words"), (F.col("pos") - start).alias("at")), "surroundings")


def scan(files: DataFrame) -> DataFrame:
    """file, path, own_license, own_cosine, license, inherited_from, depth of each row of `files` (file, path, text).

    Rows are scanned one by one, whatever they share. own_license is that of the template with the largest cosine of any run of words, if a run
    reaches its template's threshold; equal cosines go to the first name. Otherwise license is that of the nearest directory, the file's own first, with a
    licence file that has one; depth counts the directories between (null if own or none). A null path is in no directory; a
    null or empty text has no run, and the end of a text ends a run that would be longer. Other columns are ignored; no rows give no rows."""
    corpus = files.count()
    # Words of one file are left out: a word that is missing counts as one of them.
    known = stored(frequencies(files).where("df > 1"), "frequencies")
    mine = sorted({w for texts in TEMPLATES.values() for text in texts for w in words_of(text)})
    templates = weighted({r["word"]: r["df"] for r in known.where(F.col("word").isin(*mine)).collect()}, corpus)
    around = surroundings(files, templates)
    # Equal surroundings are compared once.
    found = around.where("cue <> ''").select("row", "cue", "words", "at", F.xxhash64("words", "at").alias("passage"))
    texts = stored(found.groupBy("passage").agg(F.any_value("words").alias("words"), F.any_value("at").alias("at"), F.any_value("cue").alias("cue")), "passages")
    slots = texts.select("passage", F.posexplode("words").alias("i", "word"))
    uses = slots.groupBy("word").agg(F.count("*").alias("uses")).join(known, "word", "left").select("word", "uses", F.coalesce("df", F.lit(1)).alias("df"))
    frequent = split_join(slots, stored(uses, "used"), "word", "uses").groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("i", "df"))).alias("df"))
    shared = files.sparkSession.sparkContext.broadcast((templates, corpus))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = shared.value
        by: dict[str, list[Template]] = {}
        for t in own:
            for cue in t.cues():
                by.setdefault(cue, []).append(t)
        for batch in batches:
            out = []
            for passage, words, at, cue, df in zip(*(batch.column(c).to_pylist() for c in ("passage", "words", "at", "cue", "df")), strict=True):
                weights = [idf(x, rows) for x in df]
                runs = [(-c, t.license) for t in by[cue] if (c := best_run(t, words, weights, at)) >= t.threshold]
                if runs:
                    out.append((passage, min(runs)[1], -min(runs)[0]))
            yield pa.RecordBatch.from_pylist([dict(zip(("passage", "license", "cosine"), x, strict=True)) for x in out], pa.schema([("passage", pa.int64()), ("license", pa.string()), ("cosine", pa.float64())]))

    best = texts.join(frequent, "passage").select("passage", "words", "at", "cue", F.col("df.df").alias("df")).mapInArrow(compare, "passage long, license string, cosine double")
    best = stored(best, "best")
    own = found.select("row", "passage").join(small(best), "passage").groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("m")).select("row", F.col("m.license").alias("own_license"), (-F.col("m.c")).alias("own_cosine"))
    judged = stored(around.where("cue = ''").select("row", "file", "path").join(own, "row", "left"), "judged")
    folder = F.regexp_replace("path", "[^/]*$", "")
    granted = judged.where(F.col("path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull()).groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("own_license").alias("given"), F.col("path").alias("by"))).alias("m")).select("folder", "m.given", "m.by")
    granted = stored(granted, "granted")
    # Folders, not files, are looked up: each once, with every folder above it.
    folders = judged.where("own_license is null and path is not null").select(folder.alias("folder")).distinct()
    steps = F.split(F.regexp_replace("folder", "/$", ""), "/")
    above = folders.select("folder", F.posexplode(F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/"))))).alias("depth", "up")).where("folder <> '' or depth = 0")
    nearest = above.join(granted.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(F.min(F.struct("depth", "given", "by")).alias("m")).select("folder", "m.*")
    out = judged.withColumn("folder", F.when(F.col("own_license").isNull(), folder)).join(small(stored(nearest, "nearest")), "folder", "left")
    return out.select("file", "path", "own_license", "own_cosine", F.coalesce("own_license", "given").alias("license"), F.col("by").alias("inherited_from"), "depth")


def of_documents(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """file, path, text of documents, under their source and language, and of pages, under host and path of their URL."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    one = docs.select(F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("file"), place.alias("path"), "text")
    url = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
    two = pages.select(F.concat(F.lit("p"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("file"), url.alias("path"), F.col("html").alias("text"))
    return one.unionByName(two)
