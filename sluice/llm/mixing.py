"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import copies, small, stored, word_count

#: Runs of the random order: about this many in all, so that none is large.
RUNS = 16_384
STRIDE = 128


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source_null, source_key, n, source_size, target of each source; `sources` has all but the last.

    Weights repeat over the sources in code-point order, null last. A target stops at `most` times its source's size
    and the excess is shared again by weight: sources are filled in the order of limit over weight, and the
    first whose limit isn't reached gives the level of all that follow. A row for each source is sorted in one task."""
    in_order = Window.orderBy("source_null", "source_key")
    by_room = Window.orderBy(F.col("room"), "source_null", "source_key")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("weight", F.element_at(listed, F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))).cast("int") + 1))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("room", F.col("limit") / F.col("weight"))
    ahead = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("fill", F.first(F.when(F.col("level") <= F.col("room"), F.col("level")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("fill").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("fill") * F.col("weight")))
    return rows.select("source_null", "source_key", "n", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, whole: bool = False, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row of `docs` (doc_id, text, source).

    size: the words of the text, 0 for null or none. taken: the words that the mix takes, repeats counted: as many
    whole epochs of the source as its target holds, then the documents of the random order up to the exact budget. The
    document on the cut gives its first words, or with `whole` is taken or left, whichever is nearer. The order is that
    of md5(seed, doc_id), then size, so reruns agree, and repeated rows differ in nothing but which of them stands first.
    A null source is a source of its own, last in order; a null doc_id counts as an empty one. A source without words has
    target 0. Other columns are ignored; no rows give no rows."""
    # Rows that share id, source and size are interchangeable: they are one weighted row until the end, so no key is hot.
    by = ["source_null", "source_key"]
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.select("*", F.col("source").isNull().alias("source_null"), F.coalesce("source", F.lit("")).alias("source_key"), key.alias("key"), (F.col("size") * F.col("m")).alias("words"))
    rows = stored(rows, "mix-rows")
    sums = rows.groupBy(*by).agg(F.sum("m").alias("n"), F.sum("words").alias("source_size"))
    aims = stored(targets(sums, weights, share, most), "mix-targets")
    n_sources, total = aims.agg(F.count("*"), F.sum("n")).first()
    run_rows = max(64, (total or 0) // RUNS)
    aims = aims.withColumn("runs", F.ceil(F.col("n") / run_rows)).withColumn("budget", F.round("target").cast("long"))
    rows = rows.join(small(aims, n_sources), by).withColumn("run", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("runs") / F.lit(2**32)))
    # A run for each run_rows rows and one more for each source: the table of sums is bounded by RUNS plus the sources.
    runs = rows.groupBy(*by, "run").agg(F.sum("words").alias("words"))
    # Sums of the sums of STRIDE runs first, so that no task orders all runs of a source.
    stride = F.floor(F.col("run") / STRIDE)
    before = lambda order, *more: Window.partitionBy(*by, *more).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    strides = runs.groupBy(*by, stride.alias("stride")).agg(F.sum("words").alias("words"))
    strides = strides.select(*by, "stride", F.coalesce(F.sum("words").over(before("stride")), F.lit(0)).alias("stride_ahead"))
    runs = runs.withColumn("stride", stride).join(small(strides, n_sources + RUNS // STRIDE), [*by, "stride"])
    runs = runs.select(*by, "run", (F.col("stride_ahead") + F.coalesce(F.sum("words").over(before("run", "stride")), F.lit(0))).alias("ahead"))
    within = Window.partitionBy(*by, "run").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(small(runs, n_sources + RUNS), [*by, "run"])
    rows = rows.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rows = stored(rows.select("doc_id", "source", "size", "m", "source_size", "target", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("source_size") - F.col("ahead")).alias("rest")), "mixed")
    rows = copies(rows, "m", "copy")
    rest = F.col("rest") - F.col("copy") * F.col("size")
    last = F.when(rest * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least("size", rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


#: DuckDB's words for op7 on the parameters of the query.
SQL = r"""
WITH d AS (SELECT doc_id, source, source IS NULL AS sn, coalesce(source, '') AS sk, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT sn, sk, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY sn, sk) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY sn, sk),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS room FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY room, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(w) OVER (ORDER BY room, sn, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r),
f AS (SELECT *, (SELECT min_by(lvl, (room, sn, sk)) FROM l WHERE lvl <= room) AS fill FROM l),
t AS (SELECT sn, sk, source_size, CASE WHEN fill IS NULL THEN cap ELSE least(cap, fill * w) END AS target FROM f),
o AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.sn, d.sk ORDER BY d.k, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM d JOIN t ON d.sn = t.sn AND d.sk = t.sk),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken FROM e
"""
