"""Sharding along a Hilbert curve over quantised metadata: runs of the curve become files that prune in every dimension."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import copies, stored

BITS = 3
DIMS = ("source", "lang", "doc_id", "size")
#: Runs of the curve's order that are ranked apart: about this many in all.
RUNS = 16_384


def transitions(dims: int) -> list[int]:
    """For state * 2^dims + corner, the corner's place on the curve plus 2^dims times the state inside it.

    A state is (entry corner, direction) as entry * dims + direction; the rule is Hamilton's: the corner is
    turned into the frame of the state, and its place is the rank of what results in the reflected Gray code."""
    mask = (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return (x << by | x >> (dims - by)) & mask

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    def rank(code: int) -> int:
        out = 0
        while code:
            out ^= code
            code >>= 1
        return out

    out = []
    for entry in range(1 << dims):
        for direction in range(dims):
            for corner in range(1 << dims):
                place = rank(turn(corner ^ entry, -(direction + 1)))
                into = 0 if place == 0 else (lambda x: x ^ x >> 1)(2 * ((place - 1) // 2))
                along = 0 if place == 0 else trailing_ones(place - 1) % dims if place % 2 == 0 else trailing_ones(place) % dims
                state = (entry ^ turn(into, direction + 1)) * dims + (direction + along + 1) % dims
                out.append(place + (state << dims))
    return out


def hilbert(axes: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a cell with coordinates of `bits` bits each."""
    n = len(axes)
    corners = F.array(*[sum((F.shiftright(axis, bits - 1 - level).bitwiseAND(1) * (1 << i) for i, axis in enumerate(axes)), F.lit(0)).cast("int") for level in range(bits)])
    table = F.array(*[F.lit(x) for x in transitions(n)])
    step = lambda s, corner: F.transform(F.array(F.element_at(table, F.shiftleft(s["state"], n) + corner + 1)), lambda t: F.struct(F.shiftright(t, n).alias("state"), (s["place"] * (1 << n) + t.bitwiseAND((1 << n) - 1)).cast("long").alias("place")))[0]
    return F.aggregate(corners, F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("place")), step, lambda s: s["place"])


def _quantiles(rows: DataFrame, column: str, width: int) -> list[str | None]:
    """The least value of each cell but the lowest, None where it is null; none of cells without values.

    All distinct values are dealt to ranges in their order and counted by range; then the ranges of the cuts, `width` - 1 at most, are numbered,
    each in its own task. Where the ranges' bounds lie doesn't change the result."""
    values = stored(rows.select(F.col(column).alias("value")).distinct().repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    known = values.where("value is not null")
    parts = known.groupBy("part").count().orderBy("part").collect()
    n_known = sum(r["count"] for r in parts)
    n = values.count()
    cuts = [k for k in (-(-i * n // width) for i in range(1, width)) if k < n]  # the first place of each cell but the lowest
    wanted, ahead = [], 0
    for r in parts:
        wanted += [(r["part"], k - ahead + 1, k) for k in sorted({*cuts}) if ahead <= k < ahead + r["count"]]
        ahead += r["count"]
    if not wanted:
        return [None for _ in cuts]
    numbered = known.where(F.col("part").isin([part for part, *_ in wanted])).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("value")))
    either = [(F.col("part") == part) & (F.col("at") == at) for part, at, _ in wanted]
    found = {(r["part"], r["at"]): r["value"] for r in numbered.where(reduce(or_, either)).collect()}
    least = {k: found[part, at] for part, at, k in wanted}
    return [least[k] if k < n_known else None for k in cuts]


def _cell(rows: DataFrame, column: str, width: int) -> Column:
    """The value's place among the quantiles of all distinct values of the column, null last: 0 .. width - 1."""
    above = lambda least: F.col(column).isNull() if least is None else F.coalesce(F.col(column) >= F.lit(least), F.lit(True))
    return sum((above(least).cast("int") for least in _quantiles(rows, column, width)), F.lit(0))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert of each row of `docs` (doc_id, text, lang, source).

    Source and language (by exact quantiles of all their distinct values, null last), doc_id (by its place
    between the least and the greatest) and size (by its power of two) are quantised to three bits each. Rows are ranked by
    the cell's place on the Hilbert curve, then by md5 of doc_id and checksum, doc_id, size and checksum, and the ranks are cut into
    `shards` runs by the law `rows`: counts at most one apart. size: UTF-8 bytes plus 16, 16 for null, whose checksum
    is that of the empty text. Rows equal in all of these are interchangeable and ranked as one weighted row, so neither a null
    doc_id nor a text that repeats is a hot key. grown_shard is null, as the law isn't `key`.
    A null doc_id is in the first cell. Other columns are ignored; no rows give no rows; with fewer rows than shards some
    shards stay empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("m")), "shard-rows")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.sum("m")).first()
    low, high, n, width = low or 0, high or 0, n or 0, 1 << BITS
    rows = rows.withColumns({f"q_{c}": _cell(rows, c, width) for c in ("source", "lang")})
    place = (F.col("doc_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) * width / F.lit(high - low + 1).cast("decimal(20,0)")
    power = F.floor((F.length(F.bin("size")) - 5) / 2)
    rows = rows.withColumn("q_doc_id", F.coalesce(F.floor(place).cast("int"), F.lit(0))).withColumn("q_size", F.greatest(F.lit(0), F.least(F.lit(width - 1), power)).cast("int"))
    cell = [f"q_{x}" for x in DIMS]
    # At most 2^(3 * 4) = 4096 cells: their table is small by construction.
    cells = stored(rows.groupBy(*cell).agg(F.sum("m").alias("cell_rows")).withColumn("hilbert", hilbert([F.col(c) for c in cell])), "cells")
    run_rows = max(64, n // RUNS)
    ahead = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, "hilbert", F.ceil(F.col("cell_rows") / run_rows).alias("runs"), F.coalesce(F.sum("cell_rows").over(ahead), F.lit(0)).alias("cell_ahead"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"))).join(F.broadcast(cells), cell)
    rows = rows.withColumn("run", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("runs") / F.lit(2**32)))
    # One run for each run_rows rows and at most one more for each cell: at most RUNS + 4096.
    within = Window.partitionBy("hilbert").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("hilbert", "run").agg(F.sum("m").alias("run_rows")).select("hilbert", "run", F.coalesce(F.sum("run_rows").over(within), F.lit(0)).alias("run_ahead"))
    rows = rows.join(F.broadcast(runs), ["hilbert", "run"])
    ahead = Window.partitionBy("hilbert", "run").orderBy("key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("cell_ahead") + F.col("run_ahead") + F.coalesce(F.sum("m").over(ahead), F.lit(0))
    rows = copies(stored(rows.select("doc_id", "size", "text_crc32", "hilbert", "m", first.alias("first")), "ranked"), "m", "copy")
    rows = rows.withColumn("rank", (F.col("first") + F.col("copy")).cast("long")).withColumn("shard", F.expr(f"CAST(rank * {shards} DIV {max(1, n)} AS INT)"))
    start = F.ceil(F.col("shard").cast("decimal(20,0)") * F.lit(n).cast("decimal(20,0)") / F.lit(shards)).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
