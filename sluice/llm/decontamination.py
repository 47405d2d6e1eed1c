"""Benchmark decontamination on a positional inverted index of the training tokens.

The index holds a posting (term, row, position) for each token that a test window uses, sorted by term inside every file, and
one marker for each row, whose position is the row's length. The numbers of the terms by which windows are looked up (the two rarest of
any window) come before those of all other terms, so their lists lie together, and lookups skip the row groups of
the others. A window is looked up from the list of its rarest term; the list of the next rarest is intersected with it, each
at its own offset (or, for proximity, within the span), and then all other lists at once. No text is read again and
none is ever in an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, small, stored

#: What stands between words: all else is a word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The first numbers of terms by which windows aren't looked up, and of markers.
OTHER, MARKER = 1 << 60, 1 << 61


def tokens(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN, -1), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(window, len, words of each different window of `items` (item_id, text); window, item of each item that has it and an id)."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    rows = stored(rows.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("words")).distinct(), "item-windows")
    found = stored(rows.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), F.size("words").alias("len"), "words"), "windows")
    return found, stored(rows.where("item is not null").join(small(found), "words").select("window", "item"), "window-items")


def ranked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """window, len, terms (in the window's order), first and second (term, offset) of the windows whose words all occur in `docs`.

    first and second are the two rarest different terms, second is null where there is one only; word by word, with `words`."""
    known = stored(found.select(F.explode("words").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    counted = docs.select(F.explode(tokens(F.col("text"))).alias("word")).join(small(known), "word").groupBy("word", "term").agg(F.count("*").alias("uses"))
    used = stored(counted, "uses")
    slots = found.select("window", "len", F.posexplode("words").alias("offset", "word")).join(small(used), "word")
    by = slots.groupBy("window", "len").agg(F.array_sort(F.collect_list(F.struct("offset", "term", "word"))).alias("slots"), F.array_sort(F.collect_list(F.struct("uses", "term", "offset"))).alias("order"))
    by = by.where(F.size("slots") == F.col("len"))  # the others can't occur
    place = lambda x: F.when(x.isNotNull(), F.struct(x["term"].alias("term"), x["offset"].alias("offset")))
    rarest = F.get("order", F.lit(0))
    other = F.get(F.filter("order", lambda x: x["term"] != F.get("order", F.lit(0))["term"]), F.lit(0))
    return stored(by.select("window", "len", F.col("slots.term").alias("terms"), F.col("slots.word").alias("words"), place(rarest).alias("first"), place(other).alias("second")), "ranked")


def index(docs: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, plans): term, row, pos of the words of `plans`, and the plans with the terms' numbers in the index.

    Each row of `docs` has a marker besides, with pos its length, doc_id and text_hash. row names a row of `docs` in this table; it is
    written with its postings by one task, so it agrees whatever task is run again."""
    lookups = plans.select(F.explode(F.array("first.term", "second.term")).alias("term")).where("term is not null").distinct().withColumn("own", F.lit(0).cast("long"))
    words = plans.select(F.explode(F.arrays_zip("words", "terms")).alias("s")).select(F.col("s.words").alias("word"), F.col("s.terms").alias("term")).distinct()
    words = words.join(small(lookups), "term", "left").select("word", (F.col("term") + F.coalesce("own", F.lit(OTHER))).alias("term"))
    words = stored(words.unionByName(plans.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(MARKER).cast("long").alias("term"))), "vocabulary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("words"))
    rows = rows.select("row", "doc_id", "text_hash", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    own = lambda c: F.when(F.col("term") >= MARKER, F.col(c)).alias(c)
    rows = rows.join(small(words), "word").select("term", "row", "pos", own("doc_id"), own("text_hash"))
    numbers = plans.select("window", F.posexplode("words").alias("i", "word")).join(small(words), "word").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("i", "term")))["term"].alias("terms"))
    return stored(rows.sortWithinPartitions("term"), "postings"), stored(plans.drop("terms", "words").join(small(numbers), "window"), "plans")


def search(docs: DataFrame, items: DataFrame, width: int, slop: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, lengths, owners) of the windows of `items` in `docs`.

    found: row, window, start, len and near of each place where a window stands word by word (start is not null) or, with a
    slop, all its different words stand within its length plus slop, in any order (near). lengths: row, doc_id, text_hash and
    n_words of each row of `docs`. owners: window, item."""
    known, owners = windows(items, width)
    plans = ranked(docs, known)
    postings, plans = index(docs, plans)
    span = F.col("len") + (slop or 0)
    grain = 2 * (width + (slop or 0))  # no span on both sides of a place touches more than two cells
    cell = F.floor(F.col("pos") / grain)
    cells = F.explode(F.array_distinct(F.array(F.floor((F.col("at") - span + 1) / grain), F.floor((F.col("at") + span - 1) / grain)))).alias("cell")
    lists = postings.where(F.col("term") < OTHER).select("term", "row", "pos")
    at = lists.join(small(plans.select(F.col("first.term").alias("term"), "window")), "term").select("row", "window", F.col("pos").alias("at"))
    at = at.join(small(plans.select("window", "len", F.col("first.offset").alias("o1"), F.col("second.term").alias("t2"), (F.col("second.offset") - F.col("first.offset")).alias("gap"))), "window")
    alone = at.where("t2 is null").select("row", "window", "at")
    second = lists.join(small(plans.where("second is not null").select(F.col("second.term").alias("term")).distinct()), "term", "left_semi").select("row", F.col("term").alias("t2"), "pos", cell.alias("cell"))
    met = F.col("pos") - F.col("at")
    close = met == F.col("gap") if slop is None else F.abs(met) < span
    pairs = at.where("t2 is not null").select("*", cells).join(second, ["row", "t2", "cell"]).where(close)
    # A place by which a window is looked up; it has at most one row for each position of the second list in its span.
    places = stored(pairs.select("row", "window", "at").distinct().unionByName(alone), "places")
    # All other lists at once: what stands around a place of the window's own terms, at most two spans of positions.
    every = postings.where(F.col("term") < MARKER).select("row", "term", "pos")
    touched = stored(places.select("row").distinct(), "touched-rows")
    if (n := touched.count()) <= BROADCAST_ROWS:
        every = every.join(small(touched, n), "row", "left_semi")
    wanted = plans.select("window", "len", "terms", F.col("first.offset").alias("o1"))
    around = places.join(small(wanted.select("window", "len", F.array_distinct("terms").alias("own"))), "window").select("*", cells)
    seen = around.join(every.withColumn("cell", cell), ["row", "cell"]).where(F.array_contains("own", F.col("term")) & (F.abs(F.col("pos") - F.col("at")) < span))
    seen = seen.groupBy("row", "window", "at").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("seen")).join(small(wanted), "window")
    start = F.col("at") - F.col("o1")
    phrase = F.transform("terms", lambda t, i: F.struct((start + i).alias("pos"), t.alias("term")))
    whole = F.size(F.array_except(phrase, "seen")) == 0
    inside = lambda s: F.size(F.array_distinct(F.filter("seen", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + span))["term"]))
    near = F.exists("seen", lambda s: inside(s) == F.size(F.array_distinct("terms"))) if slop is not None else F.lit(False)
    found = seen.select("row", "window", F.when(whole, start).alias("start"), "len", near.alias("near")).where("start is not null or near")
    lengths = postings.where(F.col("term") >= MARKER).select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    return stored(found, "found"), lengths, owners


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, text_hash, start, len, item of each place in a row of `docs` where a window of an item with an id stands word by word."""
    found, lengths, owners = search(docs, items, width, None)
    return found.join(small(owners), "window").join(lengths, "row").select("doc_id", "text_hash", "start", "len", "item")


def proximity_matches(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, text_hash, item: rows in which all different words of a window of an item stand within its length plus slop words, in any order.

    Same rules as `contamination` for null and empty texts; a result for each row and item with an id."""
    found, lengths, owners = search(docs, items, width, slop)
    return found.where("near").select("row", "window").distinct().join(small(owners), "window").select("row", "item").distinct().join(lengths, "row").select("doc_id", "text_hash", "item")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int | None = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near and text_hash of each row of `docs` (doc_id, text).

    A window is `width` consecutive words of an item of `items` (item_id, text), or all of a shorter one. n_hit
    counts the row's words inside any occurrence of a window; n_near the items of a window whose different words
    all stand within its length plus `slop` words, in any order (0 without slop, which saves their search). A null or empty text has no words; an item of none has no
    window; an item without an id marks words but isn't listed. Rows equal in id and text get equal results. Other columns
    are ignored; without rows or items nothing is hit."""
    found, lengths, owners = search(docs, items, width, slop)
    hits = found.where("start is not null").select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hits = hits.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    has = found.groupBy("row", "window").agg(F.max(F.col("start").isNotNull()).alias("phrase"), F.max("near").alias("near"))
    has = has.join(small(owners), "window").groupBy("row", "item").agg(F.max("phrase").alias("phrase"), F.max("near").alias("near"))
    has = has.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("phrase"), F.col("item")))).alias("items"), F.count_if("near").alias("n_near"))
    none = F.array().cast("array<string>")
    rows = lengths.join(hits.join(has, "row", "full"), "row", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "n_near": F.coalesce("n_near", F.lit(0).cast("long"))})
    digest = F.sha2(F.array_join("items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near", "text_hash")


#: DuckDB's words for op1 on the parameters of the query, without text_hash.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t FROM s),
l AS (SELECT DISTINCT n FROM q),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n),
g AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM p),
h AS (SELECT g.r, g.i, g.n, q.item FROM g JOIN q ON g.t = q.t AND g.n = q.n),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
x AS MATERIALIZED (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
u AS (SELECT word, count(*) AS uses FROM x GROUP BY word),
v AS (SELECT t, n, ws, unnest(ws) AS word FROM (SELECT DISTINCT t, n, list_distinct(string_split(t, ' ')) AS ws FROM q)),
a AS (SELECT t, n, ws, arg_min(v.word, u.uses) AS rare FROM v JOIN u ON v.word = u.word GROUP BY t, n, ws HAVING count(*) = len(ws)),
o AS (SELECT x.r, x.i AS at, a.t, a.n + 5 AS span, a.ws FROM x JOIN a ON x.word = a.rare),
y AS MATERIALIZED (SELECT o.r, o.t, o.at, o.span, len(o.ws) AS k, x.i, x.word FROM o JOIN x ON x.r = o.r AND abs(x.i - o.at) < o.span AND list_contains(o.ws, x.word)),
z AS (SELECT DISTINCT r, t FROM (SELECT e.r, e.t, e.at, e.i FROM y e JOIN y f ON e.r = f.r AND e.t = f.t AND e.at = f.at AND f.i >= e.i AND f.i < e.i + e.span GROUP BY e.r, e.t, e.at, e.i, e.k HAVING count(DISTINCT f.word) = e.k)),
m AS (SELECT z.r, count(DISTINCT q.item) AS n_near FROM z JOIN q ON z.t = q.t GROUP BY z.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items, sha256(coalesce(k.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated, coalesce(m.n_near, 0) AS n_near
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN k ON d.r = k.r LEFT JOIN m ON d.r = m.r
"""
