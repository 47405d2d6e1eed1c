"""Queries over records, DataFrames and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import sluice
from sluice.streaming import is_native, start, start_node

DATA = "/root/testdata/sf0.001"


def test_transform_match_stream(spark):
    query = sluice.compile("source | mv-expand v = V | where v > 1 | project v")
    assert query.transform({"V": [1, 2, 3]}) == [{"v": 2}, {"v": 3}]
    assert query.match({"V": [1]}) is None and query.match({"V": [2]}) == {"v": 2}
    with pytest.raises(sluice.KqlEvalError):
        query.match({"V": [2, 3]})
    records = [{"V": [1, 2]}, {"V": []}, {"V": [5]}]
    assert list(query.stream(iter(records))) == list(query.stream(records, batch=2)) == [{"v": 2}, {"v": 5}]


def test_node(spark):
    node = sluice.Node()
    node.add("a", "source | where x > 1")
    node.add("b", "source | project y = x")
    assert list(node.push({"x": 2})) == [("a", {"x": 2}), ("b", {"y": 2})]
    node.add("a", "source | where x > 5")
    node.remove("none")
    assert list(node.push({"x": 2})) == [("b", {"y": 2})]


QUERIES = [
    "source | summarize n = count(), m = max(x)", "source | mv-expand v = V | sort by v desc | take 2 | project x, v", "source | mv-expand v = V | join kind=inner (source | project x) on v == x | project v, x",
    "source | mv-expand v = V | partition by v (count)", "source | mv-expand v = V | distinct v", "source | mv-apply v = V on (summarize s = sum(v))", "source | union (source | where x > 2)",
]


@pytest.mark.parametrize("query", QUERIES)
def test_a_batch_is_its_records(spark, query):
    """Record scope over a batch gives the rows of each record."""
    records = [{"x": i, "V": [i, i + 1, 2, 2][: i % 5]} for i in range(1, 7)]
    compiled = sluice.compile(query)
    assert compiled.transform_many(records) == [row for r in records for row in compiled.transform(r)]


@pytest.mark.parametrize("query", ["source | summarize n = count(), m = max(value) by event_type", "source | sort by value desc | take 3 | project event_id", "source | distinct event_type | count"])
def test_table_scope_of_one_record_is_record_scope(spark, query):
    one = spark.read.parquet(f"{DATA}/events.parquet").limit(1).cache()
    compiled = sluice.compile(query)
    assert compiled.apply(one, "table").collect() == compiled.apply(one, "record").collect()


def test_plans(spark):
    """Filters and columns reach the scan, a row query has no exchange, and top n within a key is limited early."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    events = spark.read.parquet(f"{DATA}/events.parquet")
    rows = plan(sluice.compile("source | where event_type == 'purchase' and value > 50 | extend b = iff(value > 200, 'h', 'l') | project event_id, b").apply(events, "table"))
    assert "Exchange" not in rows and "GreaterThan(value,50.0)" in rows.split("PushedFilters")[1] and "props" not in rows.split("ReadSchema")[1]
    assert "WindowGroupLimit" in plan(sluice.compile("source | partition by event_type (top 3 by value)").apply(events, "table"))
    assert "TakeOrderedAndProject" in plan(sluice.compile("source | top 3 by value").apply(events, "table"))
    numbers = spark.range(5).select("id", F.array(F.lit(1), F.lit(2)).alias("v"))
    folded = plan(sluice.compile("source | mv-apply x = v on (summarize s = sum(x), n = count())").apply(numbers))
    assert "Generate" not in folded and "Exchange" not in folded
    assert "BroadcastHashJoin" in plan(sluice.compile("let T = datatable(event_type:string, n:long)['purchase', 1]; source | lookup T on event_type").apply(events, "table"))


def test_expansions_that_are_folds(spark):
    """Aggregates and the top of a row's own elements are had without a shuffle, and equal those of the general way."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    frame = spark.createDataFrame([(1, "b a b cc", 5), (2, "", 6), (3, None, 7), (4, "x yyy zz yyy", 8), (5, "é éé 😀", None)], "id long, text string, n long")
    for query, general in (
        ("source | where n != 7 | mv-expand w = split(text, ' ') | summarize c = count(), d = dcount(w), l = max(strlen(w)), s = sum(n), o = countif(strlen(w) > n - 4) by id, n", "source | where n != 7 | mv-expand w = split(text, ' ') | extend z = 1 | summarize c = count(), d = dcount(w), l = max(strlen(w)), s = sum(n), o = countif(strlen(w) > n - 4) by id, n"),
        ("source | project id, ws = split(text, ' ') | mv-apply w = ws on (extend l = strlen(w), k = toupper(w) | top 2 by l, k asc | project w, l)", "source | project id, ws = split(text, ' ') | mv-apply w = ws on (extend l = strlen(w), k = toupper(w) | where true | top 2 by l, k asc | project w, l)"),
        ("source | project id, ws = split(text, ' ') | mv-apply w = ws on (top 3 by w asc)", "source | project id, ws = split(text, ' ') | mv-apply w = ws on (where true | top 3 by w asc)"),
    ):
        fast, slow = (sluice.compile(q).apply(frame, record_key="id") for q in (query, general))
        assert "Exchange" not in plan(fast) and "Exchange" in plan(slow) and fast.columns == slow.columns
        assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))
    rows = sluice.compile("source | mv-apply w = split(text, ' ') on (extend l = strlen(w) | top 2 by l, w asc | project w)").transform({"text": "a ccc b ddd"})
    assert [r["w"] for r in rows] == ["ccc", "ddd"]


def test_record_scope_joins_of_tables_broadcast_nothing(spark):
    """Matching rows of a table in record scope are found by a join of keys; no table is broadcast by hint but a constant one."""
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    plan = lambda df: df._jdf.queryExecution().toString()
    joined = lambda kind: sluice.compile(f"source | join kind={kind} lineitem on o_orderkey == l_orderkey", tables={"lineitem": read("lineitem")}).apply(read("orders"), record_key="o_orderkey")
    semi = joined("rightsemi")
    assert "Cross" not in plan(semi) and "strategy=broadcast" not in plan(semi)
    assert semi.count() == read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").count()
    assert "strategy=broadcast" not in plan(joined("rightouter"))


def test_bags_of_many_keys(spark, monkeypatch):
    from sluice.operators import rows as operators

    monkeypatch.setattr(operators, "KEYS", 3)
    frame = spark.range(5).select(F.concat(F.lit('{"k'), F.col("id").cast("string"), F.lit('": 1}')).alias("b"))
    with pytest.raises(sluice.KqlEvalError):
        sluice.compile("source | extend p = parse_json(b) | evaluate bag_unpack(p)").apply(frame, "table")


def test_samples(spark):
    """Of the right size, rows of the input, different ones, the same for a seed, not the same for another."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id")
    drawn = lambda seed: [r.event_id for r in sluice.compile("source | sample 40", options=sluice.Options(random_seed=seed)).apply(events, "table").collect()]
    one, same, other, free = drawn(1), drawn(1), drawn(2), drawn(None)
    ids = {r.event_id for r in events.collect()}
    assert all(len(x) == len(set(x)) == 40 and set(x) <= ids for x in (one, other, free)) and sorted(one) == sorted(same) and set(one) != set(other)
    assert abs(sum(one) / 40 - sum(ids) / len(ids)) < 0.3 * max(ids)


def test_input_read_twice_without_a_key(spark):
    query = sluice.compile("source | where value > 90 | as A | union A | summarize n = count() by event_id")
    got = query.apply(spark.read.parquet(f"{DATA}/events.parquet").repartition(3))
    assert {r.n for r in got.collect()} == {2}


def test_tables_by_name(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    query = sluice.compile("source | join kind=inner region on n_regionkey == r_regionkey | summarize n = count() by r_name", tables={"region": read("region")})
    assert sum(r.n for r in query.apply(read("nation"), "table").collect()) == 25


def written(spark, path):
    return spark.read.parquet(str(path)).collect()


@pytest.mark.parametrize("query, native", [("source | where value > 50 | project event_id, v = round(value, 1)", True), ("source | summarize n = count() by event_id, event_type", False), ("source | as A | union A | project event_id", False)])
def test_streams_equal_batches(spark, tmp_path, query, native):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    compiled = sluice.compile(query)
    assert is_native(compiled) == native
    run = start(compiled, stream, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}")), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("n" if "summarize" not in query else "none")
    wanted = compiled.apply(events, record_key="event_id")
    columns = [c for c in wanted.columns if c != "n"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))


def test_stateful_queries_are_refused_on_a_plain_stream(spark, tmp_path):
    stream = spark.readStream.schema("a long").parquet(str(tmp_path))
    with pytest.raises(sluice.KqlUnsupportedError):
        sluice.compile("source | summarize count()").apply(stream)
    with pytest.raises(sluice.KqlUnsupportedError):
        sluice.compile("source").apply(stream, "table")


def test_node_over_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parque*")
    node = sluice.Node()
    node.add("many", "source | where value > 90 | project event_id")
    node.add("kinds", "source | summarize n = count() by event_type")
    seen: dict[str, int] = {}
    writers = {name: (lambda df, n, name=name: seen.__setitem__(name, seen.get(name, 0) + df.count())) for name in node.queries}
    start_node(node, stream, writers, str(tmp_path / "c"), record_key="event_id").awaitTermination()
    assert seen == {"many": events.where("value > 90").count(), "kinds": events.count()}
