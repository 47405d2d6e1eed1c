"""The stages against brute force, on a small folder of tables with copies, benchmark passages, nulls and repeated rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import mixing, queries, toxicity

from .test_operators import SCHEMA, WORDS, components, contaminated, fingerprint, rows

BAD = ["vilest", "grubworm", "scoundrel"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    docs = [(1000 + r[0] if r[0] is not None else None, *r[1:]) for r in rows(80, 3)]
    labels = []
    for i in range(200):
        words = rng.choices(WORDS, k=50)
        if i % 5 == 0:
            words[3:3] = rng.choices(BAD, k=4)
        docs.append((i, " ".join(words), "en", rng.choice(["a", "b", "c"]), 1))
        labels.append((i, 1, int(i % 5 == 0)))
    items = [(1, docs[4][1]), (2, " ".join(docs[5][1].split()[3:15])), (3, None)]
    docs.append((500, "x y " + (docs[4][1] or ""), "en", "a", 1))
    spark.createDataFrame(docs, SCHEMA).withColumns({x: F.lit(1) for x in ("__extra", "gone_id", "GONE_HASH", "text_hash", "mix_id", "mix_times", "mix_nth", "mix_size", "__id", "__part", "copy")}).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, items


def plain(frame):
    return sorted(map(str, frame.collect()))


def test_stages(spark, folder):
    where, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-duplicates", "decontamination", "mixing", "sharding"]

    kept = stages["toxicity"](spark, docs, where).cache()
    labels = spark.read.parquet(f"{where}/labels.parquet")
    score = {(r.doc_id, r.text): r.score for r in docs.join(toxicity.toxicity(docs, labels), "doc_id").select("doc_id", "text", "score").collect()}
    assert kept.columns == docs.columns
    assert plain(kept) == sorted(str(r) for r in docs.collect() if score.get((r.doc_id, r.text), 0) < 0.5)
    assert not [r for r in kept.collect() if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 5 == 0]

    one = stages["near-duplicates"](spark, kept, where).cache()
    before = kept.collect()
    prints = [fingerprint(r.text) for r in before]
    names = components([r.doc_id for r in before], prints)
    got = one.collect()
    assert one.columns == docs.columns
    assert sorted(str(names[(r.doc_id, fingerprint(r.text))]) for r in got) == sorted(map(str, set(names.values())))
    assert all(names[(r.doc_id, fingerprint(r.text))] == r.doc_id for r in got)

    clean = stages["decontamination"](spark, one, where).cache()
    assert plain(clean) == sorted(str(r) for r in got if not contaminated(r.text, items)[-1])
    assert clean.count() < one.count()

    mix = stages["mixing"](spark, clean, where).cache()
    taken = {(r.doc_id, r.source): (r.taken, r["size"]) for r in mixing.mix(clean, whole=True).collect()}
    times: dict = {}
    for r in mix.collect():
        times[(r.doc_id, r.source)] = times.get((r.doc_id, r.source), 0) + 1
    assert all(times.get(k, 0) == (t // s if s else 1) for k, (t, s) in taken.items()) and mix.columns == docs.columns

    shards = stages["sharding"](spark, mix, where)
    counts = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert sum(counts) == mix.count() and max(counts) - min(counts) <= 1


def test_run_and_empty_tables(spark, folder, tmp_path):
    where, _ = folder
    assert corpus_pipeline.run(spark, where).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 1), (1, "a b c d e", "en", "s", 1), (1, "A b c d e", "en", "s", 1), (2, "a b c d e", "en", "s", 1), (1, "quite another text of its own", "en", "s", 1), (None, "a b c d e", "en", "s", 1)], SCHEMA)
    got = corpus_pipeline.one_of_each_group(spark, docs, folder[0]).collect()
    assert [r.doc_id for r in got] == [1, 1] and len({r.text.lower() for r in got}) == 2


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert corpus_pipeline.ORACLE_SQL is None
