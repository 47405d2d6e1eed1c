"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. ORACLE_SQL is None: the scores of a fitted model and the
components of fingerprints can't be said in SQL, so tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, decontamination, mixing, sharding, simhash, toxicity

ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id and text aren't those of a row of `gone` (doc_id, text_hash). Up to 200 000 of `gone` no text is shuffled."""
    one, two = common.fresh(docs, "gone_id"), common.fresh(docs, "gone_hash")
    key = common.small(common.stored(gone.select(F.col("doc_id").alias(one), F.col("text_hash").alias(two)).distinct(), "gone"))
    return docs.join(key, F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(two)), "left_anti")


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't call toxic, learnt from labels outside its held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.sample(docs, labels.where(~toxicity.held_out(F.col("doc_id")))))
    return docs.where(toxicity.scorer(model)("text") < 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id, of those that share it that with the least text hash."""
    found = common.stored(simhash.near_duplicates(docs), "groups")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.where(~named).select("doc_id", "text_hash")
    # Ids may repeat: of several rows that name their group one stays.
    several = common.stored(found.where(named).groupBy("group").agg(F.min("text_hash").alias("stays"), F.count("*").alias("rows")).where("rows > 1"), "several")
    if several.isEmpty():
        return _without(docs, gone)
    others = found.where(named).join(several, "group").where("text_hash <> stays").select("doc_id", "text_hash")
    name = common.fresh(docs, "text_hash")
    marked = _without(docs, gone.unionByName(others)).withColumn(name, F.xxhash64("text"))
    return marked.dropDuplicates(["doc_id", name]).drop(name)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=None)
    return _without(docs, found.where("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, whole; those without a word once. Rows equal in id, source and size alike."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    names = [common.fresh(docs, x) for x in ("mix_id", "mix_source", "mix_size", "mix_times", "mix_nth")]
    taken = mixing.mix(docs, whole=True).groupBy(*[F.col(x).alias(n) for x, n in zip(("doc_id", "source", "size"), names, strict=False)]).agg(F.max(times).alias(names[3]))
    taken = common.small(common.stored(taken.where(F.col(names[3]) != 1), "mix-times"))
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col("source").eqNullSafe(F.col(names[1])) & (common.word_count(F.col("text")) == F.col(names[2]))
    rows = docs.join(taken, same, "left").withColumn(names[3], F.coalesce(names[3], F.lit(1)))
    rows = rows.where(F.col(names[3]) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(names[3]))).alias(names[4]))
    return rows.select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix."""
    return sharding.shard(docs)


STAGES = [("toxicity", clean_of_toxic), ("near-duplicates", one_of_each_group), ("decontamination", clean_of_benchmarks), ("mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
