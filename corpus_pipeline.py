"""A corpus pipeline over `documents`: classify quality, dedup lines, drop near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which run() writes as
Parquet in the shared folder and reads again. All stages but the last return the columns of documents.

A stage's own tables go when the next stage begins, but for those that its docs still read: write what a stage
returns, or hand it on, before another begins on something else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.llm import bpe, lines, mixing, quality, simhash
from ionloom.llm.common import discard, materialize, release, scratch
from ionloom.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: sets of five-word shingles with a Jaccard similarity of SIMILARITY. Such texts differ in 10 of 64
#: bits in the mean, so that is the radius for one of three fingerprints; a second one, within RADIUS2, keeps the
#: candidates few. What the fingerprints find is then held against the shingles themselves.
WORDS, RADIUS, RADIUS2 = 5, 10, 14
SIMILARITY = 0.8


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[DataFrame] = []


def staged(stage: Stage) -> Stage:
    """stage, of whose predecessors' tables those are deleted that docs does not read."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = {part for f in docs.inputFiles() for part in f.split("/")[-2:-1]}
            spent = [t for t in _left if t._ionloom_path.rsplit("/", 1)[1] not in read]
            for t in spent:
                if t.sparkSession.sparkContext is spark.sparkContext:
                    discard(t)
                _left.remove(t)
            release(spark)
        with scratch() as tables:
            out = stage(spark, docs, sf_dir)
        _left.extend(tables)
        return out

    return run_stage


def numbered(docs: DataFrame) -> DataFrame:
    """docs, written, with a number `row` of each row's own: doc_id may be null or repeated."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))


@staged
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rows = numbered(docs)
    judged = quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row",)).filter("kept").select("row")
    return rows.join(judged, "row", "left_semi").select(COLUMNS)


@staged
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand earlier go, and documents of which no word is left."""
    out = lines.dedup_lines(docs.select(COLUMNS)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


@staged
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest doc_id) of each group of near copies stays."""
    rows = numbered(docs)
    groups = simhash.similar_documents(rows.select(F.col("row").alias("doc_id"), "text"), WORDS, RADIUS, RADIUS2, SIMILARITY).withColumnRenamed("doc_id", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


@staged
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents are drawn to the sources' targets: each comes as often as it was drawn, up to three times, in its shards' order."""
    _, draws = mixing.mix(docs, block_words=None)
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    same = F.md5(F.to_json(F.struct("doc_id", "source", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("text"))).cast("binary"))
    rows = docs.select(*COLUMNS, same.alias("same"))
    # rows that share an id, source and size are told apart by a running number, as mix() does; equal rows are one group
    groups = rows.select("doc_id", src.alias("src"), mixing.n_words(F.col("text")).alias("size"), "same").groupBy("doc_id", "src", "size", "same").count()
    upto = F.sum("count").over(Window.partitionBy("doc_id", "src", "size").orderBy("same"))
    copies = materialize(groups.withColumn("upto", upto).withColumn("copy", F.explode(F.sequence(F.col("upto") - F.col("count") + 1, F.col("upto")))))
    if copies.agg(F.max("count")).first()[0] not in (None, 1):
        rows = rows.dropDuplicates(["same"])
    key = F.struct("src", "doc_id", "copy", "size").cast("string").alias("k")  # has no nulls
    drawn = draws.select(key, "shard", "position").join(copies.select(key, "same"), "k").select("same", "shard", "position")
    return mixing.shuffled(rows.join(drawn, "same")).select(COLUMNS)


@staged
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can't express the learned classifier and the encoder, hence not run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            discard(before)
    return docs
