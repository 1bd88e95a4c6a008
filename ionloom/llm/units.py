"""Documents as distinct texts with an id, in one order, whatever ids are null or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_columns(docs: DataFrame, row: Column | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(texts, rows, repeated) of docs (doc_id, text): k long, sub int, text of every row; these with doc_id and digest
    besides; whether a document may stand in several rows.

    (k, sub) names a document. k is the doc_id and sub 0, or where some doc_id has several texts, 31 bits of
    the text's hash; without a doc_id k is a hash of the text and sub negative, so that such documents are no
    hot key. Documents stand in the order of (sub < 0, k, sub). Rows that repeat a doc_id and its text are one.
    row: a value of each row that texts then have as held.row, with held.has: whether the text is not null.
    """
    i = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    base = docs.select(i.alias("doc_id"), text.alias("text"))
    by_id = base.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("n"))
    several, repeated = by_id.agg(F.max(F.col("doc_id").isNotNull() & (F.col("a") != F.col("b"))), F.max(F.col("n") > 1)).first()
    sub = bits if several else F.lit(0)
    k = F.coalesce(i, F.xxhash64(text, F.lit(1)))
    sub = F.when(i.isNull(), -1 - bits).otherwise(sub).cast("int")
    rows = docs.select(i.alias("doc_id"), k.alias("k"), sub.alias("sub"), text.alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    held = [] if row is None else [F.struct(row.alias("row"), F.col("text").isNotNull().alias("has")).alias("held")]
    return docs.select(k.alias("k"), sub.alias("sub"), text.alias("text"), *held), rows, bool(repeated)
