"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides where a chunk ends, so that chunks realign
after lines that were put in or taken out. A chunk of several lines that also stands earlier in the
corpus (in a smaller doc_id, or further up) is removed, after its bytes were compared with those of its
first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.llm.common import materialize, mixed, text_batches
from ionloom.llm.units import unit_columns

#: A chunk ends after one line in DIVISOR, at its second line or later.
DIVISOR = 2


def chunks(text: str) -> list[tuple[bytes, int, int]]:
    """(bytes, lines, lines with words) of each chunk; the chunks joined by newlines are the text."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    out, start, before = [], 0, 0
    for i, line in enumerate(lines):
        h = xxhash.xxh64_intdigest(line)
        if i > start and ((before * 31 + h) * 0x9E3779B97F4A7C15 >> 32) % DIVISOR == 0:
            out.append((b"\n".join(lines[start : i + 1]), i + 1 - start, sum(1 for x in lines[start : i + 1] if x.strip())))
            start = i + 1
        before = h
    if start < len(lines):
        out.append((b"\n".join(lines[start:]), len(lines) - start, sum(1 for x in lines[start:] if x.strip())))
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(chunk)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(h >> 64), signed(h & ((1 << 64) - 1))


def looked_up(chunk: tuple[bytes, int, int]) -> bool:
    """A chunk of several lines with words; others stay wherever they stand."""
    return chunk[2] >= 2


COUNTS = ("n_lines", "n_chunks", "n_removed_lines")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; other columns are kept, whatever their names) with text cut and n_lines, n_chunks, n_removed_lines.

    A row whose text is null stays null with zeros; a text that is removed whole becomes empty. Documents without
    an id come last; rows that repeat a doc_id and its text are one document, rows that share an id but not the text are
    two (see units). Texts of any length are cut whole. Columns named like the three counts are replaced. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kept = [f for f in docs.schema.fields if f.name not in COUNTS]
    # the row travels as one value, so that no name of its columns meets one of ours
    whole = F.struct(*[F.col(f"`{f.name}`") for f in kept if f.name != "text"])
    rows, _, _ = unit_columns(docs, whole)
    texts = rows.select("k", "sub", "text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for k, sub, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for at, c in enumerate(chunks(text)):
                    if looked_up(c):
                        for column, v in zip(out, (*digest(c[0]), k, sub, at)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), *(pa.array(x, pa.int32()) for x in out[3:])], names=["h1", "h2", "k", "sub", "at"])

    found = materialize(texts.mapInArrow(keys, "h1 long, h2 long, k long, sub int, at int"))
    place = F.struct((F.col("sub") < 0).alias("none"), "k", "sub", "at")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f <> l").select("h1", "h2", "f")
    first = materialize(first)

    # The first stays hand out their bytes. Both joins of the texts take all of a row, so that Spark deals the rows to tasks once
    # for both.
    asked = first.groupBy("f.k", "f.sub").agg(F.collect_set("f.at").alias("ats"))

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for text, ats in zip(b.column("text").to_pylist(), b.column("ats").to_pylist()):
                cut = chunks(text)
                for at in ats:
                    for column, v in zip(out, (*digest(cut[at][0]), cut[at][0])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["h1", "h2", "first_bytes"])

    handed = rows.join(asked, ["k", "sub"]).mapInArrow(hand_out, "h1 long, h2 long, first_bytes binary")
    handed = handed.groupBy("h1", "h2").agg(F.min("first_bytes").alias("first_bytes"))
    low = first.select(mixed(F.col("h1")).alias("x"), "h2", "f")
    later = found.withColumn("x", mixed(F.col("h1"))).join(low, ["x", "h2"]).filter(place != F.col("f")).select("h1", "h2", "k", "sub", "at")
    later = later.withColumn("x", mixed(F.col("h1"))).join(handed.select(mixed(F.col("h1")).alias("x"), "h2", "first_bytes"), ["x", "h2"])
    # a document is told the bytes of a chunk once
    verdicts = later.groupBy("k", "sub").agg(F.collect_set(F.struct("at", "first_bytes")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str | None] = []
            n: list[list[int]] = [[], [], []]
            held = b.column("held")
            for text, has, cuts in zip(b.column("text").to_pylist(), held.field("has").to_pylist(), b.column("cuts").to_pylist()):
                text = text if has else None
                parts = chunks(text) if text is not None else []
                same = {(c["at"], c["first_bytes"]) for c in cuts or []}
                keep = [c for k, c in enumerate(parts) if (k, c[0]) not in same]
                texts.append(None if text is None else b"\n".join(c[0] for c in keep).decode("utf-8", "surrogatepass"))
                lines = sum(c[1] for c in parts)
                for column, v in zip(n, (lines, len(parts), lines - sum(c[1] for c in keep))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([held.field("row"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in n)], names=["row", "cut", *COUNTS])

    schema = T.StructType([T.StructField("row", T.StructType([f for f in kept if f.name != "text"])), T.StructField("cut", T.StringType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])
    out = rows.join(verdicts, ["k", "sub"], "left").mapInArrow(cut, schema)
    return out.select(*[F.col("cut").alias("text") if f.name == "text" else F.col("row").getField(f.name).alias(f.name) for f in kept], *COUNTS)


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed_lines and kept_sha256 (of the kept text's bytes) of every row; see dedup_lines."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
